"""Toxicity by weak supervision: voters, a label model with correlations, and a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut, in_workers, text_or_empty

# How many labelled rows are learnt from at most unless told otherwise: those with the lowest seeded hashes of their ids.
MOST_LABELLED = 8_000
FOLDS = 5
# Terms are whole words (=word) and beginnings of words (^begi). So many strong and weak ones are kept.
STRONG_TERMS, WEAK_TERMS = 240, 240
SHORTEST_START, LONGEST_START = 3, 8
LEXICONS = 12
PATTERNS = ("shouting", "exclamations", "one word over and over")
VOTERS = LEXICONS + len(PATTERNS) + 1
ROWS_AT_ONCE = 256
MAX_KNOWN = 200_000
TOKEN = re.compile(r"\w+")


def word_terms(word: str) -> list[str]:
    """The terms a lower-case word stands for."""
    starts = ["^" + word[:size] for size in range(SHORTEST_START, min(LONGEST_START, len(word)) + 1)]
    return ["=" + word, *starts]


def text_terms(text: str) -> set[str]:
    found: set[str] = set()
    for word in set(TOKEN.findall(text.lower())):
        found.update(word_terms(word))
    return found


def find_terms(texts: list[str], toxic: list[int]) -> tuple[list[str], list[str]]:
    """Strong terms (nearly only in toxic texts) and weak ones (more often there), best first.

    A term is scored by a lower bound of its log odds. Of terms that stand in the same toxic texts only one is kept.
    """
    n_toxic, n_clean = sum(toxic), len(toxic) - sum(toxic)
    if not n_toxic or not n_clean:
        return [], []
    where: dict[str, list[int]] = {}
    for at, (text, label) in enumerate(zip(texts, toxic, strict=True)):
        if label:
            for term in text_terms(text):
                where.setdefault(term, []).append(at)
    where = {term: rows for term, rows in where.items() if len(rows) >= 3}
    clean: Counter[str] = Counter()
    for text, label in zip(texts, toxic, strict=True):
        if not label:
            clean.update(term for term in text_terms(text) if term in where)

    def score(term: str) -> float:
        a, b = len(where[term]), clean[term]
        odds = math.log((a + 0.5) / (n_toxic - a + 0.5)) - math.log((b + 0.5) / (n_clean - b + 0.5))
        return odds - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) * 0.5

    ranked, seen = [], set()
    for term in sorted(where, key=lambda term: (-score(term), len(term), term)):
        rows = tuple(where[term])
        if rows not in seen:
            seen.add(rows)
            ranked.append(term)
    precise = [t for t in ranked if len(where[t]) / n_toxic >= 20 * (clean[t] + 0.5) / n_clean]
    strong = precise[:STRONG_TERMS]
    taken = set(strong)
    weak = [t for t in ranked if t not in taken and score(t) > 0.5][:WEAK_TERMS]
    return strong, weak


@dataclass(frozen=True)
class LabelModel:
    """Share of toxic texts, how often each voter fires on toxic and on clean texts, and the voters' weights."""

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    correlation: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being toxic for rows of votes (1: the voter fires)."""
        fires = np.log(self.on_toxic / self.on_clean) * self.weight
        rests = np.log((1 - self.on_toxic) / (1 - self.on_clean)) * self.weight
        odds = math.log(self.prior / (1 - self.prior)) + votes @ fires + (1 - votes) @ rests
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation-maximisation on vote patterns and how many texts have each.

    The first guess is that a text is toxic if a lexicon fires. Rates come from the posteriors, and so does, within each
    class, the correlation of every two voters. Voters that repeat each other share their weight: a voter's
    log odds are divided by one plus its positive correlations with the others, so that a block of
    dependent voters counts about as one.
    """
    counts = counts.astype(np.float64)
    q = np.where(votes[:, :LEXICONS].any(axis=1), 0.9, 0.02)
    weight = np.ones(votes.shape[1])
    for _ in range(rounds):
        toxic, clean = q * counts, (1 - q) * counts
        # One made-up text in a hundred keeps the rates inside.
        on_toxic = (toxic @ votes + 0.5) / (toxic.sum() + 1)
        on_clean = (clean @ votes + 0.5) / (clean.sum() + 1)
        # A voter never turns round.
        lexical, last = slice(0, VOTERS - 1), VOTERS - 1
        on_toxic[lexical] = np.maximum(on_toxic[lexical], on_clean[lexical])
        on_toxic[last] = min(on_toxic[last], on_clean[last])
        corr = np.zeros((votes.shape[1],) * 2)
        for mass, rate in ((toxic, on_toxic), (clean, on_clean)):
            centred = (votes - rate) * np.sqrt(mass)[:, None]
            cov = centred.T @ centred / max(mass.sum(), 1)
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr += cov / np.outer(spread, spread) * mass.sum() / max(counts.sum(), 1)
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.maximum(corr, 0).sum(axis=1))
        prior = (toxic.sum() + 0.5) / (counts.sum() + 1)
        model = LabelModel(prior, on_toxic, on_clean, corr, weight)
        q = model.posterior(votes)
    return model


def fit_linear(features: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on labels between 0 and 1 by Newton's method; the intercept is not shrunk."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + shrink * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


class TermFinder:
    """Which of the terms a text has, and how the voters vote on it."""

    def __init__(self, strong: list[str], weak: list[str]):
        self.number = {term: at for at, term in enumerate([*strong, *weak])}
        self.n_strong = len(strong)
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MAX_KNOWN:
                self.known.clear()
            found = tuple(self.number[term] for term in word_terms(word) if term in self.number)
            self.known[word] = found
        return found

    def terms(self, text: str) -> tuple[list[int], int]:
        """The numbers of the terms in the text, sorted, and the votes as bits."""
        words = TOKEN.findall(text.lower())
        found: set[int] = set()
        for word in set(words):
            if hit := self._of(word):
                found.update(hit)
        votes = 0
        for at in found:
            if at < self.n_strong:
                votes |= 1 << (at % LEXICONS)
        size = max(len(words), 1)
        capitals = sum(map(str.isupper, text)) / max(1, len(text))
        often = Counter(words).most_common(1)[0][1] / size if words else 0
        patterns = (capitals > 0.5, text.count("!") / size > 0.2, often > 0.3)
        for at, fires in enumerate(patterns):
            votes |= int(fires) << (LEXICONS + at)
        votes |= int(not found) << (VOTERS - 1)
        return sorted(found), votes


def _bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(VOTERS)) & 1


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    most_labelled: int = MOST_LABELLED,
) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row.

    1. From at most ``most_labelled`` labelled rows outside the held-out fold, terms are found that mark toxic texts. They are
       dealt to lexicon voters; pattern voters and one voter for clean texts join them.
    2. All voters vote on every whole text. The votes are counted by pattern (at most ``2 ** 16``), and the label
       model learns from these counts, without labels, how far each voter is to be trusted and which repeat each other.
    3. The label model's posteriors of the rows of step 1 train a linear classifier on their terms, which
       then scores all rows. Ids, languages and sources are no inputs.

    Held out is a row whose ``crc32`` of the id as text is divisible by five; its label is never read. A null text
    is as an empty one and gets a score like any. Labels that are null, or whose id is, are ignored; without labels of both
    kinds all rows get the same score. Repeated rows are scored alike; an empty table gives an empty result.
    Other columns are left out.
    """
    spark = docs.sparkSession
    in_workers(spark)
    rows = docs.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))

    def fold(name: str):
        return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(FOLDS))

    chosen = labels.select(F.col("doc_id").alias("_label_id"), F.col("toxic").cast("int").alias("_toxic"))
    chosen = chosen.where(F.col("_toxic").isNotNull() & F.col("_label_id").isNotNull() & (fold("_label_id") != 0))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "_label_id"), "_label_id", "_toxic").limit(most_labelled)
    sample = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).select("_id", "_text", "_toxic").collect()
    sample = sorted(((row["_text"], row["_toxic"]) for row in sample))
    texts, toxic = [text for text, _ in sample], [int(label > 0) for _, label in sample]
    strong, weak = find_terms(texts, toxic)
    found = spark.sparkContext.broadcast((strong, weak))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = TermFinder(*found.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                results = [finder.terms(text) for text in part.column(1).to_pylist()]
                terms = pa.array([terms for terms, _ in results], pa.list_(pa.int32()))
                votes = pa.array([votes for _, votes in results], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), terms, votes], names=["_id", "_terms", "_votes"])

    schema = T.StructType(
        [
            rows.schema["_id"],
            T.StructField("_terms", T.ArrayType(T.IntegerType())),
            T.StructField("_votes", T.IntegerType()),
        ]
    )
    voted = cut(rows.mapInArrow(vote, schema))
    patterns = sorted(map(tuple, voted.groupBy("_votes").count().collect()))
    n_terms = len(strong) + len(weak)
    coefficients, bias = np.zeros(max(n_terms, 1)), math.log(0.02 / 0.98)
    if n_terms and patterns:
        votes, counts = np.array(patterns, dtype=np.int64).T
        model = fit_label_model(_bits(votes).astype(np.float64), counts)
        finder = TermFinder(strong, weak)
        results = [finder.terms(text) for text in texts]
        features = np.zeros((len(texts), n_terms))
        for row, (terms, _) in enumerate(results):
            features[row, terms] = 1
        target = model.posterior(_bits(np.array([v for _, v in results], dtype=np.int64)).astype(np.float64))
        coefficients, bias = fit_linear(features, target)

    weights = F.array(*(F.lit(float(round(w, 9))) for w in coefficients))
    total = F.aggregate("_terms", F.lit(float(round(bias, 9))), lambda sum_, term: sum_ + F.get(weights, term))
    score = 1 / (1 + F.exp(-total))
    return voted.select(
        F.col("_id").alias(id_col),
        (fold("_id") == 0).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )
