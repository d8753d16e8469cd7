"""Quality rules as weak supervision: rules vote or abstain, and a label model weighs the votes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, packed, plain_blanks, unpacked, words_of

SYMBOLS = "[#*$%&|<>]"
FINISHED = "[.!?\"'):;]\\s*$"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# What the label model takes as given about every rule: it calls at most this share of good texts bad. Without
# it, one of several kinds of bad text could pass for good texts that break a rule.
FALSE_ALARMS = 0.005


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good) up to ``good``, -1 (bad) from ``bad`` on, and abstains between."""

    name: str
    good: float
    bad: float


# Rates that grow as a text gets worse. Measures that rise together share a rule, as the label model takes the
# rules' mistakes for independent.
RULES = (
    Rule("symbol_rate", 0.01, 0.1),
    Rule("repetition_rate", 0.15, 0.35),
    Rule("shouting_rate", 0.1, 0.35),
    # Clean text of some languages and kinds has long words and no stops: these speak for a text, hardly against it.
    Rule("odd_word_length", 2.0, 20.0),
    Rule("unfinished_line_rate", 0.25, 2.0),
)


def base_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows with the counts that the rules need, all from expressions on the row; nothing is shuffled.

    A text's three-word windows are hashed; only where a hash repeats are they sorted, within the row, to
    find the words in repeated windows.
    """
    text, plain = F.col("_text"), F.col("_plain")
    df = packed(docs, id_col, text_col).select("*", plain_blanks(text).alias("_plain"))
    has_word = lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0
    finished = lambda line: F.rlike(line, F.lit(FINISHED))
    df = df.select(
        "*",
        F.transform(words_of(plain), lambda word: F.xxhash64(word)).alias("_words"),
        F.filter(F.split(text, "\n"), has_word).alias("_lines"),
        (F.length(text) - F.length(F.replace(plain, F.lit(" "), F.lit("")))).alias("_blanks"),
    ).drop("_plain")
    window = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3),
        lambda at: F.xxhash64(F.get("_words", at), F.get("_words", at + 1), F.get("_words", at + 2)),
    )
    none = F.array().cast("array<bigint>")
    df = df.select(
        "_id",
        "_text",
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        (F.length(text) - F.col("_blanks")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.filter("_lines", finished))).cast("long").alias("_unfinished"),
        F.when(F.size("_words") >= 3, window).otherwise(none).alias("_windows"),
    )
    windows = F.col("_windows")
    placed = F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    df = df.select("*", placed.alias("_placed")).drop("_windows")
    h_at = lambda at: F.get(F.col("_placed"), at).getField("h")
    repeated = F.filter(
        F.col("_placed"),
        lambda item, at: F.coalesce(item.getField("h") == h_at(at - 1), F.lit(False))
        | F.coalesce(item.getField("h") == h_at(at + 1), F.lit(False)),
    )
    covered = F.flatten(
        F.transform(repeated, lambda item: F.sequence(item.getField("at"), item.getField("at") + 2))
    )
    return df.select(
        "*",
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("_capitals"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("_exclamations"),
    ).drop("_placed")


def _rates() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("_n_lines"), F.lit(1))
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "repetition_rate": F.greatest(F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words),
        "shouting_rate": F.greatest(
            F.col("_capitals") / F.greatest(F.col("word_chars"), F.lit(1)), F.col("_exclamations") / words
        ),
        "odd_word_length": F.abs(F.col("word_chars") / words - 5.5),
        "unfinished_line_rate": F.col("_unfinished") / lines,
    }


def vote_columns() -> list[Column]:
    """One column per rule: 1, -1 or 0 for an abstention."""
    rates = _rates()
    return [
        F.when(rates[rule.name] >= rule.bad, -1).when(rates[rule.name] <= rule.good, 1).otherwise(0).alias(f"_v{at}")
        for at, rule in enumerate(RULES)
    ]


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts, and for each rule how often a good and a bad text get the vote 1 when it votes."""

    prior: float
    good_given_good: tuple[float, ...]
    good_given_bad: tuple[float, ...]

    def weights(self) -> tuple[float, list[float], list[float]]:
        """Log odds of being good: the start, and what a good and a bad vote of each rule add."""
        start = math.log(self.prior / (1 - self.prior))
        pairs = list(zip(self.good_given_good, self.good_given_bad, strict=True))
        return start, [math.log(a / b) for a, b in pairs], [math.log((1 - a) / (1 - b)) for a, b in pairs]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation on the counts of vote patterns.

    The first guess is that a text is bad if any rule calls it bad. Each round re-estimates the share of good
    texts and the rules' rates from the posteriors, and then the posteriors. One made-up text either way
    keeps every rate from 0 and 1. The patterns are taken in order, so the result does not depend on how they
    were gathered. Without texts the rates are even and the share is a half.
    """
    patterns = sorted(patterns)
    total = sum(count for _, count in patterns)
    good = [0.0 if min(votes) < 0 else 1.0 for votes, _ in patterns]
    for _ in range(rounds):
        mass = sum(p * n for p, (_, n) in zip(good, patterns, strict=True))
        of_good, of_bad = [], []
        for j in range(len(RULES)):
            yes, no = [1.0, 1.0], [1.0, 1.0]
            for p, (votes, n) in zip(good, patterns, strict=True):
                if votes[j]:
                    side = yes if votes[j] > 0 else no
                    side[0] += p * n
                    side[1] += (1 - p) * n
            rates = [a / (a + b) for a, b in zip(yes, no, strict=True)]
            of_good.append(max(rates[0], 1 - FALSE_ALARMS) if patterns else rates[0])
            of_bad.append(min(rates[1], 1 - FALSE_ALARMS))
        model = LabelModel((mass + 1) / (total + 2), tuple(of_good), tuple(of_bad))
        start, up, down = model.weights()
        good = [
            _sigmoid(start + sum(up[j] if v > 0 else down[j] for j, v in enumerate(votes) if v)) for votes, _ in patterns
        ]
    return model


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    rounds: int = 100,
    with_text: bool = True,
    only_kept: bool = False,
) -> DataFrame:
    """Probability that each text is good, learnt from the rules' votes alone.

    Votes of all texts are counted by pattern (at most ``3 ** 5`` groups, whatever the input), those counts
    give the label model, and each text gets its posterior from its own votes. A text of fewer than
    50 words, or with more than half of its words in repeated three-word windows, fails the
    base rule and is never kept.

    Returns the given columns, the counts, ``base_failed``, ``quality`` (0 to 1) and ``kept``. A null text has no
    words and fails. Every row is judged by itself; repeated rows count as often as they stand there. An empty
    table gives an empty result. Columns named like a result are replaced.

    Votes are computed twice, once to be counted and once to be weighed, because shuffling or storing the texts
    costs more. ``only_kept=True`` returns only the rows that are kept. ``with_text=False`` leaves the text out of the result, and then they are computed once and kept
    in the shared folder.
    """
    rows = base_features(docs, id_col=id_col, text_col=text_col)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    voted = rows.select("_id", "_text", "_row", *counts, base.alias("_failed"), *vote_columns())
    if not with_text:
        voted = cut(voted.drop("_text"))
    names = [f"_v{at}" for at in range(len(RULES))]
    grouped = voted.groupBy(*names).count().collect()
    model = fit_label_model([(tuple(row[:-1]), row[-1]) for row in grouped], rounds)

    start, up, down = model.weights()
    odds = F.lit(start)
    for at, name in enumerate(names):
        odds = odds + F.when(F.col(name) > 0, up[at]).when(F.col(name) < 0, down[at]).otherwise(0.0)
    good = 1 / (1 + F.exp(-odds))
    verdict = F.struct(good.alias("quality"), (~F.col("_failed") & (good >= threshold)).alias("kept"))
    # Exploding a list of one verdict or none keeps or drops the row. A filter would be pushed below the features, and
    # Spark would build them again for each of its conditions.
    wanted = F.filter(F.array(verdict), lambda item: item.getField("kept") | F.lit(not only_kept))
    text = [] if not with_text else ["_text"]
    judged = voted.select(*text, "_row", *counts, "_failed", F.explode(wanted).alias("_verdict"))
    results = {name: F.col(name) for name in counts}
    results |= {
        "base_failed": F.col("_failed"),
        "quality": F.col("_verdict.quality"),
        "kept": F.col("_verdict.kept"),
    }
    names = [name for name in docs.columns if with_text or name != text_col]
    return unpacked(judged, names, text_col, F.col("_text"), results)
