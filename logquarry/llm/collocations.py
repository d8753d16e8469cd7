"""Phrase collocations, counted with a bidirectional FM-index over word ids for each shard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, in_workers, text_or_empty, written
from .hashing import mix

LEAST_COUNT = 10
INSIDE_PERCENT = 50
BEST = 2000
MAX_WORDS = 3
# Groups of a language's phrases that are ranked on their own first.
PARTS = 32
# Words in a shard, and bytes of text that are split at once.
SHARD_WORDS, PART_BYTES = 1 << 21, 1 << 22
# Words of text for each bucket in which phrases of all shards are summed.
BUCKET_WORDS = 1 << 20

_BORDER = b"\xff"  # no byte of UTF-8
_FOLD = bytearray(range(256))
for _byte in range(0x41, 0x5B):
    _FOLD[_byte] += 32
for _byte in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_byte] = 0xFF
_FOLD[0x09] = 0x20
_FOLD = bytes(_FOLD)

SHARD = "shard long, sign int, langs array<string>, words array<binary>, counts array<long>, text binary"


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in parts of bounded size, only A-Z lower-cased, with a border between pieces."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = len(text)
        if end - at > PART_BYTES:
            end = text.find(b" ", at + PART_BYTES)
            end = len(text) if end < 0 else end
        yield text[at:end].replace(_BORDER, b" \xff ").split()
        at = end


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed, with their first bytes together, then their second ones, and so on."""
    return zlib.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers from 0 on, the first in ascending order, as bytes: its differences, then the others, each in as many
    planes of bytes as its largest number needs."""
    columns = [np.diff(columns[0], prepend=0), *columns[1:]]
    widths = [max(1, (int(column.max(initial=0)).bit_length() + 7) // 8) for column in columns]
    planes = [column.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes() for column, width in zip(columns, widths, strict=True)]
    return zlib.compress(bytes([len(widths), *widths]) + b"".join(planes), 1)


def unpack_columns(data: bytes) -> list[np.ndarray]:
    data = zlib.decompress(data)
    widths = data[1 : 1 + data[0]]
    at, size, columns = 1 + len(widths), (len(data) - 1 - len(widths)) // sum(widths), []
    for width in widths:
        planes = np.zeros((8, size), dtype=np.uint8)
        planes[:width] = np.frombuffer(data, dtype=np.uint8, count=width * size, offset=at).reshape(width, size)
        columns.append(np.ascontiguousarray(planes.T).view("<i8").ravel())
        at += width * size
    return [np.cumsum(columns[0]), *columns[1:]]


class _Ids(dict):
    """Ids of the words of one language, from a count that all languages share."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        super().__init__({_BORDER: 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        self[word] = one = len(self.names)
        return one


class Shard:
    """Some documents as one row of word ids, with 0 between pieces and documents, and the words by id.

    Shards with ``sign`` -1 hold words that stand in two shards, to be taken off again.
    """

    def __init__(self, sign: int = 1):
        self.sign, self.size = sign, 0
        self.names: list[tuple[str, bytes]] = []
        self.ids: dict[str, _Ids] = {}
        self.text: list[np.ndarray] = [np.zeros(1, dtype=np.int32)]

    def add(self, lang: str, words: list[bytes]) -> None:
        ids = self.ids.get(lang)
        if ids is None:
            ids = self.ids[lang] = _Ids(lang, self.names)
        self.text.append(np.array([ids[word] for word in words], dtype=np.int32))
        self.size += len(words)

    def border(self) -> None:
        self.text.append(np.zeros(1, dtype=np.int32))

    def row(self, number: int) -> dict:
        self.border()
        text = np.concatenate(self.text)
        counts = np.bincount(text, minlength=len(self.names) + 1)
        order = np.argsort(-counts[1:], kind="stable")  # frequent words get the small ids
        renamed = np.zeros(len(counts), dtype=np.int32)
        renamed[order + 1] = np.arange(1, len(counts), dtype=np.int32)
        names = [self.names[at] for at in order.tolist()]
        return {
            "shard": number,
            "sign": self.sign,
            "langs": [lang for lang, _ in names],
            "words": [word for _, word in names],
            "counts": (self.sign * counts[1:][order]).tolist(),
            "text": pack(renamed[text]),
        }


def shards(docs: Iterator[tuple[str, bytes]], most: int, overlap: int) -> Iterator[Shard]:
    """Documents dealt to shards of about ``most`` words.

    A document that goes on in the next shard takes its last ``overlap`` words along, so that no phrase is lost;
    the phrases among these are then counted twice, and once more in a shard of sign -1.
    """
    shard, twice = Shard(), Shard(-1)
    for lang, text in docs:
        tail: list[bytes] = []
        for words in word_lists(text):
            while words:
                room = max(most - shard.size, 1)
                shard.add(lang, words[:room])
                tail = [*tail, *words[:room]][-overlap:] if overlap else []
                words = words[room:]
                if shard.size >= most:
                    yield shard
                    shard = Shard()
                    shard.add(lang, tail)
                    shard.size = 0
                    twice.add(lang, tail)
                    twice.border()
        shard.border()
        if twice.size >= most:
            yield twice
            twice = Shard(-1)
    for last in (shard, twice):
        if last.names:
            yield last


class FMIndex:
    """A bidirectional FM-index of a row of word ids; 0 is a border and in no phrase.

    ``before`` is the Burrows-Wheeler transform: the word before each suffix, with suffixes in the order of their first
    words; ``after`` is the same over the reversed row. A phrase is an interval in either order. One step
    to the left reads all words before its interval, one to the right all words behind it, and each new interval follows
    from the old one in both orders. Suffixes are sorted only as deep as the phrases that are extended are long.
    """

    def __init__(self, text: np.ndarray):
        self.text = text
        counts = np.bincount(text)
        self.starts = np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _order(text: np.ndarray, depth: int) -> np.ndarray:
        padded = np.concatenate([text, np.zeros(depth, dtype=text.dtype)]).astype(np.int64)
        key, size = padded[: len(text)], int(text.max(initial=0)) + 1
        for at in range(1, depth):
            key = key * size + padded[at : at + len(text)]
            if at + 1 < depth:
                key = np.unique(key, return_inverse=True)[1]
        return np.argsort(key, kind="stable")

    def suffixes(self, depth: int) -> np.ndarray:
        return self._order(self.text, depth)

    def before(self, depth: int) -> np.ndarray:
        return self.text[self.suffixes(depth) - 1]

    def after(self, depth: int) -> np.ndarray:
        reverse = self.text[::-1]
        return reverse[self._order(reverse, depth) - 1]

    @staticmethod
    def extend(beside: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of phrases with disjoint intervals of ``beside``, one of the two transforms.

        For each extension: the place of its phrase, the word, its count, and how many words beside the phrase are
        smaller. In the other order the extension's interval starts that far behind the phrase's.
        """
        owner = np.repeat(np.arange(len(low)), size)
        first = np.cumsum(size) - size
        word = beside[np.arange(len(owner)) + np.repeat(low - first, size)]
        key = np.sort(owner * (int(beside.max(initial=0)) + 1) + word)
        at = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(np.append(at, len(key)))
        owner, word = np.divmod(key[at], int(beside.max(initial=0)) + 1)
        smaller = at - first[owner]
        inside = word > 0
        return owner[inside], word[inside], count[inside], smaller[inside]

    def start(self, beside: np.ndarray, word: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where the intervals of extensions start in the order of ``beside``: that of the word, and as far behind its
        start as the word occurs in ``beside`` before the phrase's interval."""
        width = len(beside) + 1
        rows = np.argsort(beside, kind="stable")
        places = beside[rows].astype(np.int64) * width + rows
        return np.searchsorted(places, word.astype(np.int64) * width + low)


def _joint(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number for each row, equal for equal rows."""
    code = columns[0].astype(np.int64)
    for at, more in enumerate(columns[1:]):
        if at:
            code = np.unique(code, return_inverse=True)[1]
        code = code * size + more
    return code


def pairs_of(text: np.ndarray, local: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All phrases of two of the given words: start in the order of suffixes, count, and the words' ids."""
    index = FMIndex(text)
    name = np.zeros(len(index.starts), dtype=np.int64)
    name[local] = ids + 1
    local = np.sort(local)
    low, size = index.starts[local], index.starts[local + 1] - index.starts[local]
    owner, word, count, smaller = index.extend(index.after(1), low, size)
    good = name[word] > 0
    owner, word, count, smaller = owner[good], word[good], count[good], smaller[good]
    return low[owner] + smaller, count, [name[local[owner]] - 1, name[word] - 1]


def longer_by_one(
    text: np.ndarray, low: np.ndarray, size: np.ndarray, ids: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All phrases one word longer than the given ones whose first and last words but one are both given."""
    index, depth = FMIndex(text), len(ids)
    order = np.argsort(low)
    low, size, ids = low[order], size[order], [one[order] for one in ids]
    suffixes = index.suffixes(depth)
    before = text[suffixes - 1]
    known = [text[suffixes[low] + at] for at in range(depth)]
    name = np.zeros(len(index.starts), dtype=np.int64)
    for local, one in zip(known, ids, strict=True):
        name[local] = one
    owner, word, count, _ = index.extend(before, low, size)
    begins = [word, *(local[owner] for local in known[:-1])]
    codes = _joint([np.concatenate(both) for both in zip(known, begins, strict=True)], len(index.starts))
    good = np.isin(codes[len(low) :], codes[: len(low)])
    owner, word, count = owner[good], word[good], count[good]
    return index.start(before, word, low[owner]), count, [name[word], *(one[owner] for one in ids)]


def _words(length: int) -> list[str]:
    return [f"w{at}" for at in range(1, length + 1)]


def _runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the rows, and where in it each run of equal rows starts."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[order[1:]] != column[order[:-1]]
    return order, np.flatnonzero(new)


def _phrases(texts: DataFrame, parts: DataFrame, length: int, last: bool, buckets: int) -> DataFrame:
    """Phrases of ``length`` words by shard, from the words or shorter phrases that are left of it.

    Phrases are dealt to ``buckets`` by their words. A row holds those of a shard in one bucket: with place and count, or
    for the last length with the count alone.
    """

    def count(key: tuple, text: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(text) and len(some):
            row, sign = unpack(text["text"].iloc[0]), int(text["sign"].iloc[0])
            if length == 2:
                low, counts, ids = pairs_of(row, some["local"].to_numpy(), some["id"].to_numpy())
            else:
                known = [np.concatenate(column) for column in zip(*map(unpack_columns, some["data"]), strict=True)]
                low, counts, ids = longer_by_one(row, known[0], known[1], known[2:])
            bucket = ids[0].astype(np.uint64)
            for one in ids[1:]:
                bucket = mix(bucket) + one.astype(np.uint64)
            bucket = (mix(bucket) % np.uint64(buckets)).astype(np.int64)
            columns = [*ids, counts] if last else [low, counts, *ids]
            order = np.lexsort((*ids[::-1], bucket) if last else (low, bucket))
            borders = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for at in np.split(order, borders[1:]) if len(order) else ():
                rows.append((int(bucket[at[0]]), key[0], sign, pack_columns([column[at] for column in columns])))
        return pd.DataFrame(rows, columns=["bucket", "shard", "sign", "data"])

    return texts.groupBy("shard").cogroup(parts.groupBy("shard")).applyInPandas(count, "bucket long, shard long, sign int, data binary")


def _frequent(found: DataFrame, length: int, last: bool, least: int) -> DataFrame:
    """The phrases with at least ``least`` occurrences over all shards.

    Rows of shard -1 hold them with their counts, the others what each shard has of them.
    """

    def add(group: pd.DataFrame) -> pd.DataFrame:
        shares = [unpack_columns(data) for data in group["data"]]
        sizes = [len(share[0]) for share in shares]
        columns = [np.concatenate(column) for column in zip(*shares, strict=True)]
        signs = np.repeat(group["sign"].to_numpy(), sizes)
        ids, counts = (columns[:length], columns[length]) if last else (columns[2:], columns[1])
        order, starts = _runs(ids)
        total = np.add.reduceat(signs[order] * counts[order], starts)
        good = total >= least
        rows = []
        if good.any():
            heads = order[starts[good]]
            rows.append((-1, pack_columns([*(one[heads] for one in ids), total[good]])))
            if not last:
                keeps = np.zeros(len(order), dtype=bool)
                keeps[order] = np.repeat(good, np.diff(np.append(starts, len(order))))
                begin = 0
                for shard, size in zip(group["shard"].tolist(), sizes, strict=True):
                    own = slice(begin, begin + size)
                    if keeps[own].any():
                        rows.append((shard, pack_columns([column[own][keeps[own]] for column in columns])))
                    begin += size
        return pd.DataFrame(rows, columns=["shard", "data"])

    return found.groupBy("bucket").applyInPandas(add, "shard long, data binary")


def _counts(found: DataFrame, length: int) -> DataFrame:
    """``w1, w2, ... , f`` of the frequent phrases."""
    names = [*_words(length), "f"]

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in unpack_columns(data)], names=names)

    return found.where("shard = -1").select("data").mapInArrow(spread_out, ", ".join(f"{name} long" for name in names))


def _exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of 38 digits."""
    whole = [value.cast("decimal(18,0)") for value in (a, left, right)]
    upper = F.lit(1_000_000).cast("decimal(7,0)") * (whole[0] * whole[0])
    parts = F.struct(upper.alias("upper"), (whole[1] * whole[2]).alias("lower"))
    return F.transform(F.array(parts), lambda pair: F.call_function("div", pair["upper"], pair["lower"]))[0].cast("long")


def collocations(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    max_words: int = MAX_WORDS,
    least: int = LEAST_COUNT,
    inside_percent: int = INSIDE_PERCENT,
    best: int | None = BEST,
    shard_words: int = SHARD_WORDS,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """Phrases of 2 to ``max_words`` words that stand together more often than their parts: per language the ``best``.

    Texts are split into pieces at ``.,;:!?`` and line ends and these into words at blanks and tabs; only A-Z are
    lower-cased. A phrase that occurs at least ``least`` times is scored by its weakest cut; one that lies in a phrase one word
    longer with at least ``inside_percent`` of its occurrences is dropped (any longer phrase around it that frequent
    has such a one within). Returns ``lang, rank, phrase, a, l, r, n, score``; the language of rows without one is ``und``.

    Null and empty texts have no words; equal rows count each. Other columns are left out and an empty table has no
    phrases. ``best=None`` returns all.

    Texts become shards of word ids, split wherever a shard is full. Words are counted over all shards, and only
    words, then phrases, that are frequent over all shards are extended by the shards' indexes; the counts of a phrase are
    summed across shards, in buckets of phrases whose number grows with the text. A phrase has one count per shard, so no word or
    phrase, however frequent, makes a large group.
    """
    in_workers(docs.sparkSession)
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    lang = F.coalesce(column(lang_col).cast("string"), F.lit("und"))
    source = docs.select(lang.alias("lang"), text_or_empty(text_col).cast("binary").alias("text"))
    kinds = [("shard", pa.int64()), ("sign", pa.int32()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.binary())),
             ("counts", pa.list_(pa.int64())), ("text", pa.binary())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for at, shard in enumerate(shards(rows, shard_words, max_words - 1)):
            yield pa.RecordBatch.from_pylist([shard.row(base + at)], pa.schema(kinds))

    dealt = written(source.mapInArrow(deal, SHARD))
    texts = dealt.select("shard", "sign", "text")
    per_lang = dealt.select(F.explode(F.arrays_zip("langs", "counts")).alias("one")).groupBy("one.langs").agg(F.sum("one.counts").alias("n"))

    # One row per shard and word; the words' numbers are spread over few bits, as they fill most of what is shuffled later.
    words = dealt.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("local", "one"))
    words = words.select("shard", (F.col("local") + 1).cast("long").alias("local"), F.col("one.langs").alias("lang"),
                         F.col("one.words").alias("word"), F.col("one.counts").alias("count"))
    same = Window.partitionBy("lang", "word")
    words = words.withColumn("f", F.sum("count").over(same)).where(F.col("f") >= least)
    words = words.withColumn("_at", F.monotonically_increasing_id()).withColumn("_first", F.min("_at").over(same))
    named = F.col("_at") == F.col("_first")
    words = written(words.select("shard", "local", "_first", "f", F.when(named, F.col("lang")).alias("lang"), F.when(named, F.col("word")).alias("word")))
    tasks = F.lit((words.agg(F.max(F.shiftright("_first", 33))).first()[0] or 0) + 1)
    number = F.col("_first").bitwiseAND((1 << 33) - 1) * tasks + F.shiftright("_first", 33)
    words = words.withColumn("id", number)
    parts = words.select("shard", "local", "id")

    # A bucket of phrases holds about as much as a shard.
    total = per_lang.agg(F.sum("n")).first()[0] or 0
    buckets = total // bucket_words + 1
    # Counts by length; ``w1, w2, ...`` are the words' numbers.
    counted = {1: words.where(F.col("word").isNotNull()).select(F.col("id").alias("w1"), "f")}
    for length in range(2, max_words + 1):
        last = length == max_words
        found = written(_frequent(_phrases(texts, parts, length, last, buckets), length, last, least))
        counted[length] = _counts(found, length)
        parts = found.where("shard >= 0")

    scored = []
    for length in range(2, max_words + 1):
        names = _words(length)
        phrases = counted[length].withColumnRenamed("f", "a")
        for cut in range(1, length):
            head = counted[cut].toDF(*names[:cut], f"l{cut}")
            tail = counted[length - cut].toDF(*names[cut:], f"r{cut}")
            phrases = phrases.join(head, names[:cut]).join(tail, names[cut:])
        cuts = [
            F.struct(_exact_score(F.col("a"), F.col(f"l{cut}"), F.col(f"r{cut}")).alias("score"), F.lit(cut).alias("cut"),
                     F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r"))
            for cut in range(1, length)
        ]
        weakest = F.array_min(F.array(*cuts)).alias("weakest")
        phrases = phrases.select(*names, "a", weakest)
        if length < max_words:
            longer = counted[length + 1].toDF(*_words(length + 1), "b")
            sides = [longer.select(*(F.col(f"w{at + shift}").alias(f"w{at}") for at in range(1, length + 1)), "b") for shift in (0, 1)]
            around = sides[0].unionAll(sides[1]).groupBy(*names).agg(F.max("b").alias("b"))
            inside = F.col("b").isNotNull() & (100 * F.col("b") >= inside_percent * F.col("a"))
            phrases = phrases.join(around, names, "left").where(~inside)
        scored.append(phrases.select(F.array(*names).alias("ids"), "a", "weakest"))
    scored = reduce(DataFrame.unionAll, scored).withColumn("_phrase", F.monotonically_increasing_id())
    return _named(scored, words, per_lang, best)


def _named(scored: DataFrame, words: DataFrame, per_lang: DataFrame, best: int | None) -> DataFrame:
    """The phrases with their languages, texts and ranks."""
    scored = written(scored)
    texts = words.where(F.col("word").isNotNull()).select("id", "lang", F.col("word").cast("string").alias("word"))
    spelled = scored.select("_phrase", F.posexplode("ids").alias("at", "id")).join(texts, "id").groupBy("_phrase")
    spelled = spelled.agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    phrase = F.array_join(F.col("words.word"), " ")
    found = scored.join(spelled, "_phrase").select("lang", phrase.alias("phrase"), "a", "weakest.l", "weakest.r", "weakest.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if best is not None:
        # Within some groups of a language first, so that its phrases need not all meet at once.
        found = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        found = found.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
        found = found.where(F.col("_rank") <= best)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if best is not None:
        found = found.where(F.col("rank") <= best)
    found = found.join(per_lang.withColumnRenamed("langs", "lang"), "lang")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
