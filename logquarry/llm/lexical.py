"""Ranked lexical search over impact lists, by the Best Position Algorithm."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, in_workers, written

BEST = 10
# Items are searched in blocks of so many, or of so many bytes of text.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 4 << 20
# A segment of the index holds so many documents at most, fewer where a block has many terms, or so many bytes of text.
SEGMENT_DOCS, SEGMENT_CELLS, SEGMENT_BYTES = 4096, 1 << 24, 64 << 20
FIRST_DEPTH = 16
MERGERS = 64

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytearray(range(256))
for _byte in range(0x41, 0x5B):
    _FOLD[_byte] += 32
for _byte in _SEPARATORS:
    _FOLD[_byte] = 0x20
_FOLD = bytes(_FOLD)

# Documents, their numbers of terms, and for each term a run of documents with the term's occurrences.
SEGMENT = "docs long, terms long, df array<long>, ids binary, no_id binary, n binary, border binary, doc binary, tf binary"


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, digits and all other characters, only A-Z lower-cased."""
    return text.translate(_FOLD).split()


class Segment:
    """Postings of some documents for the terms of a block, collected document by document."""

    def __init__(self, number: dict[bytes, int]):
        self.number = number
        self.most = max(1, min(SEGMENT_DOCS, SEGMENT_CELLS // max(len(number), 1)))
        self.ids: list[int | None] = []
        self.n: list[int] = []
        self.term: list[int] = []
        self.tf: list[int] = []
        self.holds: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = terms(text)
        counts = Counter(map(self.number.get, found))
        counts.pop(None, None)
        self.ids.append(doc_id)
        self.n.append(len(found))
        self.term.extend(counts.keys())
        self.tf.extend(counts.values())
        self.holds.append(len(counts))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= self.most or self.bytes >= SEGMENT_BYTES

    def row(self) -> dict:
        size, n = len(self.number), np.array(self.n, dtype=np.int64)
        term = np.array(self.term, dtype=np.int64)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), self.holds)
        order = np.argsort(term, kind="stable")
        df = np.bincount(term, minlength=size)
        return {
            "docs": int((n > 0).sum()),
            "terms": int(n.sum()),
            "df": df.tolist(),
            "ids": np.array([one or 0 for one in self.ids], dtype=np.int64).tobytes(),
            "no_id": np.array([one is None for one in self.ids]).tobytes(),
            "n": n.tobytes(),
            "border": np.concatenate([[0], np.cumsum(df)]).astype(np.int64).tobytes(),
            "doc": doc[order].tobytes(),
            "tf": np.array(self.tf, dtype=np.int64)[order].tobytes(),
        }


class ImpactLists:
    """For each term its documents by falling impact, and direct access to a document's position in every list.

    All lists stand in one array, each with one more entry of impact 0 at its end; that is the position of
    documents that the list does not hold.
    """

    def __init__(self, row: dict, docs: int, total: int):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.no_id = np.frombuffer(row["no_id"], dtype=bool)
        n = np.frombuffer(row["n"], dtype=np.int64)
        border = np.frombuffer(row["border"], dtype=np.int64)
        doc = np.frombuffer(row["doc"], dtype=np.int32)
        tf = np.frombuffer(row["tf"], dtype=np.int64)
        size = len(border) - 1
        length = 25 + (75 * n * docs) // max(total, 1)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * length[doc])
        term = np.repeat(np.arange(size), np.diff(border))
        order = np.lexsort((doc, -impact, term))
        at = np.arange(len(doc)) + term
        self.start = border[:-1] + np.arange(size)
        self.end = border[1:] + np.arange(size)
        self.doc = np.zeros(len(doc) + size, dtype=np.int32)
        self.impact = np.zeros(len(doc) + size, dtype=np.int64)
        self.doc[at], self.impact[at] = doc[order], impact[order]
        self.position = np.repeat(self.end.astype(np.int32)[:, None], len(n), axis=1)
        self.position[term, self.doc[at]] = at
        # The search that has last seen an entry, and the one that has last seen a document.
        self.seen = np.zeros(len(self.doc), dtype=np.int32)
        self.met = np.zeros(len(n), dtype=np.int32)
        self.searches = 0

    def _first_unseen(self, at: int, end: int) -> int:
        width = 64
        while at < end:
            unseen = self.seen[at : min(at + width, end)] != self.searches
            if unseen.any():
                return at + int(unseen.argmax())
            at, width = at + len(unseen), 2 * width
        return end

    def search(self, wanted: np.ndarray, weight: np.ndarray, best: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that may be among the ``best``, with their whole scores.

        All lists are read from the top to the same depth. Every document met is looked up in all lists, and
        its positions there count as seen. A list's best position is the end of the run of seen positions from its top, which is at
        least the depth read. A document not yet met stands behind the best position of every list, so its
        score is at most the sum over the next entries. Once that is strictly below the score of the last of the
        best, or below ``floor``, no document that is left can be one of them, nor tie with them.
        """
        self.searches += 1
        start, end = self.start[wanted], self.end[wanted]
        reached, depth, read = start.copy(), 0, FIRST_DEPTH
        found, scores = [], []
        last = max(floor, 1)
        while int(weight @ self.impact[reached]) >= last:
            entries = [np.arange(a, b) for a, b in zip(start + depth, np.minimum(start + read, end), strict=True) if a < b]
            docs = self.doc[np.concatenate(entries)] if entries else np.zeros(0, dtype=np.int32)
            docs = np.unique(docs[self.met[docs] != self.searches])
            self.met[docs] = self.searches
            positions = self.position[wanted[:, None], docs]
            found.append(docs)
            scores.append(weight @ self.impact[positions])
            self.seen[positions.ravel()] = self.searches
            self.seen[end] = 0
            reached = np.array([self._first_unseen(a, b) for a, b in zip(reached.tolist(), end.tolist(), strict=True)])
            known = np.concatenate(scores)
            if len(known) >= best:
                last = max(last, int(np.partition(known, -best)[-best]))
            depth, read = read, 2 * read
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found, scores = np.concatenate(found), np.concatenate(scores)
        good = scores >= last
        return found[good], scores[good]


class Best:
    """The best documents of one item so far: by score, then by id, rows without an id last."""

    def __init__(self, most: int):
        self.most = most
        self.rows: list[tuple[int, bool, int]] = []

    @property
    def floor(self) -> int:
        return -self.rows[-1][0] if len(self.rows) >= self.most else 0

    def add(self, lists: ImpactLists, docs: np.ndarray, scores: np.ndarray) -> None:
        new = zip((-scores).tolist(), lists.no_id[docs].tolist(), lists.ids[docs].tolist(), strict=True)
        self.rows = sorted([*self.rows, *new])[: self.most]


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size; partitions come to the driver one by one."""
    block, size = [], 0
    for item, text in items.select(column(item_col), column(text_col).cast("string")).toLocalIterator():
        data = (text or "").encode()
        if block and (len(block) >= BLOCK_ITEMS or size + len(data) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((item, Counter(terms(data))))
        size += len(data)
    if block:
        yield block


def _index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(number)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                segment.add(doc_id, text)
                if segment.full():
                    yield pa.RecordBatch.from_pylist([segment.row()], schema)
                    segment = Segment(number)
        if segment.ids:
            yield pa.RecordBatch.from_pylist([segment.row()], schema)

    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in SEGMENT.split(", "))])
    return docs.mapInArrow(collect, SEGMENT)


def _search_block(docs: DataFrame, block: list[tuple], item_field: T.StructField, best: int) -> DataFrame:
    number: dict[bytes, int] = {}
    for _, wanted in block:
        for term in wanted:
            number.setdefault(term, len(number))
    index = written(_index(docs, number))
    sums = index.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    holders = index.select(F.posexplode("df").alias("term", "df")).where("df > 0").groupBy("term").agg(F.sum("df").alias("df"))
    # At most one row for each term of the block.
    df = {row["term"]: row["df"] for row in holders.collect()}
    documents, total = sums["docs"] or 0, sums["terms"] or 0
    weight = {term: math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1))) for term, held in df.items()}
    queries = []
    for _, wanted in block:
        parts = [(number[term], weight[number[term]] * times) for term, times in wanted.items() if number[term] in weight]
        parts = np.array(parts, dtype=np.int64).reshape(-1, 2)
        queries.append((parts[:, 0].copy(), parts[:, 1].copy()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Best(best) for _ in queries]
        for batch in batches:
            for at in range(batch.num_rows):
                lists = ImpactLists(batch.slice(at, 1).to_pylist()[0], documents, total)
                for top, (wanted, weights) in zip(tops, queries, strict=True):
                    if len(wanted):
                        top.add(lists, *lists.search(wanted, weights, best, top.floor))
        rows = [(item, -score, None if no_id else doc_id) for item, top in enumerate(tops) for score, no_id, doc_id in top.rows]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        names = ["_item", "score", "_doc"]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()) for values in columns], names=names)

    found = index.mapInArrow(search, "_item long, score long, _doc long")
    # What the tasks found is merged in some groups first, so that no item's rows all meet at once.
    order = "order by score desc, _doc asc nulls last"
    found = found.withColumn("_part", F.pmod(F.xxhash64("_doc", "score"), F.lit(MERGERS)))
    found = found.withColumn("_rank", F.expr(f"row_number() over (partition by _item, _part {order})")).where(f"_rank <= {best}")
    found = found.withColumn("_rank", F.expr(f"row_number() over (partition by _item {order})")).where(f"_rank <= {best}")
    names = docs.sparkSession.createDataFrame(
        [(at, item) for at, (item, _) in enumerate(block)],
        T.StructType([T.StructField("_item", T.LongType()), T.StructField("_name", item_field.dataType)]),
    )
    return found.join(names, "_item").select("_name", F.col("_rank").cast("int").alias("rank"), "_doc", "score")


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    best: int = BEST,
) -> DataFrame:
    """The ``best`` highest-scoring documents of each item: the item's id, ``rank`` from 1, the document's id, ``score``.

    Documents are scored as the formula of ``ImpactLists`` and the terms' weights say, in whole numbers. Equal scores rank by ascending
    document id, rows without an id last. Items without a match have no rows. Null or empty texts have no
    terms, but every row of ``items`` is an item of its own, and every row of ``docs`` a document of its own. Ids of documents are
    integers. Other columns are left out; an empty table gives an empty result.

    The texts are read once for each block of items, and not shuffled. Every task cuts its documents into segments of
    bounded size that hold impact lists for the terms of the block, kept in the shared folder. Each segment is
    searched by best positions; a task carries the score of its last of the best from segment to segment, so that later
    ones stop sooner. At most ``best`` rows of an item leave a task.
    """
    in_workers(docs.sparkSession)
    field = items.select(column(item_col)).schema[0]
    rows = docs.select(column(id_col).cast("long").alias("_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    found = [written(_search_block(rows, block, field, best)) for block in _blocks(items, item_col, item_text_col)]
    if not found:
        kinds = [("_name", field.dataType), ("rank", T.IntegerType()), ("_doc", T.LongType()), ("score", T.LongType())]
        found = [docs.sparkSession.createDataFrame([], T.StructType([T.StructField(*kind) for kind in kinds]))]
    return reduce(DataFrame.unionAll, found).select(
        F.col("_name").alias(item_col), "rank", F.col("_doc").alias(id_col), "score"
    )
