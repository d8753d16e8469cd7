"""N-gram Jaccard join by chosen paths, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut, fewer, in_workers, release, spread, text_or_empty, written
from .components import connected
from .hashing import mix, shingle_hashes

WORDS = 5
THRESHOLD = 0.8
# Each set is embedded as so many minima of random hashes; equal places estimate the similarity.
PLACES = 128
# Children per node. A pair of similarity s meets below a node at depth d with q(d) = 1 - (1 - s q(d - 1)) ** CHILDREN.
CHILDREN = 2
TARGET_RECALL = 0.9995
# Buckets up to this size are compared by brute force; larger ones are split further. Deep ones may be larger.
SMALL, SMALL_BELOW = 64, 1024
DEEP = 3
MOST_LEVELS = 40
# Estimates: candidates (over five deviations below the threshold); safely alike; linked to a pivot that is left.
CANDIDATE, ALIKE, LINKED = 0.6, 0.85, 0.45
# Sets of a component are compared in blocks of about this many sets, or this many shingles.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
ROWS_AT_ONCE = 128

_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(1, 1 << 63, PLACES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)


def meeting(similarity: float, levels: int) -> float:
    """The chance that one run brings a pair of just this similarity together in a bucket behind so many levels."""
    meet = 1.0
    for level in reversed(range(levels)):
        meet = 1 - (1 - similarity * meet) ** (CHILDREN if level <= DEEP else 1)
    return meet


def runs_for(recall: float = TARGET_RECALL, similarity: float = THRESHOLD, levels: int = DEEP + 1) -> int:
    """How many independent runs bring a pair of just this similarity together with the target probability."""
    meet, runs = meeting(similarity, levels), 1
    while 1 - (1 - meet) ** runs < recall:
        runs += 1
    return runs


def _name(shingles: np.ndarray) -> str:
    """128 bits for a set, the same in whatever order."""
    parts = [int(mix(shingles ^ np.uint64(salt)).sum(dtype=np.uint64)) for salt in (0x51, 0xA7)]
    return f"{parts[0]:016x}{parts[1]:016x}"


def _minima(shingles: np.ndarray) -> np.ndarray:
    """Least hash per place; long sets are taken in blocks to bound the memory."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 4096):
        block = shingles[start : start + 4096]
        np.minimum(least, (block[:, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return (mix(least) >> np.uint64(32)).astype("<u4")


def _likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (one == other).mean(axis=-1)


def _sketches(rows: DataFrame) -> DataFrame:
    """``_id, _hash, _node, _size, _sketch`` for rows of ``_id, _hash, _text``; the text goes no further."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                nodes, sizes, minima = [], [], []
                ids, hashes = part.column(0).to_pylist(), part.column(1).to_pylist()
                for key, text_hash, text in zip(ids, hashes, part.column(2).to_pylist(), strict=True):
                    shingles = shingle_hashes(text.encode(), WORDS)
                    # A text without words is like no other.
                    nodes.append(_name(shingles) if len(shingles) else f"-{key}:{text_hash}")
                    sizes.append(len(shingles))
                    minima.append(_minima(shingles).tobytes() if len(shingles) else None)
                arrays = [*part.columns[:2], pa.array(nodes), pa.array(sizes, pa.int64()), pa.array(minima, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_hash", "_node", "_size", "_sketch"])

    fields = [
        T.StructField("_node", T.StringType()),
        T.StructField("_size", T.LongType()),
        T.StructField("_sketch", T.BinaryType()),
    ]
    return rows.mapInArrow(sketch, T.StructType([*rows.schema.fields[:2], *fields]))


def _place(path: Column, child: int) -> Column:
    """The place that this child of a node splits by; the children of a node have different ones."""
    step = PLACES // CHILDREN
    return F.pmod(F.xxhash64(F.lit(77), path), F.lit(step)) + child * step


def _children(nodes: DataFrame, number: int = CHILDREN) -> DataFrame:
    """The next level: rows of a bucket that agree in a sampled place share a child, whose path tells both."""
    value = lambda at: F.substring(F.col("_sketch"), (at * 4 + 1).cast("int"), F.lit(4))
    child = [F.xxhash64("_path", F.lit(at), value(_place(F.col("_path"), at))) for at in range(number)]
    return nodes.select("_node", "_sketch", F.explode(F.array(*child)).alias("_path")).select("_path", "_node", "_sketch")


def _spanning(size: int, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that connect what the ones before have not."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (parent := root.get(x, x)) != x:
            root[x] = root.get(parent, parent)
            x = root[x]
        return x

    links = []
    for a, b in zip(first.tolist(), second.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((a, b))
    return links


def _in_buckets(rows: DataFrame) -> DataFrame:
    """Brute force within small buckets: candidate links, as few as connect each bucket's candidates.

    Rows come sorted by bucket. A task compares every row with the first, second, ... row behind it, for all its buckets
    at once, and holds one batch and one bucket.
    """

    def links_of(paths: np.ndarray, nodes: list[str], sketches: np.ndarray) -> pa.RecordBatch:
        ones, others = [], []
        at = np.arange(len(paths))
        for step in range(1, len(paths)):
            at = at[: np.searchsorted(at, len(paths) - step)]
            at = at[paths[at] == paths[at + step]]
            if not len(at):
                break
            like = at[_likeness(sketches[at], sketches[at + step]) >= CANDIDATE]
            ones.append(like)
            others.append(like + step)
        empty = np.zeros(0, dtype=np.int64)
        found = _spanning(len(paths), np.concatenate([empty, *ones]), np.concatenate([empty, *others]))
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[a] for a, _ in found], pa.string()), pa.array([nodes[b] for _, b in found], pa.string())],
            names=["_u", "_v"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, nodes, data = np.zeros(0, dtype=np.int64), [], []
        for batch in batches:
            paths = np.concatenate([paths, batch.column(0).to_numpy()])
            nodes += batch.column(1).to_pylist()
            data += batch.column(2).to_pylist()
            # The last bucket may go on in the next batch.
            others = np.flatnonzero(paths != paths[-1]) if len(paths) else paths
            if len(others):
                stop = int(others[-1]) + 1
                yield links_of(paths[:stop], nodes[:stop], np.frombuffer(b"".join(data[:stop]), "<u4").reshape(-1, PLACES))
                paths, nodes, data = paths[stop:], nodes[stop:], data[stop:]
        if len(paths):
            yield links_of(paths, nodes, np.frombuffer(b"".join(data), "<u4").reshape(-1, PLACES))

    dealt = rows.select("_path", "_node", "_sketch").repartition(spread(rows.sparkSession), "_path")
    return dealt.sortWithinPartitions("_path", "_node").mapInArrow(compare, "_u string, _v string")


def _likeness_column(rows: DataFrame) -> DataFrame:
    """Add ``_like``, the estimated similarity of ``_sketch`` and ``_pivot``."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            one, other = (
                np.frombuffer(b"".join(batch.column(names.index(name)).to_pylist()), dtype="<u4").reshape(-1, PLACES)
                for name in ("_sketch", "_pivot")
            )
            like = pa.array(_likeness(one, other), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, like], names=[*names, "_like"])

    return rows.mapInArrow(estimate, T.StructType([*rows.schema.fields, T.StructField("_like", T.DoubleType())]))


def candidate_links(sets: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """Links between sets that may be alike, enough to connect all that are; ``sets`` has ``_node, _sketch``.

    The first runs are as many as the recall asks for where buckets get small within the first levels. A run that has to go
    deeper brings fewer pairs together, so the sets that were still in large buckets then get as many further runs as the depth really
    reached asks for.
    """
    links, done, runs = [], 0, runs_for(recall)
    while runs > 0:
        found, deep, levels = _run(sets, range(done, done + runs))
        links += found
        done += runs
        runs = 0
        if deep is not None:
            sets, runs = sets.join(deep, "_node", "left_semi"), runs_for(recall, levels=levels) - done
    return reduce(DataFrame.union, links)


def _run(sets: DataFrame, runs: range) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Links from some runs, the sets that were in large buckets behind level ``DEEP``, if any, and the levels it took.

    Every run is a tree. A node splits its bucket by ``CHILDREN`` sampled places; a level is one shuffle by
    path. Buckets of one row end. Small buckets are compared by brute force. A large bucket first meets its pivot (its
    least row): what is safely alike to the pivot is linked to it and leaves, since whatever is like such a row is at least
    ``LINKED`` to the pivot, and is linked to it too. The rest is split further. So a bucket of near copies of one
    text ends at once however large, and no pairs of it are listed.

    A checkpoint keeps Spark's estimate of its size, and that of a join may be the product of its sides. From level to level
    the number would get twice as many digits, megabytes of them in every plan on the driver. So each level is a table, whose
    size Spark knows, and what only picks rows is a semi-join.
    """
    total = sets.count()
    rows = total * len(runs) * CHILDREN
    roots = F.array(*(F.xxhash64(F.lit("run"), F.lit(at)) for at in runs))
    level = _children(sets.select(F.explode(roots).alias("_path"), "_node", "_sketch")).drop("_sketch")
    sizes = cut(fewer(_bucket_sizes(level), rows))
    # Most texts are alone in every bucket; only the others go on, with their sketches.
    level = cut(fewer(level.join(sizes.select("_path"), "_path", "left_semi"), rows))
    sets = cut(fewer(sets.join(level.select("_node").distinct(), "_node", "left_semi"), total))
    links, deep = [], None
    for depth in range(MOST_LEVELS):
        rows = level.count()
        small = SMALL if depth < DEEP else SMALL_BELOW
        few = fewer(level.join(sizes.where(F.col("_n") <= small).select("_path"), "_path"), rows)
        found = fewer(_in_buckets(fewer(few.join(sets, "_node"), rows)), rows)
        large = sizes.where(F.col("_n") > small)
        last = large.isEmpty()
        if not last:
            pivots = sets.select(F.col("_node").alias("_pivot_node"), F.col("_sketch").alias("_pivot"))
            large = fewer(large.join(pivots, "_pivot_node").drop("_n"), rows)
            left = fewer(fewer(level.join(large, "_path"), rows).join(sets, "_node"), rows)
            met = cut(_likeness_column(left.select("_path", "_node", "_sketch", "_pivot_node", "_pivot")).drop("_pivot"))
            linked = met.where((F.col("_like") >= LINKED) & (F.col("_node") != F.col("_pivot_node")))
            found = found.union(linked.select(F.col("_node").alias("_u"), F.col("_pivot_node").alias("_v")))
            rest = met.where(F.col("_like") < ALIKE).select("_node", "_sketch", "_path")
            if depth == DEEP:
                deep = rest.select("_node").distinct()
        links.append(cut(fewer(found.distinct(), rows)))
        if last:
            return links, deep, depth + 1
        # A pair that is still together is so in many buckets; from here on one child each keeps the rows few.
        level = written(_children(rest, CHILDREN if depth < DEEP else 1).drop("_sketch"))
        sizes = cut(fewer(_bucket_sizes(level), CHILDREN * rows))
        release(sets.sparkSession)
    raise RuntimeError("some buckets are still large; allow more levels")


def _bucket_sizes(level: DataFrame) -> DataFrame:
    """Buckets of two rows or more, with their least row."""
    sizes = level.groupBy("_path").agg(F.count("*").alias("_n"), F.min("_node").alias("_pivot_node"))
    return sizes.where(F.col("_n") > 1)


def _overlaps(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Sizes of the intersections of the first sets with the others, or of all with all if ``first`` is their number.

    Products of 0/1 matrices, in slices of the shingles that two sets have.
    """
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts[codes] > 1
    codes, owners = (np.cumsum(counts > 1) - 1)[codes[shared]], owners[shared]
    order = np.argsort(codes, kind="stable")
    codes, owners = codes[order], owners[order]
    rest = 0 if first == len(sets) else first
    total = np.zeros((first, len(sets) - rest), dtype=np.float32)
    width = 1024
    for start in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        low, high = np.searchsorted(codes, [start, start + width])
        ones = np.zeros((len(sets), width), dtype=np.float32)
        ones[owners[low:high], codes[low:high] - start] = 1
        total += ones[:first] @ ones[rest:].T
    return total


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """Exact similarities within blocks of a component: ``_node, _links, _root``.

    Rows are ``_root, _i, _j, _block, _node, _copies, _shingles``; a group holds one pair of blocks.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_block", "_node"], ignore_index=True)
        sets = [np.frombuffer(data, dtype="<u8") for data in group["_shingles"]]
        sizes, copies = np.array([len(s) for s in sets]), group["_copies"].to_numpy()
        i, j = int(group["_i"].iloc[0]), int(group["_j"].iloc[0])
        first = len(sets) if i == j else int((group["_block"] == i).sum())
        rest = 0 if i == j else first
        links, root = np.zeros(len(sets), dtype=np.int64), np.arange(len(sets))
        if 0 < first and rest < len(sets):
            inter = _overlaps(sets, first)
            like = np.empty(inter.shape, dtype=bool)
            for at in range(0, first, 256):  # a few rows at a time, as these numbers are wide
                shared = inter[at : at + 256].astype(np.int64)
                union = sizes[at : min(at + 256, first), None] + sizes[None, rest:] - shared
                like[at : at + 256] = shared >= threshold * union - 1e-9
            if i == j:
                np.fill_diagonal(like, False)
            for at in range(0, first, 256):
                some = like[at : at + 256]
                links[at : at + len(some)] += some @ copies[rest:]
                if i != j:
                    links[first:] += copies[at : at + len(some)] @ some
            for a in range(first):
                # All that this set is linked to get one root.
                own = np.unique(root[np.append(np.flatnonzero(like[a]) + rest, a)])
                if len(own) > 1:
                    root[np.isin(root, own)] = own[0]
        names = group["_node"].to_numpy()
        return pd.DataFrame({"_node": names, "_links": links, "_linked": names[root]})

    return rows.groupBy("_root", "_i", "_j").applyInPandas(compare, "_node string, _links long, _linked string")


def jaccard_join(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    recall: float = TARGET_RECALL,
) -> DataFrame:
    """Texts whose sets of five-word runs have a Jaccard similarity of at least ``threshold``.

    Returns ``id_col, text_hash, class_id, n_links, representative``: one row per input row. The class is the least id
    of all documents that links connect; ``n_links`` counts the other rows that are linked directly, copies included;
    exactly one (id, text) of a class is its representative.

    1. Texts become sets of hashed word runs (a text of one to four words is one run). Equal sets are one set with
       a number of copies, so copies are never compared or paired.
    2. Chosen paths find candidates (``candidate_links``) in as many runs as the recall asks for. The
       connected components of the candidates are a superset of the classes.
    3. Within a component all sets are compared exactly, in pairs of blocks of bounded numbers of sets and shingles, so that
       neither a component nor its pairs come together in one task. Links give the numbers and the classes.

    The similarity is exact for hashed runs (64 bits). A text without words, null included, is like no other, not even
    an equal one. Rows of one id and text are copies. An empty table gives an empty result. Other columns are
    left out. An id of null is the least.
    """
    spark = docs.sparkSession
    in_workers(spark)
    rows = docs.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    rows = rows.select("_id", F.xxhash64("_text").alias("_hash"), "_text")
    marked = cut(_sketches(rows))
    grouped = marked.groupBy("_node").agg(
        F.min(F.struct("_id", "_hash")).alias("_first"),
        F.count("*").alias("_copies"),
        F.first("_sketch").alias("_sketch"),
        F.first("_size").alias("_size"),
    )
    sets = cut(grouped)
    links = candidate_links(sets.where(F.col("_sketch").isNotNull()).select("_node", "_sketch"), recall)
    parts = connected(links)
    del links
    release(spark)

    # Blocks of the components, and the shingles of one text of each set.
    blocks = F.ceil(F.greatest(F.col("_m") / BLOCK, F.col("_all") / BLOCK_SHINGLES)).cast("int")
    members = parts.select(F.col("root").alias("_root"), F.col("node").alias("_node")).join(sets, "_node")
    sizes = members.groupBy("_root").agg(F.count("*").alias("_m"), F.sum("_size").alias("_all"))
    placed = (
        members.join(sizes, "_root")
        .select("_root", "_node", blocks.alias("_blocks"), "_first", "_copies")
        .withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
        .select("_root", "_node", "_blocks", "_block", "_copies", "_first._id", "_first._hash")
    )
    keys = placed.select(F.col("_id").alias("_key"), F.col("_hash").alias("_key_hash"), "_root", "_node", "_blocks", "_block", "_copies")
    same = F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_key_hash"))
    texts = rows.join(keys, same).select("_root", "_node", "_blocks", "_block", "_copies", "_text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                data = [shingle_hashes(text.encode(), WORDS).astype("<u8").tobytes() for text in part.column(5).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:5], pa.array(data, pa.binary())], names=[*part.schema.names[:5], "_shingles"]
                )

    with_sets = texts.mapInArrow(
        shingled, T.StructType([*texts.schema.fields[:5], T.StructField("_shingles", T.BinaryType())])
    )
    # Equal rows of one id and text would come in twice.
    with_sets = with_sets.dropDuplicates(["_node"])
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    paired = with_sets.select("*", other).select(
        "_root",
        F.least("_block", "_other").alias("_i"),
        F.greatest("_block", "_other").alias("_j"),
        "_block",
        "_node",
        "_copies",
        "_shingles",
    )
    exact = cut(_verified(paired, threshold))
    numbers = exact.groupBy("_node").agg(F.sum("_links").alias("_links"))
    classes = connected(exact.select("_node", "_linked")).select(F.col("node").alias("_node"), F.col("root").alias("_class"))

    # Classes are named by their least document.
    named = sets.select("_node", "_first", "_copies").join(numbers, "_node", "left").join(classes, "_node", "left")
    named = cut(
        named.select(
            "_node",
            "_first",
            (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"),
            F.coalesce("_class", "_node").alias("_class"),
        )
    )
    leaders = named.groupBy("_class").agg(F.min("_first").alias("_leader"))
    result = named.join(leaders, "_class").select("_node", "_links", "_leader")
    final = marked.select("_id", "_hash", "_node").join(result, "_node")
    return final.select(
        F.col("_id").alias(id_col),
        F.col("_hash").alias("text_hash"),
        F.col("_leader._id").alias("class_id"),
        F.when(F.startswith("_node", F.lit("-")), 0).otherwise(F.col("_links")).cast("long").alias("n_links"),
        F.struct("_id", "_hash").eqNullSafe(F.col("_leader")).alias("representative"),
    )


def one_per_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when of each class only the representative is kept, once."""
    kept = jaccard_join(docs, id_col=id_col, text_col=text_col, **options).where("representative")
    kept = kept.select(column(id_col).alias("_kept_id"), F.col("text_hash").alias("_kept_hash")).distinct()
    # All columns in one, so that no name can clash.
    whole = F.struct(*(column(name).alias(name) for name in docs.columns))
    rows = docs.select(column(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_hash"), whole.alias("_row"))
    same = F.col("_kept_id").eqNullSafe(F.col("_id")) & (F.col("_kept_hash") == F.col("_hash"))
    stays = rows.join(kept, same).dropDuplicates(["_id", "_hash"])
    return stays.select(*(F.col("_row").getField(name).alias(name) for name in docs.columns))
