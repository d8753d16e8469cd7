"""Groups of copies and families of near copies that hold a large share of the rows."""

import random

import numpy as np
from pyspark.sql import functions as F

import reference

from logquarry.llm import jaccard_join
from logquarry.llm.fingerprints import EMPTY, document_fingerprints, likeness

SCHEMA = "doc_id long, text string"


def words(rng, number, name="w", size=4000):
    return [f"{name}{rng.randrange(size)}" for _ in range(number)]


def test_fingerprints_with_hot_copies_and_a_hot_family(spark):
    """A group of copies and a family of near copies each hold a third of the rows."""
    rng = random.Random(11)
    copy, base = words(rng, 100, "c"), words(rng, 100, "f")
    rows = [(at, " ".join(copy)) for at in range(60)]
    for at in range(60, 120):
        near = list(base)
        near[rng.randrange(100)] = f"edit{at}"
        rows.append((at, " ".join(near)))
    rows += [(at, " ".join(words(rng, 100, size=600))) for at in range(120, 180)]
    rows[121] = (121, " ".join(copy[:50]) + " " + " ".join(words(rng, 50, size=600)))
    rows += [(180, "lonely"), (181, "single"), (182, ""), (183, None)]
    found = document_fingerprints(spark.createDataFrame(rows, SCHEMA))
    prints = {r["doc_id"]: r["fingerprint"] for r in found.collect()}
    empty = EMPTY * 48
    assert {at for at, value in prints.items() if value == empty} == {182, 183}
    assert len({prints[at] for at in range(60)}) == 1
    assert len({prints[at] for at in (0, 60, 122, 180, 181, 182)}) == 6
    pairs = [(at, at + 1) for at in range(60, 119)] + [(0, at) for at in range(60, 180) if at != 121]
    table = spark.createDataFrame([(a, b, prints[a], prints[b]) for a, b in pairs], "a long, b long, one string, other string")
    like = {(r["a"], r["b"]): r["like"] for r in table.select("a", "b", likeness(F.col("one"), F.col("other")).alias("like")).collect()}
    near = [value for (a, _), value in like.items() if a]
    assert min(near) > 0.5 and sum(near) / len(near) > 0.75
    assert max(value for (a, _), value in like.items() if not a) < 0.2


def test_join_keeps_its_recall_in_deep_buckets(spark, monkeypatch):
    """Many texts that share a third of their words are split over many levels; pairs above the threshold still meet."""
    monkeypatch.setattr(jaccard_join, "SMALL", 16)
    monkeypatch.setattr(jaccard_join, "SMALL_BELOW", 16)
    rng = random.Random(8)
    shared = [f"s{at}" for at in range(60)]
    rows, pairs = [], []
    for at in range(1500):
        words = [*shared, *(f"o{rng.randrange(10**6)}" for _ in range(60))]
        rows.append((at, " ".join(words)))
        if at % 10 == 0:
            words[70 + rng.randrange(40)] = "changed"
            words[-1] = "other"
            rows.append((10_000 + at, " ".join(words)))
            pairs.append((at, 10_000 + at))
    levels = []
    run = jaccard_join._run
    monkeypatch.setattr(jaccard_join, "_run", lambda sets, runs: levels.append((out := run(sets, runs))[2]) or out)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {row["doc_id"]: (row["class_id"], row["n_links"]) for row in jaccard_join.jaccard_join(df).collect()}
    alike = [pair for pair in pairs if reference.jaccard_classes([rows_of for rows_of in rows if rows_of[0] in pair])[pair[0]][1]]
    assert len(alike) > 100 and max(levels) >= 7 and len(levels) >= 2
    missed = [pair for pair in alike if found[pair[1]] != (pair[0], 1)]
    assert len(missed) <= 0.01 * len(alike)
    assert all(found[at] == (at, 0) for at in range(1500) if at % 10)


def test_runs_follow_the_depth():
    assert jaccard_join.runs_for() == 3
    for levels in (4, 8, 12, 20):
        runs = jaccard_join.runs_for(levels=levels)
        assert 1 - (1 - jaccard_join.meeting(0.8, levels)) ** runs >= jaccard_join.TARGET_RECALL


def test_estimates_of_size_stay_short_however_deep(spark, monkeypatch):
    """Spark's estimates are products of sizes; with every level they had twice as many digits, until the driver had no memory left."""
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "SMALL_BELOW", 2)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, jaccard_join.PLACES, dtype=np.uint32)
    rows = []
    for at in range(12):
        own = rng.integers(0, 1 << 32, jaccard_join.PLACES, dtype=np.uint32)
        rows.append((f"{at:032x}", bytearray(np.where(rng.random(jaccard_join.PLACES) < 0.8, base, own).astype("<u4").tobytes())))
    sets = spark.createDataFrame(rows, "_node string, _sketch binary").coalesce(2)
    links, deep, levels = jaccard_join._run(sets, range(1))
    estimates = [int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for df in (*links, deep)]
    assert levels >= 6 and max(estimates) < 2**1000
    assert {x for df in links for row in df.collect() for x in row} == {node for node, _ in rows}


def test_family_of_near_copies_in_several_blocks(spark, monkeypatch):
    """Blocks of unequal and odd sizes, compared in pairs, give the links of comparing everything."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 130)
    rng = random.Random(9)
    base, rows = words(rng, 120, "b"), []
    for at in range(700):
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(30)}"
        rows.append((at, " ".join(own)))
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert {row["doc_id"]: (row["class_id"], row["n_links"]) for row in found.collect()} == reference.jaccard_classes(rows)
