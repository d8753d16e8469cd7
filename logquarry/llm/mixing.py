"""Mixing sources to target weights by fitting exact word budgets."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, in_workers, plain_blanks, text_or_empty, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
# At least so many words of a budget are fitted by the knapsack.
LEAST_FITTED = 65_536
RANK_BUCKETS = 256


def source_targets(
    sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> list[float]:
    """How many words each source is to give.

    The sources share ``share`` times all words by weight (the weights repeat). A target stops at ``most`` times the
    source's own size; the excess goes to the others by weight, until none is above.
    """
    weight = [weights[at % len(weights)] for at in range(len(sizes))]
    targets = [0.0] * len(sizes)
    left, active = share * sum(sizes), list(range(len(sizes)))
    while active:
        unit = left / sum(weight[at] for at in active)
        full = [at for at in active if unit * weight[at] > most * sizes[at]]
        if not full:
            for at in active:
                targets[at] = unit * weight[at]
            break
        for at in full:
            targets[at] = float(most * sizes[at])
            left -= targets[at]
        active = [at for at in active if at not in set(full)]
    return targets


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many of the ``counts`` documents of each length to take, so that the words taken come nearest to the budget.

    One rule holds for all sizes: of a budget above twice the longest document (``LEAST_FITTED`` words at least), all but about
    that much is taken in proportion along the lengths, and a bounded knapsack over all documents that are left fits
    the rest. So a budget up to that size is fitted as nearly as any choice of documents can; a larger one is
    missed by no more than half the longest document, and is met wherever the documents that are left can do so.

    In the knapsack the bits of an integer are the sums that can be reached. Lengths are added in seeded order, a
    length's count is split into powers of two, and the steps are followed back from the sum nearest to the rest.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.copy()
    fitted = max(2 * int(lengths.max()), LEAST_FITTED)
    if budget > fitted:
        share = (budget - fitted) / total
        reached = np.floor(np.cumsum(counts) * share).astype(np.int64)
        taken = np.diff(reached, prepend=0)
    rest = budget - int((lengths * taken).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    for at in order:  # what rounding has left beyond what is fitted
        if rest > fitted and lengths[at] > 0:
            more = min(int(counts[at] - taken[at]), (rest - fitted) // int(lengths[at]))
            taken[at] += more
            rest -= more * int(lengths[at])
        elif rest < 0 and taken[at] > 0 and lengths[at] > 0:
            less = min(int(taken[at]), -(rest // int(lengths[at])))
            taken[at] -= less
            rest += less * int(lengths[at])
    if rest <= 0:
        return taken

    limit = 2 * rest
    reach, mask, steps = 1, (1 << (limit + 1)) - 1, []
    for at in order:
        length, left, power = int(lengths[at]), int(counts[at] - taken[at]), 1
        while length and left > 0 and length * power <= limit:
            some = min(power, left)
            steps.append((at, some, reach))
            reach |= (reach << (length * some)) & mask
            left, power = left - some, power * 2
        if reach >> rest & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> rest
    over = rest + (above & -above).bit_length() - 1 if above else None
    goal = over if over is not None and over - rest < rest - below else below
    for at, some, before in reversed(steps):
        if not before >> goal & 1:
            taken[at] += some
            goal -= int(lengths[at]) * some
    return taken


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    seed: int = 1,
    with_text: bool = True,
) -> DataFrame:
    """How often the mix takes each document, so that every source gives its target of words.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn; see ``source_targets``. A source whose
    target reaches its size gives every document once; what then is missing is fitted from the source's
    number of documents of each exact length (``fit_budget``), and among documents of one length those with the
    lowest seeded hash of id and text are taken. No document is taken more than twice.

    Returns the given columns, ``size`` (words), ``source_size``, ``target`` and ``taken`` (words times copies).
    A null text has size 0; a document without words is never taken. Repeated rows are documents of their own. An
    empty table gives an empty result. Columns named like a result are replaced.

    Only counts by source and length reach a source's fit, and its memory is bounded by the lengths that occur and
    twice the longest document. One row per source passes the driver. Ranks among equal lengths are made in 256 buckets, so a hot length
    is split. ``with_text=False`` leaves out the text and then reads it only once.
    """
    spark = docs.sparkSession
    in_workers(spark)
    text = F.col("_text")
    others = [column(name).alias(name) for name in docs.columns if name != text_col]
    source = column(source_col).cast("string")
    rows = docs.select(
        column(id_col).alias("_id"),
        text_or_empty(text_col).alias("_text"),
        F.struct(*others).alias("_row"),
        F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source)).alias("_source"),
    )
    order = F.xxhash64(F.lit(seed), F.col("_id").cast("string"), text)
    rows = rows.select("*", F.size(words_of(plain_blanks(text))).cast("long").alias("_size"), order.alias("_order"))
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_order", 56).cast("int"))
    if not with_text:
        rows = cut(rows.drop("_text"))

    counts = cut(rows.groupBy("_source", "_size", "_bucket").count())
    found = counts.groupBy("_source").agg(F.sum(F.col("_size") * F.col("count")).alias("_total")).collect()
    names = sorted((row["_source"] == "null", row["_source"], int(row["_total"])) for row in found)
    targets = source_targets([total for _, _, total in names], weights, share)
    per_source = spark.createDataFrame(
        [(name, total, target) for (_, name, total), target in zip(names, targets, strict=True)],
        "_source string, _total long, _target double",
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        total, target = int(group["_total"].iloc[0]), float(group["_target"].iloc[0])
        once = int(total > 0 and target >= total)
        group = group.sort_values("_size", ignore_index=True)
        extra = fit_budget(
            group["_size"].to_numpy(), group["_count"].to_numpy(), math.floor(target - once * total + 0.5), seed
        )
        return group.assign(_once=once, _extra=extra)

    by_length = counts.groupBy("_source", "_size").agg(F.sum("count").alias("_count"))
    fitted = (
        by_length.join(per_source, "_source")
        .groupBy("_source")
        .applyInPandas(
            fit,
            "_source string, _size long, _count long, _total long, _target double, _once int, _extra long",
        )
    )
    before = "sum(count) over (partition by _source, _size order by _bucket) - count"
    plan = counts.withColumn("_before", F.expr(before)).drop("count").join(fitted.drop("_count"), ["_source", "_size"])

    joined = rows.join(plan, ["_source", "_size", "_bucket"])
    rank = "row_number() over (partition by _source, _size, _bucket order by _order, _id)"
    copies = F.col("_once") + (F.col("_before") + F.expr(rank) <= F.col("_extra")).cast("int")
    results = {
        "size": F.col("_size"),
        "source_size": F.col("_total"),
        "target": F.col("_target"),
        "taken": (F.col("_size") * F.col("_copies")).cast("long"),
    }
    joined = joined.withColumn("_copies", copies)
    kept = [
        text.alias(name) if name == text_col else F.col("_row").getField(name).alias(name)
        for name in docs.columns
        if name not in results and (with_text or name != text_col)
    ]
    return joined.select(*kept, *(value.alias(name) for name, value in results.items()))
