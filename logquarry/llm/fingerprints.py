"""Document fingerprints after I-Match: hashes of the terms in a band of document frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, packed, plain_blanks, spread, text_or_empty, unpacked, wide_hash, words_of

# Terms are numbered by hash in this many slots, so the lexicon is a bit map of fixed size (32 KB).
SLOT_BITS = 18
# The band: terms found in at least and at most this share of the distinct texts.
LOWEST_SHARE, HIGHEST_SHARE = 0.001, 0.1
# A text with at most the first share of its terms in the band is printed from all its terms, from the second share on
# from those in the band alone. Between them the parts change over one by one, so that near copies stay alike.
FEW_IN_BAND, ENOUGH_IN_BAND = 0.1, 0.3
# Randomised lexicons: for each rate, so many disjoint random subsets that hold 1 / rate of the terms each.
RATES = (16, 128, 1024)
SUBSETS_PER_RATE = 16
DIGITS = 4
# What an empty list hashes to.
EMPTY = "002a"
# Documents are put in order through at most so many ranges of ids, each cut further into parts.
ID_RANGES = 256


def _slots(text: Column) -> Column:
    """The distinct slots of a text's words, case ignored."""
    words = words_of(plain_blanks(F.lower(text)))
    mask = F.lit((1 << SLOT_BITS) - 1)
    return F.array_distinct(F.transform(words, lambda word: F.xxhash64(word).bitwiseAND(mask).cast("int")))


def lexicon(texts: DataFrame, lowest: float = LOWEST_SHARE, highest: float = HIGHEST_SHARE) -> DataFrame:
    """One row with the bits of the slots in the band; ``texts`` has the column ``_text``.

    A slot counts once for each distinct text (by 128 bits) that has a word in it, so copies do not push the terms of
    their text out of the band. In small tables a slot of two texts is in the band. Copies are dropped before the
    shuffle as far as they stand in one partition; counts are combined before the shuffle, and there are at
    most ``2 ** 18`` of them.
    """
    first, second = wide_hash(F.col("_text"))
    names = [first.alias("_first"), second.alias("_second")]
    number = texts.select(*names).distinct().count()
    once = texts.select(*names, _slots(F.col("_text")).alias("_slots")).dropDuplicates(["_first", "_second"])
    counts = once.select(F.explode("_slots").alias("_slot")).groupBy("_slot").count()
    inside = F.col("count").between(max(2.0, lowest * number), max(2.0, highest * number))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_slot").bitwiseAND(F.lit(63)))
    filled = counts.where(inside).groupBy(F.shiftright("_slot", 6).alias("_at")).agg(F.bit_or(bit).alias("_bits"))
    every = texts.sparkSession.range(1 << (SLOT_BITS - 6)).select(F.col("id").cast("int").alias("_at"))
    # At most 4,096 numbers, brought together in one row.
    padded = every.join(filled, "_at", "left").select("_at", F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits"))
    row = padded.agg(F.sort_array(F.collect_list(F.struct("_at", "_bits"))).alias("_all"))
    return cut(row.select(F.lit(1).alias("_one"), F.col("_all._bits").alias("_lexicon")))


def with_fingerprint(rows: DataFrame, text_col: str, bits: DataFrame, name: str) -> DataFrame:
    """Add the I-Match fingerprint of a text column.

    The text's distinct terms in the lexicon are sorted. Each random subset of the lexicon gives one part: a hash
    of those terms that fall in the subset. Subsets of several sizes are used, so that long and short texts both have
    subsets with a few of their terms. The lexicon is one row of 32 KB and joins by broadcast.

    A text with no or few terms in the band, such as one of a large family of near copies, is printed from all its terms:
    each part has its own share, from ``FEW_IN_BAND`` to ``ENOUGH_IN_BAND``, below which it takes all terms of its subset.
    """
    names = rows.columns
    slots = rows.select("*", _slots(column(text_col)).alias("_slots"), F.lit(1).alias("_one"))
    joined = slots.join(F.broadcast(bits), "_one")

    def known(slot: Column) -> Column:
        word = F.get(F.col("_lexicon"), F.shiftright(slot, 6))
        return F.call_function("getbit", word, slot.bitwiseAND(F.lit(63))) == 1

    marked = F.transform(F.sort_array("_slots"), lambda slot: F.struct(slot.alias("t"), known(slot).alias("k")))
    terms = joined.select(*names, marked.alias("_terms"))
    inside = F.size(F.filter("_terms", lambda item: item.getField("k")))
    share = inside / F.greatest(F.size("_terms"), F.lit(1))
    terms = terms.select("*", share.alias("_share"))

    def subset(rate: int) -> Column:
        """The terms with their subset, where they have one and it takes them; the terms stay sorted."""
        placed = F.transform(
            F.col("_terms"),
            lambda item: F.struct(
                F.pmod(F.xxhash64(F.lit(rate), item.getField("t")), F.lit(rate)).alias("s"),
                item.getField("t").alias("t"),
                item.getField("k").alias("k"),
            ),
        )
        step = (ENOUGH_IN_BAND - FEW_IN_BAND) / SUBSETS_PER_RATE
        takes_all = lambda at: F.col("_share") <= F.lit(FEW_IN_BAND) + at * F.lit(step)
        return F.filter(
            placed,
            lambda item: (item.getField("s") < SUBSETS_PER_RATE) & (item.getField("k") | takes_all(item.getField("s"))),
        )

    placed = terms.select(*names, *(subset(rate).alias(f"_subset{rate}") for rate in RATES))

    def part(rate: int, at: int) -> Column:
        own = F.filter(f"_subset{rate}", lambda item: item.getField("s") == at)
        return F.xxhash64(F.transform(own, lambda item: item.getField("t")))

    parts = [part(rate, at) for rate in RATES for at in range(SUBSETS_PER_RATE)]
    digits = [F.lower(F.right(F.lpad(F.hex(part), DIGITS, "0"), F.lit(DIGITS))) for part in parts]
    return placed.select(*names, F.concat(*digits).alias(name))


def likeness(one: Column, other: Column) -> Column:
    """Share of equal parts among those that are filled in one of the two fingerprints; 1 for equal fingerprints."""
    places = F.sequence(F.lit(0), F.lit(len(RATES) * SUBSETS_PER_RATE - 1))
    part = lambda text, at: F.substring(text, at * DIGITS + 1, F.lit(DIGITS))
    either = F.filter(places, lambda at: (part(one, at) != EMPTY) | (part(other, at) != EMPTY))
    same = F.filter(places, lambda at: (part(one, at) != EMPTY) & (part(one, at) == part(other, at)))
    ratio = F.size(same) / F.greatest(F.size(either), F.lit(1))
    return F.when(one == other, 1.0).otherwise(ratio).cast("double")


def document_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The given columns and ``fingerprint``; nothing but the terms of distinct texts and their counts is shuffled.

    A null text is as an empty one, and only texts without words share the fingerprint of all-empty parts. Copies
    count as one document. An empty table gives an empty result; a column named like the result
    is replaced.
    """
    rows = packed(docs, id_col, text_col)
    marked = with_fingerprint(rows, "_text", lexicon(rows.select("_text")), "_fingerprint")
    return unpacked(marked, docs.columns, text_col, F.col("_text"), {"fingerprint": F.col("_fingerprint")})


def _in_order(rows: DataFrame) -> DataFrame:
    """Add ``_range``: a number that grows with ``_id``; rows of a range are few enough for one task.

    The borders are approximate quantiles (at most ``ID_RANGES``), each range is cut evenly into parts. Rows
    without an id come into a range below all others.
    """
    found = rows.agg(
        F.min("_id"), F.max("_id"), F.percentile_approx("_id", [at / ID_RANGES for at in range(1, ID_RANGES)], 10_000)
    ).first()
    if found[0] is None:
        return rows.withColumn("_range", F.lit(0).cast("long"))
    borders = sorted({found[0], *found[2], found[1] + 1})
    parts = max(1, -(-4 * spread(rows.sparkSession) // ID_RANGES))
    # The starts of the ranges, and how long each is; at most ID_RANGES literals.
    starts = F.array(*(F.lit(border) for border in borders))
    at = F.size(F.filter(starts, lambda border: border <= F.col("_id")))
    rows = rows.withColumn("_at", at)
    low, high = F.get(starts, F.col("_at") - 1), F.get(starts, F.col("_at"))
    part = F.floor((F.col("_id") - low) * parts / (high - low))
    return rows.withColumn("_range", F.coalesce(F.col("_at") * parts + part, F.lit(0)).cast("long")).drop("_at")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has its last half (rounded down, in code points) replaced by the first as many code
    points of the next document, or by all of it if that is shorter. Next is the document with the next smaller
    integer id; after the smallest comes the largest. Rows of one id are ordered by a hash of their text, and rows
    without an id come last. A single document is next to itself. A null text is as an empty one. An empty table
    gives an empty result.

    Returns the id and ``n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next``.

    Texts are shuffled once, by ranges of ids; a range's largest document is also sent to the range before, so the
    next document is always in the same task.
    """
    rows = docs.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    bits = lexicon(rows)
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    light = _in_order(rows.select("_id", "_tie"))
    # One row per range: its first document, and the range that comes before it. There are at most 4 per partition.
    first = F.max(F.struct("_id", "_tie")).alias("_first")
    heads = light.groupBy("_range").agg(first).collect()
    heads = sorted(((row["_range"], row["_first"]["_id"], row["_first"]["_tie"]) for row in heads), reverse=True)
    before = [(heads[at - 1][0], key, tie) for at, (_, key, tie) in enumerate(heads)]
    spark = docs.sparkSession
    borders = spark.createDataFrame(before, "_range long, _head_id long, _head_tie long").coalesce(1)

    marked = with_fingerprint(_in_order(rows), "_text", bits, "_print")
    is_head = F.col("_id").eqNullSafe(F.col("_head_id")) & (F.col("_tie") == F.col("_head_tie"))
    copies = rows.join(F.broadcast(borders), is_head).dropDuplicates(["_range"]).drop("_head_id", "_head_tie")
    copies = with_fingerprint(copies, "_text", bits, "_print").select(*marked.columns, F.lit(True).alias("_copy"))
    both = marked.withColumn("_copy", F.lit(False)).unionByName(copies)
    order = "over (partition by _range order by _copy, _id desc nulls last, _tie desc)"
    both = both.select(
        "*", F.expr(f"lead(_text) {order}").alias("_next"), F.expr(f"lead(_print) {order}").alias("_next_print")
    ).where(~F.col("_copy"))

    half = F.floor(F.length("_text") / 2).cast("int")
    kept = F.length("_text") - half
    edited = F.concat(
        F.substring(F.col("_text"), F.lit(1), kept), F.substring(F.col("_next"), F.lit(1), half)
    )
    both = both.select("_id", "_text", "_print", "_next_print", edited.alias("_edited"))
    both = with_fingerprint(both, "_edited", bits, "_edited_print")
    return both.select(
        F.col("_id").alias(id_col),
        F.length("_text").cast("long").alias("n_chars"),
        F.col("_edited").alias("edited_text"),
        F.col("_print").alias("fingerprint"),
        F.col("_edited_print").alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"),
        likeness(F.col("_print"), F.col("_next_print")).alias("near_next"),
    )
