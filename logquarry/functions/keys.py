"""Metadata carried by the names of batch files.

A key looks like ``{tenant}/{session}_{trace}_{type}_{hash}_{stamp}_{unique}.jsonl``. The
fields are read from the right because only the trace id may contain underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shape of a usable key, and the label of a key that has no trace id. The
# mark in front makes sure that a key of another shape cannot itself pass for a time.
_PART = "[^/_]*"
_USABLE = (
    f"^!.*_{_PART}_{_PART}_((?!0000)[0-9]{{4}})([0-9]{{2}})([0-9]{{2}})"
    f"T([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})Z_{_PART}$"
)
_MIDDLE = f"^{_PART}(.*)_{_PART}_{_PART}_{_PART}_{_PART}$"
NO_TRACE = "unknown"


def key_fields(key: Column) -> dict[str, Column]:
    """The five fields as columns; ``timestamp`` is null exactly when the key is unusable.

    Every field mentions the key once. Filters on fields end up on the file path of each
    row, where Spark would repeat whatever is mentioned twice. The file suffix belongs to the
    unique part, which is not a field, so it needs no treatment.
    """
    name = F.substring_index(key, "/", -1)

    def from_right(position: int) -> Column:
        return F.substring_index(F.substring_index(name, "_", -position), "_", 1)

    # Nothing or "_{trace}". A slash cannot occur in a name and tells the two cases apart.
    middle = F.concat(F.lit("/"), F.regexp_extract(name, _MIDDLE, 1))
    # ISO text and a cast: unlike a parse by pattern, that is cheap on bad input too.
    stamp = F.regexp_replace(F.concat(F.lit("!"), key), _USABLE, "$1-$2-$3T$4:$5:$6Z")
    return {
        "session_id": F.substring_index(name, "_", 1),
        "trace_id": F.replace(F.replace(middle, F.lit("/_"), F.lit("")), F.lit("/"), F.lit(NO_TRACE)),
        "trace_type": from_right(4),
        "input_hash": from_right(3),
        "timestamp": stamp.try_cast("timestamp"),
    }


def with_key_meta(df: DataFrame, key_col: str = "key") -> DataFrame:
    """Add the five fields and drop the rows whose key cannot be read."""
    fields = key_fields(F.col(key_col))
    return df.withColumns(fields).where(F.col("timestamp").isNotNull())
