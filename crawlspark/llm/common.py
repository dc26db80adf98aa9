"""Helpers shared by the training-data operators.

White space means the six ASCII characters ``[\\x20\\x09-\\x0D]`` and a word is a
maximal run of anything else, in every operator of this subpackage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, durable, keep, scratch, shared_dir  # noqa: F401  the operators take them from here

SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"

#: Tables of at most so many rows and bytes may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (cheap to read: durable or tiny) with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes as text.

    Only two numbers come to the driver. A larger table gets no hint: Spark joins it by a shuffle.
    """
    if df.count() > rows:
        return df
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if held <= size else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE + "+"))


def shingle_hashes(tokens: Column, width: int) -> Column:
    """The 64-bit hash of every window of ``width`` tokens, in order; none where there are fewer tokens."""
    return let(
        tokens,
        lambda w: F.when(
            F.size(w) >= width,
            F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def hash01(*cols: Column) -> Column:
    """A 60-bit number that MD5 draws from the columns, the same in every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 15), 16, 10).cast("bigint")


def packed(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``row``, so that no column of it clashes with a helper's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
