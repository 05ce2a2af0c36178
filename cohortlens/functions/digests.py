"""Order-free digests: sums modulo 2**256 of SHA-256 values, as eight sums of 32-bit limbs. They aggregate partially, so no task ever holds
all entries of a key; order does not matter and multiplicity does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summed(df: DataFrame, keys: Sequence[str], digest: Column, count: str | None = None) -> DataFrame:
    """keys, digest: the sum of the rows' digests (64 hexadecimal digits each; null counts for nothing), and their number as ``count``."""
    limb = lambda i: F.coalesce(F.sum(F.conv(F.substring("__d", 8 * i + 1, 8), 16, 10).cast("long")), F.lit(0)).alias(f"__l{i}")
    out = df.withColumn("__d", digest).groupBy(*keys).agg(*([F.count("*").alias(count)] if count else []), *[limb(i) for i in range(8)])
    carry, words = F.lit(0).cast("long"), []
    for i in range(7, -1, -1):
        total = F.col(f"__l{i}") + carry
        words.append(F.lpad(F.lower(F.hex(total.bitwiseAND(0xFFFFFFFF))), 8, "0"))
        carry = F.shiftright(total, 32)
    return out.select(*keys, *([count] if count else []), F.concat(*reversed(words)).alias("digest"))


def entry(name: Column, value: Column) -> Column:
    """The SHA-256 of a name and the exact double beside it; null for a zero of either sign, so that absent entries and zeros agree."""
    exact = F.when(value.isNull(), F.lit("null")).otherwise(value.cast("double").cast("string"))  # the text of a double is its own only
    return F.when(F.coalesce(value != 0, F.lit(True)), F.sha2(F.concat_ws("\x00", name, exact), 256))
