"""Ranks, running sums and exact quantiles over any number of rows: sums of buckets that follow the order, then windows within a bucket, so
that no task sees all rows. Buckets are cut at sampled values of the order itself, so they are even however the values lie (ids with one
common prefix, scores in a narrow band); hashes may use their first digits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a bucket, about; and the most buckets: their sums are windowed in one task.
BUCKET_ROWS, BUCKETS = 50_000, 1024
#: Sampled values for each bucket.
SAMPLED = 32


def cuts(df: DataFrame, key: Column, bucket_rows: int = BUCKET_ROWS) -> list:
    """Values of key that part its rows about evenly, in order. From a sample of the distinct values by their hash, of bounded size in
    expectation (a value stands for all its rows, so one that fills a bucket by itself is a cut of its own)."""
    keyed = df.select(key.alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    rows, values = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = min(BUCKETS, -(-rows // bucket_rows))
    if buckets < 2:
        return []
    every = max(1, values // (SAMPLED * buckets))
    sample = sorted((r["k"], r["n"]) for r in keyed.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).collect())
    total, seen, due, out = sum(n for _, n in sample), 0, 1, []
    for k, n in sample:
        if seen * buckets >= due * total:
            out.append(k)
            due = seen * buckets // total + 1
        seen += n
    return out


def bucket_of(key: Column, bounds: list, first: int = 0) -> Column:
    """The number of bounds at or below key, by halving; null stays null."""
    if not bounds:
        return F.when(key.isNotNull(), F.lit(first))
    m = len(bounds) // 2
    return F.when(key < bounds[m], bucket_of(key, bounds[:m], first)).otherwise(bucket_of(key, bounds[m + 1:], first + m + 1))


def running(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str], sums: Sequence[str]) -> DataFrame:
    """df with cum_<c>, the sum of column c up to and with each row along order, within keys (null is a key too). bucket must rise with
    order: of two rows in different buckets the one in the smaller comes first."""
    x = df.withColumn("__b", bucket)
    per = x.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__k_b"), *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__s_{c}") for c in sums])
    same = F.equal_null("__b", "__k_b")
    for k in keys:
        same = same & F.equal_null(k, f"__k_{k}")
    upto = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return x.join(per, same).select(*df.columns, *[(F.sum(c).over(upto) + F.col(f"__s_{c}")).alias(f"cum_{c}") for c in sums])


def ranked(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """df with the number of each row along order, from 1, within keys."""
    x = running(df.withColumn("__one", F.lit(1)), keys, bucket, order, ["__one"])
    return x.withColumn(name, F.col("cum___one").cast("long")).drop("__one", "cum___one")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """keys and a column for each share: the exact quantile of the values that are not null, between neighbours in proportion. Counts of
    distinct values and their running sums in place of a sorted buffer for each key: a key may hold all rows. Keys without values have no row."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    c = running(g, keys, bucket_of(F.col("__v"), cuts(g, F.col("__v"), bucket_rows)), ["__v"], ["__n"])
    total = g.groupBy(*[F.col(k).alias(f"__t_{k}") for k in keys]).agg(F.sum("__n").alias("__total")) if keys else g.agg(F.sum("__n").alias("__total"))
    same = F.lit(True)
    for k in keys:
        same = same & F.equal_null(k, f"__t_{k}")
    x = c.join(total, same)
    at = {name: F.lit(float(p)) * (F.col("__total") - 1) for name, p in shares.items()}
    value_at = lambda rank: F.min(F.when(F.col("cum___n") > rank, F.col("__v")))  # noqa: E731  the value of this rank, from 0
    ends = x.groupBy(*keys).agg(
        F.max("__total").alias("__total"), *[value_at(F.floor(a)).alias(f"__low_{n}") for n, a in at.items()], *[value_at(F.ceil(a)).alias(f"__high_{n}") for n, a in at.items()])
    part = {n: a - F.floor(a) for n, a in at.items()}
    return ends.select(*keys, *[((1 - part[n]) * F.col(f"__low_{n}") + part[n] * F.col(f"__high_{n}")).alias(n) for n in shares])


def with_group(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """df with aggregates of each row's group. The groups are aggregated (partially, where the rows lie) and joined back: a window by group
    would bring all rows of one into a task."""
    per = df.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys]).agg(*[a.alias(n) for n, a in aggregates.items()])
    same = F.lit(True)
    for k in keys:
        same = same & F.equal_null(k, f"__g_{k}")
    return df.join(per, same).select(*df.columns, *aggregates)
