"""Contracts of a study and confounding diagnostics, each a table of violations or figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digests import entry, summed
from ..functions.ranks import quantiles


def encode_outcome(metadata: DataFrame, outcome: str, positive: str | None = None) -> DataFrame:
    """label, code: labels in sorted order from 0, the positive one last. The label dimension is one row a class."""
    labels = metadata.select(F.col(outcome).cast("string").alias("label")).where("label is not null").distinct()
    last = F.when(F.col("label") == positive, 1).otherwise(0) if positive is not None else F.lit(0)
    return labels.select("label", (F.dense_rank().over(W.orderBy(last, "label")) - 1).cast("long").alias("code"))


def missing_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, violations: null or blank values of required columns, in one pass."""
    blank = [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns]
    return df.agg(*blank).unpivot([], list(columns), "column", "violations")


def variant_columns(cells: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """column, violations: number of keys within which a column is not constant."""
    per = cells.groupBy(key).agg(*[F.count_distinct(c).alias(c) for c in columns])
    return per.agg(*[F.count_if(F.col(c) > 1).alias(c) for c in columns]).unpivot([], list(columns), "column", "violations")


def first_per_key(cells: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row a key; equal to any row of it once variant_columns has found nothing."""
    return cells.groupBy(key).agg(*[F.min(c).alias(c) for c in columns])


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side: empty if the key sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def count_contract(long: DataFrame) -> DataFrame:
    """long: sample_id, feature_id, value. check_id, violations of raw counts."""
    v = F.col("value")
    per_value = long.agg(
        F.count_if(v.isNull() | F.isnan(v)).alias("missing"), F.count_if(v < 0).alias("negative"), F.count_if(F.abs(v - F.rint(v)) > 1e-6).alias("fractional"), F.count_if(F.abs(v) == float("inf")).alias("infinite"),
    ).unpivot([], ["missing", "negative", "fractional", "infinite"], "check_id", "violations")
    empty = long.groupBy("sample_id").agg(F.sum("value").alias("library")).agg(F.count_if(F.col("library") <= 0).alias("violations")).select(F.lit("empty_library").alias("check_id"), "violations")
    return per_value.unionByName(empty)


def dataset_contract(metadata: DataFrame, features: DataFrame, group: str) -> DataFrame:
    """check_id, violations: blank or duplicate ids, and fewer than 4 samples, 1 feature or 4 groups."""
    one = lambda name, df, c: df.agg(c.cast("long").alias("violations")).select(F.lit(name).alias("check_id"), "violations")
    dup = lambda df, key: df.groupBy(key).count().where("count > 1")
    blank = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c)) == ""))
    parts = [
        one("blank_sample_id", metadata, blank("sample_id")), one("blank_group", metadata, blank(group)), one("duplicate_sample_id", dup(metadata, "sample_id"), F.count("*")), one("duplicate_feature_id", dup(features, "feature_id"), F.count("*")),
        one("few_samples", metadata, F.count("*") < 4), one("few_features", features, F.count("*") < 1), one("few_groups", metadata, F.count_distinct(group) < 4),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_digests(long: DataFrame) -> DataFrame:
    """sample_id, digest of each sample's values that are not zero, whatever their order."""
    return summed(long, ["sample_id"], entry(F.col("feature_id"), F.col("value")))


def profile_duplicates(long: DataFrame, groups: DataFrame) -> DataFrame:
    """digest, n_groups, n_samples of identical profiles in different groups. groups: sample_id, group. Values are compared exactly; a zero
    of either sign is as good as an absent value, a null is not."""
    return profile_digests(long).join(groups, "sample_id").groupBy("digest").agg(F.count_distinct("group").alias("n_groups"), F.count("*").alias("n_samples")).where("n_groups > 1")


def pearson(x: Column, y: Column) -> Column:
    """An aggregate that is null, not an error, on constant input."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    sx, sy = F.sum(x), F.sum(y)
    vx, vy = F.sum(x * x) - sx * sx / n, F.sum(y * y) - sy * sy / n
    return F.when((vx > 1e-12) & (vy > 1e-12), (F.sum(x * y) - sx * sy / n) / F.sqrt(F.when((vx > 1e-12) & (vy > 1e-12), vx * vy)))


def target_copies(long: DataFrame, target: DataFrame, n_classes: int | None, min_count: float | None = None) -> DataFrame:
    """feature_id, n_distinct, r, copies_target. target: sample_id, y. With classes only features of at most so many values are tested;
    continuous targets test all. With min_count, counts that never reach it are not tested: no fold can use them."""
    j = long.join(target, "sample_id")
    out = j.groupBy("feature_id").agg(F.count_distinct("value").alias("n_distinct"), pearson(F.col("value"), F.col("y")).alias("r"), F.max("value").alias("__most"))
    few = F.col("n_distinct") <= n_classes if n_classes else F.lit(True)
    few = few & (F.col("__most") >= min_count) if min_count is not None else few
    return out.withColumn("copies_target", F.coalesce(few & (F.abs("r") > 1 - 1e-12), F.lit(False))).drop("__most")


def covariate_leakage(metadata: DataFrame, covariates: Sequence[str], outcome: str) -> DataFrame:
    """covariate, levels, high_cardinality (more than max(10, n / 2)), determines_outcome."""
    n = metadata.count()
    long = metadata.select(F.col(outcome).alias("y"), *[F.col(c).cast("string").alias(c) for c in covariates]).unpivot(["y"], list(covariates), "covariate", "level")
    per = long.groupBy("covariate", "level").agg(F.count_distinct("y").alias("k"))
    return per.groupBy("covariate").agg(F.count("*").alias("levels"), F.max("k").alias("k")).select("covariate", "levels", (F.col("levels") > max(10, n / 2)).alias("high_cardinality"), (F.col("k") == 1).alias("determines_outcome"))


def ids_with_labels(metadata: DataFrame, labels: DataFrame, min_length: int = 3) -> DataFrame:
    """sample_id, label: ids that contain a class label, ignoring case. labels is the class dimension."""
    long = F.broadcast(labels.where(F.length("label") >= min_length).select("label"))
    return metadata.select("sample_id").join(long, F.contains(F.lower("sample_id"), F.lower("label")))


def library_outliers(libraries: DataFrame) -> DataFrame:
    """libraries: sample_id, library. Adds deviation and outlier: |log1p - median| > max(5 * 1.4826 * MAD, 1.5)."""
    x = libraries.withColumn("log_library", F.log1p("library"))
    x = x.join(F.broadcast(quantiles(x, [], "log_library", {"__m": 0.5}))).withColumn("deviation", F.abs(F.col("log_library") - F.col("__m"))).drop("__m")  # one row
    x = x.join(F.broadcast(quantiles(x, [], "deviation", {"__d": 0.5})))
    return x.withColumn("outlier", F.col("deviation") > F.greatest(F.lit(5 * 1.4826) * F.col("__d"), F.lit(1.5))).drop("__d")


def class_balance(metadata: DataFrame, outcome: str, group: str) -> DataFrame:
    """label, groups, samples, share, few_groups (< 4), imbalanced (smallest share < 0.2)."""
    per = metadata.groupBy(F.col(outcome).alias("label")).agg(F.count_distinct(group).alias("groups"), F.count("*").alias("samples"))
    whole = W.partitionBy(F.lit(1))
    per = per.withColumn("share", F.col("samples") / F.sum("samples").over(whole))
    return per.withColumn("few_groups", F.col("groups") < 4).withColumn("imbalanced", F.min("share").over(whole) < 0.2)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long cross-tabulation a, b, n."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: cramers_v (uncorrected, null for a single row or column) and purity (share of the largest b of each a)."""
    t = crosstab(df, a, b)
    t = t.withColumn("ra", F.sum("n").over(W.partitionBy(a))).withColumn("cb", F.sum("n").over(W.partitionBy(b)))
    # chi2 / n = sum(n^2 / (row * column)) - 1, absent combinations included
    g = t.agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("q"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    best = t.groupBy(a).agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg((F.sum("m") / F.sum("n")).alias("purity"))
    k = F.least("r", "c") - 1
    return g.select(F.when(k > 0, F.sqrt(F.greatest(F.col("q") - 1, F.lit(0.0)) / F.when(k > 0, k))).alias("cramers_v")).join(F.broadcast(best))


def eta_squared(df: DataFrame, batch: str, y: str) -> DataFrame:
    """Share of the variance of y between batches, weighted by rows."""
    per = df.where(F.col(y).isNotNull()).groupBy(batch).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    whole = F.broadcast(per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("__m")))  # one row
    off = F.col("n") * (F.col("m") - F.col("__m")) * (F.col("m") - F.col("__m"))
    g = per.join(whole).agg(F.sum(off).alias("between"), (F.sum(off) + F.sum(F.col("n") * F.col("v"))).alias("all"))
    return g.select(F.when(F.col("all") > 0, F.col("between") / F.when(F.col("all") > 0, F.col("all"))).alias("eta_squared"))


def group_overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys found on both sides (must be empty)."""
    return train.select(key).intersect(test.select(key))


def list_hash(df: DataFrame, key: str) -> DataFrame:
    """One row: SHA-256 of the sorted distinct identifiers as JSON."""
    return df.agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.col(key).cast("string")))), 256).alias("digest"))
