"""Training-only preparation of a long matrix (sample_id, feature_id, value).

Every fitted state is a table aggregated over the training rows alone (``train``: sample_id of the training side) and
applied to all rows by joins, so nothing of a held-out sample can reach it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_cpm(long: DataFrame) -> DataFrame:
    """log2(1 + 1e6 * value / library), libraries over the whole feature universe; null for empty libraries."""
    lib = F.sum("value").over(W.partitionBy("sample_id"))
    return long.withColumn("__lib", lib).select("sample_id", "feature_id", F.log2(1 + 1e6 * F.col("value") / F.when(F.col("__lib") > 0, F.col("__lib"))).alias("value"))


def median_ratio_reference(long: DataFrame, train: DataFrame) -> DataFrame:
    """feature_id, reference: geometric mean of features positive in every training sample."""
    n = train.select("sample_id").distinct().count()
    x = long.join(train.select("sample_id"), "sample_id", "left_semi").where("value > 0")
    return x.groupBy("feature_id").agg(F.exp(F.avg(F.log("value"))).alias("reference"), F.count("*").alias("k")).where(F.col("k") == n).drop("k")


def median_ratio(long: DataFrame, reference: DataFrame) -> DataFrame:
    """log2(1 + value / factor), the factor being the median ratio of positive values to the frozen reference."""
    ratio = long.where("value > 0").join(reference, "feature_id").groupBy("sample_id").agg(F.median(F.col("value") / F.col("reference")).alias("factor"))
    return long.join(ratio, "sample_id").select("sample_id", "feature_id", F.log2(1 + F.col("value") / F.col("factor")).alias("value"))


def impute_median(long: DataFrame, train: DataFrame) -> DataFrame:
    """Null values become the training median of the feature, 0 where it has none."""
    fill = long.join(train.select("sample_id"), "sample_id", "left_semi").groupBy("feature_id").agg(F.median("value").alias("fill"))
    return long.join(fill, "feature_id", "left").select("sample_id", "feature_id", F.coalesce("value", "fill", F.lit(0.0)).alias("value"))


def scaler(long: DataFrame, train: DataFrame) -> DataFrame:
    """feature_id, center, scale: training mean and population deviation, 1 for constants."""
    x = long.join(train.select("sample_id"), "sample_id", "left_semi").groupBy("feature_id").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("sd"))
    return x.select("feature_id", "center", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0).alias("scale"))


def standardize(long: DataFrame, state: DataFrame) -> DataFrame:
    return long.join(state, "feature_id").select("sample_id", "feature_id", ((F.col("value") - F.col("center")) / F.col("scale")).alias("value"))


def prevalence(long: DataFrame, train: DataFrame, min_count: float, min_prevalence: float) -> DataFrame:
    """feature_id, prevalence of features counted at least min_count in enough training samples."""
    x = long.join(train.select("sample_id"), "sample_id", "left_semi")
    return x.groupBy("feature_id").agg(F.avg((F.col("value") >= min_count).cast("double")).alias("prevalence")).where(F.col("prevalence") >= min_prevalence)


def observed(long: DataFrame, train: DataFrame, max_missing: float) -> DataFrame:
    """feature_id, observed share of features not missing too often in training samples, nor always."""
    x = long.join(train.select("sample_id"), "sample_id", "left_semi")
    return x.groupBy("feature_id").agg((F.count("value") / F.count("*")).alias("observed")).where((F.col("observed") >= 1 - max_missing) & (F.col("observed") > 0))


def variable(normalized: DataFrame, train: DataFrame, floor: float = 1e-12) -> DataFrame:
    """feature_id, variance (population) over training samples, above the floor."""
    x = normalized.join(train.select("sample_id"), "sample_id", "left_semi")
    return x.groupBy("feature_id").agg(F.var_pop("value").alias("variance")).where(F.col("variance") > floor)


def f_class(normalized: DataFrame, target: DataFrame) -> DataFrame:
    """feature_id, score: one-way ANOVA F over classes. target: sample_id, y of the training samples."""
    g = normalized.join(target, "sample_id").groupBy("feature_id", "y").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    t = g.groupBy("feature_id").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("ss") - F.col("b")
    ok = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (within > 1e-12)
    return t.select("feature_id", F.when(ok, (between / (F.col("k") - 1)) / F.when(ok, within / (F.col("n") - F.col("k")))).alias("score"))


def f_regression(normalized: DataFrame, target: DataFrame) -> DataFrame:
    """feature_id, score: r^2 / (1 - r^2) * (n - 2)."""
    from .contracts import pearson

    t = normalized.join(target, "sample_id").groupBy("feature_id").agg(pearson(F.col("value"), F.col("y")).alias("r"), F.count("*").alias("n"))
    return t.select("feature_id", F.try_divide(F.col("r") * F.col("r"), 1 - F.col("r") * F.col("r")).alias("q"), "n").select("feature_id", (F.col("q") * (F.col("n") - 2)).alias("score"))


def top_features(scores: DataFrame, k: int | None) -> DataFrame:
    """feature_id, score, position: the k best (all, if None), ties by universe order, in universe order from 1."""
    best = scores if k is None else scores.withColumn("__k", F.row_number().over(W.orderBy(F.desc_nulls_last("score"), "feature_id"))).where(F.col("__k") <= k).drop("__k")
    return best.withColumn("position", F.row_number().over(W.orderBy("feature_id")).cast("long"))


def restrict(features: DataFrame, allowed: DataFrame) -> DataFrame:
    return features.join(allowed.select("feature_id"), "feature_id", "left_semi")


def encode_covariates(metadata: DataFrame, train: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """sample_id, column, value: one-hot with the first sorted training level dropped, numbers as they are, both scaled by
    training mean and population deviation. A level that training lacks is an error."""
    fit = metadata.join(train.select("sample_id"), "sample_id", "left_semi")
    columns = {}
    for c in covariates:
        if dict(metadata.dtypes)[c] in ("double", "float", "int", "bigint"):
            columns[c] = F.col(c).cast("double")
            continue
        levels = sorted(r[0] for r in fit.select(c).distinct().collect())  # a covariate has few levels
        if not metadata.where(~F.col(c).isin(levels)).isEmpty():
            raise ValueError(f"{c}: a level is missing from training")
        for level in levels[1:]:
            columns[f"{c}={level}"] = (F.col(c) == level).cast("double")
    long = metadata.select("sample_id", *[v.alias(k) for k, v in columns.items()]).unpivot(["sample_id"], list(columns), "feature_id", "value")
    return standardize(long, scaler(long, train)).withColumnRenamed("feature_id", "column")
