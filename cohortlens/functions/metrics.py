"""Weighted evaluation metrics of scored rows as DataFrame aggregates; undefined cases are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import bucket_of, cuts, running

EPS = 2.220446049250313e-16


def group_weights(rows: DataFrame, group: str) -> DataFrame:
    """rows with w: 1 / size of the row's group, scaled to mean 1 (the sum of 1 / size is the number of groups)."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
    scale = F.broadcast(sizes.agg((F.sum("__n") / F.count("*")).alias("__s")))  # one row
    return rows.join(sizes, F.equal_null(rows[group], sizes[group])).drop(sizes[group]).join(scale).withColumn("w", F.col("__s") / F.col("__n")).drop("__s", "__n")


def mean_of(x: Column) -> Column:
    return F.sum(F.col("w") * x) / F.sum("w")


def log_loss(rows: DataFrame) -> DataFrame:
    """rows: y (0/1), p, w."""
    p = F.greatest(F.least(F.col("p"), F.lit(1 - EPS)), F.lit(EPS))
    return rows.agg(mean_of(-F.log(F.when(F.col("y") == 1, p).otherwise(1 - p))).alias("log_loss"))


def regression(rows: DataFrame) -> DataFrame:
    """rows: y, p, w -> rmse, mae, r2 (null for constant y)."""
    e = F.col("y") - F.col("p")
    g = rows.agg(mean_of(e * e).alias("mse"), mean_of(F.abs(e)).alias("mae"), mean_of(F.col("y")).alias("m"), mean_of(F.col("y") * F.col("y")).alias("q"))
    v = F.col("q") - F.col("m") * F.col("m")
    return g.select(F.sqrt("mse").alias("rmse"), "mae", F.when(v > 1e-12, 1 - F.col("mse") / F.when(v > 1e-12, v)).alias("r2"))


def confusion(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rows: y, p, w -> tp, fp, tn, fn and what follows from them."""
    hard, y = F.col("p") >= threshold, F.col("y") == 1
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0.0))
    c = rows.agg(part(hard & y).alias("tp"), part(hard & ~y).alias("fp"), part(~hard & ~y).alias("tn"), part(~hard & y).alias("fn"))
    sens, spec = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    mcc = (F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    one_sided = (F.col("tp") + F.col("fp") == 0) | (F.col("tn") + F.col("fn") == 0)
    return c.select("*", sens.alias("sensitivity"), spec.alias("specificity"), F.when(both, (sens + spec) / 2).alias("balanced_accuracy"), F.when(both & one_sided, F.lit(0.0)).when(both, mcc).alias("mcc"))


def _steps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """tp and fp of each distinct score within keys, and their running sums by falling score."""
    hit, miss = F.when(F.col("y") == 1, F.col("w")).otherwise(0.0), F.when(F.col("y") == 1, 0.0).otherwise(F.col("w"))
    g = rows.groupBy(*keys, "p").agg(F.sum(hit).alias("tp"), F.sum(miss).alias("fp"))
    return running(g, keys, -bucket_of(F.col("p"), cuts(g, F.col("p"))), [F.desc("p")], ["tp", "fp"])


def curve(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cumulative weighted counts by falling score, ties collapsed, within keys: p, tp, fp, cum_tp, cum_fp."""
    return _steps(rows, keys or [])


def ranking(rows: DataFrame) -> DataFrame:
    """roc_auc (ties half) and average_precision, null with one class only."""
    c = curve(rows)
    t = F.sum("tp")
    area = F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2))
    ap = F.sum(F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")))
    return c.agg(F.try_divide(area, t * F.sum("fp")).alias("roc_auc"), F.when(F.sum("fp") > 0, F.try_divide(ap, t)).alias("average_precision"))


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(mean_of((F.col("p") - F.col("y")) ** 2).alias("brier_score"), mean_of(F.col("y").cast("double")).alias("prevalence"))


def calibration_bin(p: Column, bins: int = 5) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def calibration(rows: DataFrame, bins: int = 5, keys: list[str] | None = None) -> DataFrame:
    """bin, mean_probability, observed_fraction, n_rows, weight, within keys."""
    return rows.groupBy(*(keys or []), calibration_bin(F.col("p"), bins).alias("bin")).agg(
        mean_of(F.col("p")).alias("mean_probability"), mean_of(F.col("y").cast("double")).alias("observed_fraction"), F.count("*").alias("n_rows"), F.sum("w").alias("weight"))


def one_vs_rest(rows: DataFrame) -> DataFrame:
    """rows: y, probs (array), w -> long class, y (0/1), p, w."""
    return rows.select(F.col("y").alias("__y"), "w", F.posexplode("probs").alias("class", "p")).select("class", (F.col("__y") == F.col("class")).cast("int").alias("y"), "p", "w")


def macro_ranking(rows: DataFrame) -> DataFrame:
    """Unweighted means of one-vs-rest AUC and average precision, and the summed Brier score."""
    long = one_vs_rest(rows)
    per = _steps(long, ["class"]).groupBy("class").agg(
        F.try_divide(F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2)), F.sum("tp") * F.sum("fp")).alias("auc"), F.try_divide(F.sum(F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))), F.sum("tp")).alias("ap"))
    means = per.agg(F.when(F.count("auc") == F.count("*"), F.avg("auc")).alias("roc_auc_macro_ovr"), F.when(F.count("ap") == F.count("*"), F.avg("ap")).alias("pr_auc_macro_ovr"))
    n = long.agg((F.sum(F.col("w") * (F.col("p") - F.col("y")) ** 2) / F.sum(F.when(F.col("class") == 0, F.col("w")))).alias("brier_multiclass_sum"))
    return means.join(F.broadcast(n))


def multiclass(rows: DataFrame) -> DataFrame:
    """rows: y (class), probs, w -> log_loss, accuracy, and balanced_accuracy and mcc, null unless every class is observed."""
    p = F.greatest(F.least(F.element_at("probs", F.col("y") + 1), F.lit(1 - EPS)), F.lit(EPS))
    x = rows.select("y", "w", hard_label(F.col("probs")).alias("h"), (-F.log(p)).alias("l"), F.size("probs").alias("k"))
    cells = x.groupBy("y", "h").agg(F.sum("w").alias("n"))  # classes x classes
    t = cells.groupBy("y").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("y") == F.col("h"), F.col("n")).otherwise(0.0)).alias("c"))
    predicted = cells.groupBy(F.col("h").alias("y")).agg(F.sum("n").alias("p"))
    sums = t.join(predicted, "y", "full").agg(
        F.avg(F.col("c") / F.col("t")).alias("recall"), F.count("t").alias("seen"), F.sum("t").alias("s"), F.sum("c").alias("c"), F.sum(F.coalesce("p", F.lit(0.0)) * F.coalesce("t", F.lit(0.0))).alias("pt"),
        F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    whole = x.agg(mean_of(F.col("l")).alias("log_loss"), mean_of((F.col("h") == F.col("y")).cast("double")).alias("accuracy"), F.max("k").alias("k"))
    spread = (F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt"))
    mcc = F.when(spread > 0, (F.col("c") * F.col("s") - F.col("pt")) / F.sqrt(F.when(spread > 0, spread))).otherwise(0.0)
    every = F.col("seen") == F.col("k")
    return whole.join(F.broadcast(sums)).select("log_loss", "accuracy", F.when(every, F.col("recall")).alias("balanced_accuracy"), F.when(every, mcc).alias("mcc"))


def hard_label(probs: Column) -> Column:
    """Index of the first largest probability."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def benjamini_hochberg(tests: DataFrame, pvalue: str = "p", family: list[str] | None = None) -> DataFrame:
    """tests with padj, monotone and at most 1, within each family; null p-values stay null and count for nothing."""
    keys, p = list(family or []), F.col("__p")
    g = tests.where(F.col(pvalue).isNotNull()).groupBy(*keys, F.col(pvalue).alias("__p")).agg(F.count("*").alias("__n"))  # equal p-values share a rank
    g = running(g.withColumn("__b", bucket_of(p, cuts(g, p))), keys, F.col("__b"), ["__p"], ["__n"])
    size = g.groupBy(*[F.col(k).alias(f"__f_{k}") for k in keys]).agg(F.max("cum___n").alias("__m")) if keys else g.agg(F.max("cum___n").alias("__m"))
    g = g.join(size, _same(keys)).drop(*[f"__f_{k}" for k in keys]).withColumn("__q", p * F.col("__m") / F.col("cum___n"))
    after = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__b").rowsBetween(1, W.unboundedFollowing)
    later = g.groupBy(*keys, "__b").agg(F.min("__q").alias("__q_b")).select(*[F.col(k).alias(f"__f_{k}") for k in keys], F.col("__b").alias("__f___b"), F.min("__q_b").over(after).alias("__later"))
    own = F.min("__q").over(W.partitionBy(*keys, "__b").orderBy("__p").rowsBetween(W.currentRow, W.unboundedFollowing))
    g = g.withColumn("__own", own).join(later, _same([*keys, "__b"]))
    adjusted = g.select(*[F.col(k).alias(f"__f_{k}") for k in keys], F.col("__p").alias(f"__f_{pvalue}"), F.least("__own", "__later", F.lit(1.0)).alias("padj"))
    return tests.join(adjusted, _same([*keys, pvalue]), "left").select(*tests.columns, "padj")


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.equal_null(k, f"__f_{k}")
    return out


def permutation_pvalue(losses: DataFrame, observed: str = "perm_id = 0") -> DataFrame:
    """losses: perm_id, statistic (higher is better). p = (1 + #{null >= observed - 1e-12}) / (1 + permutations)."""
    obs = losses.where(observed).select(F.col("statistic").alias("obs"))
    return losses.where(f"not ({observed})").join(F.broadcast(obs)).agg(((1 + F.count_if(F.col("statistic") >= F.col("obs") - 1e-12)) / (1 + F.count("*"))).alias("pvalue"))
