"""Queries of the fits: no SQL form, so rows only here and tests against references elsewhere. Embeddings serve as a feature
matrix, their labels in two or three classes as outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..operators import contracts as K
from ..operators import evidence as E
from ..operators import expression_tests as X
from ..operators import fits as T
from ..operators import prep as P
from ..sources.shared import written
from ..sources.study import study, table
from . import contract_queries as kq

Q: dict = {}
SQL: dict[str, str] = {}
BASE = dict(outcome="y", group="g", batch="b", input_scale="features", normalization="none", outer_folds=3, inner_folds=2, strengths=(0.02, 0.1), l1_ratios=(0.5,), stability_resamples=6, permutations=3, max_features=20)

BASE_TOLERANCE = Config().coefficient_tolerance


def query(f):
    Q[f.__name__] = f
    return f


def fit_study(spark, d, kind="binary"):
    """(long, samples, configuration, classes) of the embeddings."""
    e = table(spark, d, "embeddings").where("label is not null")
    label = {"binary": F.when(F.col("label") < 5, "low").otherwise("high"), "multiclass": (F.col("label") % 3).cast("string"), "continuous": F.col("label").cast("double")}[kind]
    name = F.col("vec_id").cast("string")
    samples = e.select(name.alias("sample_id"), name.alias("group"), (F.col("vec_id") % 3).cast("string").alias("batch"), label.alias("label"))
    long = e.select(name.alias("sample_id"), F.posexplode("embedding").alias("i", "v")).select("sample_id", F.format_string("f%02d", F.col("i")).alias("feature_id"), F.col("v").cast("double").alias("value"))
    config = Config(**(BASE | {"outcome_type": kind}))
    if kind == "continuous":
        return long, samples.withColumnRenamed("label", "y"), config, 0
    codes = K.encode_outcome(samples, "label")
    return long, samples.join(F.broadcast(codes), "label").withColumn("y", F.col("code").cast("double")).drop("code"), config, codes.count()  # classes


def validation(spark, d, kind="binary"):
    long, samples, config, classes = fit_study(spark, d, kind)
    return T.Fits(long, T.outer_sides(samples, config), config, classes).predictions().join(samples.select("sample_id", "y"), "sample_id").select("sample_id", "y", "repeat", "fold", "class", "p", "baseline")


def whole_fit(spark, d, stage, points=None, allowed=None):
    """Fits of all rows: tuned, or at points [(strength, l1_ratio)]."""
    long, samples, config, classes = fit_study(spark, d)
    chosen = spark.createDataFrame([(f"{stage}:0:0:0", float(s), float(r)) for s, r in points], "unit string, strength double, l1_ratio double") if points else None
    return T.Fits(long, T.whole_side(samples, stage), config, classes, held_out=False, chosen=chosen, allowed=allowed)


def stability(spark, d):
    long, samples, config, classes = fit_study(spark, d)
    return T.Fits(long, T.stability_sides(samples, config), config, classes, held_out=False)


@query
def val1_nested_validation(spark, d):
    return validation(spark, d)


@query
def mod8_multiclass_validation(spark, d):
    return validation(spark, d, "multiclass")


@query
def mod6_continuous_validation(spark, d):
    return validation(spark, d, "continuous")


@query
def mod12_tuning(spark, d):
    return whole_fit(spark, d, "final").tuning.drop("context")


@query
def val2_permutation_control(spark, d):
    long, samples, config, classes = fit_study(spark, d)
    return T.Fits(long, T.outer_sides(samples, config, config.permutations), config, classes).losses()


@query
def val3_leave_batch_out(spark, d):
    long, samples, config, classes = fit_study(spark, d)
    return T.Fits(long, T.batch_sides(samples), config, classes).fits.select("fold", "loss", "baseline_loss", "converged", "error")


@query
def stb1_stability_selection(spark, d):
    return E.stability_summary(stability(spark, d).coefficients(), BASE_TOLERANCE)


@query
def pan1_panel_refit(spark, d):
    resamples = stability(spark, d)
    panel = written(E.select_panel(E.stability_summary(resamples.coefficients(), BASE_TOLERANCE), 0.5, 0.5, 10).select("feature_id"), "panel")  # at most 10 rows
    best = E.modal_parameters(resamples.fits.where("error is null")).first()
    return whole_fit(spark, d, "panel", [(best["strength"], best["l1_ratio"])], panel).coefficients()


@query
def pth1_coefficient_path(spark, d):
    return whole_fit(spark, d, "path", [(s, 0.5) for s in (0.01, 0.05, 0.2)]).fits.select("strength", F.size("coefs").alias("n_selected"))


@query
def de1_count_tests(spark, d):
    s = study(spark, d)
    return X.differential_expression(kq.expression(s), kq.metadata(s).select("sample_id", "outcome"), "outcome")


@query
def mod4_expression_screen(spark, d):
    """Adjusted p-values of the genes in each of three training sides, whole nations held out."""
    s = study(spark, d)
    meta = written(kq.metadata(s).select("sample_id", F.col("donor").alias("group"), "batch", F.col("outcome").alias("label")), "metadata")
    codes = K.encode_outcome(meta, "label")
    samples = meta.join(F.broadcast(codes), "label").withColumn("y", F.col("code").cast("double")).drop("code", "label")  # classes
    config = Config(outcome="label", outcome_type="multiclass", group="group", outer_folds=3, candidate_method="deseq2")
    sides = written(T.outer_sides(samples, config), "sides")
    rows = T.normalized(written(kq.expression(s), "expression"), sides.where("role = 'train'"), config)
    return T.expression_screen(rows, config)


@query
def pca1_two_components(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    s = study(spark, d)
    x = P.log_cpm(kq.expression(s))
    x = P.standardize(x, P.scaler(x, x.select("sample_id").distinct()))
    wide = x.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("v")).select("sample_id", array_to_vector(F.transform("v", lambda e: e["value"])).alias("v"))
    from pyspark.ml.functions import vector_to_array

    fit = PCA(k=2, inputCol="v", outputCol="c").fit(wide)
    ratio = [float(v) for v in fit.explainedVariance.toArray()]
    c = vector_to_array("c")
    return fit.transform(wide).select("sample_id", F.abs(c[0]).alias("pc1"), F.abs(c[1]).alias("pc2"), F.lit(ratio[0]).alias("ratio1"), F.lit(ratio[1]).alias("ratio2"))
