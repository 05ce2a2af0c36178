"""Fits as tables against the packed grid, which has tests of its own against optimality conditions and Spark ML."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.config import Config
from cohortlens.operators import fits as T
from cohortlens.plans import fitgrid as G

BASE = dict(group="donor", batch="batch", outer_folds=3, inner_folds=2, strengths=(0.02, 0.1, 0.3), l1_ratios=(0.5, 0.9), stability_resamples=4, permutations=2, max_features=8, tolerance=1e-5)


def study(spark, kind="binary", samples=48, features=14, seed=2, scale="counts"):
    rng = np.random.default_rng(seed)
    y = {"binary": rng.permutation(np.arange(samples) % 2), "multiclass": rng.permutation(np.arange(samples) % 3), "continuous": rng.normal(size=samples)}[kind]
    mu = np.tile(rng.uniform(2.5, 4.5, features), (samples, 1))
    mu[:, :3] += np.outer(y, [1.0, -1.0, 0.7])
    x = rng.negative_binomial(15, 15 / (15 + np.exp(mu))).astype(float)
    x[:, -1] = 1  # under min_count
    if scale != "counts":
        x = np.log1p(x)
        x[rng.random(x.shape) < 0.05] = np.nan
    names = [f"s{i:03d}" for i in range(samples)]
    long = spark.createDataFrame([(s, f"g{j:02d}", None if np.isnan(v) else float(v)) for s, row in zip(names, x) for j, v in enumerate(row)], "sample_id string, feature_id string, value double")
    rows = [(s, f"d{i // 2:03d}" if kind == "continuous" else s, f"b{i % 3}", float(v)) for i, (s, v) in enumerate(zip(names, y))]
    samples_ = spark.createDataFrame(rows, "sample_id string, group string, batch string, y double")
    meta = samples_.select("sample_id", F.col("group").alias("donor"), "batch", F.col("y").alias("phenotype") if kind == "continuous" else F.col("y").cast("int").cast("string").alias("phenotype"))
    return long, meta, samples_, 0 if kind == "continuous" else int(max(y)) + 1


def same(a, b, keys, values, tol=2e-5):
    get = lambda df: {tuple(r[k] for k in keys): [r[v] for v in values] for r in df.collect()}
    a, b = get(a), get(b)
    assert set(a) == set(b) and a
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=tol), k


@pytest.mark.parametrize("kind, more", [("binary", {}), ("binary", {"candidate_method": "association", "tuning_rule": "minimum_loss"}), ("multiclass", {"normalization": "median_ratio", "l1_ratios": (0.9,)}), ("continuous", {"repeats": 2, "candidate_method": "association"}), ("binary", {"input_scale": "features", "normalization": "none", "imputation": "median", "candidate_method": "none"})])
def test_nested_validation_equals_the_packed_grid(spark, kind, more):
    long, meta, samples, classes = study(spark, kind, scale=more.get("input_scale", "counts"))
    config = Config(**(BASE | {"outcome_type": kind} | more))
    p = G.pack(long, meta, config)
    want = G.run_units(spark, p, G.outer_units(p, config), config).cache()
    fits = T.Fits(long, T.outer_sides(samples, config), config, classes)
    same(fits.predictions(), G.predictions(want, p), ["sample_id", "repeat", "fold", "class"], ["p", "baseline"])
    same(fits.fits.where("error is null"), want.where("error is null"), ["repeat", "fold"], ["strength", "l1_ratio", "loss", "baseline_loss"])
    tuning = want.select("repeat", "fold", F.explode("tuning").alias("t")).select(T.unit_name(F.lit("outer"), F.lit(0), F.col("repeat"), F.col("fold")).alias("context"), "t.*")
    same(fits.tuning, tuning, ["context", "strength", "l1_ratio"], ["mean_loss", "mean_features"])
    coefs = G.coefficients(want, p, "outer").withColumn("unit", T.unit_name(F.lit("outer"), F.lit(0), F.floor(F.col("fit_id") / 100_000), F.col("fit_id") % 100_000))
    same(fits.coefficients().withColumnRenamed("fit_id", "unit"), coefs, ["unit", "contrast", "feature_id"], ["coef"], 1e-4)


def test_batches_resamples_and_paths_equal_the_packed_grid(spark):
    long, meta, samples, classes = study(spark)
    config = Config(**BASE)
    p = G.pack(long, meta, config)
    batch = G.run_units(spark, p, G.batch_units(p, config), config)
    same(T.Fits(long, T.batch_sides(samples), config, classes).fits, batch, ["fold"], ["loss", "baseline_loss", "strength"])
    stable = T.Fits(long, T.stability_sides(samples, config), config, classes, held_out=False)
    want = G.coefficients(G.run_units(spark, p, G.stability_units(p, config), config), p, "stability")
    same(stable.coefficients(), want.withColumn("fit_id", T.unit_name(F.lit("stability"), F.lit(0), F.lit(0), F.col("fit_id"))), ["fit_id", "contrast", "feature_id"], ["coef"], 1e-4)
    points = spark.createDataFrame([("path:0:0:0", s, 0.5) for s in (0.01, 0.05, 0.2)], "unit string, strength double, l1_ratio double")
    path = T.Fits(long, T.whole_side(samples, "path"), config, classes, held_out=False, chosen=points)
    same(path.fits.select("strength", F.size("coefs").alias("n")), G.run_units(spark, p, G.path_units(p, 0.5, (0.01, 0.05, 0.2)), config).select("strength", F.size("coefs").alias("n")), ["strength"], ["n"])
    panel = spark.createDataFrame([("g00",), ("g05",), ("none",)], "feature_id string")
    few = T.Fits(long, T.whole_side(samples, "panel"), config, classes, held_out=False, chosen=spark.createDataFrame([("panel:0:0:0", 0.02, 0.5)], "unit string, strength double, l1_ratio double"), allowed=panel)
    packed = G.run_units(spark, p, [G.final_unit(p, "panel", allowed=[0, 5], strength=0.02, l1_ratio=0.5)], config)
    same(few.coefficients(), G.coefficients(packed, p, "panel").withColumn("fit_id", F.lit("panel:0:0:0")), ["fit_id", "contrast", "feature_id"], ["coef"], 1e-4)


@pytest.mark.parametrize("strategy", ["leave_batch_out", "leave_group_out"])
def test_outer_folds_that_hold_out_names_equal_the_packed_grid(spark, strategy):
    long, meta, samples, classes = study(spark, samples=24, features=6)
    if strategy == "leave_group_out":
        samples = samples.withColumn("group", F.concat(F.lit("d"), F.col("y").cast("int").cast("string"), F.substring("batch", 2, 1)))
        meta = meta.drop("donor").join(samples.select("sample_id", F.col("group").alias("donor")), "sample_id")
    config = Config(**(BASE | {"cv_strategy": strategy, "strengths": (0.1,), "l1_ratios": (0.5,)}))
    p = G.pack(long, meta, config)
    want = G.run_units(spark, p, G.outer_units(p, config), config)
    same(T.Fits(long, T.outer_sides(samples, config), config, classes).fits, want, ["fold"], ["loss", "baseline_loss"])


def test_resamples_take_normalisations_in_turn(spark):
    long, meta, samples, classes = study(spark)
    config = Config(**(BASE | {"stability_normalizations": ("median_ratio", "logcpm"), "strengths": (0.1,), "l1_ratios": (0.5,)}))
    p = G.pack(long, meta, config)
    want = {(r["fit_id"], r["feature_id"]): (r["coef"], r["normalization"]) for r in G.coefficients(G.run_units(spark, p, G.stability_units(p, config), config), p, "stability").collect()}
    got = {(int(r["fit_id"].rsplit(":", 1)[1]), r["feature_id"]): (r["coef"], m) for m, f in T.stability_fits(long, samples, config, classes) for r in f.coefficients().collect()}
    assert set(got) == set(want) and len(got) == 4 * 14
    for k in want:
        assert got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-4)


def test_permutations_exchange_whole_groups(spark):
    _, meta, samples, _ = study(spark, "continuous")
    samples = samples.withColumn("y", F.pmod(F.hash("group"), F.lit(5)).cast("double")).withColumn("stratum", F.pmod(F.hash("group"), F.lit(3)).cast("string"))
    config = Config(**BASE, permutation_strata="site")
    rows = T.permuted(samples, config, 3).collect()
    assert len(rows) == 4 * samples.count()
    seen = {r["sample_id"]: r for r in rows if r["perm_id"] == 0}
    for k in (1, 2, 3):
        own = [r for r in rows if r["perm_id"] == k]
        by = {}
        for r in own:
            by.setdefault(r["group"], set()).add(r["y"])
        assert all(len(v) == 1 for v in by.values())
        for stratum in {r["stratum"] for r in own}:
            labels = lambda rs: sorted({(r["group"], r["y"]) for r in rs if r["stratum"] == stratum}, key=lambda t: t[1])  # noqa: B023, E731
            assert [y for _, y in labels(own)] == [y for _, y in labels(seen.values())]
        assert any(r["y"] != seen[r["sample_id"]]["y"] for r in own)
    with pytest.raises(ValueError, match="one outcome"):
        T.permuted(samples.withColumn("y", F.hash("sample_id").cast("double")), config, 1)


def test_only_training_rows_reach_a_fit(spark):
    """Held-out samples turned into nonsense change no coefficient."""
    long, _, samples, classes = study(spark)
    config = Config(**BASE)
    sides = T.outer_sides(samples, config).where("fold = 1").cache()
    test = sides.where("role = 'test'").select("sample_id")
    other = long.join(test.withColumn("t", F.lit(True)), "sample_id", "left").select("sample_id", "feature_id", F.when(F.col("t"), F.col("value") * 1000 + 7).otherwise(F.col("value")).alias("value"))
    flipped = sides.withColumn("y", F.when(F.col("role") == "test", 1 - F.col("y")).otherwise(F.col("y")))
    same(T.Fits(long, sides, config, classes).coefficients(), T.Fits(other, flipped, config, classes).coefficients(), ["fit_id", "contrast", "feature_id"], ["coef"], 1e-9)


def test_units_that_cannot_be_fitted_say_why(spark):
    long, _, samples, classes = study(spark)
    config = Config(**BASE)
    few = samples.withColumn("y", F.when(F.col("sample_id") < "s003", 1.0).otherwise(0.0))  # three groups for two inner folds of three outer ones
    fits = T.Fits(long, T.outer_sides(few, config), config, 2).fits
    assert fits.where("error is null").count() + fits.where("error like '%grid point%'").count() == 3
    one = T.Fits(long, T.outer_sides(samples.where("sample_id < 's006'").withColumn("y", F.when(F.col("sample_id") < "s001", 1.0).otherwise(0.0)), config), config, 2).fits
    assert {r["error"] for r in one.collect()} == {"too few groups for the folds"}
    wrong = T.batch_sides(samples.withColumn("y", F.when(F.col("batch") == "b0", 1.0).otherwise(0.0)))
    assert {r["fold"]: r["error"] for r in T.Fits(long, wrong, config, 2).fits.collect()}[0] == "a training fold lacks a class"
    with pytest.raises(ValueError, match="raise the fraction"):
        T.stability_sides(samples.withColumn("y", F.when(F.col("sample_id") < "s001", 1.0).otherwise(0.0)), config, 2)


def test_plans_do_not_grow_with_units(spark):
    long, _, samples, classes = study(spark, samples=24, features=6)
    size = lambda n: len(T.designs(long, T.outer_sides(samples, Config(**BASE), n), Config(**BASE))[0]._jdf.queryExecution().optimizedPlan().toString())
    assert size(40) < 1.1 * size(2)


def test_count_tests_screen_every_training_side_at_once(spark):
    """The screen inside nested validation is the packed grid's, fold by fold."""
    long, meta, samples, classes = study(spark, samples=24, features=10)
    config = Config(**(BASE | {"candidate_method": "deseq2", "de_fdr": 0.2, "outer_folds": 2, "strengths": (0.05,), "l1_ratios": (0.5,)}))
    p = G.pack(long, meta, config)
    want = G.run_units(spark, p, G.outer_units(p, config), config).cache()
    fits = T.Fits(long, T.outer_sides(samples, config), config, classes)
    names = {i: f for i, f in enumerate(p.features)}
    retained = {(r["repeat"], r["fold"]): {names[j] for j in r["retained"]} for r in want.collect()}
    got = {}
    for r in fits.state.join(fits.fits.select("unit", "repeat", "fold"), "unit").collect():
        got.setdefault((r["repeat"], r["fold"]), set()).add(r["feature_id"])
    assert got == retained and any(retained.values())
    same(fits.predictions(), G.predictions(want, p), ["sample_id", "repeat", "fold", "class"], ["p", "baseline"], 1e-3)


@pytest.mark.parametrize("kind", ["binary", "continuous"])
def test_covariates_and_their_baseline_equal_the_packed_grid(spark, kind):
    long, meta, samples, classes = study(spark, kind)
    rng = np.random.default_rng(1)
    rows = [(r["sample_id"], str(rng.choice(["north", "south", "west"])), float(rng.normal(40, 9) + 5 * r["y"])) for r in samples.orderBy("sample_id").collect()]
    meta = meta.join(spark.createDataFrame(rows, "sample_id string, site string, age double"), "sample_id")
    config = Config(**(BASE | {"outcome_type": kind, "covariates": ("site", "age"), "strengths": (0.05, 0.2)}))
    p = G.pack(long, meta, config)
    want = G.run_units(spark, p, G.outer_units(p, config), config).cache()
    assert want.where("error is not null").isEmpty()
    fits = T.Fits(long, T.outer_sides(samples, config), config, classes, covariates=T.covariate_values(meta, config.covariates))
    same(fits.fits, want, ["repeat", "fold"], ["strength", "l1_ratio", "loss", "baseline_loss"])
    same(fits.predictions(), G.predictions(want, p), ["sample_id", "repeat", "fold", "class"], ["p", "baseline"])


def test_levels_that_training_lacks(spark):
    long, meta, samples, classes = study(spark)
    config = Config(**(BASE | {"covariates": ("site",)}))
    meta = meta.withColumn("site", F.when(F.col("sample_id") == "s000", "only here").otherwise("elsewhere"))
    fits = T.Fits(long, T.outer_sides(samples, config), config, classes, covariates=T.covariate_values(meta, ["site"])).fits
    assert sorted((r["error"] or "") for r in fits.collect()).count("a covariate has a level that training lacks") == 1
    with pytest.raises(Exception, match="missing values"):
        T.covariate_values(meta.withColumn("site", F.lit(None).cast("string")), ["site"]).collect()
