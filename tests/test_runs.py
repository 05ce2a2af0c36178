"""Whole runs: every setting takes effect, from folds to panels, tests and external evaluation."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.config import Config
from cohortlens.operators import splits as S
from cohortlens.plans import fitgrid as G
from cohortlens.sources import synthetic as Y
from cohortlens.workflow import evaluate_external, external_validate, run_analysis
from test_core import SMALL, frames, synthetic

QUICK = SMALL | {"permutations": 0, "l1_ratios": (0.5,), "strengths": (0.05,), "stability_resamples": 3}


def read(path, name):
    return json.loads((path / f"{name}.json").read_text())


# folds in time --------------------------------------------------------------------------------------------------------

def test_temporal_folds_of_the_grid_equal_the_operator(spark):
    rng = np.random.default_rng(3)
    groups = np.array([f"d{i // 2:02d}" for i in range(60)])
    times = np.repeat(rng.permutation(30) * 10.0, 2) + np.tile([0.0, 4.0], 30)
    parts = G.temporal_parts(groups, times, 3, 5.0, 0.4)
    df = spark.createDataFrame([(g, float(t)) for g, t in zip(groups, times)], "group string, time double")
    fold = {(r["fold"], r["role"], r["group"]) for r in S.temporal_folds(S.group_times(df, "group", "time"), 3, 0.4, 5.0).collect()}
    assert fold == {(f, role, g) for f, (train, test) in enumerate(parts) for role, rows in (("train", train), ("test", test)) for g in groups[rows]}
    for train, test in parts:
        assert len(train) and len(test) and times[train].max() < times[test].min() - 5.0
    with pytest.raises(ValueError, match="too few"):
        G.temporal_parts(groups[:6], times[:6], 3, 0.0, 0.5)


def test_temporal_run_has_temporal_inner_folds(spark, tmp_path):
    x, y = synthetic(samples=48, features=8)
    order = np.argsort(np.random.default_rng(1).permutation(48))
    long, meta = frames(spark, x, y)
    meta = meta.join(spark.createDataFrame([(f"s{i:03d}", float(t)) for i, t in enumerate(order)], "sample_id string, day double"), "sample_id")
    config = Config(**(QUICK | {"cv_strategy": "temporal", "time": "day", "temporal_train_fraction": 0.4, "temporal_gap": 1.0}))
    p = G.pack(long, meta, config)
    for u in G.outer_units(p, config):
        train, test = np.asarray(u["train"]), np.asarray(u["test"])
        assert p.times[train].max() < p.times[test].min() - 1.0
        for tr, te in G.inner_parts(p, train, p.y[train], config):
            assert set(tr) | set(te) <= set(train) and p.times[tr].max() < p.times[te].min() - 1.0
    metrics = run_analysis(spark, long, meta, config, tmp_path / "run")
    assert metrics["roc_auc"] > 0.8
    with pytest.raises(ValueError, match="finite"):
        G.pack(long, meta.withColumn("day", F.lit(float("nan"))), config)


# covariates -----------------------------------------------------------------------------------------------------------

def test_categories_are_encoded_from_training_rows():
    columns = np.array([["b", 1.0], ["a", 2.0], ["c", 3.0], ["b", 4.0]], dtype=object)
    e = G.Encoder(columns, (True, False))
    raw = e.raw(columns)
    assert e.levels == [["a", "b", "c"], None] and raw.tolist() == [[1, 0, 1], [0, 0, 2], [0, 1, 3], [1, 0, 4]]
    assert np.allclose(e(columns).mean(axis=0), 0) and np.allclose(e(columns).std(axis=0), 1)
    with pytest.raises(ValueError, match="lacks"):
        e(np.array([["z", 1.0]], dtype=object))


def test_run_with_categorical_covariates(spark, tmp_path):
    """The outcome follows the site alone: the covariates' baseline explains it, and a frozen model scores new samples with it."""
    rng = np.random.default_rng(5)
    site = rng.choice(["north", "south", "west"], 60)
    y = np.where(rng.random(60) < np.where(site == "north", 0.9, 0.1), 1, 0)
    x = rng.negative_binomial(20, 20 / 70, (60, 8)).astype(float)
    more = spark.createDataFrame([(f"s{i:03d}", str(s), float(a)) for i, (s, a) in enumerate(zip(site, rng.normal(50, 9, 60)))], "sample_id string, site string, age double")
    long, meta = frames(spark, x, y)
    config = Config(**(QUICK | {"covariates": ("site", "age"), "outer_folds": 3}))
    metrics = run_analysis(spark, long, meta.join(more, "sample_id"), config, tmp_path / "run")
    assert metrics["roc_auc"] > 0.75 and metrics["baseline_loss"] < 0.6
    model = read(tmp_path / "run", "model")
    assert model["covariates"] == [{"name": "site", "levels": ["north", "south", "west"]}, {"name": "age", "levels": None}]
    p = G.pack(long, meta.join(more, "sample_id"), config)
    prep = G.prepare(p, np.arange(60), p.y, config)
    a = prep.transform(p.x, p.covariates)
    fit = G.net(a, p.y, np.ones(60), config, 0.05, 0.5)
    renamed = lambda df: df.withColumns({c: F.concat(F.lit("x"), c) for c in ("sample_id", "donor") if c in df.columns})
    new = renamed(long).withColumn("value", F.col("value") + 1)
    got = external_validate(spark, tmp_path / "run", new, renamed(meta.join(more, "sample_id"))).where("class = 1").orderBy("sample_id").toPandas()
    assert np.corrcoef(got["p"], fit.predict(a, "binary")[:, 1])[0, 1] > 0.95
    with pytest.raises(ValueError, match="level that training lacks"):
        external_validate(spark, tmp_path / "run", new, renamed(meta.join(more, "sample_id")).withColumn("site", F.lit("east")))


# panels, batches, gates -----------------------------------------------------------------------------------------------

def test_panel_is_validated_inside_training_rows(spark, tmp_path):
    x, y = synthetic(samples=48, features=12)
    long, meta = frames(spark, x, y)
    config = Config(**(QUICK | {"panel_validation": True, "panel_max_features": 3, "permutations": 2, "batch": "batch", "selection_threshold": 0.6}))
    metrics = run_analysis(spark, long, meta, config, tmp_path / "run")
    panel = metrics["panel"]
    assert 1 <= len(panel["features"]) <= 3 and set(panel["features"]) <= {"g00", "g01", "g02", "g03"}
    assert panel["oof_roc_auc"] > 0.9 and panel["improvement"] > 0 and panel["pvalue"] == pytest.approx(1 / 3)
    fits = spark.read.parquet(str(tmp_path / "run/panel_fits.parquet"))
    seen = {(r["stage"], r["perm_id"]): r["n"] for r in fits.groupBy("stage", "perm_id").agg(F.count("*").alias("n")).collect()}
    assert seen["outer_panel", 0] == seen["outer_panel", 1] == 3 and seen["batch_panel", 0] == 3 and seen["final_panel", 0] == 1
    assert all(len(r["retained"]) <= 3 for r in fits.collect())
    searches = spark.read.parquet(str(tmp_path / "run/fits.parquet")).where("stage = 'outer_search' and perm_id = 0").collect()
    outer = {r["fold"]: set(r["train_rows"]) for r in spark.read.parquet(str(tmp_path / "run/fits.parquet")).where("stage = 'outer' and perm_id = 0").collect()}
    assert searches and all(set(r["train_rows"]) < outer[r["fold"]] for r in searches)  # never a test row
    assert {"panel_coefficient", "passes_panel_gates"} <= set(spark.read.parquet(str(tmp_path / "run/panel_evidence.parquet")).columns)
    assert "compact_panel_permutation_not_passed" in metrics["blockers"] and "insufficient_permutation_resolution" in metrics["blockers"]
    npz = np.load(tmp_path / "run/coefficients.npz")
    assert npz["stability"].shape == (3, 1, 12) and npz["outer_panel"].shape[0] == 3 and npz["batch"].shape[0] == 3 and len(npz["features"]) == 12
    new_x, new_y = synthetic(samples=48, features=12, seed=8)
    new, new_meta = (df.withColumns({c: F.concat(F.lit("x"), c) for c in ("sample_id", "donor") if c in df.columns}) for df in frames(spark, new_x, new_y))
    outside = evaluate_external(spark, tmp_path / "run", new, new_meta, tmp_path / "external", "panel")
    assert outside["roc_auc"] > 0.8 and read(tmp_path / "external", "external_metrics")["model_kind"] == "panel"
    with pytest.raises(ValueError, match="outcome class"):
        evaluate_external(spark, tmp_path / "run", new, new_meta.withColumn("phenotype", F.lit("7")), tmp_path / "external2")
    with pytest.raises(ValueError, match="another name"):
        external_validate(spark, tmp_path / "run", long.withColumn("sample_id", F.concat(F.lit("x"), "sample_id")), new_meta)
    for name in ("biomarkers", "cv_results", "coefficients", "out_of_fold_predictions", "substitutions"):
        assert spark.read.option("header", "true").csv(str(tmp_path / f"run/{name}.csv")).count() > 0


def test_perfect_confounding_blocks(spark, tmp_path):
    long, meta, _ = Y.bulk(spark, 24, 8, 3, "batch_confounded")
    metrics = run_analysis(spark, long, meta, Config(**(QUICK | {"batch": "batch"})), tmp_path / "run")
    assert "perfect_batch_confounding" in metrics["blockers"] and "cross_batch_robustness_not_established" in metrics["blockers"] and metrics["passing"] == 0
    assert {r["status"] for r in read(tmp_path / "run", "batch_validation")["folds"]} == {"unidentifiable"}
    assert read(tmp_path / "run", "qc_report")["batch"]["purity"] == 1


@pytest.mark.parametrize("scenario, key", [("multiclass", "balanced_accuracy"), ("continuous", "r2")])
def test_other_outcomes(spark, tmp_path, scenario, key):
    long, meta, _ = Y.bulk(spark, 60, 8, 3, scenario)
    metrics = run_analysis(spark, long, meta, Config(**(QUICK | {"outcome_type": scenario, "strengths": (0.01,)})), tmp_path / "run")
    assert metrics[key] > 0.5 and metrics["loss_improvement"] > 0


def test_failed_solver_blocks(spark, tmp_path):
    x, y = synthetic(samples=24, features=6)
    long, meta = frames(spark, x, y)
    with pytest.raises(ValueError, match="converged"):
        run_analysis(spark, long, meta, Config(**(QUICK | {"max_iter": 1})), tmp_path / "run")
    assert read(tmp_path / "run", "manifest")["status"] == "failed"
    from cohortlens.operators.evidence import global_blockers

    assert global_blockers(19, 0.05, 0.05, 1.0, unconverged=3) == ["solver_nonconvergence_in_search"]
    assert global_blockers(19, 0.05, 0.05, 1.0, True, True, [0.1, 0.2]) == []
    assert global_blockers(19, 0.05, 0.05, 1.0, True, True, [0.1, None], panel={"improvement": 0.1, "pvalue": 0.05}, batch_panel=[0.1, -1]) == ["cross_batch_performance_failure", "compact_panel_cross_batch_performance_failure"]


def test_every_view_of_the_cells_must_select(spark):
    """Gates ask each normalisation and each perturbation for its own frequency."""
    from cohortlens.operators import evidence as E

    rows = [(f, 0, "g", 1.0 if f % 2 else 0.0, "logcpm", f % 2) for f in range(4)]
    coefs = spark.createDataFrame(rows, "fit_id int, contrast int, feature_id string, coef double, normalization string, perturbation int")
    got = E.frequency_by(coefs, "perturbation", (0, 1), 1e-8, "frequency_cells_").first()
    assert (got["frequency_cells_0"], got["frequency_cells_1"]) == (0.0, 1.0)


# supporting tests -----------------------------------------------------------------------------------------------------

def test_supporting_tests_reach_the_evidence(spark, tmp_path):
    x, y = synthetic(samples=24, features=8)
    long, meta = frames(spark, x, y)
    config = Config(**(QUICK | {"supporting_de": True, "batch": "batch", "positive_class": "0"}))
    run_analysis(spark, long, meta, config, tmp_path / "run")
    evidence = {r["feature_id"]: r for r in spark.read.parquet(str(tmp_path / "run/evidence.parquet")).collect()}
    assert evidence["g00"]["de_padj"] < 0.01 and evidence["g00"]["de_log2fc"] < 0 < evidence["g02"]["de_log2fc"]  # against class 1
    assert read(tmp_path / "run", "de_design") == {"unavailable": {}}


def test_states_that_cannot_be_tested_are_reported(spark):
    from cohortlens.operators.expression_tests import supporting_tests

    x, y = synthetic(samples=24, features=8)
    long, meta = frames(spark, x, y)
    both = long.withColumn("state", F.lit("A")).unionByName(long.withColumn("state", F.lit("B")))
    cells = meta.select("sample_id", F.lit("A").alias("state"), F.lit(30).alias("n_cells")).unionByName(meta.select("sample_id", F.lit("B").alias("state"), F.when(F.col("sample_id") < "s003", 30).otherwise(1).alias("n_cells")))
    tests, failed = supporting_tests(both, meta.select("sample_id", "phenotype"), "phenotype", cells)
    assert set(failed) == {"B"} and {r[0] for r in tests.select("state").distinct().collect()} == {"A"}


# command line ---------------------------------------------------------------------------------------------------------

def test_pinned_files(spark, tmp_path):
    import hashlib

    from cohortlens.sources.downloads import pinned

    (tmp_path / "source.csv").write_text("a,b\n1,2\n")
    url, digest = (tmp_path / "source.csv").as_uri(), hashlib.sha256(b"a,b\n1,2\n").hexdigest()
    path = pinned(spark, url, digest, tmp_path / "kept", "x.csv")
    assert spark.read.csv(path, header=True).first()["b"] == "2"
    (tmp_path / "source.csv").unlink()
    assert pinned(spark, url, digest, tmp_path / "kept", "x.csv") == path  # not fetched again
    (tmp_path / "other.csv").write_text("changed")
    with pytest.raises(ValueError, match="checksum"):
        pinned(spark, (tmp_path / "other.csv").as_uri(), digest, tmp_path / "kept", "y.csv")
    assert not (tmp_path / "kept/y.csv").exists()


def test_command_line_runs(spark, tmp_path, capsys):
    from cohortlens.__main__ import main

    def command(*args):
        assert main([str(a) for a in args]) == 0, capsys.readouterr().err

    quick = ["--outer-folds", 3, "--inner-folds", 2, "--permutations", 0, "--stability-resamples", 3, "--max-features", 8]
    command("simulate", "--output", tmp_path / "bulk", "--samples", 24, "--features", 8, "--seed", 3)
    (tmp_path / "symbols.csv").write_text("gene_id,gene_symbol\ngene_0000,FIRST\n")
    study = tmp_path / "bulk"
    command("bulk", "--expression", study / "expression.csv", "--metadata", study / "metadata.csv", "--config", study / "config.json", "--annotations", tmp_path / "symbols.csv", "--output", tmp_path / "run", *quick)
    assert read(tmp_path / "run", "manifest")["status"] == "complete" and read(tmp_path / "run", "manifest")["configuration"]["outer_folds"] == 3
    symbols = {r["gene_id"]: r["gene_symbol"] for r in spark.read.parquet(str(tmp_path / "run/evidence.parquet")).collect()}
    assert symbols["gene_0000"] == "FIRST" and symbols["gene_0001"] == ""
    command("simulate", "--output", tmp_path / "new", "--samples", 24, "--features", 8, "--seed", 4)
    for name in ("expression", "metadata"):
        text = (tmp_path / f"new/{name}.csv").read_text().replace("\ns0", "\nx0").replace(",d0", ",e0")
        (tmp_path / f"new/{name}.csv").write_text(text)
    command("external", "--run", tmp_path / "run", "--expression", tmp_path / "new/expression.csv", "--metadata", tmp_path / "new/metadata.csv", "--output", tmp_path / "external")
    assert "roc_auc" in read(tmp_path / "external", "external_metrics")["metrics"]


def test_command_line_on_cells(spark, tmp_path, capsys):
    from cohortlens.__main__ import main

    def command(*args):
        assert main([str(a) for a in args]) == 0, capsys.readouterr().err

    def cells(name, seed, prefix):
        table, counts = Y.cells(spark, 8, 8, 8, seed)
        table.withColumns({c: F.concat(F.lit(prefix), c) for c in ("sample_id", "donor")}).write.parquet(str(tmp_path / f"{name}_cells"))
        counts.write.parquet(str(tmp_path / f"{name}_counts"))
        return ["--cells", tmp_path / f"{name}_cells", "--counts", tmp_path / f"{name}_counts"]

    quick = ["--group", "donor", "--outer-folds", 2, "--inner-folds", 2, "--permutations", 0, "--stability-resamples", 2, "--min-cells", 4, "--max-features", 10]
    old, new = cells("old", 7, ""), cells("new", 8, "x")
    command("single-cell", *old, "--single-cell-mode", "distribution", "--supporting-de", "--cell-resamples", 1, "--output", tmp_path / "run", *quick)
    evidence = spark.read.parquet(str(tmp_path / "run/evidence.parquet"))
    assert {"frequency_cells_0", "frequency_cells_1", "de_padj"} <= set(evidence.columns) and set(r[0] for r in evidence.select("cell_type").distinct().collect()) == {"type_A", "type_B"}
    shown = spark.read.parquet(str(tmp_path / "run/specimen_evidence.parquet"))
    assert shown.select("feature_id").distinct().count() == 6 and shown.count() == 6 * 16
    assert spark.read.parquet(str(tmp_path / "run/cell_quality.parquet")).agg(F.sum("cells")).first()[0] == 8 * 2 * 2 * 8
    command("external", "--run", tmp_path / "run", *new, "--output", tmp_path / "external")
    renamed = spark.read.parquet(str(tmp_path / "old_cells")).withColumns({c: F.concat(F.lit("y"), c) for c in ("sample_id", "donor")})
    renamed.write.parquet(str(tmp_path / "renamed_cells"))
    assert main(["external", "--run", str(tmp_path / "run"), "--cells", str(tmp_path / "renamed_cells"), "--counts", str(tmp_path / "old_counts"), "--output", str(tmp_path / "again")]) == 1
    assert "another name" in capsys.readouterr().err
    spark.read.parquet(str(tmp_path / "new_counts")).where("gene_id != 'gene_0007'").write.parquet(str(tmp_path / "fewer"))
    assert main(["external", "--run", str(tmp_path / "run"), "--cells", str(tmp_path / "new_cells"), "--counts", str(tmp_path / "fewer"), "--output", str(tmp_path / "refused")]) == 1
    assert "gene universe" in capsys.readouterr().err
    command("single-cell", *old, "--cell-type-value", "type_A", "--output", tmp_path / "one", *quick)
    assert read(tmp_path / "one", "manifest")["status"] == "complete"
