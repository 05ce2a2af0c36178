"""Contracts, invariants and references of the library's own operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.config import Config, load_config
from cohortlens.functions import kernels, metrics
from cohortlens.operators import cells as C
from cohortlens.operators import contracts as K
from cohortlens.operators import evidence as E
from cohortlens.operators import expression_tests as X
from cohortlens.operators import prep as P
from cohortlens.operators import splits as S
from cohortlens.plans import fitgrid as G
from cohortlens.sources import matrices
from cohortlens.sources.runs import Run, verify
from cohortlens.sources.study import study
from cohortlens.workflow import external_validate, run_analysis, score_frozen


def synthetic(samples=60, features=40, seed=7, effect=1.7, groups=None):
    rng = np.random.default_rng(seed)
    y = np.repeat([0, 1], samples // 2)
    size = np.zeros(features)
    size[:4] = [effect, effect, -effect, -effect]
    mu = np.exp(rng.normal(4, 0.4, features) + np.outer(y - 0.5, size))
    return rng.negative_binomial(20, 20 / (20 + mu)).astype(float), y


def frames(spark, x, y):
    long = spark.createDataFrame([(f"s{i:03d}", f"g{j:02d}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "sample_id string, feature_id string, value double")
    meta = spark.createDataFrame([(f"s{i:03d}", f"d{i:03d}", str(int(v)), f"b{i % 3}") for i, v in enumerate(y)], "sample_id string, donor string, phenotype string, batch string")
    return long, meta


SMALL = dict(group="donor", outer_folds=3, inner_folds=2, strengths=(0.02, 0.15), l1_ratios=(0.5,), stability_resamples=4, permutations=19, max_features=30)


# kernels -------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["continuous", "binary", "multiclass"])
def test_elastic_net_satisfies_optimality(kind):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(70, 9)), rng.random(70) + 0.5
    score = x @ np.array([1.5, -1, 0, 0, 0, 0, 0, 0, 0.5]) + rng.normal(size=70)
    y = {"continuous": score, "binary": (score > 0).astype(float), "multiclass": np.digitize(score, [-0.7, 0.7]).astype(float)}[kind]
    lam, ratio = 0.05, 0.6
    fit = kernels.elastic_net(x, y, w, kind, lam, ratio, tol=1e-10)
    wn = w / w.sum()
    pred = fit.predict(x, kind)
    resid = (pred - y)[:, None] if kind == "continuous" else (pred[:, 1:] - y[:, None] if kind == "binary" else pred - np.eye(3)[y.astype(int)])
    grad = (wn[:, None] * resid).T @ x + lam * (1 - ratio) * fit.coef
    assert fit.converged and np.abs((wn[:, None] * resid).sum(axis=0)).max() < 1e-6
    on = np.abs(fit.coef) > 0
    assert np.abs(grad[on] + lam * ratio * np.sign(fit.coef[on])).max() < 1e-6
    assert (np.abs(grad[~on]) <= lam * ratio + 1e-6).all()


def test_logistic_agrees_with_spark_ml(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(60, 5)), rng.random(60) + 0.5
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(float)
    fit = kernels.elastic_net(x, y, w, "binary", 0.03, 0.5, tol=1e-10)
    df = spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)], ["features", "label", "w"])
    m = LogisticRegression(regParam=0.03, elasticNetParam=0.5, weightCol="w", standardization=False, tol=1e-12, maxIter=2000).fit(df)
    assert np.abs(m.coefficients.toArray() - fit.coef[0]).max() < 1e-5


# nested validation ----------------------------------------------------------------------------------------------------

def packed(x, y, **more):
    n = len(y)
    base = dict(x=x, y=np.asarray(y, float), groups=np.array([f"d{i}" for i in range(n)]), batches=np.array([f"b{i % 3}" for i in range(n)]), features=tuple(f"g{j:02d}" for j in range(x.shape[1])), samples=tuple(f"s{i}" for i in range(n)), classes=("0", "1"), covariates=np.zeros((n, 0)))
    return G.Packed(**(base | more))


def test_signal_and_noise(spark):
    config = Config(**SMALL)
    for effect, good in ((1.7, True), (0.0, False)):
        x, y = synthetic(effect=effect)
        fits = G.run_units(spark, packed(x, y), G.outer_units(packed(x, y), config, 3), config)
        loss = {r["perm_id"]: r["improvement"] for r in G.losses(fits).collect()}
        assert (loss[0] > 0.3 and loss[0] > max(v for k, v in loss.items() if k)) == good


def test_only_training_rows_reach_a_fit(spark):
    """Changing held-out values changes no coefficient."""
    config = Config(**SMALL)
    x, y = synthetic()
    unit = G.outer_units(packed(x, y), config)[:1]
    spoiled = x.copy()
    spoiled[unit[0]["test"]] = spoiled[unit[0]["test"]][:, ::-1] * 7 + 3
    a, b = (G.run_units(spark, packed(v, y), unit, config).select("coefs", "strength", "retained").first() for v in (x, spoiled))
    assert a == b


def test_folds_keep_groups_whole_and_cover_classes():
    groups = np.array([f"d{i % 12}" for i in range(48)])
    y = np.array([int(g[1:]) % 2 for g in groups], float)
    folds = G.group_folds(groups, y, 3, 42, True)
    for g in set(groups):
        assert len(set(folds[groups == g])) == 1
    assert all(set(y[folds != f]) == {0, 1} == set(y[folds == f]) for f in range(3))
    assert (G.group_folds(groups, y, 3, 42, True) == folds).all()
    with pytest.raises(ValueError):
        G.group_folds(groups, y, 13, 42, True)


def test_permutations_keep_groups_constant():
    x, y = synthetic()
    p = packed(x, y, groups=np.array([f"d{i // 2}" for i in range(len(y))]))
    moved = G.permuted(p, Config(**SMALL), 1)
    assert sorted(moved) == sorted(p.y) and (moved != p.y).any()
    assert all(len(set(moved[p.groups == g])) == 1 for g in set(p.groups))


def test_failed_units_are_reported(spark):
    x, y = synthetic()
    unit = G.outer_units(packed(x, y), Config(**SMALL))[0]
    fits = G.run_units(spark, packed(np.full_like(x, np.nan), y), [unit], Config(**SMALL)).collect()
    assert fits[0]["error"] and fits[0]["loss"] is None


# whole runs -----------------------------------------------------------------------------------------------------------

def test_run_external_and_tampering(spark, tmp_path):
    x, y = synthetic()
    long, meta = frames(spark, x, y)
    config = Config(**(SMALL | {"batch": "batch"}))
    metrics_ = run_analysis(spark, long, meta, config, tmp_path / "run")
    assert metrics_["roc_auc"] > 0.95 and metrics_["pvalue"] == 0.05 and not metrics_["blockers"]
    evidence = spark.read.parquet(str(tmp_path / "run/evidence.parquet"))
    assert {r["feature_id"] for r in evidence.where("passes_robustness_gates").collect()} >= {"g00", "g01", "g02", "g03"}
    from cohortlens.reporting import figure_tables, write_report

    figures = figure_tables(spark, tmp_path / "run")
    assert {"curves", "calibration", "path", "permutations"} <= set(figures) and all(f.count() for f in figures.values())
    new_x, new_y = synthetic(seed=8)
    new = long.limit(0).unionByName(frames(spark, new_x, new_y)[0].withColumn("sample_id", F.concat(F.lit("x"), "sample_id")))
    new_meta = frames(spark, new_x, new_y)[1].withColumns({c: F.concat(F.lit("x"), c) for c in ("sample_id", "donor")})
    scored = external_validate(spark, tmp_path / "run", new, new_meta).where("class = 1").join(new_meta, "sample_id")
    auc = metrics.ranking(scored.select(F.col("phenotype").cast("int").alias("y"), "p", F.lit(1.0).alias("w"))).first()["roc_auc"]
    assert auc > 0.9
    with pytest.raises(ValueError, match="training study"):
        external_validate(spark, tmp_path / "run", long, meta)
    with pytest.raises(ValueError, match="not empty"):
        run_analysis(spark, long, meta, config, tmp_path / "run")
    assert "auc" in open(write_report(spark, tmp_path / "run").removeprefix("file:")).read()
    model = tmp_path / "run/model.json"
    model.write_text(model.read_text().replace("0", "1", 1))
    with pytest.raises(ValueError, match="changed"):
        external_validate(spark, tmp_path / "run", new, new_meta)


def test_frozen_state_scores_like_the_kernel(spark):
    from cohortlens.workflow import freeze

    x, y = synthetic(samples=40, features=12)
    for norm in ("logcpm", "median_ratio"):
        config = Config(**(SMALL | {"normalization": norm}))
        p = packed(x, y, samples=tuple(f"s{i:03d}" for i in range(40)))
        prep = G.Prepared(p.x, p.y, p.covariates, config)
        a = prep.transform(p.x, p.covariates)
        want = kernels.elastic_net(a, p.y, kernels.group_weights(p.groups), "binary", 0.02, 0.5).predict(a, "binary")[:, 1]
        got = {r["sample_id"]: r["p"] for r in score_frozen(spark, freeze(p, config, 0.02, 0.5), frames(spark, x, y)[0], config).where("class = 1").collect()}
        assert np.abs(np.array([got[s] for s in p.samples]) - want).max() < 1e-9


def test_failed_run_is_recorded(spark, tmp_path):
    with pytest.raises(ValueError):
        with Run(spark, tmp_path / "r", {"a": float("nan")}):
            raise ValueError("broken")
    manifest = json.loads((tmp_path / "r/manifest.json").read_text())
    assert manifest["status"] == "failed" and manifest["a"] is None
    with pytest.raises(ValueError, match="not complete"):
        verify(tmp_path / "r")


# count tests ----------------------------------------------------------------------------------------------------------

def test_count_tests_find_planted_genes(spark):
    x, y = synthetic(samples=24, features=30, effect=1.5)
    long, meta = frames(spark, x, y)
    rows = {r["feature_id"]: r for r in X.differential_expression(long, meta, "phenotype").collect()}
    for j, sign in enumerate([1, 1, -1, -1]):
        assert rows[f"g{j:02d}"]["padj"] < 0.01 and np.sign(rows[f"g{j:02d}"]["log2_fold_change"]) == sign
    assert sum(r["padj"] < 0.05 for k, r in rows.items() if k > "g03") <= 2
    with pytest.raises(ValueError, match="rank"):
        X.design_matrix(meta.withColumn("copy", F.col("phenotype")).toPandas(), "phenotype", ["copy"])


# cells ----------------------------------------------------------------------------------------------------------------

def test_features_do_not_depend_on_partitioning(spark, sf_dir):
    s = study(spark, sf_dir)
    key = lambda df: sorted(map(tuple, df.select("sample_id", "state", "gene_id", "total", F.round("s", 8), "detected").collect()))
    a = C.gene_moments(C.log_normalize(s.cells, s.counts))
    b = C.gene_moments(C.log_normalize(s.cells.repartition(7), s.counts.orderBy(F.desc("count")).repartition(5)))
    assert key(a) == key(b)


def test_moments_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(1.5, size=(30, 4))
    cells = spark.createDataFrame([(i, f"s{i % 2}", "A") for i in range(30)], "cell_id long, sample_id string, state string")
    counts = spark.createDataFrame([(i, f"g{j}", int(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v], "cell_id long, gene_id string, count long")
    values = C.log_normalize(cells, counts)
    grid = C.on_grid(C.cell_totals(cells), counts.select("gene_id").distinct(), C.gene_moments(values))
    got = {(r["sample_id"], r["kind"], r["source"]): r["value"] for r in C.gene_blocks(grid, (), 1).collect()}
    v = np.log1p(1e4 * x / np.maximum(x.sum(axis=1, keepdims=True), 1))
    for s in (0, 1):
        own = v[s::2]
        for j in range(4):
            assert got[f"s{s}", "gene_mean", f"g{j}"] == pytest.approx(own[:, j].mean())
            assert got[f"s{s}", "gene_variance", f"g{j}"] == pytest.approx(own[:, j].var(ddof=1))
    pairs = spark.createDataFrame([("g0", "g1")], "a string, b string")
    m = C.pair_moments(values, pairs).join(C.cell_totals(cells), ["sample_id", "state"])
    r = {x["sample_id"]: x["r"] for x in m.select("sample_id", C.correlation("sa", "sb", "ssa", "ssb", "ab").alias("r")).collect()}
    assert r["s0"] == pytest.approx(np.corrcoef(v[0::2, 0], v[0::2, 1])[0, 1])


def test_multiset_digest_keeps_multiplicity(spark):
    h = [f"{i:064x}" for i in (2**256 - 1, 5)]
    rows = spark.createDataFrame([("a", h[0]), ("a", h[1]), ("b", h[1]), ("b", h[0]), ("c", h[0]), ("c", h[1]), ("c", h[1])], "sample_id string, digest string")
    got = {r["sample_id"]: r["digest"] for r in C.multiset_digest(rows).collect()}
    assert got["a"] == got["b"] == f"{4:064x}" and got["c"] == f"{9:064x}"


def test_subsample_ignores_other_cells(spark):
    cells = spark.range(200).withColumnRenamed("id", "cell_id")
    whole = {r[0] for r in C.subsample(cells, 0.5, 1, 2).collect()}
    assert {r[0] for r in C.subsample(cells.where("cell_id < 50"), 0.5, 1, 2).collect()} == {i for i in whole if i < 50} and 60 < len(whole) < 140


# contracts, preparation, splits, metrics --------------------------------------------------------------------------------

def test_contract_violations(spark):
    meta = spark.createDataFrame([("a", "x"), ("a", " "), ("b", None)], "sample_id string, donor string")
    got = {r["check_id"]: r["violations"] for r in K.dataset_contract(meta, spark.createDataFrame([("f",), ("f",)], "feature_id string"), "donor").collect()}
    assert got == {"blank_sample_id": 0, "blank_group": 2, "duplicate_sample_id": 1, "duplicate_feature_id": 1, "few_samples": 1, "few_features": 0, "few_groups": 1}
    long = spark.createDataFrame([("a", "f", -1.0), ("a", "g", 0.5), ("b", "f", 0.0), ("b", "g", None)], "sample_id string, feature_id string, value double")
    got = {r["check_id"]: r["violations"] for r in K.count_contract(long).collect()}
    assert got["negative"] == got["fractional"] == got["missing"] == 1 and got["empty_library"] == 2


def test_target_copies_and_duplicates(spark):
    long = spark.createDataFrame([(s, f, float(v)) for s, row in zip("abcd", [(0, 1, 5), (0, 2, 5), (1, 3, 5), (1, 5, 5)]) for f, v in zip("xyz", row)] + [("e", f, v) for f, v in zip("xyz", (0.0, 1.0, 5.0))], "sample_id string, feature_id string, value double")
    y = spark.createDataFrame([(s, v) for s, v in zip("abcde", (0.0, 0.0, 1.0, 1.0, 0.0))], "sample_id string, y double")
    got = {r["feature_id"]: (r["copies_target"], r["r"]) for r in K.target_copies(long, y, 2).collect()}
    assert got["x"][0] and not got["y"][0] and got["z"] == (False, None)
    groups = spark.createDataFrame([(s, f"g{s}") for s in "abcde"], "sample_id string, group string")
    assert [(r["n_groups"], r["n_samples"]) for r in K.profile_duplicates(long, groups).collect()] == [(2, 2)]


def test_imputation_uses_training_rows(spark):
    long = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 3.0), ("c", "f", None), ("d", "f", 99.0), ("a", "g", None), ("b", "g", None), ("c", "g", 7.0), ("d", "g", None)], "sample_id string, feature_id string, value double")
    train = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    got = {(r["sample_id"], r["feature_id"]): r["value"] for r in P.impute_median(long, train).collect()}
    assert got["c", "f"] == 2.0 and got["d", "g"] == 0.0 and got["c", "g"] == 7.0
    assert {r["feature_id"] for r in P.observed(long, train, 0.5).collect()} == {"f"}


def test_unseen_level_is_an_error(spark):
    meta = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "sample_id string, c string")
    with pytest.raises(ValueError):
        P.encode_covariates(meta, meta.where("sample_id != 'c'"), ["c"])


def test_summary_by_hand(spark):
    c = [[1.0, 0.5, 0.0], [0.8, -0.5, 0.2], [0.0, 0.0, 0.3]]
    rows = [(i, "k", f"f{j}", v) for i, r in enumerate(c) for j, v in enumerate(r)]
    got = {r["feature_id"]: r for r in E.stability_summary(spark.createDataFrame(rows, "fit_id int, contrast string, feature_id string, coef double"), 1e-7).collect()}
    assert [round(got[f"f{j}"]["selection_frequency"], 6) for j in range(3)] == [0.666667] * 3
    assert [got[f"f{j}"]["sign_consistency"] for j in range(3)] == [1.0, 0.5, 1.0]


def test_missing_statistics_never_pass(spark):
    cols = "selection_frequency sign_consistency outer_selection_frequency outer_sign_consistency coefficient coefficient_median_selected outer_dominant_sign".split()
    good = [1.0] * 7
    rows = [tuple(good)] + [tuple(None if j == i else v for j, v in enumerate(good)) for i in range(7)] + [tuple([1.0] * 4 + [-1.0, 1.0, 1.0])]
    got = [r["passes_robustness_gates"] for r in E.feature_gates(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).coalesce(1), [], 0.8, 0.9, 0.5, 1e-7).collect()]
    assert got == [True] + [False] * 8
    assert E.global_blockers(99, 0.05, 0.01, 0.1) == [] and "insufficient_permutation_resolution" in E.global_blockers(9, 0.05, 0.1, 0.1)
    assert E.global_blockers(99, 0.05, float("nan"), None)


def test_complete_linkage():
    r = {("a", "b"): 0.95, ("b", "c"): 0.9, ("a", "c"): 0.5, ("c", "d"): -0.99}
    got = E.complete_linkage("abcd", r, 0.85)
    assert got["a"] == got["b"] != got["c"] == got["d"]


def test_edge_cases_of_metrics(spark):
    one = spark.createDataFrame([(1, 0.8, 1.0), (1, 0.8, 1.0)], "y int, p double, w double")
    c = metrics.confusion(one).first()
    assert c["balanced_accuracy"] is None and c["mcc"] is None and metrics.ranking(one).first()["roc_auc"] is None
    assert metrics.brier(one).first()["brier_score"] == pytest.approx(0.04)
    flat = spark.createDataFrame([(2.0, 1.0, 1.0), (2.0, 3.0, 1.0)], "y double, p double, w double")
    assert metrics.regression(flat).first()["r2"] is None
    w = [r["w"] for r in metrics.group_weights(spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "g string"), "g").orderBy("g").collect()]
    assert sum(w[:3]) == pytest.approx(w[3])


def test_temporal_folds_look_forward(spark):
    times = spark.createDataFrame([(f"g{i}", float(i), float(i) + 0.5) for i in range(12)], "group string, first double, last double")
    rows = S.temporal_folds(times, 3, 0.5, 1.0).join(times, "group").collect()
    for f in range(3):
        begin = min(r["first"] for r in rows if r["fold"] == f and r["role"] == "test")
        assert max(r["last"] for r in rows if r["fold"] == f and r["role"] == "train") < begin - 1.0
    with pytest.raises(ValueError):
        S.temporal_folds(times, 9, 0.5, 1.0)


# sources, configuration, streaming, command line ----------------------------------------------------------------------

def test_delimited_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("id\tx\tkind\n001\t1.5\tNA\n020\t\t1\n")
    df = matrices.read_delimited(spark, str(tmp_path / "m.tsv"), ["kind"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("001", 1.5, "NA"), ("020", None, "1")]
    for text in ("id\n1\n", "id,a,a\n1,2,3\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(ValueError):
            matrices.read_delimited(spark, str(tmp_path / "bad.csv"))


def test_orientation(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    want = {("a", "f"): 1.0, ("a", "g"): None, ("b", "f"): 3.0, ("b", "g"): 4.0}
    rows = spark.createDataFrame([("a", 1.0, float("nan")), ("b", 3.0, 4.0)], "id string, f double, g double")
    cols = spark.createDataFrame([("f", 1.0, 3.0), ("g", float("nan"), 4.0)], "gene string, a double, b double")
    for wide in (rows, cols):
        assert {(r["sample_id"], r["feature_id"]): r["value"] for r in matrices.to_long(wide, ids).collect()} == want
    with pytest.raises(ValueError):
        matrices.to_long(rows, spark.createDataFrame([("x",)], "sample_id string"))


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%c\n2 2 3\n1 1 4\n2 1 1\n2 2 6\n")
    (tmp_path / "g.tsv").write_text("g0\tG0\ng1\tG1\n")
    (tmp_path / "b.tsv").write_text("001\n002\n")
    meta = spark.createDataFrame([("002", "s"), ("001", "s")], "cell_id string, sample_id string")
    path = lambda n: str(tmp_path / n)
    _, counts = matrices.read_matrix_market(spark, path("m.mtx"), path("g.tsv"), path("b.tsv"), meta)
    assert sorted(map(tuple, counts.collect())) == [("001", "g0", 4), ("001", "g1", 1), ("002", "g1", 6)]
    with pytest.raises(ValueError):
        matrices.read_matrix_market(spark, path("m.mtx"), path("g.tsv"), path("b.tsv"), meta.limit(1))


@pytest.mark.parametrize("bad", [{"outcome_type": "x"}, {"outer_folds": 1}, {"outer_folds": True}, {"strengths": (0.1, 0.1)}, {"l1_ratios": (0.0,)}, {"covariates": ("phenotype",)}, {"normalization": "none"}, {"imputation": "median"}, {"cv_strategy": "temporal"}, {"cell_resamples": 2}, {"gene_pairs": (("a", "a"),)}, {"programs": {"p": ("a", "a")}}, {"program_thresholds": {"q": 1.0}}, {"feature_blocks": ("nope",)}, {"min_prevalence": 0.0}, {"stability_fraction": 1.0}])
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_configuration_files(tmp_path):
    (tmp_path / "c.yaml").write_text("outer_folds: 4\ntolerance: '1e-3'\nstrengths: [0.1, 0.2]\n")
    (tmp_path / "c.toml").write_text("outer_folds = 4\nstrengths = [0.1, 0.2]\n")
    c = load_config(tmp_path / "c.yaml", {"seed": 3})
    assert (c.outer_folds, c.tolerance, c.strengths, c.seed) == (4, 1e-3, (0.1, 0.2), 3)
    assert load_config(tmp_path / "c.toml").strengths == (0.1, 0.2)
    with pytest.raises(ValueError, match="unknown"):
        load_config(None, {"nope": 1})


def test_streaming_moments_equal_batch(spark, tmp_path):
    """Also after a restart that repeats a batch, and when more files arrive."""
    from cohortlens.streaming.moments import SCHEMA, moments, stream_moments

    rng = np.random.default_rng(4)
    rows = [(f"s{rng.integers(3)}", "A", f"g{rng.integers(4)}", int(rng.integers(1, 9)), float(rng.random())) for _ in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    put = lambda k: df.where(F.pmod(F.hash("count", "value"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def take():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream_moments(stream, str(tmp_path / "out"), str(tmp_path / "ck"), (0.5,)).awaitTermination()

    key = lambda d: sorted((r["sample_id"], r["gene_id"], r["total"], round(r["s"], 9), r["tail_0"]) for r in d.collect())
    put(0)
    put(1)
    take()
    last = max((tmp_path / "ck/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    put(2)
    take()
    assert key(moments(spark, str(tmp_path / "out"))) == key(C.gene_moments(df, (0.5,)))
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3


def test_synthetic_studies(spark, tmp_path):
    from cohortlens.sources import synthetic as Y

    for scenario in Y.SCENARIOS:
        long, meta, truth = Y.bulk(spark, 24, 8, 3, scenario)
        assert long.count() == 192 and meta.count() == 24 and len(truth) == {"noise": 0, "batch_confounded": 0, "correlated": 6, "multiclass": 6}.get(scenario, 4)
    cells_, counts = Y.cells(spark, 3, 6, 4)
    assert cells_.count() == 48 and C.pseudobulk(cells_, counts).count() == 12 * 6
    Y.write_example(spark, tmp_path / "e", samples=12, features=5)
    assert load_config(tmp_path / "e/config.json").group == "donor"


def test_synthetic_scenarios_plant_what_they_say(spark):
    from cohortlens.sources import synthetic as Y

    def study(scenario, samples=90, features=30):
        long, meta, truth = Y.bulk(spark, samples, features, 5, scenario)
        assert sorted(map(tuple, long.repartition(3).collect())) == sorted(map(tuple, Y.bulk(spark, samples, features, 5, scenario)[0].collect()))
        wide = long.toPandas().pivot(index="sample_id", columns="feature_id", values="value")
        return np.log(wide.to_numpy() + 1), meta.orderBy("sample_id").toPandas(), truth

    shift = lambda x, y: x[y].mean(axis=0) - x[~y].mean(axis=0)
    x, m, truth = study("signal")
    d = shift(x, (m.phenotype == "1").to_numpy())
    assert (abs(d[:4]) > 1).all() and (np.sign(d[:4]) == list(truth.values())).all() and (abs(d[4:]) < 0.5).all() and (m.phenotype == "1").sum() == 45
    x, m, truth = study("batch_confounded")
    assert truth == {} and ((m.batch == "batch_case") == (m.phenotype == "1")).all() and (shift(x, (m.phenotype == "1").to_numpy())[:20] > 1).all()
    x, m, _ = study("correlated")
    r = np.corrcoef(x[:, :8].T)
    assert r[:6, :6].min() > 0.8 and abs(r[:6, 6:]).max() < 0.5 and (shift(x, (m.phenotype == "1").to_numpy())[:6] > 1).all()
    x, m, _ = study("multiclass")
    assert all((shift(x, (m.phenotype == str(c)).to_numpy())[2 * c:2 * c + 2] > 1).all() for c in range(3))
    x, m, _ = study("batch_specific")
    inside, one = (m.batch == "batch_0").to_numpy(), (m.phenotype == "1").to_numpy()
    assert (shift(x[inside], one[inside])[:4] > 1).all() and (abs(shift(x[~inside], one[~inside])[:4]) < 0.6).all()
    x, m, _ = study("outliers")
    assert x[0].mean() > x[1:].mean() + 5
    assert (study("imbalance")[1].phenotype == "1").sum() == 18 and (study("noise")[2]) == {}
    x, m, _ = study("continuous")
    assert (np.corrcoef(x[:, :4].T, m.phenotype)[4, :4] * [1, 1, -1, -1] > 0.8).all()


def test_synthetic_cells_do_not_depend_on_partitions(spark):
    from cohortlens.sources import synthetic as Y

    cells_, counts = Y.cells(spark, 4, 10, 25)
    again = [d.repartition(5) for d in Y.cells(spark, 4, 10, 25)]
    digest = lambda c, k: sorted(map(tuple, C.multiset_digest(C.profile_hash(k, c, "u")).collect()))
    assert digest(cells_, counts) == digest(*again)
    assert digest(cells_, counts) != digest(*Y.cells(spark, 4, 10, 25, seed=8))
    means = C.pseudobulk(cells_, counts).join(cells_.select("sample_id", "phenotype").distinct(), "sample_id").groupBy("gene_id").pivot("phenotype", ["0", "1"]).agg(F.sum("count")).toPandas().sort_values("gene_id")
    ratio = (means["1"] / means["0"]).to_numpy()
    assert (ratio[:4] > 3).all() and (ratio[4:] < 2).all() and ratio[4:].min() > 0.5


def test_distribution_features(spark):
    from cohortlens.operators import distribution as D
    from cohortlens.sources import synthetic as Y

    cells_, counts = Y.cells(spark, 4, 8, 6)
    blocks = ("abundance", "gene_mean", "gene_detection", "gene_variance", "gene_tail", "gene_correlation", "program_mean", "program_variance", "program_q90", "program_fraction", "program_correlation")
    config = Config(single_cell_mode="distribution", feature_blocks=blocks, gene_pairs=(("gene_0000", "gene_0001"),), programs={"p": ("gene_0000", "gene_0002"), "q": ("gene_0003",)}, program_thresholds={"p": 0.5, "q": 0.5}, min_cells=5, cell_resamples=1, group="donor")
    out = D.distribution_features(cells_, counts, config)
    per_state = 1 + 8 * 3 + 8 * 3 + 1 + 2 * 4 + 1
    assert out.count() == 8 * 2 * per_state and out.groupBy("sample_id", "feature_id").count().where("count > 1").isEmpty()
    assert D.feature_schema(out).count() == 2 * per_state
    few = D.distribution_features(cells_, counts, Config(**{**config.__dict__, "min_cells": 7}))
    assert few.where("kind != 'abundance' and value is not null").isEmpty() and few.where("kind = 'abundance' and value is null").isEmpty()
    view = D.distribution_features(cells_, counts, config, 1)
    assert view.select("feature_id").distinct().exceptAll(out.select("feature_id").distinct()).isEmpty()
    meta = cells_.drop("cell_id", "state").dropDuplicates(["sample_id"])
    fc = D.feature_config(config)
    p = G.pack(out.select("sample_id", "feature_id", "value"), meta, fc)
    assert p.x.shape == (8, 2 * per_state) and D.contract(counts, config)["version"] == 1


def test_command_line(spark, tmp_path, capsys):
    from cohortlens.__main__ import main

    (tmp_path / "m.csv").write_text("id,phenotype\na,0\nb,1\n")
    (tmp_path / "x.csv").write_text("id,f\na,1\nb,2\n")
    args = ["bulk", "--expression", str(tmp_path / "x.csv"), "--metadata", str(tmp_path / "m.csv"), "--output", str(tmp_path / "out")]
    assert main(args) == 1 and "contract" in capsys.readouterr().err
