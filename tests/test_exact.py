"""Refused settings, exact contracts, ranks and quantiles without hot tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.config import Config, load_config
from cohortlens.functions import metrics as M
from cohortlens.functions import ranks as R
from cohortlens.operators import cells as C
from cohortlens.operators import contracts as K
from cohortlens.operators import splits as S
from cohortlens.sources.matrices import to_long

ONE, TWO = {"p": ("a", "b")}, {"p": ("a", "b"), "q": ("c",)}


# settings -------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("wrong, text", [
    ({"feature_blocks": ()}, "one at least"), ({"feature_blocks": ("gene_median",)}, "known blocks"), ({"feature_blocks": ("gene_correlation",)}, "gene_pairs"),
    ({"feature_blocks": ("program_correlation",), "programs": ONE}, "two programs"), ({"feature_blocks": ("program_fraction",), "programs": TWO, "program_thresholds": {"p": 1.0}}, "every program"),
    ({"gene_pairs": (("a", "b"), ("b", "a"))}, "either order"), ({"gene_pairs": (("a", "a"),)}, "two genes"), ({"gene_pairs": ("ab",)}, "two genes"), ({"gene_thresholds": (-1.0,)}, "positive"), ({"gene_thresholds": ()}, "positive"),
    ({"programs": {"p": "abc"}}, "list of distinct genes"), ({"programs": {" ": ("a",)}}, "needs a name"), ({"programs": ["a"]}, "program"), ({"program_thresholds": {"x": 1.0}}, "by program"),
    ({"cell_states": ("A",)}, "cell_type"), ({"cell_type_value": "A", "single_cell_mode": "distribution"}, "cell_type_value"), ({"panel_validation": "false"}, "true or false"), ({"supporting_de": 1}, "true or false"),
    ({"group": " "}, "not blank"), ({"covariates": "age"}, "distinct names"), ({"covariates": None}, "distinct names"), ({"outcome": None}, "not blank"), ({"feature_genes": ("g", "g")}, "distinct names"),
])
def test_settings_that_contradict_themselves_are_refused(wrong, text):
    with pytest.raises(ValueError, match=text):
        Config(**wrong)


def test_settings_that_fit_are_taken(tmp_path):
    Config(cell_states=("all_cells",))
    Config(cell_states=("A",), cell_type="kind", single_cell_mode="distribution", feature_blocks=("program_fraction", "program_correlation", "gene_correlation"), programs=TWO, program_thresholds={"p": 0, "q": -1.5}, gene_pairs=(("a", "b"), ("b", "c")))
    (tmp_path / "c.json").write_text('{"programs": {"p": "abc"}}')
    with pytest.raises(ValueError, match="list of distinct genes"):
        load_config(tmp_path / "c.json")


# contracts ------------------------------------------------------------------------------------------------------------

def profiles(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, feature_id string, value double"), spark.createDataFrame(sorted({(r[0], "g" + r[0][0]) for r in rows}), "sample_id string, group string")


def duplicates(spark, rows):
    return [(r["n_groups"], r["n_samples"]) for r in K.profile_duplicates(*profiles(spark, rows)).collect()]


def test_profiles_are_compared_exactly(spark):
    near = [("a1", "x", 1.0), ("a1", "y", 2.0), ("b1", "x", 1.0000001), ("b1", "y", 2.0)]
    assert duplicates(spark, near) == []
    zeros = [("a1", "x", 0.1 + 0.2), ("a1", "y", -0.0), ("b1", "x", 0.1 + 0.2), ("b1", "y", 0.0), ("c1", "x", 0.1 + 0.2), ("d1", "x", 0.3)]
    assert duplicates(spark, zeros) == [(3, 3)]
    swapped = [("a1", "x", 1.0), ("a1", "y", 2.0), ("b1", "x", 2.0), ("b1", "y", 1.0), ("c1", "x", None), ("c1", "y", 2.0)]
    assert duplicates(spark, swapped) == []
    assert duplicates(spark, [("a1", "x", 1.0), ("a2", "x", 1.0), ("b1", "x", 5.0)]) == []  # within a group
    assert duplicates(spark, [("a1", "x", 1.0), ("a1", "x", 1.0), ("b1", "x", 1.0)]) == []  # multiplicity counts


def test_profile_digests_gather_no_lists(spark):
    plan = K.profile_digests(profiles(spark, [("a1", "x", 1.0)])[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan


def test_counts_that_no_fold_can_use_copy_no_target(spark):
    rows = [(f"s{i}", g, float(v)) for i in range(12) for g, v in (("low", i % 2), ("high", 9 * (i % 2)), ("other", i))]
    long, y = spark.createDataFrame(rows, "sample_id string, feature_id string, value double"), spark.createDataFrame([(f"s{i}", float(i % 2)) for i in range(12)], "sample_id string, y double")
    flagged = lambda least: {r["feature_id"] for r in K.target_copies(long, y, 2, least).where("copies_target").collect()}
    assert flagged(None) == {"low", "high"} and flagged(5.0) == {"high"} and flagged(10.0) == set()


def test_eta_squared_equals_its_definition(spark):
    rng = np.random.default_rng(1)
    b, y = rng.integers(0, 4, 500), rng.normal(1e6, 1, 500)
    y += b
    df = spark.createDataFrame([(str(k), float(v)) for k, v in zip(b, y)] + [("0", None)], "b string, y double")
    means = np.array([y[b == k].mean() for k in b])
    assert K.eta_squared(df, "b", "y").first()[0] == pytest.approx(means.var() / y.var(), rel=1e-9)


@pytest.mark.parametrize("orientation", ["samples", "features"])
def test_orientation_needs_equal_sets(spark, orientation):
    ids = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    wide = spark.createDataFrame([("s1", 1.0, 2.0, 3.0), ("s2", 4.0, 5.0, 6.0)], "id string, g1 double, g2 double, g3 double") if orientation == "samples" else spark.createDataFrame([("g1", 1.0, 4.0), ("g2", 2.0, 5.0), ("g3", 3.0, 6.0)], "id string, s1 double, s2 double")
    assert {tuple(r) for r in to_long(wide, ids).collect()} == {("s1", "g1", 1.0), ("s1", "g2", 2.0), ("s1", "g3", 3.0), ("s2", "g1", 4.0), ("s2", "g2", 5.0), ("s2", "g3", 6.0)}
    with pytest.raises(ValueError, match="exactly one axis"):
        to_long(wide, ids.limit(1))
    with pytest.raises(ValueError, match="exactly one axis"):
        to_long(wide.unionByName(wide), ids) if orientation == "samples" else to_long(wide.drop("s2"), ids)


def test_no_subsample_is_an_error(spark):
    groups = spark.createDataFrame([(f"g{i}", "a" if i else "b") for i in range(8)], "group string, label string")
    with pytest.raises(ValueError, match="raise the fraction"):
        S.subsample_groups(groups, 5, 2, 1, 0, tries=3)
    even = spark.createDataFrame([(f"g{i}", "ab"[i % 2]) for i in range(12)], "group string, label string")
    sets = [{r["group"] for r in S.subsample_groups(even, 8, 2, 1, k).collect()} for k in range(3)]
    assert all(len(s) == 8 for s in sets) and len({frozenset(s) for s in sets}) > 1
    assert S.subsample_groups(even.withColumn("label", F.lit(None).cast("string")), 8, 2, 1, 0).count() == 8


# ranks and quantiles --------------------------------------------------------------------------------------------------

def even_sizes(df, key, bounds):
    n = sorted(r["n"] for r in df.groupBy(R.bucket_of(key, bounds).alias("b")).agg(F.count("*").alias("n")).collect())
    return len(n) > 5 and n[-1] <= 3 * n[len(n) // 2]


def test_buckets_follow_the_values(spark):
    n = 40_000
    ids = spark.range(n).select(F.format_string("sample_%07d", "id").alias("k"))
    scores = spark.range(n).select((0.9990 + 0.0005 * F.rand(3)).alias("k"))
    skewed = spark.range(n).select(F.exp(20 * F.randn(5)).alias("k"))
    for df in (ids, scores, skewed):
        assert even_sizes(df, F.col("k"), R.cuts(df, F.col("k"), 4000))
    assert R.cuts(ids.limit(0), F.col("k")) == [] and R.cuts(ids, F.lit("one"), 100) in ([], ["one"])
    r = R.ranked(ids, [], R.bucket_of(F.col("k"), R.cuts(ids, F.col("k"), 4000)), ["k"])
    assert r.where(F.col("k") != F.format_string("sample_%07d", F.col("rank") - 1)).isEmpty()


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    big, small = np.round(rng.normal(size=20_000), 3), rng.normal(size=7)
    rows = [("big", float(v)) for v in big] + [("small", float(v)) for v in small] + [("one", 4.0), ("none", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["q90"], r["m"]) for r in R.quantiles(df, ["k"], "v", {"q90": 0.9, "m": 0.5}, bucket_rows=500).collect()}
    assert set(got) == {"big", "small", "one", None}
    for k, values in {"big": big, "small": small, "one": [4.0], None: [2.0, 4.0]}.items():
        assert got[k] == pytest.approx((np.quantile(values, 0.9), np.quantile(values, 0.5)), abs=1e-12)
    whole = R.quantiles(df, [], "v", {"m": 0.25}, bucket_rows=1000).first()["m"]
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.25), abs=1e-12)
    assert "percentile" not in R.quantiles(df, ["k"], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()


def test_program_quantiles_of_one_sample_with_all_cells(spark):
    rng = np.random.default_rng(4)
    scores = np.round(rng.gamma(1.0, 2.0, 5000), 2)
    df = spark.createDataFrame([(f"c{i}", "s", "A", "p", float(v)) for i, v in enumerate(scores)], "cell_id string, sample_id string, state string, program string, score double")
    r = C.program_blocks(df, {"p": 1.0}, 1).first()
    assert (r["program_q90"], r["program_fraction"], r["program_mean"]) == pytest.approx((np.quantile(scores, 0.9), (scores > 1.0).mean(), scores.mean()))
    assert C.program_blocks(df, {}, 1).first()["program_fraction"] is None


def plain_adjusted(p):
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.asarray(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


def test_adjusted_p_values_with_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKET_ROWS", 50)
    monkeypatch.setattr(R.cuts, "__defaults__", (50,))
    rng = np.random.default_rng(6)
    families = {"a": np.round(rng.random(700) ** 3, 3), "b": np.full(300, 0.04), "c": np.r_[np.full(200, 1.0), rng.random(50) * 1e-9]}
    rows = [(f"{k}{i}", k, float(p)) for k, ps in families.items() for i, p in enumerate(ps)] + [("a_null", "a", None)]
    df = spark.createDataFrame(rows, "test string, family string, p double")
    got = {r["test"]: r["padj"] for r in M.benjamini_hochberg(df, "p", ["family"]).collect()}
    assert len(got) == len(rows) and got["a_null"] is None
    for k, ps in families.items():
        assert [got[f"{k}{i}"] for i in range(len(ps))] == pytest.approx(plain_adjusted(ps), rel=1e-12)
    alone = {r["test"]: r["padj"] for r in M.benjamini_hochberg(df.where("family = 'a'")).collect()}
    assert alone == {k: v for k, v in got.items() if k[0] == "a"}


def test_least_adjusted_p_is_not_the_least_p(spark, sf_dir):
    from cohortlens.plans import prep_queries as Q

    least = {r["gene_id"]: r["p"] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("test"), F.col("p_brand").alias("gene_id")).join(Q.win6(spark, sf_dir), "test").groupBy("gene_id").agg(F.min("p").alias("p")).collect()}
    got = {r["gene_id"]: r["padj"] for r in Q.agg26(spark, sf_dir).collect()}
    assert set(got) == set(least) and all(got[g] >= least[g] for g in got) and any(got[g] > least[g] for g in got)


def test_areas_of_scores_in_a_narrow_band(spark, monkeypatch):
    monkeypatch.setattr(R.cuts, "__defaults__", (100,))
    rng = np.random.default_rng(8)
    p, y = 0.9990 + 0.0005 * np.round(rng.random(1500), 3), rng.integers(0, 2, 1500)
    df = spark.createDataFrame([(int(b), float(a), 1.0) for a, b in zip(p, y)], "y int, p double, w double")
    wins = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    assert M.ranking(df).first()["roc_auc"] == pytest.approx(wins, abs=1e-9)


# pairs, linkage, hashes -----------------------------------------------------------------------------------------------

def sparse_cells(spark, n=400, genes=12, seed=9):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, genes)) < 0.4, np.round(rng.gamma(2.0, 1.0, (n, genes)), 3), 0.0)
    group = np.where(np.arange(n) < n * 3 // 4, 0, np.arange(n) % 3)  # one sample holds most cells
    rows = [(int(i), f"s{group[i]}", "A", f"g{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return x, group, spark.createDataFrame(rows, "cell_id long, sample_id string, state string, gene_id string, value double")


def test_pair_sums_equal_matrix_products(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 64)  # many blocks
    x, group, values = sparse_cells(spark)
    pairs = [(f"g{i:02d}", f"g{j:02d}") for i in range(12) for j in range(i + 1, 12)] + [("g00", "absent")]
    got = {(r["sample_id"], r["a"], r["b"]): (r["sa"], r["ssa"], r["sb"], r["ssb"], r["ab"]) for r in C.pair_moments(values, spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert len(got) == 3 * len(pairs)
    for s in range(3):
        own = x[group == s]
        for a, b in pairs[:-1]:
            u, v = own[:, int(a[1:])], own[:, int(b[1:])]
            assert got[f"s{s}", a, b] == pytest.approx((u.sum(), u @ u, v.sum(), v @ v, u @ v))
        assert got[f"s{s}", "g00", "absent"][2:] == (0, 0, 0)


def test_plans_do_not_grow_with_pairs(spark):
    _, _, values = sparse_cells(spark, 20)
    size = lambda n: len(C.pair_moments(values, spark.createDataFrame([(f"g{i:04d}", f"h{i:04d}") for i in range(n)], "a string, b string"))._jdf.queryExecution().optimizedPlan().toString())
    assert size(1000) < 1.2 * size(2)


def test_correlations_of_many_programs(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((60, 50)) < 0.5, rng.random((60, 50)), 0.0)
    scores = spark.createDataFrame([(i, "s", "A", f"p{j:02d}", float(x[i, j])) for i in range(60) for j in range(50)], "cell_id long, sample_id string, state string, program string, score double")
    r = np.corrcoef(x.T)
    got = C.program_correlations(scores).collect()
    assert len(got) == 50 * 49 // 2 and all(row["value"] == pytest.approx(r[int(row["a"][1:]), int(row["b"][1:])]) for row in got)


def plain_linkage(names, dist, most):
    groups = [[n] for n in sorted(names)]
    while len(groups) > 1:
        d, i, j = min((max(dist[a, b] for a in groups[i] for b in groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > most + 1e-15:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("digits", [1, 6])
def test_linkage_equals_plain_steps(digits):
    from cohortlens.operators.evidence import complete_linkage

    rng = np.random.default_rng(digits)
    names = [f"f{i:02d}" for i in range(24)]
    r = {(a, b): float(np.round(rng.random() * 2 - 1, digits)) for i, a in enumerate(names) for b in names[i + 1:]}  # one digit: many ties
    dist = {k: 1 - abs(v) for k, v in r.items()} | {(b, a): 1 - abs(v) for (a, b), v in r.items()}
    for threshold in (0.1, 0.4, 0.8):
        got = complete_linkage(names[::-1], r, threshold)
        groups = {frozenset(n for n in names if got[n] == g) for g in set(got.values())}
        assert groups == plain_linkage(names, dist, 1 - threshold)
        assert sorted(set(got.values())) == [f"correlation_{k + 1:03d}" for k in range(len(groups))] and got["f00"] == "correlation_001"


def test_linkage_of_a_thousand_features():
    import time

    from cohortlens.operators.evidence import complete_linkage

    rng = np.random.default_rng(1)
    names, c = [f"f{i:04d}" for i in range(1000)], np.corrcoef(rng.normal(size=(1000, 30)))
    began = time.perf_counter()
    complete_linkage(names, {(names[i], names[j]): c[i, j] for i in range(1000) for j in range(i + 1, 1000)}, 0.01)
    assert time.perf_counter() - began < 20


def test_large_files_are_hashed_in_a_buffer(spark, tmp_path, monkeypatch):
    import hashlib

    from cohortlens.sources import runs

    monkeypatch.setattr(runs, "HASHED", 1000)
    (tmp_path / "a").mkdir()
    content = {"small.bin": b"x" * 10, "a/large.bin": bytes(range(256)) * 4000}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    assert runs.Store(spark, tmp_path).hashes() == {k: hashlib.sha256(v).hexdigest() for k, v in content.items()}


# count tests of many states -------------------------------------------------------------------------------------------

def states_study(spark, states, samples=16, genes=12):
    rng = np.random.default_rng(12)
    y = np.arange(samples) % 2
    rows = []
    for k, state in enumerate(states):
        x = rng.negative_binomial(20, 20 / (20 + np.exp(4 + 1.5 * np.outer(y, np.arange(genes) == k % genes))))
        rows += [(state, f"s{i:02d}", f"g{j:02d}", float(x[i, j])) for i in range(samples) for j in range(genes)]
    counts = spark.createDataFrame(rows, "state string, sample_id string, feature_id string, value double")
    meta = spark.createDataFrame([(f"s{i:02d}", str(v)) for i, v in enumerate(y)], "sample_id string, phenotype string")
    cells = spark.createDataFrame([(s, f"s{i:02d}", 50) for s in states for i in range(samples)], "state string, sample_id string, n_cells int")
    return counts, meta, cells


def test_states_are_tested_together_as_if_alone(spark):
    from cohortlens.operators import expression_tests as X

    counts, meta, cells = states_study(spark, ["A", "B", "C"])
    cells = cells.where("state <> 'C' or sample_id < 's03'")  # too few samples for C
    empty = counts.where("state = 'A'").withColumns({"state": F.lit("D"), "value": F.when(F.col("sample_id") == "s00", 0.0).otherwise(F.col("value"))})
    tests, failed = X.supporting_tests(counts.unionByName(empty), meta, "phenotype", cells.unionByName(cells.where("state = 'A'").withColumn("state", F.lit("D"))))
    got = {(r["state"], r["feature_id"]): r for r in tests.collect()}
    assert set(failed) == {"C", "D"} and "degrees of freedom" in failed["C"] and "s00" in failed["D"] and len(got) == 24
    for state in ("A", "B"):
        for r in X.differential_expression(counts.where(F.col("state") == state).drop("state"), meta, "phenotype").collect():
            assert (got[state, r["feature_id"]]["p"], got[state, r["feature_id"]]["log2_fold_change"]) == pytest.approx((r["p"], r["log2_fold_change"]), rel=1e-9)
    assert got["A", "g00"]["padj"] < 1e-4 and got["B", "g01"]["padj"] < 1e-4 and got["A", "g05"]["padj"] > 0.01
    assert [got[k]["padj"] for k in sorted(got)] == pytest.approx(list(plain_adjusted([got[k]["p"] for k in sorted(got)])))


def test_jobs_do_not_grow_with_states(spark):
    from cohortlens.operators import expression_tests as X

    def jobs(states, group):
        spark.sparkContext.setJobGroup(group, group)
        counts, meta, cells = states_study(spark, states, 8, 4)
        X.supporting_tests(counts, meta, "phenotype", cells)[0].count()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert abs(jobs([f"t{k}" for k in range(12)], "many") - jobs(["t0", "t1"], "few")) <= 2
