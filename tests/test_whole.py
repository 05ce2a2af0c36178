"""Operators do the whole job: nothing is left out by a filter, a default or an unread setting."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.config import Config
from cohortlens.operators import expression_tests as X
from cohortlens.plans import fitgrid as G
from cohortlens.plans import registry
from test_core import SMALL, frames, packed, synthetic


def test_temporal_queries_read_all_orders(spark, sf_dir):
    q, orders = registry.queries(), spark.read.parquet(f"{sf_dir}/orders.parquet")
    year = lambda df: df.select(F.concat_ws(":", "o_custkey", F.year("o_orderdate")).alias("group")).distinct()
    times = q["win4_group_times"](spark, sf_dir)
    assert times.select("group").exceptAll(year(orders)).isEmpty() and year(orders).exceptAll(times.select("group")).isEmpty()
    roles = {(r["fold"], r["role"]): r["count"] for r in q["spl6_temporal_folds"](spark, sf_dir).groupBy("fold", "role").count().collect()}
    assert set(roles) == {(f, r) for f in range(3) for r in ("train", "test")}  # no side is empty
    assert q["jn15_temporal_range_join"](spark, sf_dir).count() == sum(n for (_, r), n in roles.items() if r == "train")
    assert q["win5_occasion_windows"](spark, sf_dir).count() == times.select("first").distinct().count()


def test_count_tests_screen_the_training_rows(spark):
    """deseq2 keeps what the count tests of the training rows keep, not the most variable genes."""
    x, y = synthetic(samples=24, features=14)
    x[:, 13] = np.random.default_rng(0).permutation(np.r_[np.full(12, 2), np.full(12, 900)])  # varies most, says nothing
    config = Config(**(SMALL | {"candidate_method": "deseq2", "de_fdr": 0.05, "batch": "batch", "max_features": 5}))
    p = packed(x, y)
    rows = np.sort(np.random.default_rng(1).permutation(24)[:18])
    long, meta = frames(spark, x[rows], y[rows])
    tests = X.differential_expression(long, meta.drop("batch").join(spark.createDataFrame([(f"s{i:03d}", p.batches[r]) for i, r in enumerate(rows)], "sample_id string, batch string"), "sample_id"), "phenotype", ["batch"])
    padj = {r["feature_id"]: r["padj"] for r in tests.collect()}
    kept = G.prepare(p, rows, p.y[rows], config).selected
    best = sorted((v, f) for f, v in padj.items() if v <= 0.05)[:5]
    assert {p.features[j] for j in kept} == {f for _, f in best} >= {"g00", "g01", "g02", "g03"}
    assert "g13" not in {p.features[j] for j in kept} and "g13" in {p.features[j] for j in G.prepare(p, rows, p.y[rows], Config(**(SMALL | {"max_features": 5}))).selected}
    with pytest.raises(ValueError):
        G.Prepared(p.x, p.y, p.covariates, config)  # no silent fall back to variance
    unit = G.final_unit(p, strength=0.02, l1_ratio=0.5)
    got = G.run_units(spark, p, [unit], config).first()
    assert got["error"] is None and got["retained"] == G.prepare(p, np.arange(24), p.y, config).selected.tolist()
    repeated = meta.withColumn("donor", F.lit("d"))
    with pytest.raises(ValueError, match="several samples"):
        G.pack(long, repeated, config)


def test_permutations_stay_within_strata(spark):
    """Each stratum keeps its labels; without strata nothing changes; groups of several strata are refused."""
    x, y = synthetic(samples=24, features=6)
    site = np.array(["a" if i < 8 or i >= 20 else "b" for i in range(24)])
    long, meta = frames(spark, x, y)
    meta = meta.join(spark.createDataFrame([(f"s{i:03d}", s) for i, s in enumerate(site)], "sample_id string, site string"), "sample_id")
    config = Config(**(SMALL | {"permutation_strata": "site", "permutations": 5}))
    p = G.pack(long, meta, config)
    labels = [np.asarray(u["labels"]) for u in G.outer_units(p, config, 5) if u["fold"] == 0]
    assert len({tuple(v) for v in labels}) > 3
    for v in labels:
        assert all(sorted(v[site == s]) == sorted(p.y[site == s]) for s in "ab")
    free = Config(**(SMALL | {"permutations": 5}))
    assert any(sorted(G.permuted(p, free, k)[site == "a"]) != sorted(p.y[site == "a"]) for k in range(1, 6))
    for bad in (dict(permutation_strata="site", group="batch"), dict(permutation_strata="site", permutation_scheme="within_group"), dict(permutation_strata="nowhere")):
        c = Config(**(SMALL | bad))
        m = meta.withColumn("phenotype", F.when(F.col("batch") == "b0", "0").otherwise("1")) if c.group == "batch" else meta
        with pytest.raises(ValueError, match="strat"):
            G.permuted(G.pack(long, m, c), c, 1)


def test_runs_check_the_study_and_refuse_what_they_lack(spark, tmp_path):
    from cohortlens.workflow import check_study, run_analysis, study_warnings

    x, y = synthetic(samples=24, features=8)
    long, meta = frames(spark, x, y)
    config = Config(**SMALL)
    assert study_warnings(long, meta, config) == [] and check_study(long, meta, config) is not None
    copied = x.copy()
    copied[3] = copied[2]
    with pytest.raises(ValueError, match="profile_in_several_groups"):
        check_study(frames(spark, copied, y)[0], meta, config)
    leaking = meta.withColumns({"dose": F.col("phenotype").cast("double") * 2 + 1, "age": F.xxhash64("sample_id").cast("double"), "ward": F.concat(F.lit("w"), "phenotype")})
    with pytest.raises(ValueError, match="covariate_leakage:dose, covariate_leakage:ward"):
        check_study(long, leaking, Config(**(SMALL | {"covariates": ("age", "dose", "ward")})))
    named = lambda c: F.regexp_replace(c, "^s000$", "s_case")
    big = long.withColumn("value", F.when(F.col("sample_id") == "s005", F.col("value") * 100).otherwise(F.col("value"))).withColumn("sample_id", named("sample_id"))
    called = meta.withColumns({"sample_id": named("sample_id"), "phenotype": F.when(F.col("phenotype") == "0", "case").otherwise("control")})
    assert study_warnings(big, called, config) == ["id_contains_outcome", "library_outlier:s005"]
    with pytest.raises(ValueError, match="no count tests"):
        run_analysis(spark, long, meta, Config(**(SMALL | {"de_pair_group": True})), tmp_path / "refused")
    assert not (tmp_path / "refused").exists()


def test_runs_write_correlation_groups(spark, tmp_path):
    from cohortlens.workflow import run_analysis

    x, y = synthetic(samples=24, features=8)
    x[:, 1] = x[:, 0] + np.random.default_rng(0).integers(0, 2, 24)
    long, meta = frames(spark, x, y)
    metrics = run_analysis(spark, long, meta, Config(**(SMALL | {"permutations": 0, "l1_ratios": (0.2,)})), tmp_path / "run")
    members = {r["feature_id"]: r["group_id"] for r in spark.read.parquet(str(tmp_path / "run/correlation_members.parquet")).collect()}
    chosen = {r["feature_id"] for r in spark.read.parquet(str(tmp_path / "run/stability.parquet")).where("selection_frequency > 0").collect()}
    assert set(members) == chosen >= {"g00", "g01"} and members["g00"] == members["g01"]
    pair = spark.read.parquet(str(tmp_path / "run/correlations.parquet")).where("a = 'g00' and b = 'g01'").first()
    assert pair["r"] > 0.99 and spark.read.parquet(str(tmp_path / "run/substitutions.parquet")).count() > 0
    assert metrics["warnings"] == []


def test_pseudobulk_sums_cells_that_pass(spark):
    from cohortlens.__main__ import pseudobulk_studies

    cells = spark.createDataFrame([("c1", "s1", "A"), ("c2", "s1", "A"), ("c3", "s1", "A"), ("c4", "s1", "B"), ("c5", "s1", "A")], "cell_id string, sample_id string, state string")
    counts = spark.createDataFrame([("c1", "g", 5), ("c1", "h", 5), ("c2", "g", 1), ("c3", "g", 4), ("c3", "MT-1", 40), ("c4", "g", 7), ("c4", "h", 2), ("c5", "g", 30)], "cell_id string, gene_id string, count long")
    limits = dict(min_cells=1, cell_min_counts=2, cell_min_genes=2, mitochondrial_prefix="MT-", max_mito_fraction=0.5)
    values = lambda df: {(r["feature_id"]): r["value"] for r in df.collect()}
    both = pseudobulk_studies(cells, counts, Config(**limits))
    assert set(both) == {"A", "B"} and both["A"][1].permutation_alpha == 0.025
    assert values(both["A"][0]) == {"g": 5.0, "h": 5.0, "MT-1": 0.0}  # c2, c3 and c5 fail
    one = pseudobulk_studies(cells, counts, Config(**limits, cell_type_value="B"))
    assert set(one) == {"B"} and one["B"][1].permutation_alpha == 0.05
    assert pseudobulk_studies(cells, counts, Config(**(limits | {"min_cells": 2})))["A"][0].isEmpty()  # rejected cells do not count
    with pytest.raises(ValueError, match="absent"):
        pseudobulk_studies(cells, counts, Config(cell_type_value="C"))


def test_queries_over_all_donors_and_genes(spark, sf_dir):
    from cohortlens.sources.study import study

    q, s = registry.queries(), study(spark, sf_dir)
    genes = {r[0] for r in s.genes.select("gene_id").collect()}
    folds = q["spl5_leave_batch_out"](spark, sf_dir)
    for state, test in (("P", "batch = 'Z'"), (None, "true")):
        want = (s.cells.where(F.col("state") == state) if state else s.cells).select("sample_id").distinct()
        assert want.exceptAll(folds.where("role = 'test'").where(test).select("sample_id").distinct()).isEmpty()
    assert q["jn12_purged_training"](spark, sf_dir).count() == folds.where("role = 'train'").count() > 0
    assert {r[0] for r in q["src2_bulk_long_form"](spark, sf_dir).select("feature_id").distinct().collect()} == genes
    matrix = q["snk4_sample_feature_matrix"](spark, sf_dir)
    assert len(matrix.columns) == 2 + len(genes) and matrix.select("state").distinct().count() == s.cells.select("state").distinct().count()
    ranked = {r[0] for r in q["srt4_correlation_candidates"](spark, sf_dir).select("feature_id").collect()}
    pairs = q["cor1_correlation_matrix"](spark, sf_dir).collect()
    assert {r["a"] for r in pairs} | {r["b"] for r in pairs} == ranked
    shown = {r[0] for r in q["srt6_preview_limit"](spark, sf_dir).select("feature_id").distinct().collect()}
    assert {r[0] for r in q["rep1_distribution_evidence"](spark, sf_dir).select("source").distinct().collect()} == shown


@pytest.mark.parametrize("name", ["jn9_symbol_default", "src6_annotations"])
def test_symbols_of_the_genes_that_cells_count(spark, sf_dir, tmp_path, name):
    """Brands never sold, sold in unknown orders or to unknown customers, or whose quantities cancel out, are genes of no cell."""
    con, tables = duckdb.connect(), "region nation customer part orders lineitem".split()
    for t in tables:
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for key, brand in enumerate(("unsold", "no order", "no customer", "cancelled", "sold"), 900_001):
        con.execute(f"INSERT INTO part SELECT * REPLACE ({key} AS p_partkey, '{brand}' AS p_brand, 'a ' || '{brand}' AS p_name) FROM part LIMIT 1")
    con.execute("INSERT INTO orders SELECT * REPLACE (9000001 AS o_orderkey, 99999999 AS o_custkey) FROM orders LIMIT 1")
    known = con.execute("SELECT min(o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey").fetchone()[0]
    for order, part, quantity in ((9_000_002, 900_002, 3), (9_000_001, 900_003, 3), (known, 900_004, 2), (known, 900_004, -2), (known, 900_005, 1)):
        con.execute(f"INSERT INTO lineitem SELECT * REPLACE ({order} AS l_orderkey, {part} AS l_partkey, {quantity} AS l_quantity) FROM lineitem LIMIT 1")
    for t in tables:
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = registry.queries()[name](spark, str(tmp_path)).select("gene_id", "gene_symbol").collect()
    symbols = dict(map(tuple, got))
    assert symbols["sold"] == "a sold" and symbols["Brand#9"] == "" and not {"unsold", "no order", "no customer", "cancelled"} & set(symbols)
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT gene_id, gene_symbol FROM ({registry.oracle_sql()[name]})").fetchall())
