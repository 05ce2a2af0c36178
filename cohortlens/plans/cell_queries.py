"""Queries of the cell operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import cells as C
from ..sources.study import BASE_SQL, MITO_PREFIX, PAIRS, PROGRAMS, THRESHOLDS, canonical_counts, spread, study, table

Q: dict = {}
SQL: dict[str, str] = {}
QC = (20, 1, 0.9)
STATES = ("F", "O")
LIMITS = {"low": 0.5, "high": 1.0}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(*cols):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def pairs_df(spark):
    return spark.createDataFrame(list(PAIRS), "a string, b string")


def programs_df(spark):
    return spark.createDataFrame([(p, g) for p, gs in PROGRAMS.items() for g in gs], "program string, gene_id string")


QUALITY_SQL = BASE_SQL + """, quality AS (SELECT c.*, coalesce(library, 0)::BIGINT AS library, coalesce(detected, 0)::BIGINT AS detected, coalesce(mito, 0)::BIGINT / greatest(coalesce(library, 0), 1) AS mito_fraction FROM cells c
  LEFT JOIN (SELECT cell_id, sum(count) AS library, count(*) FILTER (count > 0) AS detected, sum(count) FILTER (starts_with(gene_id, 'Brand#2')) AS mito FROM counts GROUP BY 1) USING (cell_id))"""
KEEP_SQL = "library >= 20 AND detected >= 1 AND mito_fraction <= 0.9"
GROUPS_SQL = ", groups AS (SELECT sample_id, state, count(*) AS n_cells FROM cells GROUP BY 1, 2)"
VALUES_SQL = BASE_SQL + GROUPS_SQL + """, vals AS (SELECT cell_id, sample_id, state, gene_id, count, ln(1 + 1e4 * count / greatest(sum(count) OVER (PARTITION BY cell_id), 1)) AS value FROM counts JOIN cells USING (cell_id)),
moments AS (SELECT sample_id, state, gene_id, sum(count)::BIGINT AS total, sum(value) AS s, sum(value * value) AS ss, count(*) FILTER (count > 0) AS detected,
  count(*) FILTER (value > 2.0) AS tail_0, count(*) FILTER (value > 5.0) AS tail_1, count(*) FILTER (value > 7.5) AS tail_2 FROM vals GROUP BY 1, 2, 3),
grid AS (SELECT g.sample_id, g.state, n_cells, u.gene_id, coalesce(total, 0) AS total, coalesce(s, 0) AS s, coalesce(ss, 0) AS ss, coalesce(detected, 0) AS detected, coalesce(tail_0, 0) AS tail_0, coalesce(tail_1, 0) AS tail_1, coalesce(tail_2, 0) AS tail_2
  FROM groups g CROSS JOIN (SELECT DISTINCT gene_id FROM counts) u LEFT JOIN moments m ON m.sample_id = g.sample_id AND m.state = g.state AND m.gene_id = u.gene_id)"""
SCORES_SQL = VALUES_SQL + """, programs AS (SELECT * FROM (VALUES ('low', 'Brand#1'), ('low', 'Brand#2'), ('low', 'Brand#3'), ('high', 'Brand#23'), ('high', 'Brand#24'), ('high', 'Brand#25')) t(program, gene_id)),
scores AS (SELECT c.cell_id, c.sample_id, c.state, p.program, coalesce(v, 0) / 3 AS score FROM cells c CROSS JOIN (SELECT DISTINCT program FROM programs) p
  LEFT JOIN (SELECT cell_id, program, sum(value) AS v FROM vals JOIN programs USING (gene_id) GROUP BY 1, 2) h ON h.cell_id = c.cell_id AND h.program = p.program)"""
MIN_CELLS = 20


def _grid(spark, d):
    s = study(spark, d)
    values = C.log_normalize(s.cells, s.counts)
    return C.on_grid(C.cell_totals(s.cells), s.genes, C.gene_moments(values, THRESHOLDS))


def _scores(spark, d):
    s = study(spark, d)
    return C.program_scores(s.cells, C.log_normalize(s.cells, s.counts), programs_df(spark))


@query("src4_sparse_canonical", "WITH x AS (SELECT l_orderkey AS cell_id, p_brand AS gene_id, sum(l_quantity)::BIGINT AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT * FROM x WHERE count <> 0")
def src4(spark, d):
    rows = table(spark, d, "lineitem")
    parts, number = table(spark, d, "part"), rows.count()
    lines = spread(rows, "l_partkey", parts, number).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return canonical_counts(lines.select(F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene_id"), F.col("l_quantity").alias("count")), number)


@query("src14_cell_cap", BASE_SQL + " SELECT cell_id, sample_id FROM cells QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY md5('11:' || cell_id), cell_id) <= 40")
def src14(spark, d):
    return C.cap_cells(study(spark, d).cells, 40, 11).select("cell_id", "sample_id")


@query("flt1_cell_qc", QUALITY_SQL + f" SELECT cell_id, library, detected, round(mito_fraction, 6) AS mito_fraction FROM quality WHERE {KEEP_SQL}")
def flt1(spark, d):
    s = study(spark, d)
    return C.cell_quality(s.cells, s.counts, MITO_PREFIX).where(C.passes(*QC)).select("cell_id", "library", "detected", *r6("mito_fraction"))


@query("flt2_state_selection", BASE_SQL + " SELECT cell_id, state FROM cells WHERE state IN ('F', 'O')")
def flt2(spark, d):
    return C.select_states(study(spark, d).cells, STATES).select("cell_id", "state")


@query("flt3_unmodeled_denominator", BASE_SQL + " SELECT sample_id, count(*) AS n_all, count(*) FILTER (state IN ('F', 'O')) AS n_modeled FROM cells GROUP BY 1")
def flt3(spark, d):
    return study(spark, d).cells.groupBy("sample_id").agg(F.count("*").alias("n_all"), F.count_if(F.col("state").isin(*STATES)).alias("n_modeled"))


@query("flt4_min_cells", VALUES_SQL + " SELECT sample_id, state, gene_id, CASE WHEN n_cells >= 20 THEN round(s / n_cells, 6) END AS value FROM grid")
def flt4(spark, d):
    g = C.gene_blocks(_grid(spark, d), (), MIN_CELLS).where("kind = 'gene_mean'")
    return g.select("sample_id", "state", F.col("source").alias("gene_id"), *r6("value"))


PSEUDO_SQL = BASE_SQL + GROUPS_SQL + """, pseudo AS (SELECT g.state, g.sample_id, u.gene_id, coalesce(c, 0)::BIGINT AS count, n_cells FROM groups g CROSS JOIN (SELECT DISTINCT gene_id FROM counts) u
  LEFT JOIN (SELECT state, sample_id, gene_id, sum(count) AS c FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2, 3) x ON x.state = g.state AND x.sample_id = g.sample_id AND x.gene_id = u.gene_id WHERE n_cells >= 5)"""


@query("agg1_pseudobulk", PSEUDO_SQL + " SELECT * FROM pseudo")
def agg1(spark, d):
    s = study(spark, d)
    return C.pseudobulk(s.cells, s.counts, 5, s.genes)


@query("jn2_cell_destination", BASE_SQL + " SELECT state, sample_id, count(*) AS entries, sum(count)::BIGINT AS total FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2")
def jn2(spark, d):
    s = study(spark, d)
    return s.counts.join(s.cells, "cell_id").groupBy("state", "sample_id").agg(F.count("*").alias("entries"), F.sum("count").alias("total"))


@query("agg2_moments", VALUES_SQL + " SELECT sample_id, state, gene_id, total, round(s, 6) AS s, round(ss, 6) AS ss, detected, tail_0, tail_1, tail_2 FROM moments")
def agg2(spark, d):
    s = study(spark, d)
    m = C.gene_moments(C.log_normalize(s.cells, s.counts), THRESHOLDS)
    return m.select("sample_id", "state", "gene_id", "total", *r6("s", "ss"), "detected", "tail_0", "tail_1", "tail_2")


@query("agg2_moments_merged", VALUES_SQL + " SELECT sample_id, state, gene_id, total, round(s, 6) AS s, round(ss, 6) AS ss, detected FROM moments")
def agg2_merged(spark, d):
    s = study(spark, d)
    v = C.log_normalize(s.cells, s.counts)
    halves = C.gene_moments(v.where("cell_id % 2 = 0")).unionByName(C.gene_moments(v.where("cell_id % 2 = 1")))
    return C.merge_moments(halves).select("sample_id", "state", "gene_id", "total", *r6("s", "ss"), "detected")


@query("agg3_abundance", BASE_SQL + """ SELECT sample_id, state, round(ln((p + 0.001) / (1 - p + 0.001)), 6) AS value FROM (SELECT a.sample_id, st.state, (SELECT count(*) FROM cells c WHERE c.sample_id = a.sample_id AND c.state = st.state) / a.n AS p
  FROM (SELECT sample_id, count(*) AS n FROM cells GROUP BY 1) a CROSS JOIN (VALUES ('F'), ('O')) st(state))""")
def agg3(spark, d):
    return C.abundance(study(spark, d).cells, STATES).select("sample_id", "state", *r6("value"))


def _block(kind):
    def run(spark, d):
        return C.gene_blocks(_grid(spark, d), THRESHOLDS, MIN_CELLS).where(F.col("kind") == kind).select("sample_id", "state", F.col("source"), *r6("value"))

    return run


for _name, _kind, _sql in (
    ("agg4_gene_mean", "gene_mean", "s / n_cells"), ("agg5_gene_detection", "gene_detection", "detected / n_cells"),
    ("agg6_gene_variance", "gene_variance", "CASE WHEN n_cells >= 2 THEN greatest(ss - s * s / n_cells, 0) / (n_cells - 1) END"),
):
    query(_name, VALUES_SQL + f" SELECT sample_id, state, gene_id AS source, CASE WHEN n_cells >= 20 THEN round({_sql}, 6) END AS value FROM grid")(_block(_kind))
query("agg7_gene_tail", VALUES_SQL + " SELECT sample_id, state, gene_id || '>' || t AS source, CASE WHEN n_cells >= 20 THEN round(tail / n_cells, 6) END AS value FROM (" + " UNION ALL ".join(f"SELECT sample_id, state, n_cells, gene_id, '{t}' AS t, tail_{i} AS tail FROM grid" for i, t in enumerate(THRESHOLDS)) + ")")(_block("gene_tail"))

PAIR_SQL = VALUES_SQL + """, pairs AS (SELECT * FROM (VALUES ('Brand#1', 'Brand#2'), ('Brand#1', 'Brand#3'), ('Brand#23', 'Brand#24')) t(a, b)),
pm AS (SELECT g.sample_id, g.state, g.n_cells, p.a, p.b, x.s AS sa, x.ss AS ssa, y.s AS sb, y.ss AS ssb, coalesce(ab, 0) AS ab FROM groups g CROSS JOIN pairs p
  JOIN grid x ON x.sample_id = g.sample_id AND x.state = g.state AND x.gene_id = p.a JOIN grid y ON y.sample_id = g.sample_id AND y.state = g.state AND y.gene_id = p.b
  LEFT JOIN (SELECT u.sample_id, u.state, u.gene_id AS a, w.gene_id AS b, sum(u.value * w.value) AS ab FROM vals u JOIN vals w USING (cell_id) GROUP BY 1, 2, 3, 4) z ON z.sample_id = g.sample_id AND z.state = g.state AND z.a = p.a AND z.b = p.b),
pc AS (SELECT *, ssa - sa * sa / n_cells AS va, ssb - sb * sb / n_cells AS vb FROM pm)"""


@query("agg8_gene_correlation", PAIR_SQL + " SELECT sample_id, state, a, b, CASE WHEN n_cells >= 3 AND va > 1e-10 AND vb > 1e-10 THEN round(greatest(least((ab - sa * sb / n_cells) / sqrt(va * vb), 1), -1), 6) END AS value FROM pc WHERE (sample_id, state) IN (SELECT (sample_id, state) FROM vals)")
def agg8(spark, d):
    s = study(spark, d)
    m = C.pair_moments(C.log_normalize(s.cells, s.counts), pairs_df(spark)).join(C.cell_totals(s.cells), ["sample_id", "state"])
    return m.select("sample_id", "state", "a", "b", F.round(C.correlation("sa", "sb", "ssa", "ssb", "ab"), 6).alias("value"))


@query("jn5_gene_pair_products", PAIR_SQL + " SELECT sample_id, state, a, b, round(ab, 6) AS ab FROM pm WHERE (sample_id, state) IN (SELECT (sample_id, state) FROM vals)")
def jn5(spark, d):
    s = study(spark, d)
    return C.pair_moments(C.log_normalize(s.cells, s.counts), pairs_df(spark)).select("sample_id", "state", "a", "b", *r6("ab"))


@query("jn4_program_membership", SCORES_SQL + " SELECT cell_id, program, round(score, 6) AS score FROM scores")
def jn4(spark, d):
    return _scores(spark, d).select("cell_id", "program", *r6("score"))


def _program(col):
    def run(spark, d):
        return C.program_blocks(_scores(spark, d), LIMITS, MIN_CELLS).select("sample_id", "state", "program", F.round(col, 6).alias("value"))

    return run


for _name, _col, _sql in (
    ("agg9_program_mean", "program_mean", "sum(score) / count(*)"), ("agg10_program_variance", "program_variance", "greatest(sum(score * score) - sum(score) * sum(score) / count(*), 0) / (count(*) - 1)"),
    ("agg11_program_q90", "program_q90", "quantile_cont(score, 0.9)"), ("agg12_program_fraction", "program_fraction", "count(*) FILTER (score > CASE program WHEN 'low' THEN 0.5 ELSE 1.0 END) / count(*)"),
):
    query(_name, SCORES_SQL + f" SELECT sample_id, state, program, CASE WHEN count(*) >= 20 THEN round({_sql}, 6) END AS value FROM scores GROUP BY 1, 2, 3")(_program(_col))


@query("agg13_program_correlation", SCORES_SQL + """, pc AS (SELECT x.sample_id, x.state, x.program AS a, y.program AS b, count(*) AS n, sum(x.score) AS sa, sum(y.score) AS sb, sum(x.score * x.score) AS ssa, sum(y.score * y.score) AS ssb, sum(x.score * y.score) AS ab
  FROM scores x JOIN scores y ON x.cell_id = y.cell_id AND x.program < y.program GROUP BY 1, 2, 3, 4)
SELECT sample_id, state, a, b, CASE WHEN n >= 3 AND ssa - sa * sa / n > 1e-10 AND ssb - sb * sb / n > 1e-10 THEN round(greatest(least((ab - sa * sb / n) / sqrt((ssa - sa * sa / n) * (ssb - sb * sb / n)), 1), -1), 6) END AS value FROM pc""")
def agg13(spark, d):
    return C.program_correlations(_scores(spark, d), PROGRAMS).select("sample_id", "state", "a", "b", *r6("value"))


@query("jn6_program_pairs", SCORES_SQL + " SELECT x.program AS a, y.program AS b, count(*) AS n FROM scores x JOIN scores y ON x.cell_id = y.cell_id AND x.program < y.program GROUP BY 1, 2")
def jn6(spark, d):
    names = sorted(PROGRAMS)
    pairs = C.pair_sums(_scores(spark, d), "program", "score", [(a, b) for i, a in enumerate(names) for b in names[i + 1:]])
    return pairs.groupBy("a", "b").agg(F.sum("n_rows").alias("n"))


@query("agg14_technical_qc", QUALITY_SQL + f" SELECT sample_id, count(*) AS cells, count(*) FILTER (NOT ({KEEP_SQL})) AS failed, round(avg(library), 6) AS mean_library, round(avg(detected), 6) AS mean_detected, round(avg(mito_fraction), 6) AS mean_mito FROM quality GROUP BY 1")
def agg14(spark, d):
    s = study(spark, d)
    t = C.technical(C.cell_quality(s.cells, s.counts, MITO_PREFIX), C.passes(*QC))
    return t.select("sample_id", "cells", "failed", *r6("mean_library", "mean_detected", "mean_mito"))


@query("agg15_state_counts", BASE_SQL + " SELECT state, sample_id, gene_id, sum(count)::BIGINT AS count FROM counts JOIN cells USING (cell_id) WHERE state IN ('F', 'O') GROUP BY 1, 2, 3")
def agg15(spark, d):
    s = study(spark, d)
    return s.counts.join(C.select_states(s.cells, STATES), "cell_id").groupBy("state", "sample_id", "gene_id").agg(F.sum("count").alias("count"))


@query("scl3_log_cp10k", VALUES_SQL + " SELECT cell_id, gene_id, round(value, 6) AS value FROM vals")
def scl3(spark, d):
    s = study(spark, d)
    return C.log_normalize(s.cells, s.counts).select("cell_id", "gene_id", *r6("value"))


UNIFORM_SQL = "('0x' || substr(md5('5:' || {p} || ':' || cell_id), 1, 12))::BIGINT / 281474976710656.0"


@query("scl8_keyed_uniform", BASE_SQL + f" SELECT cell_id, round({UNIFORM_SQL.format(p=1)}, 9) AS u FROM cells")
def scl8(spark, d):
    return study(spark, d).cells.select("cell_id", F.round(C.keyed_uniform(F.col("cell_id"), 5, 1), 9).alias("u"))


@query("spl11_cell_subsample", BASE_SQL + f" SELECT cell_id, 2::INTEGER AS perturbation FROM cells WHERE {UNIFORM_SQL.format(p=2)} < 0.8")
def spl11(spark, d):
    return C.subsample(study(spark, d).cells, 0.8, 5, 2).select("cell_id", F.lit(2).alias("perturbation"))


PROFILE_SQL = BASE_SQL + """, profiles AS (SELECT cell_id, sample_id, sha256('brands|' || state || '|' || coalesce(entries, '')) AS digest FROM cells LEFT JOIN (SELECT cell_id, string_agg(gene_id || ':' || count, ',' ORDER BY gene_id || ':' || count) AS entries FROM counts GROUP BY 1) USING (cell_id))"""


@query("scl9_cell_profile_hash", PROFILE_SQL + " SELECT cell_id, digest FROM profiles")
def scl9(spark, d):
    s = study(spark, d)
    return C.profile_hash(s.counts, s.cells, "brands").select("cell_id", "digest")


_carry = [f"sum(('0x' || substr(digest, {8 * i + 1}, 8))::BIGINT)::BIGINT AS l{i}" for i in range(8)]
_steps, _prev = [], "0"
for _i in range(7, -1, -1):
    _steps.append((f"t{_i}", f"l{_i} + {_prev}"))
    _prev = f"(t{_i} >> 32)"
_nest = "SELECT sample_id, count(*) AS n_cells, " + ", ".join(_carry) + " FROM profiles GROUP BY 1"
for _t, _e in _steps:
    _nest = f"SELECT *, {_e} AS {_t} FROM ({_nest})"


@query("scl10_multiset_digest", PROFILE_SQL + " SELECT sample_id, n_cells, " + " || ".join(f"lpad(lower(to_hex(t{i} & 4294967295)), 8, '0')" for i in range(8)) + f" AS digest FROM ({_nest})")
def scl10(spark, d):
    s = study(spark, d)
    return C.multiset_digest(C.profile_hash(s.counts, s.cells, "brands"))


@query("snk4_sample_feature_matrix", PSEUDO_SQL + " SELECT state, sample_id, " + ", ".join(f"sum(count) FILTER (gene_id = 'Brand#{i}')::BIGINT AS brand_{i}" for i in range(1, 26)) + " FROM pseudo GROUP BY 1, 2")
def snk4(spark, d):
    s = study(spark, d)
    genes = sorted(r[0] for r in s.genes.collect())  # genes: a declared dimension
    wide = C.pseudobulk(s.cells, s.counts, 5, s.genes).groupBy("state", "sample_id").pivot("gene_id", genes).agg(F.sum("count"))
    return wide.select("state", "sample_id", *[F.col(f"`{g}`").alias(g.lower().replace("#", "_")) for g in genes])


@query("snk5_count_subset", BASE_SQL + " SELECT * FROM counts WHERE cell_id IN (SELECT cell_id FROM cells WHERE batch = 'EUROPE')")
def snk5(spark, d):
    s = study(spark, d)
    return s.counts.join(s.cells.where("batch = 'EUROPE'"), "cell_id", "left_semi")


@query("src13_holdout_partition", BASE_SQL + """, spec AS (SELECT sample_id AS specimen, donor, CASE batch WHEN 'ASIA' THEN 4 WHEN 'EUROPE' THEN 3 ELSE 2 END AS cohort FROM cells GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY donor, cohort = 4 ORDER BY cohort, specimen) AS k FROM spec)
SELECT specimen, donor, CASE WHEN cohort = 4 THEN 'external' ELSE 'train' END AS part FROM ranked r WHERE k = 1 AND (cohort = 4 OR donor NOT IN (SELECT donor FROM spec WHERE cohort = 4))""")
def src13(spark, d):
    spec = study(spark, d).cells.select(F.col("sample_id").alias("specimen"), "donor", F.when(F.col("batch") == "ASIA", 4).when(F.col("batch") == "EUROPE", 3).otherwise(2).alias("cohort")).distinct()
    first = lambda df: df.withColumn("k", F.row_number().over(W.partitionBy("donor").orderBy("cohort", "specimen"))).where("k = 1")
    external = first(spec.where("cohort = 4"))
    train = first(spec.where("cohort != 4").join(external, "donor", "left_anti"))
    pick = lambda df, part: df.select("specimen", "donor", F.lit(part).alias("part"))
    return pick(external, "external").unionByName(pick(train, "train"))
