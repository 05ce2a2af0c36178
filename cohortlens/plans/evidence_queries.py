"""Queries of the evidence operators. The coefficients are differences of mean counts by batch, state and segment."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import contracts as K
from ..operators import evidence as E
from ..operators import prep as P
from ..sources.shared import written
from ..sources.study import BASE_SQL, study, table
from . import cell_queries as cq
from . import contract_queries as kq
from . import prep_queries as pq

Q: dict = {}
SQL: dict[str, str] = {}
r6 = cq.r6
TOL = 1e-8


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def coefficients(spark, d):
    """fit_id (batch:state), contrast (outcome), feature_id, coef on the complete grid; small differences are zero."""
    s = study(spark, d)
    x = s.counts.join(s.cells, "cell_id")
    fit = F.concat_ws(":", "batch", "state")
    n = s.cells.groupBy(fit.alias("fit_id"), F.col("outcome").alias("contrast")).agg(F.count("*").alias("n"))
    t = x.groupBy(fit.alias("fit_id"), F.col("outcome").alias("contrast"), F.col("gene_id").alias("feature_id")).agg(F.sum("count").alias("c"))
    names = F.broadcast(s.genes.agg(F.array_sort(F.collect_set("gene_id")).alias("g")))
    grid = n.join(names).select("fit_id", "contrast", "n", F.explode("g").alias("feature_id")).join(t, ["fit_id", "contrast", "feature_id"], "left").na.fill(0, ["c"])
    whole = W.partitionBy("fit_id", "feature_id")  # contrasts
    diff = grid.withColumn("x", F.round(F.col("c") / F.col("n") - F.sum("c").over(whole) / F.sum("n").over(whole), 1))
    return diff.select("fit_id", "contrast", "feature_id", F.when(F.abs("x") >= 0.4, F.col("x")).otherwise(0.0).alias("coef"))


COEF = BASE_SQL + """, n AS (SELECT batch || ':' || state AS fit_id, outcome AS contrast, count(*) AS n FROM cells GROUP BY 1, 2), g AS (SELECT DISTINCT gene_id AS feature_id FROM counts),
t AS (SELECT batch || ':' || state AS fit_id, outcome AS contrast, gene_id AS feature_id, sum(count) AS c FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2, 3),
grid AS (SELECT n.fit_id, n.contrast, n.n, g.feature_id, coalesce(c, 0) AS c FROM n CROSS JOIN g LEFT JOIN t ON t.fit_id = n.fit_id AND t.contrast = n.contrast AND t.feature_id = g.feature_id),
diff AS (SELECT fit_id, contrast, feature_id, round(c / n - sum(c) OVER (PARTITION BY fit_id, feature_id) / sum(n) OVER (PARTITION BY fit_id, feature_id), 1) AS x FROM grid),
coefs AS (SELECT fit_id, contrast, feature_id, CASE WHEN abs(x) >= 0.4 THEN x ELSE 0 END AS coef FROM diff)"""
RANKED = COEF + ", ranked AS (SELECT *, rank() OVER (PARTITION BY fit_id, contrast ORDER BY abs(coef) DESC) + (count(*) OVER (PARTITION BY fit_id, contrast, abs(coef)) - 1) / 2 AS rank FROM coefs)"
SUMMARY = RANKED + """, summary AS (SELECT contrast, feature_id, avg((abs(coef) > 1e-8)::INT) AS selection_frequency, coalesce(greatest(count(*) FILTER (coef > 1e-8), count(*) FILTER (coef < -1e-8)) / nullif(count(*) FILTER (abs(coef) > 1e-8), 0), 0) AS sign_consistency,
  avg(coef) AS coefficient_mean, median(coef) AS coefficient_median, coalesce(median(coef) FILTER (abs(coef) > 1e-8), 0) AS coefficient_median_selected, quantile_cont(coef, 0.25) AS coefficient_q25, quantile_cont(coef, 0.75) AS coefficient_q75,
  median(rank) FILTER (abs(coef) > 1e-8) AS rank_median_selected, quantile_cont(rank, 0.75) FILTER (abs(coef) > 1e-8) - quantile_cont(rank, 0.25) FILTER (abs(coef) > 1e-8) AS rank_iqr_selected, count(*) FILTER (abs(coef) > 1e-8) AS n_selecting_fits FROM ranked GROUP BY 1, 2)"""
FREQ = COEF + ", fs AS (SELECT contrast, feature_id, avg((abs(coef) > 1e-8)::INT) AS frequency, coalesce(greatest(count(*) FILTER (coef > 1e-8), count(*) FILTER (coef < -1e-8)) / nullif(count(*) FILTER (abs(coef) > 1e-8), 0), 0) AS consistency, sign(sum(sign(coef)))::DOUBLE AS dominant_sign FROM coefs GROUP BY 1, 2)"


def _coefs(spark, d):
    """The coefficients as a written table, for queries that read them more than once."""
    return written(coefficients(spark, d), "coefficients")


def _summary(spark, d):
    return E.stability_summary(coefficients(spark, d), TOL)


@query("win1_average_rank", RANKED + " SELECT fit_id, contrast, feature_id, round(rank, 6) AS rank FROM ranked")
def win1(spark, d):
    return E.average_ranks(coefficients(spark, d)).select("fit_id", "contrast", "feature_id", *r6("rank"))


NUM = ["selection_frequency", "sign_consistency", "coefficient_mean", "coefficient_median", "coefficient_median_selected", "coefficient_q25", "coefficient_q75", "rank_median_selected", "rank_iqr_selected"]


@query("agg21_stability_summary", SUMMARY + " SELECT contrast, feature_id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in NUM) + ", n_selecting_fits FROM summary")
def agg21(spark, d):
    return _summary(spark, d).select("contrast", "feature_id", *[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) for c in NUM], "n_selecting_fits")  # no negative zero


@query("agg22_axis_frequency", COEF + " SELECT contrast, feature_id, round(avg((abs(coef) > 1e-8)::INT) FILTER (fit_id LIKE '%:F'), 6) AS frequency_F, round(avg((abs(coef) > 1e-8)::INT) FILTER (fit_id LIKE '%:O'), 6) AS frequency_O FROM coefs GROUP BY 1, 2")
def agg22(spark, d):
    x = coefficients(spark, d).withColumn("axis", F.substring_index("fit_id", ":", -1))
    return E.frequency_by(x, "axis", ["F", "O"], TOL).select("contrast", "feature_id", *r6("frequency_F", "frequency_O"))


@query("agg23_jaccard", COEF + """, s AS (SELECT contrast, fit_id, feature_id FROM coefs WHERE abs(coef) > 1e-8), z AS (SELECT f.contrast, f.fit_id, count(s.feature_id) AS n FROM (SELECT DISTINCT contrast, fit_id FROM coefs) f LEFT JOIN s USING (contrast, fit_id) GROUP BY 1, 2),
k AS (SELECT a.contrast, a.fit_id AS a, b.fit_id AS b, count(*) AS k FROM s a JOIN s b ON a.contrast = b.contrast AND a.feature_id = b.feature_id AND a.fit_id < b.fit_id GROUP BY 1, 2, 3)
SELECT x.contrast, x.fit_id AS a, y.fit_id AS b, round(coalesce(k, 0) / nullif(x.n + y.n - coalesce(k, 0), 0), 6) AS jaccard FROM z x JOIN z y ON x.contrast = y.contrast AND x.fit_id < y.fit_id LEFT JOIN k ON k.contrast = x.contrast AND k.a = x.fit_id AND k.b = y.fit_id""")
def agg23(spark, d):
    return E.jaccard(coefficients(spark, d), TOL).select("contrast", "a", "b", *r6("jaccard"))


@query("agg24_frequency_and_sign", FREQ + " SELECT contrast, feature_id, round(frequency, 6) AS frequency, round(consistency, 6) AS consistency, dominant_sign FROM fs")
def agg24(spark, d):
    return E.frequency_and_sign(coefficients(spark, d), TOL).select("contrast", "feature_id", *r6("frequency", "consistency"), "dominant_sign")


@query("scl14_direction_labels", COEF + " SELECT fit_id, contrast, feature_id, CASE WHEN coef > 0.5 THEN 'positive' WHEN coef < -0.5 THEN 'negative' ELSE 'none' END AS direction FROM coefs")
def scl14(spark, d):
    return coefficients(spark, d).select("fit_id", "contrast", "feature_id", E.direction(F.col("coef"), 0.5).alias("direction"))


@query("scl15_contrast_names", "WITH l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS label FROM customer)) SELECT code, label || '_vs_' || (SELECT label FROM l WHERE code = 0) AS contrast FROM l WHERE code > 0")
def scl15(spark, d):
    return E.contrast_names(K.encode_outcome(table(spark, d, "customer"), "c_mktsegment"))


@query("scl16_safe_names", "SELECT DISTINCT s_name, substr(regexp_replace(s_name || ' / ' || s_nationkey, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 60) AS name FROM supplier")
def scl16(spark, d):
    return table(spark, d, "supplier").select("s_name", E.safe_name(F.concat("s_name", F.lit(" / "), F.col("s_nationkey").cast("string"))).alias("name")).distinct()


PLACED = SUMMARY + ", ranks AS (SELECT *, row_number() OVER (ORDER BY selection_frequency DESC, sign_consistency DESC, rank_median_selected ASC NULLS LAST, feature_id, contrast) AS place FROM (SELECT contrast, feature_id, round(selection_frequency, 9) AS selection_frequency, round(sign_consistency, 9) AS sign_consistency, rank_median_selected FROM summary){where})"


def _rounded(t):
    return t.withColumns({c: F.round(c, 9) for c in ("selection_frequency", "sign_consistency")})


@query("srt3_panel_ranking", PLACED.format(where=" WHERE selection_frequency >= 0.3 AND sign_consistency >= 0.5") + " SELECT feature_id, row_number() OVER (ORDER BY min(place)) AS position FROM ranks GROUP BY 1 QUALIFY position <= 8")
def srt3(spark, d):
    return E.select_panel(_rounded(_summary(spark, d)), 0.3, 0.5, 8)


@query("pan1_panel_selection", SQL["srt3_panel_ranking"])
def pan1(spark, d):
    return srt3(spark, d)


@query("srt4_correlation_candidates", PLACED.format(where=" WHERE selection_frequency > 0") + " SELECT feature_id, row_number() OVER (ORDER BY min(place)) AS position FROM ranks GROUP BY 1 QUALIFY position <= 10")
def srt4(spark, d):
    return E.candidates(_rounded(_summary(spark, d)), 10)


@query("srt6_preview_limit", PLACED.format(where="") + " SELECT contrast, feature_id, place FROM ranks WHERE place <= 25")
def srt6(spark, d):
    return E.rank_features(_rounded(_summary(spark, d))).where("place <= 25").select("contrast", "feature_id", "place")


GRID = "WITH losses AS (SELECT (l_linenumber)::VARCHAR AS context, l_discount AS strength, CASE WHEN l_tax > 0.04 THEN 0.5 ELSE 0.9 END::DOUBLE AS l1_ratio, l_extendedprice / 10000 AS loss, l_quantity AS n_selected FROM lineitem), tt AS (SELECT context, strength, l1_ratio, avg(loss) AS mean_loss, stddev_samp(loss) AS sd, count(*) AS n, avg(n_selected) AS mean_features FROM losses GROUP BY 1, 2, 3)"


def _losses(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("context"), F.col("l_discount").alias("strength"), F.when(F.col("l_tax") > 0.04, 0.5).otherwise(0.9).alias("l1_ratio"), (F.col("l_extendedprice") / 10000).alias("loss"), F.col("l_quantity").alias("n_selected"))


@query("agg17_tuning_table", GRID + " SELECT context, strength, l1_ratio, round(mean_loss, 6) AS mean_loss, round(sd, 6) AS sd, n, round(mean_features, 6) AS mean_features FROM tt")
def agg17(spark, d):
    return E.tuning_table(_losses(spark, d)).select("context", "strength", "l1_ratio", *r6("mean_loss", "sd"), "n", *r6("mean_features"))


@query("agg30_tuning_surface", GRID + " SELECT strength, round(avg(loss) FILTER (l1_ratio = 0.5), 6) AS ratio_05, round(avg(loss) FILTER (l1_ratio = 0.9), 6) AS ratio_09 FROM losses GROUP BY 1")
def agg30(spark, d):
    w = _losses(spark, d).groupBy("strength").pivot("l1_ratio", [0.5, 0.9]).agg(F.round(F.avg("loss"), 6))
    return w.select("strength", F.col("`0.5`").alias("ratio_05"), F.col("`0.9`").alias("ratio_09"))


@query("srt5_one_standard_error", GRID + """, b AS (SELECT *, first_value(mean_loss + coalesce(sd, 0) / sqrt(n)) OVER (PARTITION BY context ORDER BY mean_loss, strength DESC, l1_ratio DESC) AS cut FROM tt)
SELECT context, strength, l1_ratio FROM b WHERE mean_loss <= cut + 1e-12 QUALIFY row_number() OVER (PARTITION BY context ORDER BY mean_features, strength DESC, l1_ratio DESC) = 1""")
def srt5(spark, d):
    return E.one_standard_error(E.tuning_table(_losses(spark, d))).select("context", "strength", "l1_ratio")


@query("agg25_modal_parameters", GRID + " SELECT strength, l1_ratio, count(*) AS n FROM losses GROUP BY 1, 2 ORDER BY 3 DESC, 1 DESC, 2 DESC LIMIT 1")
def agg25(spark, d):
    return E.modal_parameters(_losses(spark, d))


CORR = pq.EXPR + f""", cx AS (SELECT * FROM cpm WHERE feature_id IN (SELECT feature_id FROM ({SQL['srt4_correlation_candidates']}))), cor AS (SELECT a.feature_id AS a, b.feature_id AS b, {kq.PEARSON.format(x='a.value', y='b.value')} AS r FROM cx a JOIN cx b ON a.sample_id = b.sample_id AND a.feature_id < b.feature_id GROUP BY 1, 2)"""


@query("cor1_correlation_matrix", CORR + " SELECT a, b, round(greatest(least(r, 1), -1), 6) AS r FROM cor")
def cor1(spark, d):
    return E.correlation_matrix(P.log_cpm(kq.expression(study(spark, d))), srt4(spark, d)).select("a", "b", *r6("r"))


# groups of the candidates by complete linkage: at each step the two nearest groups merge, while all their members correlate by LINK
LINK = 0.2
LINKAGE = CORR.replace("WITH ", "WITH RECURSIVE ", 1) + f""", far AS (SELECT map(list(k), list(v)) AS m FROM (SELECT a || '|' || b AS k, 1 - abs(greatest(least(r, 1), -1)) AS v FROM cor UNION ALL SELECT b || '|' || a, 1 - abs(greatest(least(r, 1), -1)) FROM cor)),
seed AS (SELECT (SELECT list([feature_id] ORDER BY feature_id) FROM ({SQL['srt4_correlation_candidates']})) AS g, m FROM far),
lk AS (SELECT g, m FROM seed UNION ALL SELECT list_concat(list_concat(g[1:near.i - 1], [list_concat(g[near.i], g[near.j])]), list_concat(g[near.i + 1:near.j - 1], g[near.j + 1:])), m FROM (
  SELECT g, m, list_sort(flatten(list_transform(range(1, len(g)), lambda i: list_transform(range(i + 1, len(g) + 1), lambda j:
    {{'d': list_max(flatten(list_transform(g[i], lambda a: list_transform(g[j], lambda b: m[a || '|' || b])))), 'i': i, 'j': j}}))))[1] AS near FROM lk WHERE len(g) > 1) WHERE near.d <= 1 - {LINK}),
members AS (SELECT unnest(own) AS feature_id, 'correlation_' || lpad(k::VARCHAR, 3, '0') AS group_id FROM (SELECT own, row_number() OVER (ORDER BY list_min(own)) AS k FROM (SELECT unnest(g) AS own FROM (SELECT g FROM lk ORDER BY len(g) LIMIT 1))))"""
MEMBERS_SQL = LINKAGE + COEF.removeprefix(BASE_SQL) + ", x AS (SELECT group_id, contrast, fit_id, feature_id, (abs(coef) > 1e-8)::INT AS s FROM coefs JOIN members USING (feature_id))"


def _members(spark, d):
    """feature_id, group_id of the candidates, linked over their correlations: as many rows as srt4 has candidates."""
    top = written(srt4(spark, d), "candidates")
    names = [r["feature_id"] for r in top.collect()]
    matrix = E.correlation_matrix(P.log_cpm(kq.expression(study(spark, d))), top).collect()
    groups = E.complete_linkage(names, {(r["a"], r["b"]): r["r"] for r in matrix}, LINK)
    return spark.createDataFrame(sorted(groups.items()), "feature_id string, group_id string")


@query("cor1_complete_linkage", LINKAGE + " SELECT feature_id, group_id FROM members")
def cor1_linkage(spark, d):
    return _members(spark, d)


GROUPS = MEMBERS_SQL + ", gf AS (SELECT * FROM (SELECT group_id, contrast, avg(s) AS selection_frequency FROM (SELECT group_id, contrast, fit_id, max(s) AS s FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN (SELECT group_id, contrast, min(s) AS minimum_member_frequency, count(*) AS n_members FROM (SELECT group_id, contrast, feature_id, avg(s) AS s FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (group_id, contrast))"


@query("agg28_group_frequency", GROUPS + " SELECT group_id, contrast, round(selection_frequency, 6) AS selection_frequency, round(minimum_member_frequency, 6) AS minimum_member_frequency, n_members FROM gf")
def agg28(spark, d):
    return E.group_frequencies(_coefs(spark, d), _members(spark, d), TOL).select("group_id", "contrast", *r6("selection_frequency", "minimum_member_frequency"), "n_members")


@query("agg29_substitution", MEMBERS_SQL + """, p AS (SELECT a.group_id, a.contrast, a.feature_id AS a, b.feature_id AS b, count(*) AS n, sum(a.s * b.s) AS k, sum(a.s) AS na, sum(b.s) AS nb FROM x a JOIN x b ON a.group_id = b.group_id AND a.contrast = b.contrast AND a.fit_id = b.fit_id AND a.feature_id < b.feature_id GROUP BY 1, 2, 3, 4)
SELECT group_id, contrast, a, b, round((na + nb - k) / n, 6) AS frequency_any, round(k / n, 6) AS frequency_both, round((na + nb - 2 * k) / nullif(na + nb - k, 0), 6) AS exclusive_given_any, CASE WHEN na * (n - na) * nb * (n - nb) > 0 THEN round((n * k - na * nb) / sqrt(na * (n - na) * nb * (n - nb)), 6) END AS selection_phi FROM p""")
def agg29(spark, d):
    return E.substitution(_coefs(spark, d), _members(spark, d), TOL).select("group_id", "contrast", "a", "b", *r6("frequency_any", "frequency_both", "exclusive_given_any", "selection_phi"))


@query("jn10_group_membership", GROUPS + " SELECT f.feature_id, f.contrast, coalesce(m.group_id, 'not_assessed') AS group_id, round(g.selection_frequency, 6) AS group_frequency FROM (SELECT DISTINCT feature_id, contrast FROM coefs) f LEFT JOIN members m USING (feature_id) LEFT JOIN gf g ON g.group_id = m.group_id AND g.contrast = f.contrast")
def jn10(spark, d):
    c, m = _coefs(spark, d), _members(spark, d)
    freq = E.group_frequencies(c, m, TOL).select("group_id", "contrast", F.round("selection_frequency", 6).alias("group_frequency"))
    return c.select("feature_id", "contrast").distinct().join(m, "feature_id", "left").join(freq, ["group_id", "contrast"], "left").select("feature_id", "contrast", F.coalesce("group_id", F.lit("not_assessed")).alias("group_id"), "group_frequency")


def _identity(spark, d):
    return study(spark, d).genes.where("gene_id > 'Brand#2'").select(F.col("gene_id").alias("feature_id"), F.lit("gene_mean").alias("kind"), F.lit("F").alias("cell_type"), F.lit("log1p CP10K").alias("unit"))


@query("jn7_identity_join", BASE_SQL + " SELECT gene_id AS feature_id, CASE WHEN gene_id > 'Brand#2' THEN 'gene_mean' ELSE 'gene_expression' END AS kind, CASE WHEN gene_id > 'Brand#2' THEN 'F' ELSE 'all' END AS cell_type, CASE WHEN gene_id > 'Brand#2' THEN 'log1p CP10K' ELSE 'count' END AS unit FROM (SELECT DISTINCT gene_id FROM counts)")
def jn7(spark, d):
    return E.join_identity(study(spark, d).genes.withColumnRenamed("gene_id", "feature_id"), _identity(spark, d))


@query("jn8_expression_test_join", FREQ + """, tab AS (SELECT feature_id AS gene_id, contrast, 'F' AS cell_type, CASE WHEN feature_id < 'Brand#15' THEN 'gene_correlation' ELSE 'gene_mean' END AS kind FROM fs),
tests AS (SELECT feature_id AS gene_id, contrast, 'F' AS cell_type, round(frequency, 6) AS de_log2fc, round(consistency, 6) AS de_padj FROM fs WHERE contrast < 'H') SELECT gene_id, contrast, cell_type, kind, CASE WHEN kind <> 'gene_correlation' THEN de_log2fc END AS de_log2fc, CASE WHEN kind <> 'gene_correlation' THEN de_padj END AS de_padj FROM tab LEFT JOIN tests USING (gene_id, contrast, cell_type)""")
def jn8(spark, d):
    f = E.frequency_and_sign(coefficients(spark, d), TOL).withColumnRenamed("feature_id", "gene_id").withColumn("cell_type", F.lit("F"))
    tab = f.select("gene_id", "contrast", "cell_type", F.when(F.col("gene_id") < "Brand#15", "gene_correlation").otherwise("gene_mean").alias("kind"))
    tests = f.where("contrast < 'H'").select("gene_id", "contrast", "cell_type", F.round("frequency", 6).alias("de_log2fc"), F.round("consistency", 6).alias("de_padj"))
    return E.join_expression_tests(tab, tests)


GATED = SUMMARY + """, outerf AS (SELECT contrast, feature_id, avg((abs(coef) > 1e-8)::INT) AS f, coalesce(greatest(count(*) FILTER (coef > 1e-8), count(*) FILTER (coef < -1e-8)) / nullif(count(*) FILTER (abs(coef) > 1e-8), 0), 0) AS s, sign(sum(sign(coef)))::DOUBLE AS d FROM coefs WHERE fit_id LIKE '%:F' GROUP BY 1, 2),
tab AS (SELECT contrast, feature_id, round(selection_frequency, 9) AS selection_frequency, round(sign_consistency, 9) AS sign_consistency, rank_median_selected, round(coefficient_mean, 9) AS coefficient, coefficient_median_selected, round(f, 9) AS outer_selection_frequency, round(s, 9) AS outer_sign_consistency, d AS outer_dominant_sign FROM summary JOIN outerf USING (contrast, feature_id)),
gated AS (SELECT *, coalesce(selection_frequency >= 0.3 AND sign_consistency >= 0.6 AND outer_selection_frequency >= 0.2 AND outer_sign_consistency >= 0.6 AND abs(coefficient) > 1e-8 AND sign(coefficient) = sign(coefficient_median_selected) AND sign(coefficient) = outer_dominant_sign, false) AS ok FROM tab)"""


def _gated(spark, d, blockers=()):
    c = _coefs(spark, d)
    o = E.frequency_and_sign(c.where(F.col("fit_id").endswith(":F")), TOL).select("contrast", "feature_id", F.round("frequency", 9).alias("outer_selection_frequency"), F.round("consistency", 9).alias("outer_sign_consistency"), F.col("dominant_sign").alias("outer_dominant_sign"))
    t = _rounded(E.stability_summary(c, TOL)).withColumn("coefficient", F.round("coefficient_mean", 9)).join(o, ["contrast", "feature_id"])
    return E.feature_gates(t, blockers, 0.3, 0.6, 0.2, TOL)


@query("gat1_evidence_gates", GATED + " SELECT contrast, feature_id, ok AS passes_feature_stability_gates, ok AS passes_robustness_gates, CASE WHEN ok THEN 'candidate_predictive_association' ELSE 'exploratory_only' END AS evidence_status, 'not_established' AS biological_validation, 'not_established' AS causal_claim FROM gated")
def gat1(spark, d):
    return _gated(spark, d).select("contrast", "feature_id", "passes_feature_stability_gates", "passes_robustness_gates", "evidence_status", "biological_validation", "causal_claim")


@query("gat2_panel_gates", GATED + " SELECT contrast, feature_id, coalesce(ok AND abs(coefficient / 2) > 0.01 AND sign(coefficient) = sign(coefficient_median_selected) AND outer_selection_frequency >= 0.4 AND outer_sign_consistency >= 0.6 AND sign(coefficient) = outer_dominant_sign, false) AS passes_panel_gates FROM gated")
def gat2(spark, d):
    t = _gated(spark, d).withColumn("panel_coefficient", F.col("coefficient") / 2)
    t = t.withColumns({f"panel_outer_{c}": F.col(f"outer_{c}") for c in ("selection_frequency", "sign_consistency", "dominant_sign")})
    return E.panel_gates(t, 0.4, 0.6, 0.01).select("contrast", "feature_id", "passes_panel_gates")


@query("jn11_panel_gate_lookup", GATED + " SELECT feature_id, contrast, ok AS passes_robustness_gates FROM gated WHERE feature_id IN ('Brand#1', 'Brand#2', 'Brand#3')")
def jn11(spark, d):
    panel = spark.createDataFrame([(f"Brand#{i}",) for i in (1, 2, 3)], "feature_id string")
    return F.broadcast(panel).join(_gated(spark, d).select("feature_id", "contrast", "passes_robustness_gates"), "feature_id")


@query("srt2_final_order", GATED + " SELECT contrast, feature_id, row_number() OVER (ORDER BY ok DESC, selection_frequency DESC, sign_consistency DESC, outer_selection_frequency DESC, rank_median_selected ASC NULLS LAST, feature_id, contrast) AS evidence_rank FROM gated")
def srt2(spark, d):
    return E.final_order(_gated(spark, d)).select("contrast", "feature_id", "evidence_rank")


SCORES = pq.SCALED + ", c AS (SELECT * FROM (VALUES (0, 'Brand#1', 0.4), (0, 'Brand#2', -0.3), (1, 'Brand#1', -0.1), (1, 'Brand#3', 0.7), (2, 'Brand#2', 0.2)) t(class, feature_id, coef)), s AS (SELECT sample_id, class, sum(value * coef) + CASE class WHEN 0 THEN 0.1 WHEN 1 THEN -0.2 ELSE 0 END AS score FROM z JOIN c USING (feature_id) GROUP BY 1, 2)"


def _linear(spark, d):
    x, _, train = pq._base(spark, d)
    x = P.log_cpm(x)
    z = P.standardize(x, P.scaler(x, train))
    coefs = spark.createDataFrame([(0, "Brand#1", 0.4), (0, "Brand#2", -0.3), (1, "Brand#1", -0.1), (1, "Brand#3", 0.7), (2, "Brand#2", 0.2)], "class int, feature_id string, coef double")
    return E.linear_scores(z, coefs, spark.createDataFrame([(0, 0.1), (1, -0.2), (2, 0.0)], "class int, intercept double"))


@query("scl7_sigmoid_scores", SCORES + " SELECT sample_id, round(1 / (1 + exp(-score)), 6) AS p FROM s WHERE class = 0")
def scl7(spark, d):
    return _linear(spark, d).where("class = 0").select("sample_id", F.round(E.sigmoid(F.col("score")), 6).alias("p"))


@query("scl7_softmax_scores", SCORES + " SELECT sample_id, class, round(exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY sample_id), 6) AS p FROM (SELECT *, max(score) OVER (PARTITION BY sample_id) AS m FROM s)")
def scl7_softmax(spark, d):
    return E.softmax(_linear(spark, d)).select("sample_id", "class", *r6("p"))


@query("rep1_distribution_evidence", cq.VALUES_SQL + ", m AS (SELECT sample_id, min(outcome) AS outcome, min(batch) AS batch FROM cells GROUP BY 1) SELECT sample_id, state, gene_id AS source, outcome, batch, n_cells, CASE WHEN n_cells >= 20 THEN round(s / n_cells, 6) END AS value FROM grid JOIN m USING (sample_id) WHERE gene_id IN (SELECT feature_id FROM (" + SQL["srt6_preview_limit"] + "))")
def rep1(spark, d):
    s = study(spark, d)
    top = srt6(spark, d).select(F.col("feature_id").alias("source")).distinct()
    long = C.gene_blocks(cq._grid(spark, d), (), cq.MIN_CELLS).where("kind = 'gene_mean'").join(F.broadcast(top), "source")
    return long.join(kq.metadata(s).select("sample_id", "outcome", "batch"), "sample_id").join(C.cell_totals(s.cells), ["sample_id", "state"]).select("sample_id", "state", "source", "outcome", "batch", "n_cells", *r6("value"))


@query("rep2_cell_quality", cq.QUALITY_SQL + f" SELECT sample_id, min(outcome) AS outcome, count(*) AS cells, count(*) FILTER (NOT ({cq.KEEP_SQL})) AS failed, round(avg(library), 6) AS mean_library FROM quality GROUP BY 1")
def rep2(spark, d):
    s = study(spark, d)
    return cq.agg14(spark, d).join(kq.metadata(s).select("sample_id", "outcome"), "sample_id").select("sample_id", "outcome", "cells", "failed", "mean_library")
