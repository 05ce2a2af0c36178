"""Queries of preparation, splits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.ranks import with_group
from ..operators import contracts as K
from ..operators import prep as P
from ..operators import splits as S
from ..sources.shared import written
from ..sources.study import study, table
from . import cell_queries as cq
from . import contract_queries as kq

Q: dict = {}
SQL: dict[str, str] = {}
r6 = cq.r6


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


EXPR = kq.EXPR_SQL + ", train AS (SELECT sample_id FROM meta WHERE batch <> 'ASIA'), cpm AS (SELECT sample_id, feature_id, log2(1 + 1e6 * value / nullif(sum(value) OVER (PARTITION BY sample_id), 0)) AS value FROM expr)"
MISSING = EXPR + ", gappy AS (SELECT sample_id, feature_id, CASE WHEN value < 120 THEN NULL ELSE value END AS value FROM expr)"


def _base(spark, d):
    """Expression, metadata and training samples of the specimens: small tables, written as each step of a preparation reads them again."""
    s = study(spark, d)
    meta = written(kq.metadata(s), "metadata")
    return written(kq.expression(s), "expression"), meta, meta.where("batch != 'ASIA'").select("sample_id")


def _gappy(long):
    return long.withColumn("value", F.when(F.col("value") < 120, None).otherwise(F.col("value")))


@query("scl1_log_cpm", EXPR + " SELECT sample_id, feature_id, round(value, 6) AS value FROM cpm")
def scl1(spark, d):
    return P.log_cpm(_base(spark, d)[0]).select("sample_id", "feature_id", *r6("value"))


RATIO = EXPR + """, pos AS (SELECT feature_id, exp(avg(ln(value))) AS reference FROM expr WHERE value > 0 AND sample_id IN (SELECT sample_id FROM train) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM train)),
factor AS (SELECT sample_id, median(value / reference) AS factor FROM expr JOIN pos USING (feature_id) WHERE value > 0 GROUP BY 1)"""


@query("scl2_median_ratio", RATIO + " SELECT sample_id, feature_id, round(log2(1 + value / factor), 6) AS value FROM expr JOIN factor USING (sample_id)")
def scl2(spark, d):
    x, _, train = _base(spark, d)
    return P.median_ratio(x, P.median_ratio_reference(x, train)).select("sample_id", "feature_id", *r6("value"))


@query("scl4_median_imputation", MISSING + ", fill AS (SELECT feature_id, median(value) AS f FROM gappy WHERE sample_id IN (SELECT sample_id FROM train) GROUP BY 1) SELECT sample_id, feature_id, round(coalesce(value, f, 0), 6) AS value FROM gappy LEFT JOIN fill USING (feature_id)")
def scl4(spark, d):
    x, _, train = _base(spark, d)
    return P.impute_median(_gappy(x), train).select("sample_id", "feature_id", *r6("value"))


SCALED = EXPR + ", st AS (SELECT feature_id, avg(value) AS c, stddev_pop(value) AS s FROM cpm WHERE sample_id IN (SELECT sample_id FROM train) GROUP BY 1), z AS (SELECT sample_id, feature_id, (value - c) / CASE WHEN s > 1e-12 THEN s ELSE 1 END AS value FROM cpm JOIN st USING (feature_id))"


@query("scl5_standardize", SCALED + " SELECT sample_id, feature_id, round(value, 6) AS value FROM z")
def scl5(spark, d):
    x, _, train = _base(spark, d)
    x = P.log_cpm(x)
    return P.standardize(x, P.scaler(x, train)).select("sample_id", "feature_id", *r6("value"))


@query("scl6_covariates", kq.META_SQL + """, tr AS (SELECT * FROM meta WHERE donor <> 'FRANCE'), l AS (SELECT sample_id, 'batch=' || b AS "column", (batch = b)::INT::DOUBLE AS value FROM meta CROSS JOIN (SELECT DISTINCT batch AS b FROM tr WHERE batch <> (SELECT min(batch) FROM tr)) UNION ALL SELECT sample_id, 'account', account FROM meta),
st AS (SELECT "column", avg(value) AS c, stddev_pop(value) AS s FROM l WHERE sample_id IN (SELECT sample_id FROM tr) GROUP BY 1) SELECT sample_id, "column", round((value - c) / CASE WHEN s > 1e-12 THEN s ELSE 1 END, 6) AS value FROM l JOIN st USING ("column")""")
def scl6(spark, d):
    meta = kq.metadata(study(spark, d))
    return P.encode_covariates(meta, meta.where("donor != 'FRANCE'"), ["batch", "account"]).select("sample_id", "column", *r6("value"))


@query("flt5_prevalence", EXPR + " SELECT feature_id, round(avg((value >= 150)::INT), 6) AS prevalence FROM expr WHERE sample_id IN (SELECT sample_id FROM train) GROUP BY 1 HAVING avg((value >= 150)::INT) >= 0.5")
def flt5(spark, d):
    x, _, train = _base(spark, d)
    return P.prevalence(x, train, 150, 0.5).select("feature_id", *r6("prevalence"))


@query("flt6_missingness", MISSING + " SELECT feature_id, round(count(value) / count(*), 6) AS observed FROM gappy WHERE sample_id IN (SELECT sample_id FROM train) GROUP BY 1 HAVING count(value) / count(*) >= 0.6 AND count(value) > 0")
def flt6(spark, d):
    x, _, train = _base(spark, d)
    return P.observed(_gappy(x), train, 0.4).select("feature_id", *r6("observed"))


VAR = EXPR + ", v AS (SELECT feature_id, var_pop(value) AS variance FROM cpm WHERE sample_id IN (SELECT sample_id FROM train) GROUP BY 1 HAVING var_pop(value) > 1e-12)"


@query("flt7_variance", VAR + " SELECT feature_id, round(variance, 6) AS variance FROM v")
def flt7(spark, d):
    x, _, train = _base(spark, d)
    return P.variable(P.log_cpm(x), train).select("feature_id", *r6("variance"))


@query("flt8_panel_restriction", VAR + " SELECT feature_id, round(variance, 6) AS variance FROM v WHERE feature_id IN ('Brand#1', 'Brand#5', 'Brand#9')")
def flt8(spark, d):
    x, _, train = _base(spark, d)
    panel = spark.createDataFrame([("Brand#1",), ("Brand#5",), ("Brand#9",)], "feature_id string")
    return P.restrict(P.variable(P.log_cpm(x), train), panel).select("feature_id", *r6("variance"))


@query("flt9_de_prefilter", EXPR + " SELECT feature_id, round(avg((value >= 10)::INT), 6) AS prevalence FROM expr GROUP BY 1 HAVING avg((value >= 10)::INT) >= 0.9")
def flt9(spark, d):
    x, meta, _ = _base(spark, d)
    return P.prevalence(x, meta, 10, 0.9).select("feature_id", *r6("prevalence"))


@query("mod2_variance_screen", VAR + ", t AS (SELECT feature_id, round(variance, 9) AS score FROM v ORDER BY 2 DESC, 1 LIMIT 10) SELECT feature_id, round(score, 6) AS score, row_number() OVER (ORDER BY feature_id) AS position FROM t")
def mod2(spark, d):
    x, _, train = _base(spark, d)
    v = P.variable(P.log_cpm(x), train).select("feature_id", F.round("variance", 9).alias("score"))
    return P.top_features(v, 10).select("feature_id", *r6("score"), "position")


ANOVA = EXPR + """, g AS (SELECT feature_id, outcome, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM cpm JOIN meta USING (sample_id) WHERE batch <> 'ASIA' GROUP BY 1, 2),
t AS (SELECT feature_id, sum(n) AS n, count(*) AS k, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM g GROUP BY 1), f AS (SELECT feature_id, round(((b - s * s / n) / (k - 1)) / ((ss - b) / (n - k)), 6) AS score FROM t)"""


@query("mod3_anova_screen", ANOVA + " SELECT * FROM f")
def mod3(spark, d):
    x, meta, _ = _base(spark, d)
    return P.f_class(P.log_cpm(x), meta.where("batch != 'ASIA'").select("sample_id", F.col("outcome").alias("y"))).select("feature_id", *r6("score"))


@query("srt1_stable_top_k", ANOVA + ", t2 AS (SELECT * FROM f ORDER BY score DESC, feature_id LIMIT 8) SELECT feature_id, score, row_number() OVER (ORDER BY feature_id) AS position FROM t2")
def srt1(spark, d):
    return P.top_features(mod3(spark, d), 8)


@query("mod3_regression_screen", EXPR + f", t AS (SELECT feature_id, count(*) AS n, {kq.PEARSON.format(x='value', y='account')} AS r FROM cpm JOIN meta USING (sample_id) GROUP BY 1) SELECT feature_id, round(r * r / (1 - r * r) * (n - 2), 6) AS score FROM t")
def mod3_regression(spark, d):
    x, meta, _ = _base(spark, d)
    return P.f_regression(P.log_cpm(x), meta.select("sample_id", F.col("account").alias("y"))).select("feature_id", *r6("score"))


@query("mod5_no_cap", VAR + " SELECT feature_id, round(variance, 6) AS score, row_number() OVER (ORDER BY feature_id) AS position FROM v")
def mod5(spark, d):
    x, _, train = _base(spark, d)
    return P.top_features(P.variable(P.log_cpm(x), train).withColumnRenamed("variance", "score"), None).select("feature_id", *r6("score"), "position")


@query("mod1_prepared_matrix", SCALED + ", t AS (SELECT feature_id FROM (SELECT feature_id, round(var_pop(value), 9) AS v FROM cpm WHERE sample_id IN (SELECT sample_id FROM train) GROUP BY 1) ORDER BY v DESC, feature_id LIMIT 10) SELECT sample_id, feature_id, round(value, 6) AS value FROM z WHERE feature_id IN (SELECT feature_id FROM t)")
def mod1(spark, d):
    x, _, train = _base(spark, d)
    n = P.log_cpm(x)
    top = P.top_features(P.variable(n, train).select("feature_id", F.round("variance", 9).alias("score")), 10)
    chosen = P.restrict(n, top)
    return P.standardize(chosen, P.scaler(chosen, train)).select("sample_id", "feature_id", *r6("value"))


# splits: a customer is a group of one class; a nation is a group of mixed classes
CUST = "WITH g AS (SELECT c_custkey AS \"group\", c_mktsegment AS label, c_nationkey AS stratum FROM customer)"


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("group"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("stratum"))


FOLDS = CUST + ", f AS (SELECT \"group\", label, ((row_number() OVER (PARTITION BY label ORDER BY md5('7:' || \"group\"), \"group\") + dense_rank() OVER (ORDER BY label) - 2) % 5)::INTEGER AS fold FROM g)"


@query("spl1_stratified_group_folds", FOLDS + " SELECT * FROM f")
def spl1(spark, d):
    return S.stratified_folds(_customers(spark, d).drop("stratum"), 5, 7)


@query("spl2_plain_group_folds", CUST + " SELECT \"group\", (ntile(4) OVER (ORDER BY md5('7:' || \"group\"), \"group\") - 1)::INTEGER AS fold FROM g")
def spl2(spark, d):
    return S.plain_folds(_customers(spark, d).select("group"), 4, 7)


@query("spl3_mixed_group_folds", kq.META_SQL + """, s AS (SELECT donor AS "group", count(*) AS n FROM meta GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5('7:' || "group"), "group") - 1 AS k FROM s)
SELECT "group", n, CASE WHEN (k // 4) % 2 = 0 THEN k % 4 ELSE 3 - k % 4 END::INTEGER AS fold FROM k""")
def spl3(spark, d):
    return S.balanced_folds(kq.metadata(study(spark, d)).groupBy(F.col("donor").alias("group")).agg(F.count("*").alias("n")), 4, 7)


@query("spl4_leave_group_out", kq.META_SQL + " SELECT (dense_rank() OVER (ORDER BY donor) - 1)::INTEGER AS fold, sample_id FROM meta")
def spl4(spark, d):
    return S.leave_one_out(kq.metadata(study(spark, d)), "donor")


# cells of state P are another batch, which every donor has: its training side is empty
LBO = kq.BASE_SQL + """, m AS (SELECT DISTINCT sample_id, donor, CASE WHEN state = 'P' THEN 'Z' ELSE batch END AS batch FROM cells), b AS (SELECT DISTINCT batch AS held FROM m)
SELECT held AS batch, sample_id, 'test' AS role FROM m JOIN b ON held = batch UNION ALL SELECT held, sample_id, 'train' FROM m CROSS JOIN b WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.donor = m.donor AND x.batch = held)"""


@query("spl5_leave_batch_out", LBO)
def spl5(spark, d):
    c = study(spark, d).cells
    return S.leave_batch_out(c.select("sample_id", "donor", F.when(F.col("state") == "P", "Z").otherwise(F.col("batch")).alias("batch")).distinct(), "donor", "batch")


@query("jn12_purged_training", LBO.replace("SELECT held AS batch, sample_id, 'test' AS role FROM m JOIN b ON held = batch UNION ALL SELECT held, sample_id, 'train'", "SELECT held AS batch, sample_id"))
def jn12(spark, d):
    return spl5(spark, d).where("role = 'train'").drop("role")


@query("jn13_group_semi_join", FOLDS + " SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT \"group\" FROM f WHERE fold = 0)")
def jn13(spark, d):
    chosen = spl1(spark, d).where("fold = 0").select(F.col("group").alias("o_custkey"))
    return table(spark, d, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey")


# a group is a customer's year: whole histories span the table and leave no training side
TIMES = "WITH t AS (SELECT o_custkey || ':' || year(o_orderdate::DATE) AS \"group\", min(o_orderdate::DATE - DATE '1970-01-01')::DOUBLE AS first, max(o_orderdate::DATE - DATE '1970-01-01')::DOUBLE AS last FROM orders GROUP BY 1)"


def _times(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("double"))
    return S.group_times(o.withColumn("customer_year", F.concat_ws(":", "o_custkey", F.year("o_orderdate"))), "customer_year", "day")


@query("win4_group_times", TIMES + " SELECT * FROM t")
def win4(spark, d):
    return _times(spark, d)


TEMPORAL = TIMES + """, o AS (SELECT first, row_number() OVER (ORDER BY first) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT first FROM t)), w AS (SELECT first, (ntile(3) OVER (ORDER BY first) - 1)::INTEGER AS fold FROM o WHERE k > greatest(1, ceil(n * 0.5))), b AS (SELECT fold, min(first) AS begin FROM w GROUP BY 1)"""


@query("spl6_temporal_folds", TEMPORAL + " SELECT fold, \"group\", 'test' AS role FROM t JOIN w USING (first) UNION ALL SELECT fold, \"group\", 'train' FROM t JOIN b ON last < begin - 30")
def spl6(spark, d):
    return S.temporal_folds(_times(spark, d), 3, 0.5, 30)


@query("jn15_temporal_range_join", TEMPORAL + " SELECT fold, \"group\" FROM t JOIN b ON last < begin - 30")
def jn15(spark, d):
    return spl6(spark, d).where("role = 'train'").drop("role")


@query("win5_occasion_windows", TIMES + " SELECT first, (ntile(7) OVER (ORDER BY first) - 1)::INTEGER AS bucket FROM (SELECT DISTINCT first FROM t)")
def win5(spark, d):
    from pyspark.sql import Window as W

    return _times(spark, d).select("first").distinct().withColumn("bucket", (F.ntile(7).over(W.orderBy("first")) - 1).cast("int"))  # days: a small dimension


@query("spl7_class_coverage", FOLDS + ", n AS (SELECT unnest(range(5))::INTEGER AS fold) SELECT n.fold, count(DISTINCT label) AS classes, count(DISTINCT label) = (SELECT count(DISTINCT label) FROM g) AS covers FROM n JOIN f ON f.fold <> n.fold GROUP BY 1")
def spl7(spark, d):
    g = _customers(spark, d).drop("stratum")
    return S.class_coverage(S.stratified_folds(g, 5, 7).select("group", "fold"), g, 5)


@query("spl8_split_audit", kq.META_SQL + """, s AS (SELECT donor, (ntile(3) OVER (ORDER BY md5('3:' || donor), donor) - 1)::INTEGER AS own FROM (SELECT DISTINCT donor FROM meta)), r AS (SELECT n.fold, CASE WHEN own = n.fold THEN 'test' ELSE 'train' END AS role, sample_id, donor FROM meta JOIN s USING (donor) CROSS JOIN (SELECT unnest(range(3))::INTEGER AS fold) n)
SELECT fold, role, string_agg(DISTINCT sample_id, ',' ORDER BY sample_id) AS samples, string_agg(DISTINCT donor, ',' ORDER BY donor) AS groups FROM r GROUP BY 1, 2""")
def spl8(spark, d):
    meta = kq.metadata(study(spark, d))
    folds = S.plain_folds(meta.select(F.col("donor").alias("group")).distinct(), 3, 3)
    return S.split_audit(meta, folds, 3, "donor").select("fold", "role", F.array_join("samples", ",").alias("samples"), F.array_join("groups", ",").alias("groups"))


@query("spl9_group_subsample", CUST + ", c AS (SELECT \"group\", label, row_number() OVER (ORDER BY md5('101:4:0:' || \"group\"), \"group\") AS k FROM g) SELECT \"group\", label FROM c WHERE k <= ceil((SELECT count(*) FROM g) * 0.7)")
def spl9(spark, d):
    g = _customers(spark, d).drop("stratum")
    return S.subsample_groups(g, S.subsample_size(g.count(), 0.7, 3), 3, 101, 4)


@query("spl10_label_permutation", CUST + """, l AS (SELECT stratum, label, row_number() OVER (PARTITION BY stratum ORDER BY "group") AS k FROM g), p AS (SELECT stratum, "group", row_number() OVER (PARTITION BY stratum ORDER BY md5('7919:2:' || "group"), "group") AS k FROM g)
SELECT "group", stratum, label FROM p JOIN l USING (stratum, k)""")
def spl10(spark, d):
    return S.permute_labels(_customers(spark, d), 7919, 2)


# metrics: labelled documents with a deterministic score, grouped by source
SCORED = """WITH s AS (SELECT doc_id, toxic::INTEGER AS y, source, (doc_id * 7919 % 101) / 100.0::DOUBLE AS q FROM labels JOIN documents USING (doc_id)),
w AS (SELECT *, (q + y) / 2 AS p, 1 / count(*) OVER (PARTITION BY source) AS w0 FROM s), r AS (SELECT *, w0 / avg(w0) OVER () AS w FROM w)"""


def _scored(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("y"), "source", ((F.col("doc_id") * 7919 % 101) / F.lit(100.0)).alias("q"))
    return M.group_weights(x.withColumn("p", (F.col("q") + F.col("y")) / 2), "source")


@query("agg16_group_weights", SCORED + " SELECT doc_id, round(w, 6) AS w FROM r")
def agg16(spark, d):
    return _scored(spark, d).select("doc_id", *r6("w"))


@query("win3_group_sizes", SCORED + " SELECT doc_id, count(*) OVER (PARTITION BY source) AS n FROM s")
def win3(spark, d):
    return with_group(_scored(spark, d), ["source"], n=F.count("*")).select("doc_id", "n")


@query("met1_log_loss", SCORED + " SELECT round(sum(w * -ln(CASE WHEN y = 1 THEN greatest(p, 2.220446049250313e-16) ELSE 1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) END)) / sum(w), 6) AS log_loss FROM r")
def met1(spark, d):
    return M.log_loss(_scored(spark, d)).select(*r6("log_loss"))


@query("met2_regression", SCORED + " SELECT round(sqrt(sum(w * (n - p) * (n - p)) / sum(w)), 6) AS rmse, round(sum(w * abs(n - p)) / sum(w), 6) AS mae, round(1 - sum(w * (n - p) * (n - p)) / (sum(w * n * n) - sum(w * n) * sum(w * n) / sum(w)), 6) AS r2 FROM (SELECT *, (doc_id % 17) / 17.0::DOUBLE AS n FROM r)")
def met2(spark, d):
    return M.regression(_scored(spark, d).withColumn("y", F.col("doc_id") % 17 / F.lit(17.0))).select(*r6("rmse", "mae", "r2"))


CONF = SCORED + ", c AS (SELECT coalesce(sum(w) FILTER (p >= 0.5 AND y = 1), 0) AS tp, coalesce(sum(w) FILTER (p >= 0.5 AND y = 0), 0) AS fp, coalesce(sum(w) FILTER (p < 0.5 AND y = 0), 0) AS tn, coalesce(sum(w) FILTER (p < 0.5 AND y = 1), 0) AS fn FROM (SELECT y, w, q AS p FROM r))"


@query("met3_confusion", CONF + " SELECT round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c")
def met3(spark, d):
    return M.confusion(_scored(spark, d).withColumn("p", F.col("q"))).select(*r6("sensitivity", "specificity", "balanced_accuracy", "mcc"))


CURVE = SCORED + ", g AS (SELECT p, sum(w * y) AS tp, sum(w * (1 - y)) AS fp FROM r GROUP BY 1), k AS (SELECT *, sum(tp) OVER (ORDER BY p DESC) AS ct, sum(fp) OVER (ORDER BY p DESC) AS cf FROM g)"


@query("met4_roc_auc", CURVE + " SELECT round(sum(fp * (ct - tp / 2)) / (sum(tp) * sum(fp)), 6) AS roc_auc FROM k")
def met4(spark, d):
    return M.ranking(_scored(spark, d)).select(*r6("roc_auc"))


@query("met5_average_precision", CURVE + " SELECT round(sum(tp * ct / (ct + cf)) / sum(tp), 6) AS average_precision FROM k")
def met5(spark, d):
    return M.ranking(_scored(spark, d)).select(*r6("average_precision"))


@query("win7_roc_pr_curves", CURVE + " SELECT round(p, 6) AS p, round(ct, 6) AS cum_tp, round(cf, 6) AS cum_fp FROM k")
def win7(spark, d):
    return M.curve(_scored(spark, d)).select(*r6("p", "cum_tp", "cum_fp"))


@query("met6_brier", SCORED + " SELECT round(sum(w * (p - y) * (p - y)) / sum(w), 6) AS brier_score, round(sum(w * y) / sum(w), 6) AS prevalence FROM r")
def met6(spark, d):
    return M.brier(_scored(spark, d)).select(*r6("brier_score", "prevalence"))


@query("met7_calibration", SCORED + " SELECT least(floor(p * 5), 4)::INTEGER AS bin, round(sum(w * p) / sum(w), 6) AS mean_probability, round(sum(w * y) / sum(w), 6) AS observed_fraction, count(*) AS n_rows, round(sum(w), 6) AS weight FROM r GROUP BY 1")
def met7(spark, d):
    return M.calibration(_scored(spark, d)).select("bin", *r6("mean_probability", "observed_fraction"), "n_rows", *r6("weight"))


@query("scl12_calibration_bins", SCORED + " SELECT doc_id, least(floor(p * 5), 4)::INTEGER AS bin FROM r")
def scl12(spark, d):
    return _scored(spark, d).select("doc_id", M.calibration_bin(F.col("p")).alias("bin"))


MULTI = "WITH s AS (SELECT doc_id, (doc_id % 3)::INTEGER AS y, source, [1 + doc_id * 31 % 7, 1 + doc_id * 17 % 5, 1 + doc_id * 13 % 11] AS a FROM labels JOIN documents USING (doc_id)), n AS (SELECT *, list_transform(a, lambda x: x / list_sum(a)) AS probs, 1 / count(*) OVER (PARTITION BY source) AS w0 FROM s), r AS (SELECT *, w0 / avg(w0) OVER () AS w FROM n)"


def _multi(spark, d):
    k = F.col("doc_id")
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("doc_id", (k % 3).cast("int").alias("y"), "source", F.array(1 + k * 31 % 7, 1 + k * 17 % 5, 1 + k * 13 % 11).alias("a"))
    total = F.aggregate("a", F.lit(0).cast("long"), lambda s, v: s + v)
    return M.group_weights(x.withColumn("t", total).withColumn("probs", F.transform("a", lambda v: v / F.col("t"))), "source")


@query("scl13_hard_labels", MULTI + " SELECT doc_id, (list_position(probs, list_max(probs)) - 1)::INTEGER AS label FROM r")
def scl13(spark, d):
    return _multi(spark, d).select("doc_id", M.hard_label(F.col("probs")).alias("label"))


@query("met4_macro_multiclass", MULTI + """, l AS (SELECT c AS class, (y = c)::INTEGER AS y, probs[c + 1] AS p, w FROM r CROSS JOIN (SELECT unnest(range(3)) AS c)), g AS (SELECT class, p, sum(w * y) AS tp, sum(w * (1 - y)) AS fp FROM l GROUP BY 1, 2),
k AS (SELECT *, sum(tp) OVER (PARTITION BY class ORDER BY p DESC) AS ct, sum(fp) OVER (PARTITION BY class ORDER BY p DESC) AS cf FROM g), per AS (SELECT class, sum(fp * (ct - tp / 2)) / (sum(tp) * sum(fp)) AS auc, sum(tp * ct / (ct + cf)) / sum(tp) AS ap FROM k GROUP BY 1)
SELECT round(avg(auc), 6) AS roc_auc_macro_ovr, round(avg(ap), 6) AS pr_auc_macro_ovr, round((SELECT sum(w * (p - y) * (p - y)) / (sum(w) / 3) FROM l), 6) AS brier_multiclass_sum FROM per""")
def met4_macro(spark, d):
    return M.macro_ranking(_multi(spark, d)).select(*r6("roc_auc_macro_ovr", "pr_auc_macro_ovr", "brier_multiclass_sum"))


PV = "WITH t AS (SELECT p_partkey AS test, p_brand AS family, ((p_partkey * 7919 % 997) + 1) / 1000.0::DOUBLE * ((p_partkey * 7919 % 997) + 1) / 1000.0::DOUBLE AS p FROM part)"


ADJUSTED = PV + """, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS m FROM t),
adjusted AS (SELECT test, family, p, least(1, min(p * m / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS padj FROM r)"""


@query("win6_benjamini_hochberg", ADJUSTED + " SELECT test, round(p, 6) AS p, round(padj, 6) AS padj FROM adjusted")
def win6(spark, d):
    u = ((F.col("p_partkey") * 7919 % 997) + 1) / F.lit(1000.0)
    t = table(spark, d, "part").select(F.col("p_partkey").alias("test"), F.col("p_brand").alias("family"), (u * ((F.col("p_partkey") * 7919 % 997) + 1) / F.lit(1000.0)).alias("p"))
    return M.benjamini_hochberg(t, "p", ["family"]).select("test", *r6("p", "padj"))


@query("agg26_min_adjusted_p", ADJUSTED + " SELECT family AS gene_id, round(coalesce(min(padj), 1), 6) AS padj FROM adjusted GROUP BY 1")
def agg26(spark, d):
    genes = table(spark, d, "part").select(F.col("p_partkey").alias("test"), F.col("p_brand").alias("gene_id"))
    return win6(spark, d).join(genes, "test").groupBy("gene_id").agg(F.coalesce(F.min("padj"), F.lit(1.0)).alias("padj"))


@query("agg27_expression_prevalence", EXPR + " SELECT feature_id, round(avg((value > 100)::INT), 6) AS prevalence FROM expr GROUP BY 1")
def agg27(spark, d):
    return _base(spark, d)[0].groupBy("feature_id").agg(F.round(F.avg((F.col("value") > 100).cast("double")), 6).alias("prevalence"))


@query("mod9_dummy_model", SCORED + " SELECT y, round(sum(w) / (SELECT sum(w) FROM r), 6) AS prior FROM r GROUP BY 1")
def mod9(spark, d):
    x = _scored(spark, d)
    from pyspark.sql import Window as W

    return x.groupBy("y").agg(F.sum("w").alias("w")).select("y", F.round(F.col("w") / F.sum("w").over(W.partitionBy(F.lit(1))), 6).alias("prior"))


@query("val2_permutation_pvalue", "WITH l AS (SELECT p_size AS perm_id, count(*)::DOUBLE AS statistic FROM part GROUP BY 1) SELECT round((1 + count(*) FILTER (statistic >= (SELECT statistic FROM l WHERE perm_id = 1) - 1e-12)) / (1 + count(*)), 6) AS pvalue FROM l WHERE perm_id <> 1")
def val2_pvalue(spark, d):
    l = table(spark, d, "part").groupBy(F.col("p_size").alias("perm_id")).agg(F.count("*").cast("double").alias("statistic"))
    return M.permutation_pvalue(l, "perm_id = 1").select(*r6("pvalue"))
