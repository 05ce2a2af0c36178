"""Queries of the contracts, set relations and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import bucket_of, cuts, ranked, with_group
from ..operators import cells as C
from ..operators import contracts as K
from ..sources.study import BASE_SQL, study, table
from . import cell_queries as cq

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


r6 = cq.r6
META_SQL = BASE_SQL + ", meta AS (SELECT sample_id, min(donor) AS donor, min(batch) AS batch, min(outcome) AS outcome, avg(account) AS account, min(day) AS day FROM cells GROUP BY 1)"
EXPR_SQL = META_SQL + """, expr AS (SELECT s.sample_id, g.gene_id AS feature_id, coalesce(v, 0)::DOUBLE AS value FROM meta s CROSS JOIN (SELECT DISTINCT gene_id FROM counts) g
  LEFT JOIN (SELECT sample_id, gene_id, sum(count) AS v FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2) x ON x.sample_id = s.sample_id AND x.gene_id = g.gene_id)"""


def metadata(s):
    return s.cells.groupBy("sample_id").agg(F.min("donor").alias("donor"), F.min("batch").alias("batch"), F.min("outcome").alias("outcome"), F.avg("account").alias("account"), F.min("day").alias("day"))


def expression(s):
    """sample_id, feature_id, value on the complete grid: pseudobulk over all states."""
    return C.pseudobulk(s.cells.withColumn("state", F.lit("all")), s.counts, genes=s.genes).select("sample_id", F.col("gene_id").alias("feature_id"), F.col("count").cast("double").alias("value"))


@query("prj1_required_columns", BASE_SQL + " SELECT 'donor' AS \"column\", count(*) FILTER (donor IS NULL OR trim(donor) = '') AS violations FROM cells UNION ALL SELECT 'state', count(*) FILTER (state IS NULL OR trim(state) = '') FROM cells UNION ALL SELECT 'batch', count(*) FILTER (batch IS NULL OR trim(batch) = '') FROM cells")
def prj1(spark, d):
    return K.missing_cells(study(spark, d).cells, ["donor", "state", "batch"])


@query("prj2_sample_invariance", BASE_SQL + ", k AS (SELECT sample_id, count(DISTINCT donor) AS a, count(DISTINCT batch) AS b, count(DISTINCT state) AS c FROM cells GROUP BY 1) SELECT 'donor' AS \"column\", count(*) FILTER (a > 1) AS violations FROM k UNION ALL SELECT 'batch', count(*) FILTER (b > 1) FROM k UNION ALL SELECT 'state', count(*) FILTER (c > 1) FROM k")
def prj2(spark, d):
    return K.variant_columns(study(spark, d).cells, "sample_id", ["donor", "batch", "state"])


@query("prj3_first_row_metadata", BASE_SQL + " SELECT sample_id, min(donor) AS donor, min(batch) AS batch, min(outcome) AS outcome FROM cells GROUP BY 1")
def prj3(spark, d):
    return K.first_per_key(study(spark, d).cells, "sample_id", ["donor", "batch", "outcome"])


@query("prj4_outcome_codes", "SELECT label, dense_rank() OVER (ORDER BY label = 'BUILDING', label) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS label FROM customer)")
def prj4(spark, d):
    return K.encode_outcome(table(spark, d, "customer"), "c_mktsegment", "BUILDING")


@query("prj5_group_key", META_SQL + " SELECT sample_id, coalesce(donor, sample_id) AS \"group\" FROM meta")
def prj5(spark, d):
    return metadata(study(spark, d)).select("sample_id", F.coalesce("donor", "sample_id").alias("group"))


@query("prj6_row_subset", META_SQL + " SELECT sample_id, batch FROM meta WHERE sample_id IN (SELECT sample_id FROM meta WHERE outcome IN ('BUILDING', 'MACHINERY'))")
def prj6(spark, d):
    m = metadata(study(spark, d))
    return m.join(m.where(F.col("outcome").isin("BUILDING", "MACHINERY")).select("sample_id"), "sample_id", "left_semi").select("sample_id", "batch")


@query("prj7_feature_key", BASE_SQL + " SELECT DISTINCT gene_id, to_json(['gene_mean', 'F', gene_id])::VARCHAR AS feature_id FROM counts")
def prj7(spark, d):
    return study(spark, d).genes.select("gene_id", F.to_json(F.array(F.lit("gene_mean"), F.lit("F"), F.col("gene_id"))).alias("feature_id"))


@query("prj8_feature_label", BASE_SQL + " SELECT DISTINCT gene_id, gene_id || ' > 2.0 | F | gene_tail' AS label FROM counts")
def prj8(spark, d):
    return study(spark, d).genes.select("gene_id", F.format_string("%s > 2.0 | %s | %s", F.col("gene_id"), F.lit("F"), F.lit("gene_tail")).alias("label"))


@query("prj9_public_names", BASE_SQL + " SELECT DISTINCT gene_id AS feature, 'count' AS unit FROM counts")
def prj9(spark, d):
    return study(spark, d).genes.withColumn("unit", F.lit("count")).withColumn("internal", F.lit(1)).drop("internal").withColumnRenamed("gene_id", "feature")


@query("chk1_dataset_contract", META_SQL + """ SELECT * FROM (VALUES ('blank_sample_id', 0::BIGINT), ('blank_group', 0), ('duplicate_sample_id', 0), ('duplicate_feature_id', 0)) t(check_id, violations)
  UNION ALL SELECT 'few_samples', (count(*) < 4)::BIGINT FROM meta UNION ALL SELECT 'few_features', (count(DISTINCT gene_id) < 1)::BIGINT FROM counts UNION ALL SELECT 'few_groups', (count(DISTINCT donor) < 4)::BIGINT FROM meta""")
def chk1(spark, d):
    s = study(spark, d)
    return K.dataset_contract(metadata(s), s.genes.withColumnRenamed("gene_id", "feature_id"), "donor")


@query("chk2_raw_counts", EXPR_SQL + """ SELECT 'missing' AS check_id, count(*) FILTER (value IS NULL) AS violations FROM expr UNION ALL SELECT 'negative', count(*) FILTER (value < 0) FROM expr UNION ALL SELECT 'fractional', count(*) FILTER (abs(value - round_even(value, 0)) > 1e-6) FROM expr
  UNION ALL SELECT 'infinite', 0 UNION ALL SELECT 'empty_library', count(*) FILTER (l <= 0) FROM (SELECT sum(value) AS l FROM expr GROUP BY sample_id)""")
def chk2(spark, d):
    return K.count_contract(expression(study(spark, d)))


@query("chk3_duplicate_profiles", "WITH e AS (SELECT vec_id, label, string_agg(x::VARCHAR, ',' ORDER BY i) AS p FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), g AS (SELECT p, count(DISTINCT label) AS n_groups, count(*) AS n_samples FROM e GROUP BY 1) SELECT n_groups, n_samples, count(*) AS profiles FROM g WHERE n_groups > 1 GROUP BY 1, 2")
def chk3(spark, d):
    e = table(spark, d, "embeddings")
    long = e.select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("i", "value")).select("sample_id", F.format_string("f%03d", F.col("i")).alias("feature_id"), F.col("value").cast("double").alias("value"))
    return K.profile_duplicates(long, e.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("group"))).groupBy("n_groups", "n_samples").agg(F.count("*").alias("profiles"))


PEARSON = "CASE WHEN sum({x}*{x}) - sum({x})*sum({x})/count(*) > 1e-12 AND sum({y}*{y}) - sum({y})*sum({y})/count(*) > 1e-12 THEN (sum({x}*{y}) - sum({x})*sum({y})/count(*)) / sqrt((sum({x}*{x}) - sum({x})*sum({x})/count(*)) * (sum({y}*{y}) - sum({y})*sum({y})/count(*))) END"


@query("chk4_target_copies", EXPR_SQL + f", t AS (SELECT feature_id, count(DISTINCT value) AS n_distinct, max(value) AS most, {PEARSON.format(x='value', y='account')} AS r FROM expr JOIN meta USING (sample_id) GROUP BY 1) SELECT feature_id, n_distinct, round(r, 6) AS r, coalesce(most >= 5 AND abs(r) > 1 - 1e-12, false) AS copies_target FROM t")
def chk4(spark, d):
    s = study(spark, d)
    return K.target_copies(expression(s), metadata(s).select("sample_id", F.col("account").alias("y")), None, 5).select("feature_id", "n_distinct", *r6("r"), "copies_target")


@query("chk5_covariate_leakage", META_SQL + ", l AS (SELECT 'donor' AS covariate, donor AS level, outcome FROM meta UNION ALL SELECT 'batch', batch, outcome FROM meta), k AS (SELECT covariate, level, count(DISTINCT outcome) AS k FROM l GROUP BY 1, 2) SELECT covariate, count(*) AS levels, count(*) > greatest(10, (SELECT count(*) FROM meta) / 2) AS high_cardinality, max(k) = 1 AS determines_outcome FROM k GROUP BY 1")
def chk5(spark, d):
    return K.covariate_leakage(metadata(study(spark, d)), ["donor", "batch"], "outcome")


@query("chk6_label_in_id", META_SQL + " SELECT sample_id, label FROM meta JOIN (SELECT DISTINCT outcome AS label FROM meta) ON contains(lower(sample_id), lower(label)) WHERE length(label) >= 3")
def chk6(spark, d):
    m = metadata(study(spark, d))
    return K.ids_with_labels(m, K.encode_outcome(m, "outcome"))


@query("chk7_library_outliers", EXPR_SQL + ", l AS (SELECT sample_id, ln(1 + sum(value)) AS x FROM expr GROUP BY 1), v AS (SELECT sample_id, abs(x - (SELECT median(x) FROM l)) AS deviation FROM l) SELECT sample_id, round(deviation, 6) AS deviation, deviation > greatest(5 * 1.4826 * (SELECT median(deviation) FROM v), 1.5) AS outlier FROM v")
def chk7(spark, d):
    lib = expression(study(spark, d)).groupBy("sample_id").agg(F.sum("value").alias("library"))
    return K.library_outliers(lib).select("sample_id", *r6("deviation"), "outlier")


@query("chk8_class_balance", META_SQL + ", c AS (SELECT outcome AS label, count(DISTINCT donor) AS groups, count(*) AS samples FROM meta GROUP BY 1) SELECT label, groups, samples, round(samples / (SELECT sum(samples) FROM c), 6) AS share, groups < 4 AS few_groups, (SELECT min(samples) / sum(samples) FROM c) < 0.2 AS imbalanced FROM c")
def chk8(spark, d):
    return K.class_balance(metadata(study(spark, d)), "outcome", "donor").select("label", "groups", "samples", *r6("share"), "few_groups", "imbalanced")


@query("chk9_universe_equality", "WITH a AS (SELECT DISTINCT p_brand AS feature_id FROM part), b AS (SELECT DISTINCT p_brand AS feature_id FROM part WHERE p_size > 45 OR p_brand <> 'Brand#7') SELECT feature_id, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT feature_id, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def chk9(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_brand", "feature_id")
    return K.key_differences(p, p.where("p_size > 45 or feature_id != 'Brand#7'"), "feature_id")


@query("chk10_split_disjoint", META_SQL + " SELECT donor FROM meta WHERE batch = 'ASIA' INTERSECT SELECT donor FROM meta WHERE batch <> 'EUROPE'")
def chk10(spark, d):
    m = metadata(study(spark, d))
    return K.group_overlap(m.where("batch = 'ASIA'"), m.where("batch != 'EUROPE'"), "donor")


@query("set1_key_equality", "SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def set1(spark, d):
    return K.key_differences(table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "k")


@query("set2_overlap", "SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT s_suppkey FROM supplier")
def set2(spark, d):
    return K.group_overlap(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "k"), table(spark, d, "supplier").withColumnRenamed("s_suppkey", "k"), "k")


@query("set3_difference", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set3(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).subtract(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")))


@query("set4_fold_concatenation", META_SQL + " SELECT 0::INTEGER AS fold, sample_id, NULL::DOUBLE AS loss FROM meta WHERE batch = 'ASIA' UNION ALL SELECT 1, sample_id, round(account, 6) FROM meta WHERE batch <> 'ASIA'")
def set4(spark, d):
    m = metadata(study(spark, d))
    a = m.where("batch = 'ASIA'").select(F.lit(0).alias("fold"), "sample_id")
    b = m.where("batch != 'ASIA'").select(F.lit(1).alias("fold"), "sample_id", F.round("account", 6).alias("loss"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set5_ordered_dedup", "WITH e AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1) SELECT user_id, row_number() OVER (ORDER BY t, user_id) AS position FROM e")
def set5(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("t"))
    return ranked(e, [], bucket_of(F.col("t"), cuts(e, F.col("t"))), ["t", "user_id"], "position").select("user_id", "position")


@query("agg18_crosstab", "SELECT lang, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def agg18(spark, d):
    return K.crosstab(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "lang", "toxic")


@query("agg19_cramers_v", """WITH t AS (SELECT lang, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS ra, sum(n) OVER (PARTITION BY toxic) AS cb FROM t)
SELECT round(sqrt(greatest(sum(n * n / (ra * cb)) - 1, 0) / (least(count(DISTINCT lang), count(DISTINCT toxic)) - 1)), 6) AS cramers_v, round((SELECT sum(b) / sum(s) FROM (SELECT max(n) AS b, sum(n) AS s FROM t GROUP BY lang)), 6) AS purity FROM m""")
def agg19(spark, d):
    return K.cramers_v(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "lang", "toxic").select(*r6("cramers_v", "purity"))


@query("agg20_eta_squared", META_SQL + " SELECT round(var_pop(m) / var_pop(account), 6) AS eta_squared FROM (SELECT account, avg(account) OVER (PARTITION BY batch) AS m FROM meta)")
def agg20(spark, d):
    return K.eta_squared(metadata(study(spark, d)), "batch", "account").select(*r6("eta_squared"))


@query("win2_group_mean", META_SQL + " SELECT sample_id, round(avg(account) OVER (PARTITION BY batch), 6) AS batch_mean FROM meta")
def win2(spark, d):
    return with_group(metadata(study(spark, d)), ["batch"], batch_mean=F.avg("account")).select("sample_id", *r6("batch_mean"))


@query("agg31_distinct_counts", META_SQL + " SELECT count(DISTINCT donor) AS donors, count(DISTINCT outcome) AS classes, count(DISTINCT batch) AS batches, count(*) AS samples FROM meta")
def agg31(spark, d):
    return metadata(study(spark, d)).agg(F.count_distinct("donor").alias("donors"), F.count_distinct("outcome").alias("classes"), F.count_distinct("batch").alias("batches"), F.count("*").alias("samples"))


@query("scl11_identifier_hash", "SELECT sha256(to_json(list(DISTINCT p_brand ORDER BY p_brand))) AS digest FROM part")
def scl11(spark, d):
    return K.list_hash(table(spark, d, "part"), "p_brand")


@query("jn1_expression_metadata", EXPR_SQL + " SELECT sample_id, donor, feature_id, value FROM expr JOIN meta USING (sample_id)")
def jn1(spark, d):
    s = study(spark, d)
    return expression(s).join(metadata(s), "sample_id").select("sample_id", "donor", "feature_id", "value")


@query("jn14_external_overlap", META_SQL + " SELECT DISTINCT donor FROM meta WHERE batch = 'ASIA' AND donor IN (SELECT donor FROM meta WHERE outcome = 'BUILDING')")
def jn14(spark, d):
    m = metadata(study(spark, d))
    return m.where("batch = 'ASIA'").select("donor").join(m.where("outcome = 'BUILDING'"), "donor", "left_semi").distinct()


@query("jn16_state_count_alignment", cq.PSEUDO_SQL + " SELECT sample_id, gene_id, count FROM pseudo WHERE state = 'F' AND n_cells >= 40")
def jn16(spark, d):
    s = study(spark, d)
    ok = C.cell_totals(s.cells.where("state = 'F'")).where("n_cells >= 40").select("sample_id")
    return C.pseudobulk(s.cells, s.counts, 5, s.genes).where("state = 'F'").join(ok, "sample_id").select("sample_id", "gene_id", "count")


@query("src2_bulk_long_form", EXPR_SQL + " SELECT sample_id, feature_id, value FROM expr")
def src2(spark, d):
    from ..sources.matrices import to_long, to_wide

    s = study(spark, d)
    genes = sorted(r[0] for r in s.genes.collect())  # genes: a declared dimension
    return to_long(to_wide(expression(s), genes), metadata(s))


@query("src6_annotations", BASE_SQL + " SELECT g.gene_id, coalesce(gene_symbol, '') AS gene_symbol FROM (SELECT DISTINCT gene_id FROM counts) g LEFT JOIN (SELECT p_brand AS gene_id, min(p_name) AS gene_symbol FROM part WHERE p_brand <> 'Brand#9' GROUP BY 1) USING (gene_id)")
def src6(spark, d):
    from ..sources.matrices import annotate

    names = table(spark, d, "part").where("p_brand != 'Brand#9'").groupBy(F.col("p_brand").alias("gene_id")).agg(F.min("p_name").alias("gene_symbol"))
    return annotate(study(spark, d).counts.select("gene_id").distinct(), names)  # genes that cells count, as in the SQL


@query("jn9_symbol_default", SQL["src6_annotations"])
def jn9(spark, d):
    return src6(spark, d)
