"""A task's share of a study does not grow with the study: partitions do."""

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import registry
from cohortlens.sources import study as S
from cohortlens.sources import texts as T


def shares(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("share", [2_000, 500])
def test_entries_of_a_task_are_bounded(spark, sf_dir, monkeypatch, share):
    want = rows(registry.queries()["agg14_technical_qc"](spark, sf_dir))
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(S.dealt, "__defaults__", (None, share))
    counts = S.study(spark, sf_dir).counts
    assert max(shares(counts)) <= 1.5 * share and len(shares(counts)) == max(-(-n // share), spark.sparkContext.defaultParallelism)
    assert max(shares(registry.queries()["src4_sparse_canonical"](spark, sf_dir))) <= 1.5 * share
    assert rows(registry.queries()["agg14_technical_qc"](spark, sf_dir)) == want


#: Queries whose entries are dealt by the step that `dealt` is, as reported.
DEALT = [
    "rep2_cell_quality",
    "flt1_cell_qc",
    "scl10_multiset_digest",
    "snk5_count_subset",
    "scl9_cell_profile_hash",
    "agg1_pseudobulk",
    "agg21_stability_summary",
    "agg22_axis_frequency",
    "agg23_jaccard",
    "agg24_frequency_and_sign",
    "agg27_expression_prevalence",
    "agg28_group_frequency",
    "agg29_substitution",
    "agg2_moments",
    "agg4_gene_mean",
    "agg5_gene_detection",
]


@pytest.mark.parametrize("name", DEALT)
def test_queries_take_dealt_entries(spark, sf_dir, monkeypatch, name):
    deal, made = S.dealt, []
    monkeypatch.setattr(deal, "__defaults__", (None, 500))
    monkeypatch.setattr(S, "dealt", lambda *a: made.append(deal(*a)) or made[-1])
    registry.queries()[name](spark, sf_dir)
    assert made and max(n for df in made for n in shares(df)) <= 750


@pytest.mark.parametrize("name", DEALT)
def test_long_joins_take_dealt_rows(spark, sf_dir, monkeypatch, name):
    deal, made = S.spread, []
    monkeypatch.setattr(S, "LONG", 10)
    monkeypatch.setattr(S, "ENTRIES", 300)
    monkeypatch.setattr(S, "spread", lambda df, key, *a: made.append((key, deal(df, key, *a))) or made[-1][1])
    registry.queries()[name](spark, sf_dir)
    assert {key for key, _ in made} == {"o_custkey", "l_partkey"}
    assert max(n for _, df in made for n in shares(df)) <= 600


@pytest.mark.parametrize("name", ["src4_sparse_canonical", "flt1_cell_qc", "scl10_multiset_digest", "agg1_pseudobulk", "agg2_moments", "agg24_frequency_and_sign", "agg27_expression_prevalence"])
def test_long_joins_keep_results(spark, sf_dir, monkeypatch, name):
    want = rows(registry.queries()[name](spark, sf_dir))
    monkeypatch.setattr(S, "LONG", 10)
    monkeypatch.setattr(S, "ENTRIES", 300)
    assert S.spread(spark.range(20), "id", spark.range(10)).rdd.getNumPartitions() == spark.range(20).rdd.getNumPartitions()  # not long: left as it is
    assert rows(registry.queries()[name](spark, sf_dir)) == want


def test_few_entries_are_left_to_adaptive_execution(spark, sf_dir):
    assert len(shares(S.study(spark, sf_dir).counts)) <= 4


def test_texts_of_a_task_are_bounded(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = rows(T.corpus_study(docs).counts)
    n, total, longest = docs.agg(F.count("*"), F.sum(F.length("text")), F.max(F.length("text"))).first()
    monkeypatch.setattr(T, "CHARS", longest)
    study = T.corpus_study(docs)
    weights = study.counts.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.col("count") * (F.length("gene_id") + 1)).alias("n")).collect()
    assert study.counts.rdd.getNumPartitions() == max(-(-(total + n * T.ROW) // longest), spark.sparkContext.defaultParallelism) > 4
    assert max(r["n"] for r in weights) <= 4 * longest and len(weights) > 4
    assert rows(study.counts) == want and study.cells.count() == n
    assert rows(T.corpus_study(docs.where("doc_id < 0")).counts) == []  # nothing to weigh
    empty = spark.createDataFrame([(i, None, "en", "s") for i in range(50)], "doc_id long, text string, lang string, source string")
    assert T.corpus_study(empty).cells.count() == 50
