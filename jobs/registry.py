"""The jobs as queries: each runs twice into one new folder of the shared storage and returns the output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.sources.shared import new_folder

from . import marker_terms, term_moments


def job1_marker_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_folder(spark, "job1-marker-terms")
    for _ in range(2):
        marker_terms.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", output)
    return marker_terms.read_evidence(spark, output)


def job2_term_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_folder(spark, "job2-term-moments")
    for _ in range(2):
        term_moments.run(spark, f"{sf_dir}/documents[.]parquet", output)  # a pattern: the table may be one file
    return term_moments.read(spark, output, "features")


def queries() -> dict:
    return {"job1_marker_terms": job1_marker_terms, "job2_term_moments": job2_term_moments}


def oracle_sql() -> dict[str, str]:
    return {"job1_marker_terms": marker_terms.oracle(), "job2_term_moments": term_moments.oracle()}
