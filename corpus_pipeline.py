"""A training corpus from ``documents`` in five stages, each an operator of cohortlens.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Rejected by quality or toxicity: gone. Of near copies (five-word shingles, similarity 0.8): the smallest
doc_id stays. Mixing uses a document at most once and spends 90 % of the tokens left, by weights. Packing returns pieces.

Defined results. Null text: as ''; an empty text may be kept and is one piece. Null lang or source: ''. Null doc_id: no label and no
copy of another; its rows stay. Rows that share a doc_id are judged each by the classifiers, and stay or go together in near_dedup.
Very long texts are read whole, and cut into pieces by packing only. Without labels the classifiers reject nothing. Columns beside
doc_id, text, lang and source stay as they are, whatever their names, until packing. Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import mixing, neardup, packing, quality, toxicity
from cohortlens.llm.common import materialize

MIXTURE = mixing.MixtureSpec(weights={"domain": {"web": 40, "news": 30, "code": 10, "books": 20}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}}, default_weight=1, budget_percent=90, max_epochs=1, seed="corpus-1")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep_good(docs, labels, F.col("source"), F.col("lang"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixture(docs, mixing.domain_of(F.col("source")), MIXTURE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", good_quality), ("toxicity", civil), ("near_dedup", distinct_texts), ("mixing", mixed), ("packing", packed)]

#: The classifiers and the packing plan have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"corpus-{name}")
    return docs
