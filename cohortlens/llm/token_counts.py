"""Token counts through a digest cache.

The cache is a Parquet table (content, tokenizer, n_tokens): the SHA-256 of a text, the SHA-256 of the vocabulary file,
and the count. ``count_tokens`` digests every text, finds the digests that the cache lacks for this tokenizer, encodes
one text for each of them, appends the counts, and joins the cache to the documents. Copies are thus encoded once, and
a second run over the same texts encodes nothing. One narrow shuffle finds the misses. Where the digests that have copies or
are cached are few (counted), the rows to pass over are broadcast and texts are encoded where they lie; else texts are
shuffled once, by (document, digest), which no group of copies can make uneven.

Defined results. Null text: as ''. Null doc_id: kept as null. Rows repeated exactly or ids used twice: one row each.
Texts are encoded whole, however long. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, new_path, path_exists, text_batches, tidied, worker_state

LIMIT = 4096
CACHE = "content string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def load(path: str):
    """texts -> counts, by the library the file belongs to."""
    state = worker_state()
    if ("count", path) not in state:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            state["count", path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            state["count", path] = lambda texts: [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    return state["count", path]


def _encode(path: str, version: str, batch_bytes: int = 4 << 20):
    def run(batches):
        count = load(path)
        for batch in batches:
            digests, texts = batch.column("content"), batch.column("text")
            counts, part, size = [], [], 0
            for t in texts:
                part.append(t.as_py())
                size += len(part[-1])
                if size >= batch_bytes:
                    counts += count(part)
                    part, size = [], 0
            counts += count(part) if part else []
            yield pa.RecordBatch.from_arrays([digests, pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["content", "tokenizer", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(cache) if path_exists(spark, cache) else spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """doc_id, content (digest), n_bytes, n_tokens. tokenizer: path of a .model or .json file; cache: a folder on shared
    storage, made if missing."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("content"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row"))
    slim = materialize(rows.select("doc_id", "content", "row", F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("content", F.lit(True).alias("cached")).distinct()
    first = slim.groupBy("content").agg(F.min("row").alias("row"), F.count("*").alias("n")).join(known, "content", "left")
    first = materialize(first, "token-first")
    idle = first.where("n > 1 or cached").select(F.col("content").alias("__content"), F.when(F.col("cached").isNull(), F.col("row")).alias("__row"))
    if idle.count() <= BROADCAST_ROWS:  # few copies and hits: texts stay where they are
        other = F.col("__row").isNull() | (F.col("row") != F.col("__row"))
        texts = rows.join(F.broadcast(idle), (F.col("content") == F.col("__content")) & other, "left_anti")
    else:
        texts = rows.join(first.where("cached is null").select("content", "row").hint("shuffle_hash"), ["content", "row"], "left_semi")
    with text_batches(spark):
        texts.select("content", "text").mapInArrow(tidied(_encode(tokenizer, version)), CACHE).write.mode("append").parquet(cache)
    # written before the join, so that adaptive execution can split a digest that many documents share
    counts = materialize(read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return slim.drop("row").join(counts, "content").select("doc_id", "content", "n_bytes", "n_tokens")


def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    counts = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
