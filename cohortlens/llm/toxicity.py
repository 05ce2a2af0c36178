"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words (lower-cased runs of letters), of the words' beginnings (4 and 6
letters, for inflected forms), of pairs of neighbours and of pairs with one word between. Training is one pass of
FTRL-proximal per epoch, with per-coordinate learning rates and L1, over at most ``max_rows`` labelled rows chosen by
hash; its features stream into a single task, whose input is bounded by that parameter. The weights that L1 leaves are
collected (at most 2**``bits`` of them) and broadcast; every document is then scored whole, where it lies, without a shuffle.

Defined results. Null or empty text: the intercept's score. Null doc_id: scored; counts as not held out. Labels: of several
for one doc_id the largest counts; null labels are ignored; without any label every score is 0.5. Only ``text`` is
ever an input of a score. Of documents that share a doc_id, that whose sorted features come first is learned from; all are scored. Empty tables give no rows. Other columns stay as they are.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_column, crc_fold, free_prefix, text_batches, tidied

WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7


@dataclass(frozen=True)
class FtrlParams:
    """max_rows bounds the labelled rows that are learned from."""

    max_rows: int = 16_000
    bits: int = 20
    epochs: int = 8
    alpha: float = 1.5
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1


def features(text: str, bits: int) -> np.ndarray:
    """Hashes (uint32, with repeats) of all features of a text."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint32)
    crc = zlib.crc32
    raw = [w.encode() for w in words]
    one = np.array([crc(b) for b in raw], dtype=np.uint32)
    four = np.array([crc(w[:4].encode(), 4) for w in words], dtype=np.uint32)
    six = np.array([crc(w[:6].encode(), 6) for w in words], dtype=np.uint32)
    mix = np.uint32(0x9E3779B1)
    two = (one[:-1] * mix) ^ one[1:] ^ np.uint32(2)
    skip = (one[:-2] * mix) ^ (one[2:] * np.uint32(0x85EBCA6B)) ^ np.uint32(3)
    h = np.concatenate([one, four, six, two, skip])
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) & np.uint32((1 << bits) - 1)


def ftrl(rows: list[tuple[np.ndarray, int]], p: FtrlParams) -> tuple[np.ndarray, np.ndarray]:
    """rows: (distinct hashes, label), in order. Returns indices and values of the non-zero weights; index 2**bits is the
    intercept's."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        zi = z[i]
        w = (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        return np.where(np.abs(zi) > p.l1, w, 0.0)

    for _ in range(p.epochs):
        for idx, y in rows:
            w = weights(idx)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            if abs(g) < 1e-4:
                continue
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / p.alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
    w = weights(np.arange(size))
    keep = np.flatnonzero(w)
    return keep, w[keep]


def train(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from the rows of labels (doc_id, toxic) outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    sample = known.select("doc_id", "y", F.md5(F.col("doc_id").cast("string")).alias("at")).orderBy("at", "doc_id").limit(params.max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("at", "y", "text")  # at most max_rows ids, maybe of many rows
    bits = params.bits

    def hashed(batches):
        for batch in batches:
            h = [np.unique(features(t.as_py() or "", bits)).astype(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("y"), pa.array(h, pa.list_(pa.int32()))], ["at", "y", "h"])

    def learn(batches):
        rows = []
        for batch in batches:
            flat, ends = batch.column("h").flatten().to_numpy(), batch.column("h").offsets.to_numpy() - batch.column("h").offsets[0].as_py()
            rows += [(np.append(flat[a:b], np.int32(1 << bits)), y) for a, b, y in zip(ends, ends[1:], batch.column("y").to_pylist())]
        idx, w = ftrl(rows, params) if rows else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(idx.astype(np.int64)), pa.array(w)], ["i", "w"])

    with text_batches(docs.sparkSession):
        rows = rows.mapInArrow(tidied(hashed), "at string, y int, h array<int>").groupBy("at", "y").agg(F.min("h").alias("h"))
        fitted = rows.repartition(1).sortWithinPartitions("at").mapInArrow(tidied(learn), "i long, w double").toPandas()
    return fitted["i"].to_numpy(np.int64), fitted["w"].to_numpy(float)


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int = FtrlParams.bits, name: str = "__tox_score", keep_text: bool = True) -> DataFrame:
    """docs with the probability that a text is toxic in column ``name``, as the last; without ``text`` unless keep_text."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs have a column {name} already")
    sent = docs.sparkSession.sparkContext.broadcast((weights[0].astype(np.int32), weights[1].astype(np.float32)))

    def scorer():
        w = np.zeros((1 << bits) + 1, np.float32)
        w[sent.value[0]] = sent.value[1]
        base = float(w[-1])

        def give(texts):
            out = []
            for t in texts:
                h = features(t, bits)
                h = np.unique(h[w[h] != 0])
                out.append(float(1 / (1 + np.exp(-np.clip(base + w[h].sum(dtype=np.float64), -35, 35)))))
            return out

        return give

    return add_column(docs, name, "double", scorer, keep=keep_text)


def keep_civil(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams(), threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored under the threshold, with their own columns only."""
    name = free_prefix(docs, "__tox_") + "score"
    return score(docs, train(docs, labels, params), params.bits, name).where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_ftrl_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    scored = score(docs, train(docs, labels.select("doc_id", "toxic")), name="score", keep_text=False)
    held = F.coalesce(crc_fold(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
