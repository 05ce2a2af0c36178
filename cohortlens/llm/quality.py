"""Quality by hierarchical empirical Bayes over sites.

Evidence of a document is the probability of good quality that a logistic regression gives to shares and repetition in
its text, fitted on at most ``max_rows`` labelled rows. Grouped aggregation sums the evidence by host and by path; the
method of moments gives the variance between hosts around the global mean, and between paths around their hosts, and so
the number of documents at which a site's own mean and its prior weigh the same. Hosts shrink toward the global mean,
paths toward their host's posterior. The final quality of a document replaces the global prior in its evidence's odds by
its path's posterior; sparse sites hardly move it.

Only counts and sums per site are shuffled. The table of sites is broadcast if its counted rows are few, else joined
by shuffle with adaptive splitting of skewed sites. Texts go through Python once, where they lie; the rows are written with
their evidence, which sites are summed from and their posteriors joined to.

Defined results. Null or empty text: features of ''. Null host or path: ''. Labels: of several for one doc_id the
smallest counts; null labels are ignored; without labels of both classes the evidence is 0.5 throughout. Of documents that
share a doc_id, that whose features come first is fitted on; all are scored and count in their site. Empty tables give no rows. Other columns stay as they are.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_column, broadcast_if_small, crc_fold, free_prefix, materialize, text_batches

CLASSES = (b"!", b"%$&*#@^~+=<>{}[]\\/_", b"|", b".,;:?'\"-()", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" ", b"\n")
EDGE = 1e-3
ENDLESS = 1e9


@dataclass(frozen=True)
class QualityParams:
    """max_rows bounds the labelled rows that the evidence is fitted on; min_quality is the least quality to accept."""

    max_rows: int = 20_000
    ridge: float = 1.0
    min_quality: float = 0.5


def describe(text: str) -> list[float]:
    """Shares of character classes, and repetition of words and lines, on a logarithmic scale."""
    data = text.encode()
    n = len(data) or 1
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = [hist[list(c)].sum() / n for c in CLASSES]
    upper = sum(map(str.isupper, text)) / max(1, len(text)) if data and shares[5] > 0.02 else shares[5]
    words = text.split()
    k = len(words) or 1
    top = max(Counter(words).values(), default=0)
    lines = text.split("\n")
    same = 1 - len(set(lines)) / len(lines)
    distinct = len(set(words)) / k
    return [*(float(np.log1p(50 * s)) for s in shares), float(np.log1p(50 * upper)), float(np.log1p(k)), top / k, distinct, float(np.log1p(20 * same)), min(len(text) / k, 40.0) / 10]


def fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients (intercept last) of a ridge logistic regression on standardised features, folded back to raw ones."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    a = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    b, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    raw = b[:-1] / sd
    return np.append(raw, b[-1] - raw @ mean)


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> np.ndarray | None:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(params.max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", F.md5(F.col("doc_id").cast("string")).alias("at"), "text")  # at most max_rows ids, maybe of many rows
    described = add_column(rows, "x", "double[]", lambda: lambda texts: [describe(t) for t in texts], keep=False)
    got = described.groupBy("at", "y").agg(F.min("x").alias("x")).toPandas().sort_values("at")
    if got["y"].nunique() < 2:
        return None
    return fit(np.array(got["x"].tolist(), dtype=float), got["y"].to_numpy(float), params.ridge)


def evidence(docs: DataFrame, model: np.ndarray | None, name: str = "__qua_evidence", keep_text: bool = True) -> DataFrame:
    coef = None if model is None else [float(v) for v in model]

    def scorer():
        def give(texts):
            if coef is None:
                return [0.5] * len(texts)
            x = np.array([describe(t) for t in texts], dtype=float).reshape(len(texts), -1)
            logits = np.zeros(len(texts)) + coef[-1]
            for j in range(x.shape[1]):
                logits += x[:, j] * coef[j]
            return np.clip(1 / (1 + np.exp(-np.clip(logits, -30, 30))), EDGE, 1 - EDGE).tolist()

        return give

    return add_column(docs, name, "double", scorer, keep=keep_text)


def _strength(groups: DataFrame, prior: Column) -> float:
    """How many documents a prior is worth: variance within over variance between groups (n, s, ss) around ``prior``."""
    r = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - prior) ** 2).alias("between"), F.sum(F.col("n").cast("double") ** 2).alias("nn"),
    ).first()
    if not r["n"] or r["n"] <= r["k"] or r["k"] < 2:
        return ENDLESS
    sigma = max(r["within"], 0.0) / (r["n"] - r["k"])
    tau = (r["between"] - (r["k"] - 1) * sigma) / (r["n"] - r["nn"] / r["n"])
    return float(min(max(sigma / tau, 1.0), ENDLESS)) if tau > 1e-12 and sigma > 0 else ENDLESS


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """rows: host, path, p. Returns (host, path, host_posterior, path_posterior) and the global mean."""
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total["s"] / total["n"] if total["n"] else 0.5
    k = _strength(hosts, F.lit(mean))
    hosts = hosts.select("host", ((F.col("s") + F.lit(k * mean)) / (F.col("n") + F.lit(k))).alias("host_posterior"), (F.col("s") / F.col("n")).alias("host_mean"))
    both = paths.join(hosts, "host")
    k = _strength(both, F.col("host_mean"))
    return both.select("host", "path", "host_posterior", ((F.col("s") + F.lit(k) * F.col("host_posterior")) / (F.col("n") + F.lit(k))).alias("path_posterior")), mean


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, params: QualityParams = QualityParams(), prefix: str = "__qua_", keep_text: bool = True) -> DataFrame:
    """docs, without ``text`` unless keep_text, with host, path, evidence, host_posterior, path_posterior and quality, each behind the prefix,
    which no column of docs may have. Texts go through Python once: what is returned is written with its evidence."""
    if free_prefix(docs, prefix) != prefix:
        raise ValueError(f"docs have a column that begins with {prefix}")
    model = train(docs, labels, params)
    h, p, e = (prefix + n for n in ("host", "path", "evidence"))
    sited = docs.withColumns({h: F.coalesce(host.cast("string"), F.lit("")), p: F.coalesce(path.cast("string"), F.lit(""))})
    with text_batches(docs.sparkSession):
        rows = materialize(evidence(sited, model, e, keep_text), "quality-evidence")
    sites, mean = site_posteriors(rows.select(F.col(h).alias("host"), F.col(p).alias("path"), F.col(e).alias("p")))
    sites = materialize(sites.select(*[F.col(c).alias(prefix + c) for c in ("host", "path", "host_posterior", "path_posterior")]), "quality-sites")
    rows = rows.join(broadcast_if_small(sites, sites.count()), [h, p])
    logit = lambda c: F.log(c / (1 - c))
    safe = lambda c: F.least(F.greatest(c, F.lit(EDGE)), F.lit(1 - EDGE))
    odds = logit(F.col(e)) + logit(safe(F.col(prefix + "path_posterior"))) - logit(safe(F.lit(mean)))
    return rows.withColumn(prefix + "quality", 1 / (1 + F.exp(-odds)))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, params: QualityParams = QualityParams()) -> DataFrame:
    """The documents accepted, with their own columns only."""
    prefix = free_prefix(docs, "__qua_")
    return score(docs, labels, host, path, params, prefix).where(F.col(prefix + "quality") >= params.min_quality).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_site_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text", "source", "lang"), labels.select("doc_id", "quality"), F.col("source"), F.col("lang"), keep_text=False)
    names = {"__qua_host": "host", "__qua_path": "path", "__qua_evidence": "evidence", "__qua_host_posterior": "host_posterior", "__qua_path_posterior": "path_posterior", "__qua_quality": "quality"}
    return scored.select("doc_id", *[F.col(k).alias(v) for k, v in names.items()], (F.col("__qua_quality") >= QualityParams.min_quality).alias("accepted"))
