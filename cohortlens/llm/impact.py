"""Exact top-k by an impact-ordered index, processed score at a time.

Components become integers (floor(scale * x)). A tile of candidates is indexed as posting segments: for every
dimension and sign the candidates whose magnitude falls in one impact level (the magnitude without its low ``SHIFT``
bits). Segments are processed in descending order of impact over all dimensions, adding query weight times impact to the
accumulators of their postings; those of one level are spread over a block and added by one product for a batch of queries. Every accumulator has a proven interval: a processed posting is off by at most
half a level's width, and an unprocessed dimension contributes at most its weight times the largest impact left. After
each level a query stops if the k-th highest lower bound proves that only k candidates can be members, or once all
segments are in; the possible members are rescored exactly from the integers. So the result is exact whenever it stops.

Intervals are in doubles, widened by their rounding where sums may pass 2**52; scores are rescored in 64-bit integers, or in
Python's where those could overflow.

Defined results: see vectors.clean_vectors for what takes part; zero vectors do. A component beyond a long counts as the nearest
long (from 2**53 on it is a multiple of its double's spacing), and a score beyond a long is given, and ordered, as the nearest long. Vectors meet only those of their own
length. A query's own id is never returned. Ties go to the smaller vec_id; with fewer candidates than k all are
returned. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best, clean_vectors, search

TILE_QUERIES, TILE_CANDIDATES = 1024, 4096
#: Queries whose accumulators are held at once.
BATCH = 128
SCALE = 1024
LEVELS = 16


def segments(c: np.ndarray, shift: int):
    """[(impact level, candidates, dimensions, signs)] by descending level: the posting segments of a level, one for each dimension and
    sign, behind one another. Level 0 has none (magnitudes under 1 << shift stay in the bounds)."""
    level = np.abs(c) >> shift
    rows, dims = np.nonzero(level)
    at, sign = level[rows, dims], np.sign(c[rows, dims])
    order = np.lexsort((rows, -sign, dims, -at))
    rows, dims, at, sign = rows[order], dims[order], at[order], sign[order].astype(np.float64)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else []
    return [(int(at[i]), rows[i:j], dims[i:j], sign[i:j]) for i, j in zip(cuts, cuts[1:])]


def rescore(c: np.ndarray, q: np.ndarray, fits: bool) -> np.ndarray:
    """Inner products of the rows of c with q as longs, where they fit; else beyond a long the nearest one."""
    if fits:
        return c @ q
    wide = c.astype(object) @ q.astype(object)
    return np.array([min(max(int(v), -(2**63)), 2**63 - 1) for v in wide], np.int64)


def cell_top(k: int):
    def cell(q_ids, q, c_ids, c):
        c, q = np.maximum(c, -(2**63) + 1), np.maximum(q, -(2**63) + 1)  # so that magnitudes are longs
        most = max(1, int(np.abs(c).max()))
        shift = max(0, most.bit_length() - LEVELS.bit_length() + 1)
        index = segments(c, shift)
        width = 1 << shift
        found_q, found_c, found_s = [], [], []
        for a in range(0, len(q), BATCH):
            open_q = np.arange(a, min(a + BATCH, len(q)))
            weight = q[open_q].astype(np.float64)
            total = np.abs(weight).sum(axis=1)
            acc, seen = np.zeros((len(open_q), len(c))), np.zeros((len(open_q), len(c)))
            at = 0
            while len(open_q):
                if at < len(index):
                    level, rows, dims, sign = index[at]
                    posted = np.zeros(c.shape[::-1])
                    posted[dims, rows] = sign
                    acc += (weight * (level * width + (width - 1) / 2)) @ posted
                    seen += np.abs(weight) @ np.abs(posted, out=posted)
                    at += 1
                left = (index[at][0] + 1) * width - 1 if at < len(index) else width - 1
                # (width - 1) / 2 for what is processed, at most left for the rest
                gap = seen * ((width - 1) / 2 - left) + (total * left + np.where(total * most < 2**52, 0.0, total * most * 1e-12))[:, None]
                low, high = acc - gap, acc + gap
                if (total * most).max() >= 2.0**63:
                    low, high = (np.clip(x, -(2.0**63), 2.0**63) for x in (low, high))
                own = np.minimum(np.searchsorted(c_ids, q_ids[open_q]), len(c) - 1)
                mine = np.flatnonzero(c_ids[own] == q_ids[open_q])
                low[mine, own[mine]] = high[mine, own[mine]] = -np.inf
                floor = np.partition(low, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(open_q), -np.inf)
                live = (high >= floor[:, None]) & (high > -np.inf)
                stop = (live.sum(axis=1) <= k) | (at >= len(index))
                for i in np.flatnonzero(stop):
                    rows = np.flatnonzero(live[i])
                    scores = rescore(c[rows], q[open_q[i]], most * total[i] < 2.0**62)
                    top = best(scores, c_ids[rows], k)
                    found_q.append(np.full(len(top), q_ids[open_q[i]]))
                    found_c.append(c_ids[rows[top]])
                    found_s.append(scores[top])
                open_q, weight, total, acc, seen = (x[~stop] for x in (open_q, weight, total, acc, seen))
        return np.concatenate(found_q), np.concatenate(found_c), np.concatenate(found_s)

    return cell


def top_scores(df: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", scale: int = SCALE, tile_q: int = TILE_QUERIES, tile_c: int = TILE_CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score (integer) for each row of df where is_query (on column ``id``) holds."""
    rows = clean_vectors(df.select("vec_id", vector), vector, drop_zero=False)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(F.lit(scale) * x).cast("long")))
    return search(rows, is_query, cell_top(k), k, np.int64, "long", tile_q, tile_c)


def op3_impact_topk(spark, sf_dir):
    return top_scores(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, 10)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
