"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are quantised once to int8 codes with a scale, and the lengths of the coded vector and of what coding left over; only
these travel to the cells of the grid. The product of two tiles of codes gives every pair of a cell an approximate inner product,
and the residuals bound its error (Cauchy-Schwarz on both). A pair survives its cell if its upper bound reaches the k-th highest
lower bound there, and the merge of the cells if it reaches the k-th highest of all. Survivors alone meet the original vectors:
they are recomputed in double precision, summed in order of the dimensions, and kept in heaps of k per query. Pruning never drops
a possible member, so the lists are exact, not approximate. Of many copies of one vector a cell looks at the k + 1 smallest ids.

Defined results: see vectors.clean_vectors for what takes part. Components of any finite size may meet: where a bound overflows,
the pair is recomputed; a product that overflows itself scores as double arithmetic has it. Zero vectors take no part. Vectors
meet only those of their own length. A query's own id is never its neighbour. Ties go to the smaller vec_id; with fewer
candidates than k all are returned. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import clean_vectors, grid, merge_heaps

TILE_QUERIES, TILE_CANDIDATES = 2048, 8192
#: Queries of one product: bounds its memory.
SUB_Q = 256
#: Queries' vectors are broadcast to the survivors up to so many bytes, else joined by shuffle.
BROADCAST_BYTES = 16 << 20
CODED = "id long, same long, dim int, codes binary, scale double, coded double, rest double"


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, free of overflow and underflow of the squares."""
    most = np.abs(x).max(axis=1)
    unit = x / np.where(most > 0, most, 1)[:, None]
    return most * np.sqrt((unit * unit).sum(axis=1))


def quantise(x: np.ndarray):
    """int8 codes, scales, lengths of the coded vector and of the residual. Where the scale underflows, the codes are 0 and the
    residual is the whole vector."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(np.clip(x / np.where(scale > 0, scale, 1)[:, None], -127, 127)) * (scale > 0)[:, None]
    coded = codes * scale[:, None]
    return codes.astype(np.int8), scale, norms(coded), norms(x - coded)


def _vectors(column, rows: np.ndarray) -> np.ndarray:
    """The vectors of these rows, all of one length."""
    part = column.take(pa.array(rows))
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _code(batches):
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            codes, *figures = quantise(_vectors(batch.column("vec"), rows))
            ids = (pa.array(batch.column(c).to_numpy()[rows]) for c in ("id", "same"))
            yield pa.RecordBatch.from_arrays([*ids, pa.array(dims[rows]), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, figures)], ["id", "same", "dim", "codes", "scale", "coded", "rest"])


def bounds(q, c) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of two tiles (codes, scales, coded lengths, residual lengths)."""
    kind = np.float32 if q[0].shape[1] * 127 * 127 < 2**24 else np.float64  # a BLAS product of whole numbers that is exact
    with np.errstate(over="ignore", invalid="ignore"):
        near = (q[0].astype(kind) @ c[0].astype(kind).T).astype(np.float64) * q[1][:, None] * c[1][None, :]
        slack = q[3][:, None] * (c[2] + c[3])[None, :] + q[2][:, None] * c[3][None, :]
        slack *= 1 + 1e-9
        slack += 1e-12 * (q[2] + q[3])[:, None] * (c[2] + c[3])[None, :] + 1e-300  # rounding, and products that underflow
        low, high = near - slack, near + slack
        wild = ~(np.isfinite(near) & np.isfinite(slack))  # overflow proves nothing
    low[wild], high[wild] = -np.inf, np.inf
    return low, high


SURVIVORS = "query_id long, vec_id long, low double, high double"


def _cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def tile(table: pa.Table):
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(table.num_rows, -1)
        return table.column("id").to_numpy(), (codes, *(table.column(c).to_numpy() for c in ("scale", "coded", "rest")))

    def first_copies(table: pa.Table) -> pa.Table:
        """Of rows with one vector the k + 1 smallest ids: ties go to them, and a query may be one."""
        ids, same = (table.column(c).to_numpy() for c in ("id", "same"))
        order = np.lexsort((ids, same))
        starts = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
        return table.take(pa.array(order[place <= k]))

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = first_copies(left)
        (c_ids, c), (q_ids, q) = tile(left), tile(right)
        out = []
        for a in range(0, len(q_ids), SUB_Q):
            rows = slice(a, a + SUB_Q)
            low, high = bounds([x[rows] for x in q], c)
            own = q_ids[rows, None] == c_ids[None, :]
            low[own] = -np.inf
            floor = np.partition(low, len(c_ids) - k, axis=1)[:, len(c_ids) - k] if len(c_ids) > k else np.full(len(low), -np.inf)
            i, j = np.nonzero((high >= floor[:, None]) & ~own)
            out.append(pa.table([pa.array(q_ids[a + i]), pa.array(c_ids[j]), pa.array(low[i, j]), pa.array(high[i, j])], schema=schema))
        return pa.concat_tables(out)

    return run


def _prune(k: int):
    """A stream sorted by query and falling lower bound: the pairs whose upper bound reaches the query's k-th lower bound."""

    def run(batches):
        query, seen, floor = None, 0, -np.inf
        for batch in batches:
            q, low, high = (batch.column(c).to_numpy() for c in ("query_id", "low", "high"))
            keep = np.ones(len(q), bool)
            starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else []
            for a, b in zip(starts, [*starts[1:], len(q)]):
                if q[a] != query:
                    query, seen, floor = q[a], 0, -np.inf
                if seen < k <= seen + b - a:
                    floor = low[a + k - seen - 1]
                seen += b - a
                keep[a:b] = high[a:b] >= floor
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(batch.column("vec_id").to_numpy()[keep])], ["query_id", "vec_id"])

    return run


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order of the dimensions."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def _recompute(batches):
    for batch in batches:
        dims, scores = batch.column("dim").to_numpy(), np.zeros(batch.num_rows)
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            scores[rows] = exact(_vectors(batch.column("query"), rows), _vectors(batch.column("vec"), rows))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(scores)], ["query_id", "vec_id", "score"])


def nearest(df: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", tile_q: int = TILE_QUERIES, tile_c: int = TILE_CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score for each row of df where is_query (on column ``id``) holds."""
    rows = materialize(clean_vectors(df.select("vec_id", vector), vector, drop_zero=True), "ann-vectors")
    coded = materialize(rows.withColumn("same", F.xxhash64("vec")).mapInArrow(_code, CODED), "ann-codes")
    cand, query = grid(coded, is_query, tile_q, tile_c)
    key = ["dim", "ct", "qt"]
    cells = cand.groupBy(*key).cogroup(query.groupBy(*key)).applyInArrow(_cell(k), SURVIVORS)
    pairs = cells.repartition("query_id").sortWithinPartitions("query_id", F.desc("low")).mapInArrow(_prune(k), "query_id long, vec_id long")
    own = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    n, most = rows.where(is_query).agg(F.count("*"), F.max("dim")).first()
    own = F.broadcast(own) if n * 8 * (most or 0) <= BROADCAST_BYTES else own
    both = pairs.join(rows.withColumnRenamed("id", "vec_id"), "vec_id").join(own, "query_id")
    scored = both.select("query_id", "vec_id", "dim", "vec", "query").mapInArrow(_recompute, "query_id long, vec_id long, score double")
    return merge_heaps(scored, k, "double")


def op2_block_ann(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, 20)


ORACLE = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""
