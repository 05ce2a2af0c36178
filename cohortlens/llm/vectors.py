"""Block layout and merging shared by the two vector searches.

Queries and candidates are cut into tiles by a hash of their ids, and each pair of tiles is one cell of a grid. Tile
numbers grow with the counted rows, so a cell holds a bounded number of vectors at any size of input; a tile of either
side is sent once to each cell of its row or column, which is the communication of a blocked matrix product. Nothing is
broadcast or gathered.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "query_id long, rank int, vec_id long, score {}"


def clean_vectors(df: DataFrame, vector: str, drop_zero: bool) -> DataFrame:
    """id, vec (array<double>): rows with an id and a vector without null or non-finite components (and not all zero,
    if drop_zero). Rows repeated exactly count once; of different vectors with one id the smallest is taken."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.where(F.forall(F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if drop_zero:
        rows = rows.where(F.exists(F.col("vec"), lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def grid(rows: DataFrame, is_query: Column, tile_q: int, tile_c: int) -> tuple[DataFrame, DataFrame]:
    """(candidates, queries), each with the columns of rows (id among them) and the cell's numbers ct and qt."""
    n, n_q = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    cts, qts = max(1, -(-n // tile_c)), max(1, -(-n_q // tile_q))
    ct, qt = F.pmod(F.xxhash64("id"), F.lit(cts)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(qts)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cand = rows.select("*", ct.alias("ct"), every(qts).alias("qt"))
    query = rows.where(is_query).select("*", qt.alias("qt"), every(cts).alias("ct"))
    return cand, query


def matrix(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.asarray(flat, dtype=dtype).reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 1), dtype)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, highest first, ties to the smaller id."""
    return np.lexsort((ids, ~scores if scores.dtype.kind == "i" else -scores))[:k]  # the least long has no negative


def merge_heaps(partial: DataFrame, k: int, score_type: str) -> DataFrame:
    """The k best per query of the cells' partial lists: query_id, vec_id, score. A stream over rows sorted by query
    keeps one heap of k at a time."""

    def merge(batches):
        heap, now = [], None

        def done():
            out = sorted(heap, key=lambda x: (-x[0], -x[1]))
            return pd.DataFrame({"query_id": [now] * len(out), "rank": np.arange(1, len(out) + 1, dtype=np.int32), "vec_id": [-x[1] for x in out], "score": [x[0] for x in out]})

        for pdf in batches:
            out = []
            for q, v, s in zip(pdf["query_id"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist()):
                if q != now:
                    if heap:
                        out.append(done())
                    heap, now = [], q
                item = (s, -v)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if out:
                yield pd.concat(out)
        if heap:
            yield done()

    return partial.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(merge, RESULT.format(score_type))


def search(rows: DataFrame, is_query: Column, cell, k: int, dtype, score_type: str, tile_q: int, tile_c: int) -> DataFrame:
    """cell(query ids, query matrix, candidate ids, candidate matrix) -> (query ids, candidate ids, scores), at most k a
    query and exact."""
    cand, query = grid(rows, is_query, tile_q, tile_c)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64() if score_type == "double" else pa.int64())])

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        return pa.table(list(cell(*matrix(right, dtype), *matrix(left, dtype))), schema=schema)

    key = ["dim", "ct", "qt"]
    cells = cand.groupBy(*key).cogroup(query.groupBy(*key)).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    return merge_heaps(cells, k, score_type)
