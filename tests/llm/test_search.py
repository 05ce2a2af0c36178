"""Both vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import ann, impact

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "clash") for i, v in zip(ids, vectors)], SCHEMA)


def answer(ids, vectors, queries, k, integer):
    out = []
    for q in queries:
        scored = []
        for i, v in zip(ids, vectors):
            if i != q[0] and len(v) == len(q[1]):
                if integer:
                    s = int(np.floor(1024 * np.float32(q[1]).astype(float)).astype(np.int64) @ np.floor(1024 * np.float32(v).astype(float)).astype(np.int64))
                else:
                    s = 0.0
                    for a, b in zip(np.float32(q[1]).astype(float), np.float32(v).astype(float)):
                        s += a * b
                scored.append((-s, i))
        out += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("tiles", [(2048, 8192), (7, 31)])
@pytest.mark.parametrize("integer", [False, True])
def test_search_is_exact(spark, tiles, integer):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 12))
    vectors[50:120] = vectors[50]  # ties
    ids = list(range(300))
    k = 10 if integer else 20
    queries = [(i, vectors[i]) for i in ids if i % 20 == 0]
    run = impact.top_scores if integer else ann.nearest
    got = rows(run(frame(spark, ids, vectors), F.col("id") % 20 == 0, k, tile_q=tiles[0], tile_c=tiles[1]))
    assert got == answer(ids, vectors, queries, k, integer)


@pytest.mark.parametrize("run", [ann.nearest, impact.top_scores])
def test_odd_vectors(spark, run):
    ids = [0, 1, 2, 3, 4, 5, 6, None, 8, 8, 9]
    vectors = [[1, 2], [2, 1], None, [1, None], [float("nan"), 1], [float("inf"), 0], [0, 0], [1, 1], [3, 3], [3, 3], [1, 2, 3]]
    got = rows(run(frame(spark, ids, vectors), F.col("id") == 0, 5))
    takes_zero = run is impact.top_scores
    assert [r[2] for r in got] == ([8, 1, 6] if takes_zero else [8, 1])  # id 9 has another length, 8 counts once
    assert rows(run(frame(spark, [], []), F.col("id") == 0, 5)) == []
    assert rows(run(frame(spark, [0], [[1, 1]]), F.col("id") == 0, 5)) == []


def test_bounds_hold_for_extreme_scales(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(540, 9)) * 10.0 ** rng.integers(-12, 12, (540, 1))
    low, high = ann.bounds(ann.quantise(v[:40]), ann.quantise(v[40:]))
    true = np.array([ann.exact(np.repeat(v[i:i + 1], 500, axis=0), v[40:]) for i in range(40)])
    assert (low <= true).all() and (true <= high).all()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for q, _, _, s in rows(ann.nearest(df, F.col("id") < 40, 5, tile_c=100)):
        got.setdefault(q, []).append(s)
    for i in range(40):
        every = np.delete(ann.exact(np.repeat(v[i:i + 1], 540, axis=0), v), i)
        assert got[i] == np.sort(every)[::-1][:5].tolist()


def test_tiny_and_huge_components(spark):
    """A scale that underflows proves nothing, and neither does a bound that overflows."""
    ids = [0, 1, 2, 3, 4]
    vectors = [[5e-324, 0.0], [1e300, 1.0], [2e300, 1.0], [1e-310, 0.0], [-1e300, 0.0]]
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")
    got = rows(ann.nearest(df, F.col("id") == 0, 3))
    assert got == [(0, 1, 2, 5e-324 * 2e300), (0, 2, 1, 5e-324 * 1e300), (0, 3, 3, 0.0)]
    assert [r[2] for r in rows(ann.nearest(df, F.col("id") == 2, 4))] == [1, 3, 0, 4]


def test_scores_beyond_a_long_are_its_ends(spark):
    df = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 1.0]), (2, [-1e17, 1.0]), (3, [1.0, 1.0]), (4, [1e13, 0.0])], "vec_id long, embedding array<double>")
    top, least = 2**63 - 1, -(2**63)
    assert rows(impact.top_scores(df, F.col("id") == 0, 4)) == [(0, 1, 1, top), (0, 2, 3, top), (0, 3, 4, top), (0, 4, 2, least)]  # ties go to the smaller id
    assert rows(impact.top_scores(df, F.col("id") == 0, 1)) == [(0, 1, 1, top)]
    assert rows(impact.top_scores(df, F.col("id") == 3, 4))[:2] == [(3, 1, 0, top), (3, 2, 1, top)]


def test_large_integers_stay_exact(spark):
    """Sums beyond what doubles hold are rescored in integers."""
    rng = np.random.default_rng(5)
    vectors = np.rint(rng.normal(size=(80, 3)) * 2**18) + rng.integers(0, 3, (80, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = [[int(x) * 1024 for x in v] for v in vectors]
    assert max(abs(x) for v in whole for x in v) ** 2 > 2**55
    want = []
    for q in (0, 40):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(80) if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert rows(impact.top_scores(df, F.col("id") % 40 == 0, 5)) == want
