"""SimHash fingerprints and BK-trees against plain arithmetic and all pairs."""

import re

import numpy as np
import pytest
import xxhash

from cohortlens.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(rows, radius=3):
    """rows (id, fingerprint) -> the smallest id reachable of each row, by all pairs."""
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows[:i]):
            if a is not None and b is not None and (a == b or (x ^ y).bit_count() <= radius):
                up[root(i)] = root(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[root(i)] = min(least.get(root(i), a), a)
    return [None if a is None else least[root(i)] for i, (a, _) in enumerate(rows)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near_codes(rng, n):
    """Fingerprints in balls and chains, so that every number of differing bits around the radius occurs."""
    out = [int(x) for x in rng.integers(0, 1 << 63, n // 4, dtype=np.int64)]
    while len(out) < n:
        x = out[int(rng.integers(len(out)))]
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return [int(x) for x in out]


def test_tree_finds_what_lies_within(spark):
    rng = np.random.default_rng(3)
    fps = np.unique(np.array(near_codes(rng, 700), np.uint64))
    rng.shuffle(fps)
    parent, edge = simhash.BKTree.links(fps)
    below = {}
    for k in range(1, len(fps)):  # the structure: edges are distances, and a node's children have different ones
        assert edge[k] == int(fps[k] ^ fps[parent[k]]).bit_count() and parent[k] < k
        assert below.setdefault((parent[k], edge[k]), k) == k
    asked = np.concatenate([fps[:50], rng.integers(0, 1 << 63, 50, dtype=np.int64).astype(np.uint64)])
    for radius in (0, 3, 7):
        found = {(int(q), int(k)) for qs, ks in simhash.BKTree(fps, parent, edge).within(asked, radius) for q, k in zip(qs, ks)}
        assert found == {(q, k) for q in range(len(asked)) for k in range(len(fps)) if int(asked[q] ^ fps[k]).bit_count() <= radius}


@pytest.mark.parametrize("dealing", [{}, {"shard": 16, "tree": 1 << 20}, {"shard": 8, "tree": 8}, {"shard": 8, "tree": 8, "broadcast": 0}, {"blocks": 5, "shard": 32}, {"blocks": 6, "shard": 10, "tree": 20}])
def test_links_connect_what_all_pairs_connect(spark, dealing):
    rng = np.random.default_rng(7)
    fps = near_codes(rng, 400)
    ball = [fps[0] ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)]  # 120 entries that agree on three of four pieces
    fps = sorted(set(fps + ball))
    entries = spark.createDataFrame([(signed(x), i) for i, x in enumerate(fps)], "fp long, rep long")
    links = [(r.hub, r.other) for r in simhash.fingerprint_links(entries, **dealing).collect()]
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == classes(list(enumerate(fps)))


def test_blocks_tell_entries_apart():
    assert simhash.blocks_for(10**6, 3) == 4
    assert simhash.blocks_for(10**9, 3) == 5
    assert [simhash.blocks_for(10**12, 3), simhash.blocks_for(10**12, 1)] == [6, 2]


def test_query_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, plain(r.text)) for r in docs]
    label = classes(want)
    got = simhash.op11_bk_simhash(spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == sorted((i, f"{x:016x}", c) for (i, x), c in zip(want, label))
    assert sum(c != i for (i, _), c in zip(want, label)) > 5


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(5, None), (3, ""), (9, " \t\r\n"), (None, "a b c d"), (7, "a b c d"), (2, "A B\u000bC d"), (2, "A B\u000bC d"), (11, "Ä b"), (12, "ä b"), (13, "word"), (14, long), (15, long + " end"), (16, "a b c"), (4, "quite another text of words"), (4, "and yet another text of other words here")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, fp int, component_id string, label string")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    want = [(i, plain(t)) for i, t in rows]
    assert got == sorted(((i, x, c) for (i, x), c in zip(want, classes(want))), key=repr)
    assert {c for i, _, c in got if i in (3, 5, 9)} == {3} and {c for i, _, c in got if i in (7, 2)} == {2}
    assert {c for i, _, c in got if i in (14, 15)} == {14} and {c for i, _, c in got if i == 4} == {4}
    assert simhash.near_duplicates(df.limit(0)).collect() == []
