"""TPUT against scores of all documents by plain arithmetic."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import tput

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """docs [(doc_id, text)], items {item_id: set of terms} -> sorted rows of the answer."""
    bags = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, length = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, asked in items.items():
        scored = []
        for doc_id, bag, size in bags:
            m = 100 - 90 + 90 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in asked if t in bag)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def study(spark, docs, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, row int"), spark.createDataFrame(items, "item_id long, text string")


def corpus(rng, n):
    names = [f"{a}{b}" for a in "bcdfghklmn" for b in "aeiouäé"]
    share = np.array([1 / (k + 1) for k in range(len(names))])
    texts = [" ".join(rng.choice(names, int(rng.integers(1, 60)), p=share / share.sum())) for _ in range(n)]
    return list(enumerate(texts)), names


@pytest.mark.parametrize("how", [{}, {"term_limit": 3, "broadcast": 0}])
def test_search_equals_all_scores(spark, how):
    rng = np.random.default_rng(11)
    docs, names = corpus(rng, 400)
    docs += [(1000 + i, docs[i % 5][1]) for i in range(60)]  # ties at the ends of the ranks
    items = [(i, " ".join(rng.choice(names, int(rng.integers(1, 9)))).upper()) for i in range(25)] + [(90, "ba"), (91, "mé mé bä unknown")]
    want = plain(docs, {i: set(words(t)) for i, t in items}, 10)
    assert rows(tput.search(*study(spark, docs, items), **how)) == want


def test_threshold_spares_most_postings(spark):
    """Phase 2 fetches fewer postings than the lists hold, and no document of the answer is lost by it."""
    rng = np.random.default_rng(5)
    docs, names = corpus(rng, 600)
    rare = [f"rare{k}" for k in range(12)]
    docs = [(i, f"{t} {rare[i % 12]}" if i % 5 == 0 else t) for i, t in docs] + [(5000, " ".join(rare))]
    seen, fetch = [], tput.fetch

    def counted(postings, asked, *rest):
        seen.append((postings.join(asked, "term_id").count(), postings.join(asked, "term_id").where("impact >= least").count()))
        return fetch(postings, asked, *rest)

    tput.fetch = counted
    try:
        got = rows(tput.search(*study(spark, docs, [(1, " ".join(rare + names[:4]))]), k=1))
    finally:
        tput.fetch = fetch
    assert [r[2] for r in got] == [5000]
    assert seen[0][1] < seen[0][0] / 2


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5003}" for i in range(150_000))
    docs = [(1, None), (2, ""), (3, "!? \x00 _"), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (5, "ALPHA, İ beta-Ähre"), (6, long), (7, "x"), (8, "común")]
    items = [(1, "Alpha beta"), (1, "Ähre"), (2, None), (3, "..."), (None, "alpha"), (4, "w17 w4000 nowhere"), (5, "común İ")]
    want = plain(docs, {1: {"alpha", "beta", "Ähre"}, 4: {"w17", "w4000", "nowhere"}, 5: {"común", "İ"}}, 10)
    assert rows(tput.search(*study(spark, docs, items))) == want
    assert [r[2] for r in want if r[0] == 1] == [5, 4, 4, None]
    some, asks = study(spark, docs, items)
    assert rows(tput.search(some.limit(0), asks)) == rows(tput.search(some, asks.limit(0))) == rows(tput.search(some, asks.where("item_id = 3"))) == []


def test_terms_of_all_documents_weigh_nothing(spark):
    docs = [(i, "same words") for i in range(12)]
    assert rows(tput.search(*study(spark, docs, [(1, "same")]))) == plain(docs, {1: {"same"}}, 10)
