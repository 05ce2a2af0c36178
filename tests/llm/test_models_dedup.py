"""Classifiers by held-out accuracy and brute force; near duplicates by brute force; the pipeline's stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import neardup, quality, toxicity
from cohortlens.llm.common import crc_fold

WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice([w.replace("w", "") + "or" for w in WORDS], 40))
        if i % 4 == 0:
            words[int(rng.integers(40))] = ["vile", "rotten", "Nasty!"][i % 3]
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, known)).join(known, "doc_id").where(crc_fold(F.col("doc_id")) == 1)
    wrong = got.where((F.col("__tox_score") >= 0.7).cast("int") != F.col("toxic")).count()
    assert got.count() > 200 and wrong <= 0.03 * got.count()


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "vile", 1), (3, "a " * 50_000, 1), (3, "b", 1)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["__tox_score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels))
    assert got.count() == 5 and got.columns == ["doc_id", "text", "toxic", "__tox_score"]
    assert all(0 <= r["__tox_score"] <= 1 for r in got.collect())
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def plain_features(text, bits):
    """The hashes of a text's features, by whole numbers."""
    import re
    import zlib

    words = [w for w in re.split(r"[\W\d_]+", text.lower()) if w]
    crc = [zlib.crc32(w.encode()) for w in words]
    out = crc + [zlib.crc32(w[:4].encode(), 4) for w in words] + [zlib.crc32(w[:6].encode(), 6) for w in words]
    out += [(a * 0x9E3779B1) % 2**32 ^ b ^ 2 for a, b in zip(crc, crc[1:])]
    out += [(a * 0x9E3779B1) % 2**32 ^ (b * 0x85EBCA6B) % 2**32 ^ 3 for a, b in zip(crc, crc[2:])]
    mixed = [(h ^ h >> 15) * 0x2C1B3C6D % 2**32 for h in out]
    return {(h ^ h >> 13) % 2**bits for h in mixed}


def plain_ftrl(rows, p):
    """The published updates, coordinate by coordinate."""
    from math import copysign, exp, sqrt

    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= p.l1 else (copysign(p.l1, zi) - zi) / ((p.beta + sqrt(n.get(i, 0.0))) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for hashes, y in rows:
            w = {i: weight(i) for i in hashes}
            g = 1 / (1 + exp(-max(-35, min(35, sum(w.values()))))) - y
            if abs(g) < 1e-4:
                continue
            for i in hashes:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (sqrt(old + g * g) - sqrt(old)) / p.alpha * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_toxicity_equals_plain_ftrl(spark):
    """Features, the order of rows, the updates and the scores, against arithmetic without arrays."""
    import hashlib
    from math import exp

    rng = np.random.default_rng(8)
    base = [f"{a}ost{b}" for a in "abcdefgh" for b in ("e", "en", "er", "ung")]
    rows = [(i, " ".join(rng.choice(base, 15)) + (" Räuber!" if i % 5 == 0 else "") + (" it's 9 x_y" if i % 7 == 0 else "")) for i in range(90)]
    labels = [(i, int(i % 5 == 0)) for i in range(0, 90, 2)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    p = toxicity.FtrlParams(bits=14, l1=0.5, epochs=3)
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", crc_fold(F.col("doc_id")).alias("f")).collect()}
    text, order = dict(rows), sorted((hashlib.md5(str(i).encode()).hexdigest(), i, y) for i, y in labels if fold[i] != 1)
    want = plain_ftrl([(sorted(plain_features(text[i], p.bits)) + [2**p.bits], y) for _, i, y in order], p)
    index, weights = toxicity.train(docs, known, p)
    assert dict(zip(index.tolist(), weights)) == pytest.approx(want, rel=1e-9)
    got = {r["doc_id"]: r["__tox_score"] for r in toxicity.score(docs, (index, weights), p.bits).collect()}
    for i, t in rows:
        x = sum(want.get(h, 0.0) for h in plain_features(t, p.bits)) + want.get(2**p.bits, 0.0)
        assert got[i] == pytest.approx(1 / (1 + exp(-x)), rel=1e-5)


def test_stages_keep_clashing_columns(spark):
    """Columns named as the operators' own are kept as they are."""
    docs = spark.createDataFrame([(1, "a fine text", "en", "s", 5.0, 6, "q"), (2, "another fine text", "en", "s", 7.0, 8, "r")], "doc_id long, text string, lang string, source string, __tox_score double, __MIX_tokens int, __qua_evidence string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    from cohortlens.llm import mixing

    for kept in (toxicity.keep_civil(docs, labels), quality.keep_good(docs, labels, F.col("source"), F.col("lang")), mixing.keep_mixture(docs, F.lit("d"), mixing.MixtureSpec(budget_percent=100)), neardup.keep_one(docs)):
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect())) and kept.columns == docs.columns
    for broken in (lambda: toxicity.score(docs, (np.zeros(0, int), np.zeros(0))), lambda: quality.score(docs, labels, F.col("source"), F.col("lang")), lambda: mixing.select_mixture(docs, F.lit("d"), mixing.MixtureSpec())):
        with pytest.raises(ValueError, match="docs have a column"):
            broken()


def test_training_takes_one_row_an_id(spark):
    """An id of many rows counts once, so what reaches the learner is bounded by max_rows."""
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(rng.choice(WORDS, 12)) + (" VILE!!" if i % 3 == 0 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(60)], "doc_id long, toxic int, quality int")
    once = spark.createDataFrame(texts, "doc_id long, text string")
    often = spark.createDataFrame(texts + texts[:20] + [texts[0]] * 200, "doc_id long, text string")
    p = toxicity.FtrlParams(bits=12, l1=0.5, epochs=2)
    (i, w), (j, v) = toxicity.train(once, labels, p), toxicity.train(often, labels, p)
    assert len(i) and i.tolist() == j.tolist() and w.tolist() == v.tolist()
    assert quality.train(once, labels).tolist() == quality.train(often, labels).tolist()


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    rows = [(np.append(rng.choice(5000, 60, replace=False), [6000] if y else []).astype(int), int(y)) for y in rng.random(2000) < 0.3]
    p = toxicity.FtrlParams(bits=13)
    idx, w = toxicity.ftrl(rows, p)
    assert 6000 in idx and w[list(idx).index(6000)] > 1 and len(idx) < 2000


def test_site_posteriors_equal_formulas(spark):
    rng = np.random.default_rng(7)
    rows = [(f"h{i % 6}", f"p{i % 4}", float(np.clip(rng.normal(0.2 + 0.1 * (i % 6), 0.1), 0.01, 0.99))) for i in range(500)] + [("lone", "p", 0.01)]
    got, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r["host"], r["path"]): (r["host_posterior"], r["path_posterior"]) for r in got.collect()}

    def strength(groups):  # [(values, prior)]
        n = np.array([len(v) for v, _ in groups], float)
        within = sum(((v - v.mean()) ** 2).sum() for v, _ in groups) / (n.sum() - len(n))
        between = sum(len(v) * (v.mean() - m) ** 2 for v, m in groups)
        tau = (between - (len(n) - 1) * within) / (n.sum() - (n**2).sum() / n.sum())
        return min(max(within / tau, 1.0), quality.ENDLESS) if tau > 1e-12 else quality.ENDLESS

    all_p = np.array([r[2] for r in rows])
    assert mean == pytest.approx(all_p.mean())
    hosts = {h: np.array([r[2] for r in rows if r[0] == h]) for h in {r[0] for r in rows}}
    k = strength([(v, all_p.mean()) for v in hosts.values()])
    post = {h: (v.sum() + k * all_p.mean()) / (len(v) + k) for h, v in hosts.items()}
    paths = {key: np.array([r[2] for r in rows if r[:2] == key]) for key in {r[:2] for r in rows}}
    kp = strength([(v, hosts[h].mean()) for (h, _), v in paths.items()])
    for key, v in paths.items():
        assert got[key][0] == pytest.approx(post[key[0]], rel=1e-9)
        assert got[key][1] == pytest.approx((v.sum() + kp * post[key[0]]) / (len(v) + kp), rel=1e-9)
    assert got["lone", "p"][1] > 0.1  # one document does not make a site


def test_quality_on_labelled_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels, F.col("source"), F.col("lang")).join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id").where(crc_fold(F.col("doc_id")) == 1)
    wrong = got.where((F.col("__qua_quality") >= 0.5).cast("int") != F.col("y")).count()
    assert got.count() > 15 and wrong <= max(1, 0.05 * got.count())


def test_quality_equals_plain_arithmetic(spark):
    """The fit is stationary, and evidence and final odds follow from it and the sites' posteriors."""
    from math import exp, log

    rng = np.random.default_rng(12)
    rows = []
    for i in range(200):
        good = i % 3 > 0
        words = rng.choice(WORDS, 30).tolist()
        rows.append((i, " ".join(words) + "." if good else "!!! " + " ".join(words[:3] * 10) + " %$#", f"s{i % 4}", ["en", "de"][i % 2]))
    labels = [(i, int(i % 3 > 0) if rng.random() > 0.1 else int(i % 3 == 0)) for i in range(0, 200, 2)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", crc_fold(F.col("doc_id")).alias("f")).collect()}
    seen = [(i, y) for i, y in labels if fold[i] != 1]
    x, y = np.array([quality.describe(rows[i][1]) for i, _ in seen]), np.array([y for _, y in seen], float)
    model = quality.train(docs, known)
    mean, sd = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    p = 1 / (1 + np.exp(-(x @ model[:-1] + model[-1])))
    assert np.abs(((x - mean) / sd).T @ (y - p) - quality.QualityParams.ridge * model[:-1] * sd).max() < 1e-6 and abs((y - p).sum()) < 1e-3
    got = {r["doc_id"]: r for r in quality.score(docs, known, F.col("source"), F.col("lang")).collect()}
    evidence = {i: min(max(1 / (1 + exp(-max(-30, min(30, float(np.dot(quality.describe(t), model[:-1]) + model[-1]))))), quality.EDGE), 1 - quality.EDGE) for i, t, _, _ in rows}
    assert {i: r["__qua_evidence"] for i, r in got.items()} == pytest.approx(evidence, rel=1e-9)
    prior, logit = sum(evidence.values()) / len(evidence), lambda v: log(v / (1 - v))
    for i, r in got.items():
        odds = logit(evidence[i]) + logit(min(max(r["__qua_path_posterior"], quality.EDGE), 1 - quality.EDGE)) - logit(prior)
        assert r["__qua_quality"] == pytest.approx(1 / (1 + exp(-odds)), rel=1e-9)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "s", "en"), (2, "x", "s", "en"), (None, "y " * 30_000, "s", None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    got = quality.score(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == 4 and {round(r["__qua_quality"], 9) for r in got} == {0.5}
    assert quality.score(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0
    assert quality.keep_good(docs, labels, F.col("source"), F.col("lang")).columns == docs.columns


def classes(rows, size, percent):
    """Connected components over all pairs."""
    sets = {i: set(neardup.shingles(t, size).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def edits(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[int(rng.integers(len(words)))] = str(rng.choice(WORDS))
    return " ".join(words)


@pytest.mark.parametrize("size, work", [(2, 64), (2, 0), (5, 0)])
def test_near_duplicates_equal_brute_force(spark, size, work, monkeypatch):
    """work 0: large nodes branch all the way, with pivots and the pass over their fringe."""
    monkeypatch.setattr(neardup, "WORK", work)
    rng = np.random.default_rng(size)
    rows, base = [], [list(rng.choice(WORDS, 80)) for _ in range(12)]
    for i in range(420):
        kind = i % 14
        rows.append((i, edits(rng, base[kind % 12], int(rng.integers(0, 7))) if kind < 12 else " ".join(rng.choice(WORDS, 60))))
    rows += [(1000 + i, edits(rng, base[0], 1)) for i in range(150)] + [(2000 + i, t) for i, t in enumerate(["", None, " \t", "one", "ONE", "one two", "é one two three"])]
    rows += [(3000 + i, rows[3][1]) for i in range(40)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, rep string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, size).collect()}
    assert got == classes(rows, size, 80)
    kept = neardup.keep_one(docs, size)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


@pytest.mark.parametrize("percent", [50, 60, 90, 95])
def test_recall_at_other_similarities(spark, percent):
    """Isolated pairs just above and just below the bound: all but one in a hundred of the former are found, none of the latter."""
    rng = np.random.default_rng(percent)
    rows, want = [], {}
    for i in range(300):
        words, n = [f"w{i}_{k}" for k in range(120)], int(round(119 * 2 * percent / (100 + percent)))
        above, below = words[: n + 2], words[: n - 3]  # 2-word shingles: n + 1 and n - 4 of 119 stay
        other = (above if i % 3 else below) + [f"x{i}_{k}" for k in range(120 - len(above if i % 3 else below))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        want[2 * i + 1] = 2 * i if i % 3 else 2 * i + 1
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 2, percent).collect()}
    true = classes(sorted((int(i), t) for i, t in rows), 2, percent)
    pairs = [i for i in want if true[i][1] != i]
    found = [i for i in pairs if got[i] == true[i][1]]
    print(f"similarity {percent}: {len(found)} of {len(pairs)} pairs")
    assert len(pairs) == 200 and len(found) >= 0.99 * len(pairs)
    assert all(got[i] == i for i in want if true[i][1] == i)


def test_members_of_crowds_keep_their_other_links(spark):
    """Sets similar to a member of a crowd but not to its centre, and crowds linked by their members only."""
    base = [f"b{k}" for k in range(200)]
    rows = [(i, " ".join(base[:100] + [f"c{i}"] + base[101:])) for i in range(60)]  # a crowd around 0
    rows += [(1000 + i, " ".join([f"d{k}" for k in range(10 + 2 * (i % 5))] + base[10 + 2 * (i % 5):])) for i in range(10)]
    rows += [(2000 + i, " ".join([f"d{k}" for k in range(28)] + base[28:190] + [f"e{i}_{k}" for k in range(10)])) for i in range(5)]
    far = [f"d{k}" for k in range(45)] + base[45:]
    rows += [(3000 + i, " ".join(far[:150] + [f"f{i}"] + far[151:])) for i in range(60)]  # another, 0.6 from the first
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 2).collect()}
    assert got == classes(rows, 2, 80)


def test_crowds_are_collapsed(spark):
    """A crowd of near copies costs a class a node in the trees, not a row a member."""
    rng = np.random.default_rng(11)
    base = list(rng.choice(WORDS, 200))
    docs = spark.createDataFrame([(i, edits(rng, base, 2)) for i in range(400)], "doc_id long, text string")
    got = neardup.near_duplicates(docs, 2).collect()
    assert {r["component_id"] for r in got} == {0}
    sets = [(r[0], neardup.shingles(r[1], 2)) for r in docs.collect()]
    marked = [(i, len(x), neardup.minwise(x).tobytes(), neardup.sketch(neardup.minwise(x)).tobytes()) for i, x in sets]
    stars = neardup.crowd_stars(spark.createDataFrame(marked, "rep long, n long, sig binary, mark binary"), neardup.Limits(80))
    assert stars.count() > 350


def test_tables_of_a_scratch_go(spark):
    from cohortlens.llm.common import materialize, path_exists, scratch

    with scratch(spark) as outer:
        with scratch(spark) as keep:
            gone, kept = (materialize(spark.range(3), f"test-{k}") for k in range(2))
            keep(kept)
        assert not path_exists(spark, gone._table_path) and kept.count() == 3
        last = materialize(spark.range(4), "test-last")
        outer(last)
    assert not path_exists(spark, kept._table_path) and last.count() == 4
    with pytest.raises(ZeroDivisionError), scratch(spark):
        lost = materialize(spark.range(1), "test-lost")
        1 / 0
    assert not path_exists(spark, lost._table_path) and materialize(spark.range(2), "test-free").count() == 2


def test_very_long_texts(spark):
    words = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-5000])), (3, " ".join(words[20_000:])), (4, "w1 w2")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_blocks_compare_everything(spark, monkeypatch):
    """Nodes that never get small are compared in a grid."""
    monkeypatch.setattr(neardup, "DEPTH", 0)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = list(rng.choice(WORDS, 100))
    rows = [(i, edits(rng, base, int(rng.integers(0, 9)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 2).collect()}
    assert got == classes(rows, 2, 80)


def test_blocks_read_only_texts_that_may_be_near(spark, monkeypatch):
    """Of a large node whose sets are mostly far from each other, only the texts of those near another one travel."""
    monkeypatch.setattr(neardup, "DEPTH", 0)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    asked, texts_of = [], neardup.texts_of
    monkeypatch.setattr(neardup, "texts_of", lambda docs, ids: asked.extend(r["doc_id"] for r in ids.distinct().collect()) or texts_of(docs, ids))
    common = [f"c{k}" for k in range(40)]
    rows = [(i, " ".join(common + [f"w{i}_{k}" for k in range(60)])) for i in range(400)]
    rows += [(1000 + i, " ".join(common + [f"w{i}_{k}" for k in range(56)] + [f"x{k}" for k in range(4)])) for i in range(0, 400, 40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == classes(rows, 2, 80) and got[1040] == (99, 40)
    assert {40, 1040} <= set(asked) and len(set(asked)) < 60


def test_nodes_are_dealt_once(spark, monkeypatch):
    """The rows of all nodes, the largest table of the join, pass one exchange for both uses."""
    plans, materialize = [], neardup.materialize

    def spy(df, tag):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, tag)

    rows = materialize(spark.range(3000).selectExpr("id % 1000 AS node", "id % 7 AS cls"), "test-nodes")
    monkeypatch.setattr(neardup, "materialize", spy)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        placed = neardup.place(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    final = plans[0].split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1 and final.count(" Exchange hashpartitioning(node") == 2  # one of them in the line of the reuse
    assert placed.count() == 3000 and {r["m"] for r in placed.collect()} == {3}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "hub long, other long")
    for one_task in (neardup.FOREST_ROWS, 0):
        got = {r["rep"]: r["label"] for r in neardup.components(links.repartition(5), one_task).collect()}
        assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, 2).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 2, True), ("None", None, True)]
    assert neardup.near_duplicates(docs.limit(0), 2).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen, columns = {"documents": docs}, docs.columns
    for name, stage in p.STAGES:
        docs = p.materialize(stage(spark, docs, sf_dir), f"test-{name}")
        seen[name] = docs
    assert len(p.STAGES) == 5 and all(seen[n].columns == columns for n, _ in p.STAGES[:-1])
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for before, after in (("documents", "quality"), ("quality", "toxicity"), ("toxicity", "near_dedup"), ("near_dedup", "mixing")):
        assert ids(seen[after]) < ids(seen[before])
    good = ids(labels.where("quality = 1 and toxic = 0"))
    assert len(good & ids(seen["toxicity"])) >= 0.98 * len(good & ids(seen["documents"]))
    rows = [(r["doc_id"], r["text"]) for r in seen["toxicity"].collect()]
    assert ids(seen["near_dedup"]) == {i for i, (_, c) in classes(rows, 5, 80).items() if i == c}
    assert ids(seen["packing"]) == ids(seen["mixing"])
    from test_chat_mixing import brute

    plain = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in seen["near_dedup"].collect()]
    domain = {r["source"]: r["d"] for r in seen["near_dedup"].select("source", p.mixing.domain_of(F.col("source")).alias("d")).distinct().collect()}
    used = brute(plain, lambda source: domain[source], p.MIXTURE)
    assert ids(seen["mixing"]) == {i for i, t, _, _ in plain if sum(used[i]) > 0 or not (t or "").split()}
    import public_tokenizers
    from tokenizers import Tokenizer

    tokens, sizes, fill = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}, {}
    for r in seen["packing"].collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sizes == {r["doc_id"]: len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1 for r in seen["mixing"].collect()}
    assert all(sum(n for _, n in spans) <= 2048 and sorted(spans)[0][0] == 0 for spans in fill.values())
    assert {tuple(r) for r in p.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect()} == {tuple(r) for r in seen["packing"].select("doc_id", "piece", "length", "ids_crc32").collect()}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names, and no rows at all."""
    import corpus_pipeline as p

    rows = [(None, None, None, None), (1, "", "en", "s"), (2, "word " * 20_000, "en", "s"), (3, "a plain text of some words", "en", "s"), (3, "a plain text of some words", "en", "s"), (3, "another text under the same id", None, "t"), (4, "a plain text of some words", "de", None), (None, "no id but a text", "en", "s")]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, source string, __tox_score double")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for some, wanted in ((docs, True), (docs.limit(0), False)):
        got = some
        for name, stage in p.STAGES:
            got = p.materialize(stage(spark, got, str(tmp_path)), f"odd-{name}")
            assert name == "packing" or got.columns == docs.columns
        kept = [r["doc_id"] for r in got.collect()]
        assert bool(kept) == wanted and (not wanted or {3, None} <= set(kept) and 4 not in kept)
