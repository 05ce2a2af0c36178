"""Preference formatting and mixing against small known answers and brute force."""

import hashlib

from pyspark.sql import functions as F

from cohortlens.llm import chat, mixing

TURNS = "pair_id long, turn long, role string, text string, prompt string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TURNS)


def test_common_prefix_is_rendered_once(spark):
    c = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "fine")])
    r = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "no")])
    (row,) = chat.format_preferences(c, r).collect()
    assert row["n_common"] == 1
    assert row["prompt"] == "<|user|>\nhi<|end|>\n"
    assert row["rejected"] == "<|assistant|>\nno<|end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in row["chosen_spans"].split(";")]
    assert [row["chosen"][a:a + n] for a, n in spans] == ["yes<|end|>\n", "fine<|end|>\n"]


def test_odd_rows_have_defined_results(spark):
    c = turns(spark, [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "only chosen"), (3, 0, "user", "same"), (4, 0, "a", "t"), (4, 0, "b", "t")])
    r = turns(spark, [(1, None, None, None), (1, 0, "user", "a"), (3, 0, "user", "same"), (4, 0, "b", "t"), (4, 0, "a", "t")])
    got = {x["pair_id"]: x for x in chat.format_preferences(c, r).collect() if x["n_common"] or x["chosen"] or x["rejected"]}
    assert set(got) == {1, 3, 4}
    assert sum(x["n_common"] for x in chat.format_preferences(c, r).where("pair_id = 1").collect()) == 2
    assert got[3]["chosen"] == got[3]["rejected"] == "" and got[3]["chosen_spans"] == ""
    assert got[4]["n_common"] == 2  # tied turn numbers agree as a whole, in any order


def test_a_pair_is_one_row_however_its_turns_are_numbered(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} " + "x" * 5000) for t in range(0, 600_000, 1000)]
    c, r = turns(spark, rows), turns(spark, rows[:-1] + [(1, 599_000, "assistant", "other")])
    (got,) = chat.format_preferences(c, r).collect()
    render = lambda some: "".join(f"<|{role}|>\n{text}<|end|>\n" for _, _, role, text in some)
    assert (got["part"], got["n_common"]) == (0, 599)
    assert got["prompt"] == render(rows[:-1]) and got["chosen"] == render(rows[-1:]) and got["rejected"] == "<|assistant|>\nother<|end|>\n"


def test_pairs_beyond_the_bound_come_in_parts(spark):
    """Parts hold about part_turns turns of both sides each, by position; no turn is lost."""
    rows = [(1, t, "user", f"text {t}") for t in range(0, 300_000, 300)]
    got = sorted(chat.format_preferences(turns(spark, rows), turns(spark, rows[:-1]), part_turns=500).collect(), key=lambda x: x["part"])
    assert [x["part"] for x in got] == [0, 1, 2, 3] and [x["n_common"] for x in got] == [250, 250, 250, 249]
    assert "".join(x["prompt"] for x in got) == "".join(f"<|user|>\n{t}<|end|>\n" for _, _, _, t in rows[:-1])
    assert got[3]["chosen"] == "<|user|>\ntext 299700<|end|>\n" and got[3]["rejected"] == ""


def test_every_answered_conversation_gives_a_pair(spark):
    """The next conversation with an answer, whatever the gap; the last takes the first's; repeated rows change nothing."""
    conv = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (5, 0, "user", "none"), (9, 0, "user", "q9"), (9, 1, "assistant", "a9"), (9, 2, "assistant", "b9"), (10**15, 4, "assistant", "far"), (None, 0, "assistant", "x"), (1, None, "assistant", "x")]
    df = spark.createDataFrame(conv * 2, "conv_id long, turn int, role string, text string")
    got = {r["pair_id"]: (r["prompt"], r["rejected"]) for r in chat.format_preferences(*chat.preference_sides(df)).collect()}
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got == {1: (say("user", "q1"), say("assistant", "a9")), 9: (say("user", "q9") + say("assistant", "a9"), say("assistant", "far")), 10**15: ("", say("assistant", "a1"))}


def test_pairs_of_sparse_ids_equal_sql(spark, sf_dir):
    import duckdb

    rows = [(k, t, role, f"{role} {k}.{t}") for k in (-5, 7, 8, 900, 2**61) for t, role in enumerate(("user", "assistant", "user", "assistant"))] + [(9, 0, "user", "alone")]
    got = {r["pair_id"]: r["rejected"] for r in chat.format_preferences(*chat.preference_sides(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    follows = {-5: 7, 7: 8, 8: 900, 900: 2**61, 2**61: -5}
    assert got == {k: f"<|assistant|>\nassistant {n}.1<|end|>\n" for k, n in follows.items()}
    none = spark.createDataFrame(rows[-1:], "conv_id long, turn long, role string, text string")
    assert chat.format_preferences(*chat.preference_sides(none)).isEmpty()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet' WHERE conv_id % 3 <> 1")  # gaps
    sparse = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id % 3 != 1")
    df = chat.format_preferences(*chat.preference_sides(sparse))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({chat.ORACLE})").fetchall())
    assert df.select("pair_id").distinct().count() == sparse.where("role = 'assistant'").select("conv_id").distinct().count()


def test_empty_tables(spark):
    none = turns(spark, [])
    assert chat.format_preferences(none, none).count() == 0


DOCS = "doc_id long, text string, lang string, source string, budget string, epochs int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], DOCS)


def brute(rows, domain, spec):
    """Water-filling by repeated proportional shares, then the prefix of the seeded epoch."""
    size = lambda t: len((t or "").split())
    leaf = lambda r: (domain(r[3]), r[2] or "", r[3] or "")
    tokens = {}
    for r in rows:
        tokens[leaf(r)] = tokens.get(leaf(r), 0) + size(r[1])
    weight = lambda level, name: spec.weights.get(level, {}).get(name, spec.default_weight)

    def fill(budget, kids):  # {name: (cap, weight)}
        out, left, open_ = {}, budget, dict(kids)
        while open_:
            total = sum(w for _, w in open_.values())
            full = [k for k, (c, w) in open_.items() if c * total <= left * w]
            if not full:
                return out | {k: left * w // total for k, (c, w) in open_.items()}
            for k in full:
                out[k] = open_.pop(k)[0]
                left -= out[k]
        return out

    cap = {k: t * spec.max_epochs for k, t in tokens.items()}
    group = lambda keys, n: {k[:n]: sum(v for q, v in cap.items() if q[:n] == k[:n]) for k in keys}
    budget = {(): min(sum(tokens.values()) * spec.budget_percent // 100, sum(cap.values()))}
    for n, level in ((1, "domain"), (2, "lang"), (3, "source")):
        caps, nxt = group(cap, n), {}
        for parent, b in budget.items():
            kids = {k: (c, weight(level, k[-1])) for k, c in caps.items() if k[:-1] == parent}
            nxt |= fill(b, kids)
        budget = nxt
    out = {}
    for k, b in budget.items():
        own = [r for r in rows if leaf(r) == k]
        epochs = b // tokens[k] if tokens[k] else 0
        left = b - epochs * tokens[k]
        for r in sorted(own, key=lambda r: hashlib.md5(f"{spec.seed}:{epochs}:{r[0]}".encode()).hexdigest()):
            take = max(0, min(size(r[1]), left))
            left -= take
            out[r[0]] = (epochs, take)
    return out


def test_mixture_equals_brute_force(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ["en", "de"][i % 2], f"s{i % 5}" if i % 3 else "s0") for i in range(200)]
    names = {f"s{i}": "x" if i < 3 else "y" for i in range(5)}
    spec = mixing.MixtureSpec(weights={"domain": {"x": 1, "y": 9}, "lang": {"en": 3}, "source": {"s4": 5}}, budget_percent=70, max_epochs=2)
    domain = F.when(F.col("source").isin("s0", "s1", "s2"), "x").otherwise("y")
    got = mixing.select_mixture(docs(spark, rows), domain, spec)
    assert {r["doc_id"]: (r["__mix_epochs"], r["__mix_prefix"]) for r in got.collect()} == brute(rows, names.get, spec)
    assert {"budget", "epochs"} <= set(got.columns)


def test_shortage_goes_to_siblings_first(spark):
    rows = [(1, "a " * 10, "en", "small"), (2, "b " * 1000, "en", "large"), (3, "c " * 1000, "de", "other")]
    spec = mixing.MixtureSpec(budget_percent=50, max_epochs=1)
    got = {r["doc_id"]: r["__mix_epochs"] * r["__mix_tokens"] + r["__mix_prefix"] for r in mixing.select_mixture(docs(spark, rows), F.lit("d"), spec).collect()}
    assert got == {1: 10, 2: 492, 3: 502}  # 1005 tokens, half a language; the sibling takes what "small" lacks


def test_mixture_of_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "one", "en", "s"), (3, "one", "en", "s"), (None, "x y", "en", "s"), (5, "w " * 50_000, "en", "s")]
    got = mixing.select_mixture(docs(spark, rows), F.lit(None).cast("string"), mixing.MixtureSpec(budget_percent=100, max_epochs=1)).collect()
    assert len(got) == 6 and sum(r["__mix_epochs"] * r["__mix_tokens"] + r["__mix_prefix"] for r in got) == 50_004
    assert mixing.select_mixture(docs(spark, []), F.lit("d"), mixing.MixtureSpec()).count() == 0
    kept = mixing.keep_mixture(docs(spark, rows), F.lit("d"), mixing.MixtureSpec(budget_percent=100, max_epochs=1))
    assert kept.columns == docs(spark, rows).columns and kept.count() == 6


def test_zero_weight_excludes(spark):
    rows = [(1, "a b c d", "en", "s"), (2, "a b c d", "de", "s")]
    spec = mixing.MixtureSpec(weights={"lang": {"de": 0}}, budget_percent=100, max_epochs=2)
    got = {r["doc_id"]: r["__mix_epochs"] for r in mixing.select_mixture(docs(spark, rows), F.lit("d"), spec).collect()}
    assert got == {1: 2, 2: 0}
