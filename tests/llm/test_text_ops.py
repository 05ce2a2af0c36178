"""Packing, token counts and archives: exact round trips and brute force."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import packing, token_counts, warc
from cohortlens.llm.common import new_path

DOCS = "doc_id long, text string, length int, piece string"
TEXTS = [None, "", "  \n ", "Hello, World! it's 12", "x " * 9000, "Ünïcode ΣΑΣ İstanbul <|endoftext|> a\x1cb", "same", "same"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(texts)], DOCS)


def test_words_encode_like_the_library():
    random.seed(4)
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = list("abcXYZéÉßñÇö'’.,;!?-_#$%&1239½²٣ \t\n 　\x85\x1cΣσςİıΆ̸=<|>日本🙂\x00") + ["'s", "'re", "<|endoftext|>"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    for text, got in zip(texts, enc(texts)):
        assert np.frombuffer(got, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_memo_limit_changes_nothing(monkeypatch):
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"word{i} other, Thing{i}!" for i in range(50)]
    want = enc(texts)
    monkeypatch.setattr(packing, "MEMO_WORDS", 5)
    assert [enc([t])[0] for t in texts] == want


def test_packing_round_trip(spark):
    got = packing.pack(packing.tokenize(docs(spark), public_tokenizers.path("word_bpe_49k.json"))).collect()
    t = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    by_doc, places = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert [p["length"] for p in pieces] == [min(2048, len(ids) - a) for a in range(0, len(ids), 2048)]
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"]:p["start"] + p["length"]], "<u4").tobytes())
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 200])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [i for i, room in enumerate(bins) if room >= length]
            if fit:
                best = min(fit, key=lambda i: bins[i])
                bins[best] -= length
            else:
                bins.append(capacity - length)
    used, ranks = {}, {}
    for length, rank, n, first, each, offset in packing.plan_best_fit(counts, capacity):
        assert rank == ranks.get(length, 0)
        ranks[length] = rank + n
        for i in range(n):
            b, at = first + i // each, offset + i % each * length
            assert used.get(b, 0) == at
            used[b] = at + length
    assert ranks == counts and max(used.values()) <= capacity
    assert len(used) == len(bins)


def test_ranks_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    pieces = spark.createDataFrame([(i, 0, 0, 700 if i % 3 else 650, i) for i in range(300)], packing.PIECES)
    got = packing.pack(pieces).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 300
    assert len({r["sequence_id"] for r in got}) == 134  # 100 of two 700s, 34 of three 650s
    assert packing.pack(pieces.limit(0)).count() == 0


def test_ranks_over_many_blocks(spark, monkeypatch):
    """A length that most pieces share: ranks stay gapless over buckets and blocks of buckets."""
    monkeypatch.setattr(packing, "BUCKET", 2)
    monkeypatch.setattr(packing, "BLOCK", 3)
    pieces = spark.createDataFrame([(i, 0, 0, 9 if i % 10 else 2000, i) for i in range(200)], packing.PIECES)
    buckets = pieces.groupBy("length", (F.col("doc_id") % 37).alias("bucket")).agg(F.count("*").alias("n"))
    for length in (9, 2000):
        at = 0
        own = {r["bucket"]: r["n"] for r in buckets.where(F.col("length") == length).collect()}
        for r in sorted(packing.first_ranks(buckets).where(F.col("length") == length).collect(), key=lambda r: r["bucket"]):
            assert r["base"] == at
            at += own[r["bucket"]]
    got = packing.pack(pieces).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 200 and len({r["sequence_id"] for r in got}) == 21


def test_packing_of_odd_ids(spark):
    """Null and repeated ids: every row is packed."""
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c"), (1, "d e f")], "doc_id long, text string")
    got = packing.pack(packing.tokenize(rows, public_tokenizers.path("word_bpe_49k.json"))).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["length"]) for r in got) == sorted([("None", 0, 3), ("None", 0, 3), ("1", 0, 2), ("1", 0, 2), ("1", 0, 4)])
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5


@pytest.mark.parametrize("name, most", [("piece_bpe_32k.model", 200_000), ("word_bpe_49k.json", 200_000), ("piece_bpe_32k.model", 0)])
def test_counts_and_cache(spark, name, most, monkeypatch):
    """most 0: texts are shuffled to the misses instead of encoded where they lie."""
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", most)
    path, cache = public_tokenizers.path(name), new_path(spark, "test-cache")
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda text: len(sp.encode(text))
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda text: len(t.encode(text, add_special_tokens=False).ids)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs(spark), path, cache).collect()}
    assert got == {i: (len((t or "").encode()), count(t or "")) for i, t in enumerate(TEXTS)}
    known = spark.read.parquet(cache)
    assert known.count() == len({t or "" for t in TEXTS})  # copies are encoded once
    before = known.count()
    again = token_counts.count_tokens(docs(spark, [*TEXTS, "new"]), path, cache)
    assert again.count() == len(TEXTS) + 1
    assert spark.read.parquet(cache).count() == before + 1  # the rest was known
    assert token_counts.count_tokens(docs(spark, []), path, new_path(spark, "test-cache")).count() == 0


def test_counts_of_odd_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    got = token_counts.count_tokens(rows, public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "test-cache"))
    assert got.count() == 4 and got.where("doc_id is null").count() == 1


PAGES = "page_id long, url string, html string, refers_to string"


def test_archives_round_trip(spark):
    long = "<html>" + "é\r\n\r\nWARC/1.1\r\n" * 30
    rows = [(1, "http://a/", long), (2, "http://a b/\n", long), (3, None, None), (4, "u", "short"), (5, "u", "short"), (0, "u", long), (7, "u", "y" * 3_000_000), (None, "u", "z"), (None, "u", long), (None, "u", "w" * 200), (None, "u", "w" * 200), (2**62, "u", "big"), (-(2**63), "u", "least"), (-9, "u", "only"), (7, "u", "y" * 3_000_000)]
    path = new_path(spark, "test-warc")
    warc.pages_to_warc(spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3), path)
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, path).collect()]
    n = len(long.encode())
    want = [(0, n, "response", None), (1, n, "revisit", 0), (2, n, "revisit", 0), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None), (-9, 4, "response", None)]
    want += [(7, 3_000_000, "response", None)] * 2 + [(None, 1, "response", None), (None, n, "revisit", 0), (2**62, 3, "response", None), (-(2**63), 5, "response", None)] + [(None, 200, "response", None)] * 2
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_archive(spark):
    path = new_path(spark, "test-warc")
    warc.pages_to_warc(spark.createDataFrame([], PAGES), path)
    assert warc.read_warc(spark, path).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    docs = [("http://x/a", "1.2.3.4", "19990102030405", "text/html", warc.http_message(5, b"body\nline")), ("dns:x", "1.2.3.4", "19990102030405", "text/dns", b""), ("http://x/b", "1.2.3.4", "19990102030405", "text/html", b"last")]
    data = warc.build_arc(docs, version)
    assert list(warc.parse_arc(data)) == docs
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-3]))
    ((head, block),) = warc.parse_warc(warc.to_warc(docs[0], 5))
    assert head["WARC-Date"] == "1999-01-02T03:04:05Z" and block == docs[0][4] and warc.key_of(head["WARC-Record-ID"]) == 5


@pytest.mark.parametrize("key", [None, 0, 1, -1, 2**61, 2**63 - 1, -(2**63)])
def test_identifiers_hold_keys(key):
    assert warc.key_of(warc.record_id("ab" * 32, key)) == key


def arc_file(version, records, break_="\n"):
    """An archive as other crawlers wrote them: written out by hand, with bytes of any kind."""
    fields = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    about = f"{version} 1 InternetArchive\n{fields}\n\n".encode()
    more = " 200 abc - 0 x.arc" if version == 2 else ""
    out = f"filedesc://IA-001102.arc 0.0.0.0 19960923142103 text/plain{more} {len(about)}\n".encode() + about
    for url, date, kind, doc in records:
        out += f"{break_}{url} 192.0.2.7 {date} {kind}{more} {len(doc)}\n".encode("latin-1") + doc
    return out + break_.encode()


def test_foreign_archives(spark, tmp_path):
    """Records without any private header: payloads that are no UTF-8, lines ended by a single line feed, messages without length, dns and
    plain documents, short dates, several gzip members, addresses with spaces."""
    import gzip

    latin = b"<html>caf\xe9 \xff\xfe\x00\n\r\n\r\nend</html>" * 8
    ok = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n"
    one = [("http://a/ b?q=1", "19970101000000", "text/html", ok + latin), ("dns:a", "19970101000000", "text/dns", b"19970101 a. IN A 192.0.2.7\n"), ("http://a/lf", "199702", "text/html", b"HTTP/1.0 200 OK\nA: b\n\n" + latin), ("http://a/none", "19970301000000", "no-type", b""), ("http://a/empty", "19970301000001", "text/html", ok)]
    two = [("http://b/early", "19960101000000", "text/html", ok + latin), ("http://b/plain", "19970101000000", "text/plain", b"\x80 no message"), ("http://b/small", "19970101000000", "text/html", ok + b"tiny"), ("http://b/small", "19970101000000", "text/html", ok + b"tiny"), ("http://b/head", "19970101000000", "text/html", b"HTTP/1.0 304 Not Modified")]
    (tmp_path / "one.arc").write_bytes(arc_file(1, one, "\r\n"))
    data = arc_file(2, two)
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(data[:300]) + gzip.compress(data[300:]))
    (tmp_path / "nothing.arc").write_bytes(b"")
    out = new_path(spark, "test-foreign")
    warc.convert(spark, str(tmp_path), out)
    rows = warc.read_warc(spark, out, info=True).collect()
    assert sorted(r["record_type"] for r in rows) == sorted(["warcinfo"] * 2 + ["response"] * 5 + ["revisit"] * 2 + ["resource"] * 3)
    assert len({r["record_id"] for r in rows}) == len(rows) and all(r["page_id"] is None for r in rows)
    by = {r["url"]: r for r in rows if r["url"] not in (None, "http://b/small")}
    assert by["http://b/early"]["record_type"] == "response"  # the earliest capture
    for url in ("http://a/ b?q=1", "http://a/lf"):
        assert (by[url]["record_type"], by[url]["refers_to_id"], by[url]["payload_bytes"]) == ("revisit", by["http://b/early"]["record_id"], len(latin))
        assert by[url]["payload_digest"] == hashlib.sha256(latin).hexdigest()
    assert by["http://a/lf"]["date"] == "1997-02-01T00:00:00Z" and by["http://a/empty"]["payload_bytes"] == 0
    assert {u: by[u]["content_type"] for u in ("dns:a", "http://a/none", "http://b/plain")} == {"dns:a": "text/dns", "http://a/none": "application/octet-stream", "http://b/plain": "text/plain"}
    whole = {}
    for path in Path(out.removeprefix("file:")).glob("part-*"):
        data = path.read_bytes()
        assert gzip.decompress(data) == b"".join(warc.members(data))  # any gzip reader takes the files
        for content in warc.members(data):
            ((head, block),) = warc.parse_warc(content)  # a record a member
            whole.setdefault((head.get("WARC-Target-URI"), head["WARC-Date"]), []).append((head, block))
    assert whole["http://b/early", "1996-01-01T00:00:00Z"][0][1] == ok + latin
    assert whole["http://a/lf", "1997-02-01T00:00:00Z"][0][1] == b"HTTP/1.0 200 OK\nA: b\n\n"
    assert {h["WARC-Filename"] for h, _ in whole[None, "1996-09-23T14:21:03Z"]} == {"IA-001102.arc"}


@pytest.mark.parametrize("broken, text", [(b"filedesc://x 0.0.0.0 19960923142103 text/plain 9\n3 1 x\ny z\n", "version"), (arc_file(1, [("http://a/", "1997", "text/html", b"abc")])[:-2], "cut short"), (arc_file(2, []) + b"http://a/ 1.2.3.4 1997 text/html 3\nabc", "header line"), (b"no archive", "header line")])
def test_damaged_archives(broken, text):
    with pytest.raises(ValueError, match=text):
        list(warc.arc_records(broken))


@pytest.mark.parametrize("size", [0, 10, 1 << 16, (1 << 24) + 5])
def test_members_end_with_the_byte_between_rows(size):
    import gzip
    import random

    data = random.Random(size).randbytes(min(size, 1000)) * (size // 1000 + 1)
    assert gzip.decompress(warc.member(data[:size]) + b"\x00") == data[:size]


def test_many_revisits_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 1)
    monkeypatch.setattr("cohortlens.llm.common.BROADCAST_ROWS", 1)
    rows = [(i, f"http://x/{i}", "same text " * 20 if i % 3 else f"own text {i} " * 20, "-") for i in range(60)]
    path = new_path(spark, "test-warc")
    warc.pages_to_warc(spark.createDataFrame(rows, PAGES).repartition(4), path)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, path).collect()}
    assert got == {i: ("response", None) if i % 3 == 0 or i == 1 else ("revisit", 1) for i in range(60)}
