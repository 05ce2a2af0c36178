"""Best-fit packing planned on a histogram of lengths.

1. Documents become token ids plus a separator, cut into pieces of at most ``capacity`` ids only where longer. The
   narrow table of pieces is written once.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to the driver, where best-fit decreasing runs over
   counts: bins with the same history are one range, and a step fills a whole range. The plan's size depends on the
   capacity, not on the number of documents.
3. Each piece gets its rank within its length and takes the planned slot of that rank. Ranks come from buckets of about
   ``BUCKET`` pieces per length with prefix sums over blocks of ``BLOCK`` buckets and over the buckets of a block, so a length
   shared by a third of all pieces is no hot group: of n pieces n / 32,768 rows meet in a task.

Defined results. Null text: as ''. Null doc_id: kept. Rows repeated exactly and ids used twice are packed each. An
empty text is one piece holding the separator. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, text_batches, tidied, worker_state

CAPACITY = 2048
BUCKET = 128
#: Buckets that are summed together.
BLOCK = 256
#: A worker remembers so many words (about 50 MB) for good, later ones within a call only; that changes speed only.
MEMO_WORDS = 200_000
#: Not white space to the tokenizer's patterns, but to str.split.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
#: Texts without these are lower-cased as a whole, which is what the file's normaliser does to each of their characters.
NOT_LATIN = re.compile("[\u0130\u0250-\U0010ffff]")


class WordEncoder:
    """Ids of texts under a word-level BPE file as little-endian uint32 bytes, equal to the library's: its patterns never
    cross white space, so a text's ids are those of its words, and words are remembered. A word of plain Latin letters
    and ASCII marks behind it is split into both, and the letters, in lower case, are merged by tiktoken over the same
    vocabulary (the end-of-word suffix is a byte that UTF-8 never has), which is several times as fast on new words. Any
    other word goes to the library, and so do whole texts with special tokens or unusual separators."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.merge = word_merger(path)

    def _library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        memo, merge, rest, parts, out = self.memo, self.merge, set(), [], {}
        for w in new:
            if merge and w.isascii() and w.isalpha():
                out[w] = merge(w.lower())
                continue
            head = w.rstrip(string.punctuation)
            if merge and head.isalpha() and (head.isascii() or max(head) < "\u0250" and "\u0130" not in head):
                low, tail = head.lower(), w[len(head):]
                ids = memo.get(low) or out.get(low) or merge(low)
                if not tail:
                    out[w] = ids
                else:
                    parts.append((w, ids, tail))
                    if tail not in memo:
                        rest.add(tail)
            else:
                rest.add(w)
        todo = list(rest)
        out.update(zip(todo, self._library(todo)))
        for w, ids, tail in parts:
            out[w] = ids + (out[tail] if tail in out else memo[tail])
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [None if any(s in t for s in self.special) or any(c in t for c in ODD_SPACES) else (t.lower() if self.merge and not NOT_LATIN.search(t) else t).split() for t in texts]
        seen: set[str] = set()
        for words in split:
            seen.update(words or ())
        learned = self._learn(seen.difference(self.memo))
        if len(self.memo) + len(learned) <= MEMO_WORDS:
            self.memo.update(learned)
            get = self.memo.__getitem__
        else:
            learned.update((w, self.memo[w]) for w in seen if w in self.memo)
            get = learned.__getitem__
        return [self._library([t])[0] if words is None else b"".join(map(get, words)) for t, words in zip(texts, split)]


def word_merger(path: str):
    """word -> ids as bytes, for a file that is a lower-casing byte-level BPE with end-of-word suffix whose ids follow
    the order of its merges; None for any other."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    if model.get("type") != "BPE" or not suffix or model.get("dropout") or "Lowercase" not in json.dumps(spec["normalizer"]):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"]["".join(p)] for p in pairs]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {}
    for token, i in model["vocab"].items():
        end = token.endswith(suffix) and token != suffix
        body = token[: -len(suffix)] if end else token
        if token not in special:
            ranks[bytes(letters[c] for c in body) + b"\xff" * end] = i
    singles = [i for t, i in model["vocab"].items() if t not in special and (len(t) == 1 or len(t.removesuffix(suffix)) == 1)]
    if order != sorted(order) or order and max(singles) > order[0]:
        return None
    core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    piece = getattr(getattr(core, "_core_bpe", None), "encode_single_piece", core._encode_single_piece)  # without the wrapper's checks
    return lambda word: array("I", piece(word.encode() + b"\xff")).tobytes()


def encoder(path: str) -> WordEncoder:
    state = worker_state()
    if ("words", path) not in state:
        state["words", path] = WordEncoder(path)
    return state["words", path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, separator: int, group_bytes: int = 4 << 20):
    tail = np.array([separator], dtype="<u4").tobytes()

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            cols: list[list] = [[], [], [], [], []]
            part: list[str] = []
            size, at = 0, 0
            for i in range(len(ids)):
                part.append(texts[i].as_py() or "")
                size += len(part[-1])
                if size < group_bytes and i + 1 < len(ids):
                    continue
                for doc, data in zip(ids[at:i + 1], encode(part)):
                    data += tail
                    for k, b in enumerate(range(0, len(data), 4 * capacity)):
                        piece = data[b:b + 4 * capacity]
                        for col, v in zip(cols, (doc, k, b // 4, len(piece) // 4, zlib.crc32(piece))):
                            col.append(v)
                part, size, at = [], 0, i + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, first rank, pieces, first bin, pieces a bin, offset): the pieces of
    that length from that rank on go into consecutive bins, so many to each, from that offset on."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: ranges (first bin, bins)
    bins = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, n: int, each: int, room: int) -> None:
            nonlocal left, rank
            rows.append((length, rank, n * each, first, each, capacity - room))
            left, rank = left - n * each, rank + n * each
            if room > each * length:
                free[room - each * length].append((first, n))

        room = length
        while left:
            while room <= capacity and not free[room]:
                room += 1
            if room <= capacity:
                first, n = free[room].pop()
            else:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = room // length
            whole = min(n, left // each)
            if whole:
                put(first, whole, each, room)
            if left and whole < n:
                put(first + whole, 1, left, room)
                whole += 1
            if whole < n:
                free[room].append((first + whole, n - whole))
    return rows


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(_pieces(tokenizer, capacity, separator)), PIECES)


def first_ranks(buckets: DataFrame) -> DataFrame:
    """buckets: length, bucket, n. base: the pieces of that length in the buckets before, summed by blocks of BLOCK buckets, then within them."""
    x = buckets.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    earlier = lambda keys, by: W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    before = lambda keys, by: F.coalesce(F.sum("n").over(earlier(keys, by)), F.lit(0))
    blocks = x.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", before(["length"], "block").alias("start"))
    within = x.withColumn("within", before(["length", "block"], "bucket"))
    return within.join(blocks, ["length", "block"]).select("length", "bucket", (F.col("start") + F.col("within")).alias("base"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (PIECES) with sequence_id and offset."""
    spark = pieces.sparkSession
    with text_batches(spark):
        pieces = materialize(pieces, "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = np.array(sorted(plan_best_fit(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    dealt = F.broadcast(spark.createDataFrame([(k, -(-n // BUCKET)) for k, n in counts.items()], "length long, buckets long"))
    pieces = pieces.join(dealt, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))
    own = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    base = first_ranks(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    ranked = pieces.withColumn("own", F.row_number().over(own)).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own") - 1)
    sent = spark.sparkContext.broadcast(plan)
    step = max(counts.values(), default=0) + 1

    def place(batches):
        p = sent.value
        keys = p[:, 0] * step + p[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = p[np.searchsorted(keys, length * step + rank, side="right") - 1]
            i = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 3] + i // row[:, 4]), pa.array(row[:, 5] + i % row[:, 4] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack(tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
