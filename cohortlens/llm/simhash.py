"""Near-duplicate classes by SimHash fingerprints and BK-trees.

A fingerprint has a bit set where over half of a document's shingle hashes have it. Two documents are linked when their fingerprints
differ in at most ``radius`` bits; classes are the connected documents.

Equal fingerprints are one entry from the start, so exact copies, however many, cost a partial aggregate. Two entries within the radius
agree on at least ``blocks - radius`` of ``blocks`` pieces of their bits. For each choice of so many pieces the entries are dealt into
shards by a hash of these bits, so whatever is within the radius of an entry is in one of its own shards at least, and no entry need ask
the others. Each shard becomes a BK-tree: a node's children are keyed by their integer Hamming distance to it, and a search for what lies
within the radius of q follows, from a node at distance d of q, the edges d - radius to d + radius only. Trees are plain arrays of at most about
``TREE`` entries. A shard that outgrows this (many entries agree on these bits) is cut into several trees by a hash of the entry, and
every tree is sent to the entries of the other cuts: by broadcast while the counted trees are few, else by a shuffle on the cut that
asks. The number of shards grows with the counted entries, so the work of an entry stays the same; ``blocks`` grows by one when
entries come to outnumber what that many bits can tell apart.

A search gives a spanning forest of the links it finds, never all of them: rows stay below the entries asked, also where thousands of entries lie
within the radius of each other. ``neardup.components`` joins the forests.

Defined results. Null, empty or blank text: fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence
is the one shingle. Null doc_id: a fingerprint, but no link, and component_id null. Rows that share a doc_id are one document for
the links: the class of each of their fingerprints holds the id, so they are all of one class. Repeated rows come back as often as they came. Very long texts
are read whole. An empty table gives no rows. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, scratch, text_batches, tidied
from .neardup import components

RADIUS = 3
#: Words in a shingle, and the seed of its XXH64.
SIZE, SEED = 3, 42
#: Entries in a tree, about, and in a shard on average.
TREE, SHARD = 2048, 1024
#: Trees that may be broadcast: some 25 MB.
BROADCAST_TREES = 400
#: Hashes whose bits are counted at a time.
STEP = 1 << 16


def fingerprint(text: bytes | None, size: int = SIZE) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: lowers A-Z only, splits at space and 0x09-0x0D only
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[size - 1:])) or [(0, ends[-1])]
    votes = np.zeros(64, np.int64)
    for a in range(0, len(spans), STEP):
        h = np.array([digest(joined[x:y], SEED) for x, y in spans[a:a + STEP]], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(spans), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return run


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKTree:
    """Entries in arrays: node k > 0 hangs below parent[k] by the edge edge[k], its distance to it; the root is 0."""

    def __init__(self, fps: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.fps = fps
        code = parent[1:].astype(np.int64) * 128 + edge[1:]
        order = np.argsort(code)
        self.codes, self.children = code[order], order + 1

    @staticmethod
    def links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parent, edge) of the tree that inserting fps in their order makes, a level of all of them at a time. All differ."""
        parent, edge = np.zeros(len(fps), np.int32), np.zeros(len(fps), np.int8)
        rows, at = np.arange(1, len(fps)), np.zeros(max(len(fps) - 1, 0), np.int64)
        while len(rows):
            d = distance(fps[rows], fps[at])
            _, first, inverse = np.unique(at * 128 + d, return_index=True, return_inverse=True)
            new = rows[first]
            parent[new], edge[new] = at[first], d[first]
            left = np.ones(len(rows), bool)
            left[first] = False
            rows, at = rows[left], new[inverse][left]
        return parent, edge

    def within(self, queries: np.ndarray, radius: int):
        """(query, node) position pairs within the radius, as arrays, a level of the tree at a time."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(q):
            d = distance(queries[q], self.fps[node])
            hit = d <= radius
            yield q[hit], node[hit]
            low = np.searchsorted(self.codes, node * 128 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.codes, node * 128 + d + radius, side="right") - low
            q = np.repeat(q, n)
            node = self.children[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(q))]


def _plant(batches):
    """Rows (shard, cut, cuts, entries) -> (shard, cut, cuts, fps, reps, parent, edge), the last four as bytes."""
    for batch in batches:
        out = []
        for entries in batch.column("entries"):
            fps, reps = (entries.values.field(k).to_numpy() for k in ("fp", "rep"))
            order = np.argsort(fps)
            fps, reps = fps[order], reps[order]
            parent, edge = BKTree.links(fps.view(np.uint64))
            out.append([x.tobytes() for x in (fps, reps, parent, edge)])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("shard", "cut", "cuts")), *(pa.array([o[k] for o in out], pa.binary()) for k in range(4))], ["shard", "cut", "cuts", "fps", "reps", "parent", "edge"])


TREE_SCHEMA = "shard long, cut int, cuts int, fps binary, reps binary, parent binary, edge binary"


def _ask(radius: int):
    """Rows of a tree and the entries that ask it (ask_fps, ask_reps; null: its own): a spanning forest of the links found."""

    def run(batches):
        for batch in batches:
            hubs, others = [], []
            for row in range(batch.num_rows):
                fps, reps, parent, edge, ask_fps, ask_reps = (None if (v := batch.column(c)[row].as_py()) is None else np.frombuffer(v, t) for c, t in zip(("fps", "reps", "parent", "edge", "ask_fps", "ask_reps"), ("<u8", "<i8", "<i4", "i1", "<u8", "<i8")))
                own = ask_fps is None
                queries, names = (fps, reps) if own else (ask_fps, np.concatenate([reps, ask_reps]))
                top = list(range(len(names)))

                def root(x):
                    while top[x] != x:
                        top[x] = top[top[x]]
                        x = top[x]
                    return x

                for q, node in BKTree(fps, parent, edge).within(queries, radius):
                    if own:
                        q, node = q[q < node], node[q < node]
                    for a, b in zip((q if own else q + len(reps)).tolist(), node.tolist()):
                        a, b = root(a), root(b)
                        if a != b:
                            top[max(a, b)] = min(a, b)
                            hubs.append(names[a])
                            others.append(names[b])
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(others, pa.int64())], ["hub", "other"])

    return run


def blocks_for(entries: int, radius: int) -> int:
    """Pieces of the bits: one more than the radius, or more while a shard of equal bits would hold over SHARD entries of random bits."""
    blocks = radius + 1
    while blocks < 2 * radius + 2 and entries > SHARD << (64 // blocks * (blocks - radius)):
        blocks += 1
    return blocks


def shard_keys(blocks: int, radius: int, shards: int) -> list:
    """A column for each choice of blocks - radius pieces: the number of the entry's shard, different for different choices."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    out = []
    for turn, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum((1 << cuts[b + 1]) - (1 << cuts[b]) for b in chosen)
        bits = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        out.append(F.pmod(F.xxhash64(bits), F.lit(shards)) + turn * shards)
    return out


def fingerprint_links(entries: DataFrame, radius: int = RADIUS, blocks: int | None = None, tree: int = TREE, shard: int = SHARD, broadcast: int = BROADCAST_TREES) -> DataFrame:
    """entries (fp, rep), each fp once -> links (hub, other) of reps that connect just what links within the radius connect."""
    n = entries.count()
    blocks = blocks or blocks_for(n, radius)
    keys = shard_keys(blocks, radius, max(1, -(-n // shard)))
    dealt = entries.select(F.explode(F.array(*keys)).alias("shard"), "fp", "rep")
    large = materialize(dealt.groupBy("shard").agg(F.count("*").alias("m")).where(F.col("m") > tree).select("shard", F.ceil(F.col("m") / shard).cast("int").alias("cuts")), "simhash-large")
    dealt = dealt.join(broadcast_if_small(large, large.count()), "shard", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    dealt = dealt.withColumn("cut", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cuts")).cast("int"))
    groups = dealt.groupBy("shard", "cut", "cuts").agg(F.collect_list(F.struct("fp", "rep")).alias("entries")).where(F.size("entries") + F.col("cuts") > 2)
    trees = materialize(groups.mapInArrow(tidied(_plant), TREE_SCHEMA), "simhash-trees")
    cut = trees.where("cuts > 1")
    sent = cut.where(F.col("cut") + 1 < F.col("cuts")).select("shard", F.explode(F.sequence(F.col("cut") + 1, F.col("cuts") - 1)).alias("cut"), "fps", "reps", "parent", "edge")
    asks = cut.select("shard", "cut", F.col("fps").alias("ask_fps"), F.col("reps").alias("ask_reps"))
    if cut.count() <= broadcast:
        small = F.broadcast(cut.select("shard", F.col("cut").alias("sender"), "fps", "reps", "parent", "edge"))
        across = asks.join(small, "shard").where(F.col("sender") < F.col("cut"))
    else:
        across = asks.join(sent, ["shard", "cut"])
    columns = ["fps", "reps", "parent", "edge", "ask_fps", "ask_reps"]
    own = trees.select("fps", "reps", "parent", "edge", F.lit(None).cast("binary").alias("ask_fps"), F.lit(None).cast("binary").alias("ask_reps"))
    return own.unionByName(across.select(*columns)).mapInArrow(tidied(_ask(radius)), "hub long, other long")


def near_duplicates(docs: DataFrame, size: int = SIZE, radius: int = RADIUS, **dealing) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and component_id of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with text_batches(docs.sparkSession):
        rows = materialize(docs.mapInArrow(tidied(_fingerprints(size)), "doc_id long, fp long"), "simhash-rows")
    with scratch(docs.sparkSession) as keep:
        known = rows.where("doc_id is not null")
        entries = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "simhash-entries")
        links = fingerprint_links(entries.select("fp", "rep"), radius, **dealing)
        many = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("doc_id")
        again = known.join(many, "doc_id").join(entries.select("fp", "rep"), "fp").select(F.col("rep").alias("hub"), F.col("doc_id").alias("other")).where("hub <> other")
        label = components(links.unionByName(again))
        # what differs from the rule that a document is its own class: entries with several ids, or in a link
        shared = entries.join(label, "rep", "left").where("label is not null or rep < last").select("fp", F.coalesce("label", "rep").alias("component"))
        shared = materialize(shared, "simhash-classes")
        keep(shared)
    out = rows.join(broadcast_if_small(shared, shared.count()), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op11_bk_simhash(spark, sf_dir):
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
