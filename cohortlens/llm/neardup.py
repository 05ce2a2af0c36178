"""Near-duplicate classes by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Equal sets are collapsed first. Every distinct set carries
``HASHES`` minwise hashes. In a tree a node selects, by a hash of its own path, 1 / similarity of these hashes on average; a
set goes down the branches named by the values it has there. So similar sets stay together on some path with a probability
that does not fade with depth, and dissimilar ones part. The first two levels are taken at once.

Crowds come first: in up to ``ROUNDS`` trees, sets that share a node with more than ``SMALL`` others meet ``PIVOTS`` of its
members, and those that look similar to one become its satellites; a satellite, once confirmed on full sets, is of its
centre's class, and a class counts once in every node from then on. So a crowd costs a row a node, not one a member.

Then ``trees`` independent trees: nodes of at most ``SMALL`` classes are compared exhaustively (all pairs, on 64-byte
sketches of the minwise hashes); larger ones go on branching, until comparing them exhaustively, in blocks and on full sets (of
those whose sketch is anywhere near another one of their block), is cheap (``WORK``), or for ``DEPTH`` more levels. Nothing leaves a node early. A class stands in a comparison by its centre:
as its members are within distance d = 1 - similarity of it, whatever is similar to a member is within 2 d of the centre (3 d if it is a
member of another class), and every class that may be so near is compared with all members, exactly and in blocks.

Candidate pairs are confirmed on the full sets, recomputed from whole texts: first one pair for each set; then, of all
other pairs, those whose ends are still in different classes; last, sets near a crowd with its members. Links make classes by forests
within tasks, then, if many are left, by repeated minimum labels with pointer jumping as DataFrame joins. No step gathers a
group, a component or a list of links in one task or on the driver.

Recall: two levels down, a tree keeps a pair of similarity 0.8 together in 7 of 10 cases, so ``trees`` = 12 lose one in 10**6;
where nodes stay large for more levels, under 1 in 1000. All trees share the hashes of a set, and a pair is passed over where
their estimate is four standard deviations low (1 in 30,000; six in large nodes, under 1 in 10**7), so losses of different trees are not independent. Confirmed links are exact.

Defined results. Null, empty or blank text: an empty set, linked with nothing. Fewer words than a shingle has: the whole
sequence is the one shingle. Null doc_id: linked with nothing, component null, kept. Rows that share a doc_id stay or go
together. Very long texts count whole. Empty tables give no rows; other columns are ignored by ``near_duplicates`` and kept by
``keep_one``. percent is from 1 to 100.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, materialize, scratch, text_batches, tidied

HASHES = 64
TREES = 12
SMALL = 16
PIVOTS = 4
ROUNDS = 4
DEPTH = 12
HUB_ROWS = 512
#: Large nodes are compared exhaustively once that makes at most so many comparisons for each set of the input, and one copy of its text.
WORK = 256
#: So many links (counted, after each task has reduced its own to a forest) are solved in one task; more by joins.
FOREST_ROWS = 200_000
BLOCK = 512
#: Estimates may be so many standard deviations off before a pair is lost, and before a pair counts as sure; WIDE: before a pair of a large
#: node that is compared exhaustively is lost.
SLACK, SURE, WIDE = 4, 3, 6


def deviation(similarity: float) -> float:
    """Standard deviation of an estimate from HASHES hashes."""
    return math.sqrt(max(similarity * (1 - similarity), 0.0) / HASHES)


class Limits:
    """What follows from percent. least[c], looks[c]: similarity, and its estimate, that a pair of centres has at least if of its c
    classes with members (0, 1 or 2) some member is similar to the other side. wide[c]: as looks[c], for large nodes."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError("percent must be from 1 to 100")
        self.percent, self.similarity = percent, percent / 100
        self.least = np.array([max(0.0, 1 - (c + 1) * (1 - self.similarity)) for c in range(3)])
        self.looks = np.array([max(0.0, x - SLACK * deviation(x)) for x in self.least])
        self.wide = np.array([max(0.0, x - WIDE * deviation(x)) for x in self.least])
        self.sure = self.similarity + SURE * deviation(self.similarity)


SEED = np.random.default_rng(20240229)
MULTIPLY = (SEED.integers(1, 1 << 63, HASHES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = SEED.integers(1, 1 << 63, HASHES, dtype=np.int64).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at space and 0x09-0x0D only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(size, len(h))))
    for k in range(min(size, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(out)


def minwise(x: np.ndarray) -> np.ndarray:
    """The HASHES minwise hashes of a non-empty set, as uint32."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(x), 4096):
        out = np.minimum(out, (x[a:a + 4096, None] * MULTIPLY + ADD).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def sketch(sig: np.ndarray) -> np.ndarray:
    return (sig ^ (sig >> np.uint32(8)) ^ (sig >> np.uint32(16))).astype(np.uint8)


def branch(nodes: np.ndarray, sigs: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, child nodes): each row of sigs goes to the children that its node selects, 1 / similarity on average."""
    r = mix(nodes ^ np.uint64(0xD6E8FEB86659FD93))
    whole = int(1 / similarity)
    more = np.flatnonzero((r >> np.uint64(40)).astype(float) / 2**24 < 1 / similarity - whole)
    rows = np.concatenate([np.arange(len(nodes))] * whole + [more])
    turn = np.repeat(np.arange(whole + 1), [len(nodes)] * whole + [len(more)]).astype(np.uint64)
    at = (mix(r[rows] + turn * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(HASHES)).astype(np.int64)
    return rows, mix(nodes[rows] * np.uint64(0x9E3779B97F4A7C15) + mix((sigs[rows, at].astype(np.uint64) << np.uint64(8)) + at.astype(np.uint64)))


def _describe(size: int):
    def run(batches):
        import xxhash

        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for t in batch.column("text"):
                x = shingles(t.as_py(), size)
                n.append(len(x))
                d = xxhash.xxh3_128_intdigest(x.tobytes())
                k1.append((d >> 64) - (1 << 63))
                k2.append((d & (1 << 64) - 1) - (1 << 63))
                sig.append(minwise(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return run


def _matrix(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), HASHES)


def _plant(first: int, trees: int, similarity: float, once: bool):
    """(node, rep, cls) of sets two levels down the trees numbered from first on; of rows that differ in rep only, one a batch if once."""

    def run(batches):
        for batch in batches:
            sigs, reps, classes = _matrix(batch.column("sig"), np.uint32), batch.column("rep").to_numpy(), batch.column("cls").to_numpy()
            at, node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t in range(first, first + trees):
                rows, nodes = np.arange(len(reps)), np.full(len(reps), mix(np.array([t + 1], np.uint64))[0])
                for _ in range(2):
                    k, nodes = branch(nodes, sigs[rows], similarity)
                    rows = rows[k]
                at.append(rows)
                node.append(nodes.view(np.int64))
            rows, nodes = np.concatenate(at), np.concatenate(node)
            if once:
                order = np.lexsort((classes[rows], nodes))
                rows, nodes = rows[order], nodes[order]
                new = np.ones(len(rows), bool)
                new[1:] = (nodes[1:] != nodes[:-1]) | (classes[rows[1:]] != classes[rows[:-1]])
                rows, nodes = rows[new], nodes[new]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(reps[rows]), pa.array(classes[rows])], ["node", "rep", "cls"])

    return run


def _descend(similarity: float):
    """Rows (node, rep, cls, sig) -> (node, rep, cls) one level further down."""

    def run(batches):
        for batch in batches:
            rows, child = branch(batch.column("node").to_numpy().view(np.uint64), _matrix(batch.column("sig"), np.uint32), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(pa.array(batch.column(c).to_numpy()[rows]) for c in ("rep", "cls"))], ["node", "rep", "cls"])

    return run


def _groups(batches, keys):
    """Slices of a stream sorted by keys, one for each value: tables that hold whole groups."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        cols = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), starts[:-1]
        rest = table.slice(starts[-1])
    if rest is not None:
        yield rest.combine_chunks(), np.zeros(1, np.int64)


PAIRS = "hub long, other long, wave int"


def node_pairs(reps: np.ndarray, sizes: np.ndarray, marks: np.ndarray, crowd: np.ndarray, limits: Limits) -> list[tuple[int, int, int]]:
    """Candidate pairs of one small node: wave 1 for a spanning forest by falling estimate, wave 2 for the others unless
    sure links of the forest join their ends already; wave 3 for a class with members (first) and what may be near one of them."""
    order = np.argsort(reps)
    reps, sizes, marks, crowd = reps[order], sizes[order], marks[order], crowd[order].astype(np.int64)
    i, j = np.triu_indices(len(reps), 1)
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep = small >= (limits.least[crowd[i] + crowd[j]] - 1e-9) * large
    i, j, small, large = i[keep], j[keep], small[keep], large[keep]
    est = (marks[i] == marks[j]).mean(axis=1)
    fit = np.flatnonzero((est >= limits.looks[0]) & (100 * small >= limits.percent * large))
    out, top, sure = [], list(range(len(reps))), list(range(len(reps)))

    def root(up, x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k in fit[np.argsort(-est[fit], kind="stable")]:
        a, b = root(top, i[k]), root(top, j[k])
        if a != b:
            top[b] = a
            if est[k] >= limits.sure:
                sure[root(sure, j[k])] = root(sure, i[k])
            out.append((reps[i[k]], reps[j[k]], 1))
        elif root(sure, i[k]) != root(sure, j[k]):
            out.append((reps[i[k]], reps[j[k]], 2))
    for k in np.flatnonzero((crowd[i] + crowd[j] > 0) & (est >= limits.looks[crowd[i] + crowd[j]])):
        out.append((reps[i[k]], reps[j[k]], 3) if crowd[i[k]] else (reps[j[k]], reps[i[k]], 3))
    return out


def _pairs_batch(rows: list[tuple[int, int, int]]):
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], ["hub", "other", "wave"])


def _compare(limits: Limits):
    def run(batches):
        for table, starts in _groups(batches, ("node",)):
            reps, sizes, marks, crowd = (table.column(c).to_numpy() if c != "mark" else _matrix(table.column(c), np.uint8) for c in ("cls", "n", "mark", "crowd"))
            out = []
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                out += node_pairs(reps[a:b], sizes[a:b], marks[a:b], crowd[a:b], limits)
            yield _pairs_batch([(int(x), int(y), w) for x, y, w in out])

    return run


def _nearest(limits: Limits):
    """Rows (rep, n, mark) of crowded nodes with their node's pivots: the pair with a pivot that looks similar, if any, the smallest of several."""

    def run(batches):
        for batch in batches:
            reps, sizes, marks, pivots = batch.column("rep").to_numpy(), batch.column("n").to_numpy(), _matrix(batch.column("mark"), np.uint8), batch.column("pivots")
            hub, other = [], []
            for r in range(len(reps)):
                own = sorted(pivots[r].as_py(), key=lambda p: p["rep"])
                if any(p["rep"] == reps[r] for p in own):
                    continue
                est = (np.frombuffer(b"".join(p["mark"] for p in own), np.uint8).reshape(len(own), HASHES) == marks[r]).mean(axis=1)
                fit = [p["rep"] for p, e in zip(own, est) if e >= limits.similarity and 100 * min(p["n"], sizes[r]) >= limits.percent * max(p["n"], sizes[r])]
                if fit:
                    hub.append(fit[0])
                    other.append(int(reps[r]))
            yield pa.RecordBatch.from_arrays([pa.array(hub, pa.int64()), pa.array(other, pa.int64())], ["hub", "other"])

    return run


def crowd_stars(sets: DataFrame, limits: Limits) -> DataFrame | None:
    """(hub, other): sets that look similar to a pivot of a crowded node, each with one hub; no hub is another's other. None without crowds."""
    rest, stars = sets.select("rep", F.col("rep").alias("cls"), "sig"), None
    for turn in range(ROUNDS):
        rows = rest.mapInArrow(tidied(_plant(1000 + turn, 1, limits.similarity, False)), "node long, rep long, cls long")
        rows = materialize(rows.select("node", "rep"), "near-crowd-nodes")
        large = materialize(rows.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > SMALL).select("node"), "near-large")
        few = large.count()
        if not few:
            break
        inside = materialize(rows.join(broadcast_if_small(large, few), "node"), "near-crowded")
        pivots = inside.groupBy("node").agg(F.min("rep").alias("p0"), *[F.min(F.struct(F.xxhash64("node", "rep", F.lit(k)), "rep")).getField("rep").alias(f"p{k}") for k in range(1, PIVOTS)])
        pivots = pivots.select("node", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("rep")).join(sets.select("rep", "n", "mark"), "rep")
        pivots = materialize(pivots.groupBy("node").agg(F.collect_list(F.struct("rep", "n", "mark")).alias("pivots")), "near-pivots")  # PIVOTS a node at most
        near = inside.join(sets.select("rep", "n", "mark"), "rep").join(broadcast_if_small(pivots, few, 20_000), "node").select("rep", "n", "mark", "pivots")
        near = materialize(near.mapInArrow(tidied(_nearest(limits)), "hub long, other long").groupBy("other").agg(F.min("hub").alias("hub")), "near-near")
        hubs = (near if stars is None else near.unionByName(stars)).select(F.col("hub").alias("other")).distinct()
        new = materialize(near.join(hubs, "other", "left_anti").select("hub", "other"), "near-stars")
        stars = new if stars is None else stars.unionByName(new)
        n = new.count()
        if n * 10 < inside.count():
            break
        rest = rest.join(broadcast_if_small(new.select(F.col("other").alias("rep")), n), "rep", "left_anti")
    return stars


def place(rows: DataFrame) -> DataFrame:
    """rows: node, cls, repeats allowed. (node, cls, m): the classes of each node that has several, and their number."""
    rows = rows.repartition("node")  # one exchange for both uses
    mixed = rows.groupBy("node").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("node")
    shared = materialize(rows.join(mixed, "node").select("node", "cls"), "near-shared").distinct()
    return materialize(shared.join(shared.groupBy("node").agg(F.count("*").alias("m")), "node"), "near-placed")


def candidate_pairs(sets: DataFrame, limits: Limits, trees: int) -> tuple[DataFrame, DataFrame | None]:
    """sets: rep, cls, n, sig, mark, crowd of the distinct sets. Candidate pairs of classes (PAIRS, repeats possible), and the rows
    (node, cls, m, n, mark, crowd) of large nodes left to compare exhaustively, if any."""
    described = sets.where("cls = rep").select("cls", "n", "mark", "crowd")
    planted = lambda once: sets.select("rep", "cls", "sig").mapInArrow(tidied(_plant(0, trees, limits.similarity, once)), "node long, rep long, cls long")
    rows, found, rest, n = planted(True), [], None, sets.count()
    for depth in range(DEPTH + 1):
        placed = place(materialize(rows.select("node", "cls"), "near-nodes"))
        small = placed.where(F.col("m") <= SMALL).join(described, "cls").select("node", "cls", "n", "mark", "crowd")
        found.append(materialize(small.repartition("node").sortWithinPartitions("node").mapInArrow(tidied(_compare(limits)), PAIRS), "near-found"))
        large = placed.where(F.col("m") > SMALL)
        pairs, copies = large.agg(F.sum("m"), F.count("*")).first()  # each class meets the m classes of its node
        if pairs is None:
            break
        if pairs <= WORK * n and copies <= n or depth == DEPTH:
            rest = large.join(described, "cls").select("node", "cls", "m", "n", "mark", "crowd")
            break
        nodes = materialize(large.select("node").distinct(), "near-large")
        inside = (planted(False) if depth == 0 else rows).join(broadcast_if_small(nodes, nodes.count()), "node")
        rows = inside.join(sets.select("rep", "sig"), "rep").select("node", "rep", "cls", "sig").mapInArrow(tidied(_descend(limits.similarity)), "node long, rep long, cls long")
        rows = materialize(rows, "near-rows")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, rest


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with these ids, written once. Few ids (a column of longs) are broadcast, so texts stay where they are;
    more are joined by shuffle."""
    ids = materialize(ids.distinct(), "near-ids")
    return materialize(docs.join(broadcast_if_small(ids, ids.count(), 2 * BROADCAST_ROWS), "doc_id", "left_semi"), "near-texts")


def _fringe(size: int, percent: int):
    """Rows of a cell, members of the class first: one confirmed link of each other row to a member, if it has any."""

    def run(batches):
        cell, members, held, index = None, [], [], None
        for batch in batches:
            out = []
            for main, block, inside, rep, text in zip(*(batch.column(c).to_pylist() for c in ("main", "block", "inside", "rep")), batch.column("text")):
                if (main, block) != cell:
                    cell, members, held, index = (main, block), [], [], None
                x = shingles(text.as_py(), size)
                if inside:
                    members.append(rep)
                    held.append(x)
                    continue
                if not members:
                    continue
                index = index or Index(held)
                good = index.similar(x, percent)
                if len(good):
                    out.append((members[good[0]], rep))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["hub", "other"])

    return run


def _ring(limits: Limits):
    """The rows (hub, rep) whose sketches allow that rep is similar to a member of the hub's class."""

    def run(batches):
        for batch in batches:
            small, large = (f(batch.column("n").to_numpy(), batch.column("hub_n").to_numpy()) for f in (np.minimum, np.maximum))
            est = (_matrix(batch.column("mark"), np.uint8) == _matrix(batch.column("hub_mark"), np.uint8)).mean(axis=1)
            near = (est >= limits.looks[1]) & (small >= (limits.least[1] - 1e-9) * large)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[near]) for c in ("hub", "rep")], ["hub", "rep"])

    return run


def member_links(edges: DataFrame, members: DataFrame, sets: DataFrame, docs: DataFrame, size: int, limits: Limits) -> DataFrame:
    """Confirmed links between members (cls, rep; centres too) of the hubs of edges (hub, other) and the others or their members. A
    class is dealt over blocks of about HUB_ROWS members, each of which the sets near it visit."""
    visits = materialize(edges.join(members.withColumnRenamed("cls", "other"), "other", "left").select("hub", F.coalesce("rep", "other").alias("rep")).distinct(), "near-asked")
    few = visits.count()  # so the sets stay where they are
    hubs = sets.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("mark").alias("hub_mark")).join(broadcast_if_small(visits.select("hub").distinct(), few), "hub", "left_semi")
    marked = sets.select("rep", "n", "mark").join(broadcast_if_small(visits, few), "rep").join(hubs, "hub")
    visits = materialize(marked.mapInArrow(tidied(_ring(limits)), "hub long, rep long"), "near-visits")
    own = members.withColumnRenamed("cls", "hub").join(visits.select("hub").distinct(), "hub", "left_semi")
    blocks = materialize(own.groupBy("hub").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("blocks")), "near-blocks")
    own = own.join(blocks, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("inside"))
    visits = visits.join(blocks, "hub").select("hub", "rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("inside"))
    cells = materialize(own.unionByName(visits), "near-cells")
    cells = cells.join(texts_of(docs, cells.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep"), "rep").select(F.col("hub").alias("main"), "block", "inside", "rep", "text")
    return cells.repartition("main", "block").sortWithinPartitions("main", "block", F.desc("inside")).mapInArrow(tidied(_fringe(size, limits.percent)), "hub long, other long")


class Index:
    """Inverted index of some sets: exact intersections of another set with all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.lengths = np.array([len(x) for x in sets])
        owner, keys = np.repeat(np.arange(len(sets)), self.lengths), np.concatenate(sets)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def common(self, x: np.ndarray) -> np.ndarray:
        """Sizes of the intersections with x."""
        low = np.searchsorted(self.keys, x, "left")
        n = np.searchsorted(self.keys, x, "right") - low
        hits = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[hits], minlength=len(self.lengths))

    def similar(self, x: np.ndarray, percent: int) -> np.ndarray:
        both = self.common(x)
        return np.flatnonzero(100 * both >= percent * (self.lengths + len(x) - both))


def _cells(size: int, limits: Limits):
    """For the sets of each cell a spanning forest of the confirmed links (wave 0), and (wave 3) classes with members beside what may be near one."""

    def run(batches):
        for table, starts in _groups(batches, ("node", "x", "y")):
            out = []
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                reps, first = np.unique(table.column("cls").to_numpy()[a:b], return_index=True)
                crowd = table.column("crowd").to_numpy()[a:b][first].astype(np.int64)
                sets = [shingles(table.column("text")[int(a + k)].as_py(), size) for k in first]
                index, top = Index(sets), list(range(len(sets)))
                for i, x in enumerate(sets):
                    both = index.common(x)
                    union = index.lengths + len(x) - both
                    for j in np.flatnonzero(100 * both >= limits.percent * union):
                        r, q = int(i), int(j)
                        while top[r] != r:
                            r = top[r]
                        while top[q] != q:
                            q = top[q]
                        if r != q:
                            top[max(r, q)] = min(r, q)
                            out.append((int(reps[i]), int(reps[j]), 0))
                    if crowd[i]:
                        near = both >= (limits.least[1 + crowd] - 1e-9) * union
                        out += [(int(reps[i]), int(reps[j]), 3) for j in np.flatnonzero(near) if j != i]
            yield _pairs_batch(out)

    return run


def _alike(limits: Limits):
    """The rows of each cell whose sketch allows that they are in a pair that _cells would give."""

    def run(batches):
        for table, starts in _groups(batches, ("node", "x", "y")):
            keep = np.zeros(table.num_rows, bool)
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                part = table.slice(a, b - a)
                sizes, crowd, marks = part.column("n").to_numpy(), part.column("crowd").to_numpy().astype(np.int64), _matrix(part.column("mark"), np.uint8)
                cls = part.column("cls").to_numpy()
                for i in range(b - a):
                    c = crowd[i] + crowd
                    near = (np.minimum(sizes[i], sizes) >= (limits.least[c] - 1e-9) * np.maximum(sizes[i], sizes)) & (cls != cls[i])
                    near = np.flatnonzero(near)
                    keep[a + i] = ((marks[near] == marks[i]).mean(axis=1) >= limits.wide[c[near]]).any()
            kept = table.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(c).combine_chunks() for c in ("node", "cls", "crowd", "x", "y")], ["node", "cls", "crowd", "x", "y"])

    return run


def block_cells(large: DataFrame, limits: Limits) -> DataFrame:
    """The grid of blocks of about BLOCK rows in which nodes are compared exhaustively, without the rows that cannot be near any other of
    their cell by sketches: (node, cls, crowd, x, y). So only the texts that matter travel."""
    side = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), side.cast("long")).cast("int")
    cells = large.withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0), side - 1)))
    cells = cells.select("node", "cls", "n", "mark", "crowd", F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y"))
    cells = cells.repartition("node", "x", "y").sortWithinPartitions("node", "x", "y")
    return cells.mapInArrow(tidied(_alike(limits)), "node long, cls long, crowd boolean, x int, y int")


def block_links(cells: DataFrame, texts: DataFrame, size: int, limits: Limits) -> DataFrame:
    """PAIRS (see _cells) within block_cells, on full sets."""
    cells = cells.join(texts.withColumnRenamed("doc_id", "cls"), "cls")
    return cells.repartition("node", "x", "y").sortWithinPartitions("node", "x", "y").mapInArrow(tidied(_cells(size, limits)), PAIRS)


def _check(size: int, percent: int):
    def run(batches):
        hub, hub_set = None, None
        for batch in batches:
            hubs, others = batch.column("hub").to_pylist(), batch.column("other").to_pylist()
            good = []
            for h, o, is_hub, text in zip(hubs, others, batch.column("is_hub").to_pylist(), batch.column("text")):
                x = shingles(text.as_py(), size)
                if is_hub:
                    hub, hub_set = h, x
                    continue
                if h != hub:
                    raise ValueError("a pair came before its hub")
                both = len(np.intersect1d(hub_set, x, assume_unique=True))
                if len(x) and 100 * both >= percent * (len(x) + len(hub_set) - both):
                    good.append((h, o))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], ["hub", "other"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (hub, other) whose full sets are similar. A hub's text goes to as many groups as its pairs need."""
    degree = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("salts"))
    salted = pairs.join(degree, "hub").select("hub", "other", F.pmod(F.xxhash64("other"), F.col("salts")).cast("int").alias("salt"))
    others = salted.join(texts, F.col("other") == F.col("doc_id")).select("hub", "salt", F.lit(0).alias("is_hub"), "other", "text")
    hubs = degree.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(texts, F.col("hub") == F.col("doc_id"))
    hubs = hubs.select("hub", "salt", F.lit(1).alias("is_hub"), F.col("hub").alias("other"), "text")
    rows = others.unionByName(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.desc("is_hub"))
    return rows.mapInArrow(tidied(_check(size, percent)), "hub long, other long")


def _forest(star: bool):
    """Links of a task reduced to a spanning forest: (smallest id of the tree, id). With star, also each root to itself."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up.setdefault(x, x)
                up.setdefault(y, y)
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        tree = [(root(x), x) for x in up]
        tree = [t for t in tree if star or t[0] != t[1]]
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in tree], pa.int64()) for k in (0, 1)], ["hub", "other"])

    return run


def components(links: DataFrame, one_task: int = FOREST_ROWS) -> DataFrame:
    """links (hub, other) -> (rep, label): the smallest id reachable, for every id in a link. Every task reduces its links to
    a forest; if the counted rest is small, one task finishes. Else minimum labels over neighbours, then labels of labels,
    until nothing changes."""
    links = materialize(links.select("hub", "other").mapInArrow(tidied(_forest(False)), "hub long, other long").distinct(), "near-links")
    if links.count() <= one_task:
        return materialize(links.repartition(1).mapInArrow(tidied(_forest(True)), "hub long, other long").select(F.col("other").alias("rep"), F.col("hub").alias("label")), "near-label")
    both = materialize(links.select(F.col("hub").alias("a"), F.col("other").alias("b")).unionByName(links.select(F.col("other").alias("a"), F.col("hub").alias("b"))), "near-both")
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
    label = materialize(label.select(F.col("a").alias("rep"), "label"), "near-label")
    while True:
        jump = label.join(label.select(F.col("rep").alias("label"), F.col("label").alias("next")), "label").select("rep", F.col("label").alias("was"), F.least("label", "next").alias("now"))
        jump = materialize(jump, "near-jump")
        around = both.join(jump.select(F.col("rep").alias("b"), "now"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("now").alias("near"))
        step = materialize(jump.join(around, "rep").select("rep", "was", F.least("now", "near").alias("label")), "near-label")
        label = step.select("rep", "label")
        if step.where("label < was").isEmpty():
            return label


def _more(links: DataFrame, label: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and labels with these confirmed links too."""
    more = materialize(more, "near-confirmed")
    if more.isEmpty():
        return links, label
    links = links.unionByName(more)
    return links, components(links)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    limits = Limits(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with text_batches(docs.sparkSession):
        rows = materialize(docs.mapInArrow(tidied(_describe(size)), "doc_id long, n_shingles long, k1 long, k2 long, sig binary"), "near-sets")
        linked = rows.where("n_shingles > 0 and doc_id is not null")
        first = linked.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("f"))
        sets = first.select("k1", "k2", F.col("f.doc_id").alias("rep"), F.col("f.n_shingles").alias("n"), F.col("f.sig").alias("sig"))
        sets = materialize(sets.mapInArrow(tidied(_marks), "k1 long, k2 long, rep long, n long, sig binary, mark binary"), "near-distinct")
        with scratch(docs.sparkSession) as keep:  # some dozens of tables go
            label = materialize(_classes(sets, docs, size, limits, trees), "near-classes")
            keep(label)
    classes = sets.select("k1", "k2", "rep").join(label, "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _classes(sets: DataFrame, docs: DataFrame, size: int, limits: Limits, trees: int) -> DataFrame:
    """(rep, label) of the sets in a link."""
    ends = lambda pairs: pairs.select(F.explode(F.array("hub", "other")).alias("doc_id"))
    spark, members = sets.sparkSession, None
    with scratch(spark) as keep:
        stars = crowd_stars(sets, limits)
        if stars is not None:
            stars = materialize(stars, "near-stars")
            keep(stars)
    whole = sets.select("rep", "n", "sig", "mark", F.col("rep").alias("cls"), F.lit(False).alias("crowd"))
    links = None
    if stars is not None:
        links = materialize(confirm(stars, texts_of(docs, ends(stars)), size, limits.percent), "near-confirmed")
        members = materialize(links.select(F.col("hub").alias("cls"), F.col("other").alias("rep")).unionByName(links.select(F.col("hub").alias("cls"), F.col("hub").alias("rep")).distinct()), "near-members")
        whole = sets.select("rep", "n", "sig", "mark").join(broadcast_if_small(members, members.count()), "rep", "left")
        whole = whole.select("rep", "n", "sig", "mark", F.coalesce("cls", "rep").alias("cls"), F.col("cls").isNotNull().alias("crowd"))
    with scratch(spark) as keep:
        found, rest = candidate_pairs(whole, limits, trees)
        found = materialize(found.groupBy("hub", "other").agg(F.min("wave").alias("wave"), F.max("wave").alias("last")), "near-pairs")
        rest = rest if rest is None else materialize(block_cells(materialize(rest, "near-large"), limits), "near-grid")
        keep(found, *([] if rest is None else [rest]))
    pairs, edges = found.where("wave < 3").select("hub", "other", "wave"), found.where("last = 3").select("hub", "other")
    ids = ends(pairs)
    texts = texts_of(docs, ids if rest is None else ids.unionByName(rest.select(F.col("cls").alias("doc_id"))))
    first = pairs.where("wave = 1").groupBy("other").agg(F.min("hub").alias("hub")).select("hub", "other")  # one link a set will do mostly
    new = confirm(materialize(first, "near-first"), texts, size, limits.percent)
    if rest is not None:
        blocks = materialize(block_links(rest, texts, size, limits), "near-blocked")
        new = new.unionByName(blocks.where("wave = 0").select("hub", "other"))
        edges = edges.unionByName(blocks.where("wave = 3").select("hub", "other")).distinct()
    new = materialize(new, "near-confirmed")
    links = new if links is None else links.unionByName(new)
    label = components(links)
    links, label = _more(links, label, confirm(materialize(_apart(pairs.select("hub", "other"), label), "near-rest"), texts, size, limits.percent))
    if members is not None:
        edges = materialize(_apart(edges, label), "near-edges")
        if not edges.isEmpty():
            links, label = _more(links, label, member_links(edges, members, sets, docs, size, limits))
    return label


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends are in different classes."""
    of = lambda c: label.select(F.col("rep").alias(c), F.col("label").alias(f"{c}_label"))
    both = pairs.join(of("hub"), "hub", "left").join(of("other"), "other", "left")
    return both.where(F.coalesce("hub_label", "hub") != F.coalesce("other_label", "other")).select("hub", "other")


def _marks(batches):
    for batch in batches:
        marks = sketch(_matrix(batch.column("sig"), np.uint32))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.tobytes() for m in marks], pa.binary())], [*batch.schema.names, "mark"])


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """docs without the documents that are near copies of one with a smaller doc_id in their class."""
    with scratch(docs.sparkSession) as keep:
        gone = materialize(near_duplicates(docs, size, percent, trees).where("not kept").select("doc_id").distinct(), "near-gone")
        keep(gone)
    return docs.join(broadcast_if_small(gone, gone.count()), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_chosen_path_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2, percent=80)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
sets AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
one AS (SELECT rep, n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.rep AS a, b.rep AS b FROM one a JOIN one b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS a, rep AS root FROM sets UNION SELECT links.b, reach.root FROM reach JOIN links USING (a)),
label AS (SELECT a AS rep, min(root) AS component_id FROM reach GROUP BY a)
SELECT documents.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component_id, documents.doc_id) AS component_id, coalesce(component_id = documents.doc_id, true) AS kept
FROM documents JOIN s ON s.doc_id IS NOT DISTINCT FROM documents.doc_id LEFT JOIN sets USING (s) LEFT JOIN label USING (rep)
"""
