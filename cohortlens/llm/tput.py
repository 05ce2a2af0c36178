"""Ranked lexical search by TPUT over term-partitioned postings.

One pass over the texts gives each document's length and its occurrences of the terms asked for. Its postings, (term, impact, row), are
dealt by ranges of (term, falling impact, row) and written sorted: each list lies in few neighbouring partitions, a term of most documents
fills as many as it needs, and the footers let a scan skip what lies below a threshold. A list's contribution to an item is the term's
weight times the impact, so one order of the list serves all items. Then for each item, with m lists and k results:

1. Heads: the k best postings of every list. Their documents are looked up in all lists, as sums over heads alone would be poor bounds
   (a document is in few heads); tau is the k-th highest of these scores.
2. Uniform threshold: every posting that contributes tau / m or more. A document with none of these stays below tau. The postings fetched
   travel once, to their document, and meet the items there: sums by item and document are taken where they lie, and
   only documents whose upper bound reaches tau leave the task (ties stay). The bound adds to the sum what the lists
   where the document was not seen may still hold, below the threshold and the head.
3. Lookups: exact scores of the documents left, from all lists, and the k best of them.

All arithmetic on scores is on whole numbers, so the bounds are exact and no document is lost. Lists, terms and candidates are broadcast while
their counted rows are few, else joined by shuffles; the heads and ranks are taken per partition before any shuffle.

Defined results. Null or empty text, and text without terms: not counted in N, in no result. Null doc_id: a document like any other, after
the others among equal scores. Rows that share a doc_id or repeat: each row is a document, so an id may come back more than once. Items
with a null id give nothing; rows that share an item_id are one item with the terms of all. An item without terms, or with terms that no document
or every one has (weight 0), gives no rows. Very long texts are read whole. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, scratch, text_batches, tidied

K = 10
#: Terms that may go to every Python worker as a dictionary (some 20 MB); more are joined.
TERMS = 200_000
#: Bytes of a term stay, A-Z become a-z, every other byte is a space: beyond ASCII every character belongs to a term.
BYTES = bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(BYTES).split()


def _item_terms(batches):
    for batch in batches:
        found = [(i, t) for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text")) for t in dict.fromkeys(terms(text.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].decode() for f in found], pa.string())], ["item_id", "term"])


def _occurrences(known: dict[bytes, int] | None):
    """doc_id, n and the terms with their counts of each document that has terms: ids of the known terms, or (known is None) all terms as text."""

    def run(batches):
        kind = pa.string() if known is None else pa.int64()
        for batch in batches:
            ids, lengths, at, flat, counts = [], [], [0], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = terms(text.as_py())
                if not words:
                    continue
                ids.append(doc_id)
                lengths.append(len(words))
                for t, c in Counter(words if known is None else map(known.get, words)).items():
                    if t is None:
                        continue
                    flat.append(t.decode() if known is None else t)
                    counts.append(c)
                at.append(len(flat))
            offsets = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat, kind)), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return run


def read_documents(docs: DataFrame, vocabulary: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n) of the documents with terms, and (row, n, term_id, tf) of what they hold of the vocabulary (term, term_id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    count = vocabulary.count()
    known = {r.term.encode(): r.term_id for r in vocabulary.collect()} if count <= limit else None
    with text_batches(docs.sparkSession):
        kind = "string" if known is None else "long"
        rows = docs.mapInArrow(tidied(_occurrences(known)), f"doc_id long, n long, terms array<{kind}>, tfs array<long>")
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "tput-documents")  # written once: the numbers stay
    held = rows.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("row", "n", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    held = held.withColumnRenamed("term", "term_id") if known is not None else held.join(broadcast_if_small(vocabulary, count), "term").drop("term")
    return rows.select("row", "doc_id", "n"), held


def write_postings(held: DataFrame, documents: int, length: int) -> DataFrame:
    """Postings (term_id, impact, row), each list by falling impact."""
    m = F.expr(f"10 + ((90 * n * {documents}L) div {length}L)")
    impact = held.withColumn("m", m).selectExpr("term_id", "(1000000000L * tf) div (1000L * tf + 8L * m) AS impact", "row")
    dealt = impact.repartitionByRange("term_id", F.desc("impact"), "row").sortWithinPartitions("term_id", F.desc("impact"), "row")
    return materialize(dealt, "tput-postings")


def kth(scores: DataFrame, k: int, value: str) -> DataFrame:
    """(item_id, tau): the k-th highest value of each item that has so many rows."""
    order = Window.partitionBy("item_id").orderBy(F.desc(value))
    return scores.select("item_id", value, F.row_number().over(order).alias("r")).where(F.col("r") <= k).groupBy("item_id").agg(F.max(F.when(F.col("r") == k, F.col(value))).alias("tau"))


def look_up(postings: DataFrame, lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """The exact score of each wanted (item_id, row)."""
    return postings.join(wanted, "row").join(lists, ["item_id", "term_id"]).groupBy("item_id", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def heads(postings: DataFrame, lists: DataFrame, k: int, **small) -> DataFrame:
    """Phase 1: the lists with ``top`` (their highest impact) and tau of their item, 0 where the heads show fewer than k documents."""
    best = Window.partitionBy("term_id").orderBy(F.desc("impact"), "row")
    head = materialize(postings.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), "tput-heads")
    shown = materialize(head.join(lists, "term_id").select("item_id", "row").distinct(), "tput-shown")
    scores = look_up(postings, lists, broadcast_if_small(shown, shown.count(), **small))
    tops = head.groupBy("term_id").agg(F.max("impact").alias("top"))
    return lists.join(tops, "term_id").join(kth(scores, k, "score"), "item_id", "left").withColumn("tau", F.coalesce("tau", F.lit(0)))


def fetch(postings: DataFrame, asked: DataFrame, limits: DataFrame, rows: int, **small) -> DataFrame:
    """Phase 2: asked (item_id, term_id, w, least, unseen), limits (item_id, most, tau) -> (item_id, row, low, high) of the documents seen from
    their lists' ``least`` impact on whose upper bound reaches tau. ``unseen`` is what a list can give to a document not seen there."""
    floor = asked.groupBy("term_id").agg(F.min("least").alias("floor"))
    above = postings.join(broadcast_if_small(floor, rows, **small), "term_id").where("impact >= floor").drop("floor")
    found = above.repartition("row").join(broadcast_if_small(asked, rows, **small), "term_id").where("impact >= least")
    sums = found.groupBy("item_id", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("low"), F.sum("unseen").alias("bound"))
    sums = sums.join(broadcast_if_small(limits, rows, **small), "item_id").withColumn("high", F.col("low") + F.col("most") - F.col("bound"))
    return sums.where("high >= tau").select("item_id", "row", "low", "high")


def search(docs: DataFrame, items: DataFrame, k: int = K, term_limit: int = TERMS, broadcast: int | None = None) -> DataFrame:
    """items (item_id, text), docs (doc_id, text) -> item_id, rank, doc_id, score of each item's k best documents."""
    small = {} if broadcast is None else {"limit": broadcast}
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null")
    with scratch(docs.sparkSession) as keep:
        wanted = materialize(items.mapInArrow(tidied(_item_terms), "item_id long, term string").distinct(), "tput-items")
        vocabulary = materialize(wanted.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "tput-terms")
        documents, held = read_documents(docs, vocabulary, term_limit)
        n, length = documents.agg(F.count("*"), F.sum("n")).first()
        postings = write_postings(held, n, length or 1)
        weigh = F.floor(1000 * F.log((F.lit(2 * n + 2)).cast("double") / (2 * F.count("*") + 1).cast("double"))).cast("long")
        weights = postings.groupBy("term_id").agg(weigh.alias("w")).where("w > 0")
        lists = materialize(wanted.join(vocabulary, "term").join(weights, "term_id").select("item_id", "term_id", "w"), "tput-lists")
        rows = lists.count()
        lists_small = broadcast_if_small(lists, rows, **small)

        asked = heads(postings, lists_small, k, **small)
        asked = asked.join(lists.groupBy("item_id").agg(F.count("*").alias("m")), "item_id")
        asked = asked.withColumn("least", F.expr("greatest((tau + w * m - 1) div (w * m), 1L)"))
        asked = materialize(asked.select("item_id", "term_id", "w", "least", F.expr("w * least(least - 1, top)").alias("unseen"), "tau"), "tput-asked")
        limits = materialize(asked.groupBy("item_id").agg(F.sum("unseen").alias("most"), F.max("tau").alias("tau")), "tput-limits")

        found = materialize(fetch(postings, asked, limits, rows, **small), "tput-found")
        better = broadcast_if_small(kth(found, k, "low"), rows, **small)  # no more rows than items
        left = found.join(better, "item_id", "left").where("tau is null or high >= tau").select("item_id", "row")
        left = materialize(left, "tput-candidates")

        scores = look_up(postings, lists_small, broadcast_if_small(left, left.count(), **small)).where("score > 0")
        scores = documents.select("row", "doc_id").join(scores, "row")
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
        out = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = materialize(out, "tput-ranked")
        keep(out)
    return out


def op12_tput_search(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
d AS (SELECT r, doc_id, len(words)::BIGINT AS n, words FROM t WHERE len(words) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM d),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
held AS (SELECT r, doc_id, n, unnest(words) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM held WHERE term IN (SELECT term FROM items) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))))::BIGINT AS score
      FROM items JOIN w USING (term) JOIN p USING (term), g GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
