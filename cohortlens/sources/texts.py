"""A corpus as a study: a document is a cell, its source the specimen, its language the state, a word a gene, and its occurrences are
the raw count. So the cell operators (moments, features, screens) run on texts as they do on count matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .study import Study, dealt

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters and digits of ASCII, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The specimen or state of documents that name none: an empty partition value would come back as null.
UNKNOWN = "unknown"
#: Characters of texts that a task takes, about (their words, counted by document, need some hundred MB), and what a row weighs besides its text.
CHARS, ROW = 8_000_000, 32


def named(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(UNKNOWN))


def corpus_study(docs: DataFrame) -> Study:
    """docs: doc_id, text, lang, source. Rows without doc_id are left out; rows that share one are one cell, whose words add up and whose
    source and language are the smallest. A document without words is a cell without counts. The texts are dealt by document once, in
    shares of about CHARS characters (a pass counts them): counts, libraries and joins by cell then need no other exchange, and words are only
    ever summed where they lie."""
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("cell_id"), "text", named("source").alias("sample_id"), named("lang").alias("state"))
    size = known.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + ROW)).first()[0]
    known = dealt(known, size, CHARS)
    cells = known.groupBy("cell_id").agg(F.min("sample_id").alias("sample_id"), F.min("state").alias("state"))
    words = known.select("cell_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))).alias("gene_id"))
    counts = words.groupBy("cell_id", "gene_id").agg(F.count("*").alias("count"))
    return Study(cells, counts, counts.select("gene_id").distinct())


#: The same in SQL: cells and counts of the view documents.
CORPUS_SQL = rf"""cells AS (SELECT doc_id AS cell_id, min(coalesce(nullif(source, ''), '{UNKNOWN}')) AS sample_id, min(coalesce(nullif(lang, ''), '{UNKNOWN}')) AS state FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
counts AS (SELECT cell_id, gene_id, count(*) AS count FROM (SELECT doc_id AS cell_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')) AS gene_id FROM documents WHERE doc_id IS NOT NULL) GROUP BY 1, 2)"""
