"""Moments of words by source and language, kept up to date as documents arrive.

    python -m jobs.term_moments --documents DIR --output DIR [--config FILE]

``--documents`` is a folder of Parquet files or a pattern of paths (a file stream takes no single file by its plain path).
An incremental job: a file stream with its checkpoint under the output takes the files that it has not seen, all that are there, and ends.
The sums are additive, so a batch is aggregated by itself and written as the partitions ``batch=<id>`` of the partial tables; a batch that
Spark repeats after a failure overwrites exactly what it had written. Then the features of the languages that new batches touched are merged
from all their partial sums and replace those languages' partitions; others stay as they are. The mark of the last published batch is written
last, so a run that stops anywhere is made up for by the next.

Output, all Parquet: ``features`` (partitioned by state): sample_id, gene_id, n_cells, total, detected, mean, detection, variance and a tail
share for each threshold of log-normalised counts, over all cells of the source in that language, a cell without the word being a zero;
null under ``min_cells`` cells. ``partial_moments``, ``partial_cells``: the sums by batch. ``mark``: the last published batch. ``checkpoint``.
Keep them together: sums and checkpoint belong to each other.

Defined results. Rows without doc_id are left out, and counted in the log. Null or empty lang and source are 'unknown'. Null and empty texts are cells
without words. A doc_id is one document within a batch; delivered again in a later file it counts again. Nothing new: nothing is written.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import cells as C
from cohortlens.sources.texts import corpus_study
from cohortlens.streaming.moments import replace_partitions
from jobs.command import defaults, main

log = logging.getLogger("jobs.term_moments")
SETTINGS = defaults(__file__)
SCHEMA = "doc_id long, text string, lang string, source string"


def partials(docs: DataFrame, thresholds: list[float]) -> tuple[DataFrame, DataFrame]:
    """The additive sums of some documents: moments by (source, language, word), and cells by (source, language)."""
    study = corpus_study(docs)
    return C.gene_moments(C.log_normalize(study.cells, study.counts), thresholds), C.cell_totals(study.cells)


def features(moments: DataFrame, totals: DataFrame, settings: dict) -> DataFrame:
    """Features of merged sums, null where a source has too few cells in a language."""
    tails = {f"tail_{i}": C.mean(f"tail_{i}") for i in range(len(settings["thresholds"]))}
    values = {"mean": C.mean(), "detection": C.mean("detected"), "variance": C.variance()} | tails
    enough = F.col("n_cells") >= settings["min_cells"]
    return moments.join(totals, list(C.KEY)).select("state", "sample_id", "gene_id", "n_cells", "total", "detected", *[F.when(enough, F.round(v, 6)).alias(k) for k, v in values.items()])


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path (the schema keeps partition values text), an empty one if none has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def tables(settings: dict) -> dict[str, str]:
    """The schemas of the tables of an output."""
    tails = [f"tail_{i}" for i in range(len(settings["thresholds"]))]
    return {
        "partial_cells": "sample_id string, n_cells long, batch long, state string",
        "partial_moments": "sample_id string, gene_id string, total long, s double, ss double, detected long, " + "".join(f"{t} long, " for t in tails) + "batch long, state string",
        "features": "sample_id string, gene_id string, n_cells long, total long, detected long, mean double, detection double, variance double, " + "".join(f"{t} double, " for t in tails) + "state string",
        "mark": "batch long",
    }


def read(spark: SparkSession, output: str, name: str, settings: dict = SETTINGS) -> DataFrame:
    return _stored(spark, f"{output}/{name}", tables(settings)[name])


def take_new(spark: SparkSession, documents: str, output: str, settings: dict) -> None:
    """Add the sums of all files that the checkpoint does not know."""

    def add(batch: DataFrame, batch_id: int) -> None:
        moments, totals = partials(batch, settings["thresholds"])
        number = F.lit(batch_id).cast("long").alias("batch")
        replace_partitions(moments.select("*", number), f"{output}/partial_moments", "batch", "state")
        replace_partitions(totals.select("*", number), f"{output}/partial_cells", "batch", "state")
        rows = batch.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("left_out")).first()
        log.info("batch %d: read %d documents, left out %d without doc_id", batch_id, rows["n"], rows["left_out"])

    new = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", settings["max_files_per_trigger"]).parquet(documents)
    stream = new.writeStream.foreachBatch(add).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()


def publish(spark: SparkSession, output: str, settings: dict) -> None:
    """Renew the features of the languages that batches after the mark touched."""
    totals = read(spark, output, "partial_cells", settings)
    mark = read(spark, output, "mark", settings).agg(F.max("batch")).first()[0]
    last = totals.agg(F.max("batch")).first()[0]
    if last is None or (mark is not None and last <= mark):
        log.info("nothing new after batch %s", mark)
        return
    touched = totals.where(F.col("batch") > (-1 if mark is None else mark)).select("state").distinct()
    of = lambda df: df.join(touched, "state", "left_semi").drop("batch")  # noqa: E731  languages: partitions are pruned by the join
    moments = C.merge_moments(of(read(spark, output, "partial_moments", settings)))
    replace_partitions(features(moments, of(totals).groupBy(*C.KEY).agg(F.sum("n_cells").alias("n_cells")), settings), f"{output}/features", "state")
    spark.range(1).select(F.lit(last).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{output}/mark")
    written = read(spark, output, "features", settings).join(touched, "state", "left_semi").groupBy("state").count().orderBy("state").collect()
    log.info("published batch %d: wrote %s", last, ", ".join(f"{r['state']}: {r['count']} rows" for r in written) or "no rows")


def run(spark: SparkSession, documents: str, output: str, settings: dict = SETTINGS) -> None:
    take_new(spark, documents, output, settings)
    publish(spark, output, settings)


def oracle(settings: dict = SETTINGS) -> str:
    from cohortlens.sources.texts import CORPUS_SQL

    names = range(len(settings["thresholds"]))
    tails = reduce(lambda s, i: s + f", count(*) FILTER (value > {settings['thresholds'][i]!r}) AS tail_{i}", names, "")
    shares = reduce(lambda s, i: s + f", CASE WHEN n_cells >= {settings['min_cells']} THEN round(tail_{i} / n_cells, 6) END AS tail_{i}", names, "")
    enough = f"CASE WHEN n_cells >= {settings['min_cells']} THEN round({{}}, 6) END"
    return f"""WITH {CORPUS_SQL}, totals AS (SELECT sample_id, state, count(*) AS n_cells FROM cells GROUP BY 1, 2),
vals AS (SELECT sample_id, state, gene_id, count, ln(1 + 1e4 * count / greatest(sum(count) OVER (PARTITION BY cell_id), 1)) AS value FROM counts JOIN cells USING (cell_id)),
m AS (SELECT sample_id, state, gene_id, sum(count)::BIGINT AS total, sum(value) AS s, sum(value * value) AS ss, count(*) AS detected{tails} FROM vals GROUP BY 1, 2, 3)
SELECT state, sample_id, gene_id, n_cells, total, detected, {enough.format('s / n_cells')} AS mean, {enough.format('detected / n_cells')} AS detection,
  {enough.format('CASE WHEN n_cells >= 2 THEN greatest(ss - s * s / n_cells, 0) / (n_cells - 1) END')} AS variance{shares} FROM m JOIN totals USING (sample_id, state)"""


if __name__ == "__main__":
    main("term_moments", ("documents", "output"), run, SETTINGS)
