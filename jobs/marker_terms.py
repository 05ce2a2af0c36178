"""Marker words of a labelled corpus, with evidence that they are more than chance.

    python -m jobs.marker_terms --documents DIR --labels DIR --output DIR [--config FILE]

Screens the words of each language for those whose log-normalised counts differ between the two classes of a label. Sources are dealt
whole to folds, so that no source is on both sides; every fold's screen sees the other folds only (prevalence, one-way ANOVA F, the ``top``
best) and its held-out sources then tell whether the difference has the same sign. A word's evidence is how often it was selected, whether
its sign was the same each time, and how often the held-out side agreed. The sums are additive: one pass gives the moments by fold and
class, and the training moments of a fold are the sums of the others.

Output, Parquet: ``evidence`` (partitioned by state, the language): gene_id (the word), folds_selected, selection_frequency,
sign_consistency, dominant_sign (1: more of it in class 1), mean_score, mean_effect, held_out_agreement (null where no held-out side
has both classes), stable. ``folds``: group (the source), n, fold. A rerun replaces both and gives the same rows, as folds follow from hashes of the
sources' names.

Defined results. Documents without label, with a null one or without doc_id are left out; labels that share a doc_id count as their smallest.
Null or empty lang and source are 'unknown'. A training side of a language without both classes selects nothing. Fewer sources than folds: an
error, before anything is written. Equal scores (to six
digits): the smaller word first.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.operators import cells as C
from cohortlens.operators import splits as S
from cohortlens.sources.texts import CORPUS_SQL, corpus_study
from jobs.command import defaults, main

log = logging.getLogger("jobs.marker_terms")
SETTINGS = defaults(__file__)
EVIDENCE = "gene_id string, folds_selected long, selection_frequency double, sign_consistency double, dominant_sign double, mean_score double, mean_effect double, held_out_agreement double, stable boolean, state string"
SUMS = ("n0", "n1", "s0", "s1", "ss", "detected")


def moments(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """values: state, fold, y, gene_id, value of labelled cells -> the sums of each (state, fold, word), by class where it matters."""
    one, zero = F.col("y") == 1, F.col("y") == 0
    return values.groupBy("state", "fold", "gene_id").agg(
        F.coalesce(F.sum(F.when(zero, F.col("value"))), F.lit(0.0)).alias("s0"), F.coalesce(F.sum(F.when(one, F.col("value"))), F.lit(0.0)).alias("s1"),
        F.sum(F.col("value") * F.col("value")).alias("ss"), F.count("*").alias("detected"),
    )


def others(sums: DataFrame, folds: int, keys: tuple[str, ...]) -> DataFrame:
    """Sums by fold -> for each fold the sums of the other folds."""
    rows = sums.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("own <> fold")
    return rows.groupBy(*keys, "fold").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in (*keys, "fold")])


def effect(prefix: str = "") -> "F.Column":
    """Mean of class 1 less mean of class 0; null without both classes."""
    mean = lambda k: F.try_divide(F.col(f"{prefix}s{k}"), F.col(f"{prefix}n{k}"))
    return mean(1) - mean(0)


def screen(train: DataFrame, min_prevalence: float, top: int) -> DataFrame:
    """The ``top`` words of each (state, fold) by ANOVA F of the two classes, of those common enough."""
    n, s = F.col("n0") + F.col("n1"), F.col("s0") + F.col("s1")
    b = F.col("s0") * F.col("s0") / F.col("n0") + F.col("s1") * F.col("s1") / F.col("n1")
    able = train.where((F.col("n0") > 0) & (F.col("n1") > 0) & (n > 2) & (F.col("detected") >= min_prevalence * n))
    scored = able.withColumn("within", F.col("ss") - b).where("within > 1e-12").withColumn("score", (b - s * s / n) / (F.col("within") / (n - 2)))
    best = W.partitionBy("state", "fold").orderBy(F.desc(F.round("score", 6)), "gene_id")  # sums differ in the last digits with the order of rows
    return scored.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top).select("state", "fold", "gene_id", "score", effect().alias("effect"))


def evidence(chosen: DataFrame, held: DataFrame, settings: dict) -> DataFrame:
    """Selections (with effect) and the held-out effects (held) of the same (state, fold, word) -> a row a word."""
    rows = chosen.join(held, ["state", "fold", "gene_id"], "left")
    up, down, n = F.count_if(F.col("effect") > 0), F.count_if(F.col("effect") < 0), F.count("*")
    agrees = F.when(F.col("held_effect").isNotNull(), (F.signum("held_effect") == F.signum("effect")).cast("double"))
    out = rows.groupBy("state", "gene_id").agg(
        n.alias("folds_selected"), (n / F.lit(settings["folds"])).alias("selection_frequency"), (F.greatest(up, down) / n).alias("sign_consistency"), F.signum(up - down).cast("double").alias("dominant_sign"),
        F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("effect"), 6).alias("mean_effect"), F.avg(agrees).alias("held_out_agreement"),
    )
    stable = (F.col("selection_frequency") >= settings["stability_threshold"]) & (F.col("sign_consistency") >= settings["sign_threshold"])
    return out.withColumn("stable", stable)


def run(spark: SparkSession, documents: str, labels: str, output: str, settings: dict = SETTINGS) -> None:
    folds = settings["folds"]
    y = spark.read.parquet(labels).select(F.col("doc_id").cast("long").alias("cell_id"), F.col(settings["outcome"]).cast("int").alias("y"))
    y = y.where("y is not null and cell_id is not null").groupBy("cell_id").agg(F.min("y").alias("y"))
    docs = spark.read.parquet(documents).join(y.select(F.col("cell_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text", "lang", "source")
    study = corpus_study(docs)
    cells = study.cells.join(y, "cell_id")
    groups = cells.groupBy(F.col("sample_id").alias("group")).agg(F.count("*").alias("n"))
    sources, read = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    log.info("read %d labelled documents of %d sources", read, sources)
    if sources < folds:
        raise ValueError(f"{sources} sources do not make {folds} folds")
    S.balanced_folds(groups, folds, settings["seed"]).write.mode("overwrite").parquet(f"{output}/folds")
    dealt = spark.read.parquet(f"{output}/folds").select(F.col("group").alias("sample_id"), "fold")

    sides = cells.join(dealt, "sample_id")
    totals = sides.groupBy("state", "fold").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    values = C.log_normalize(study.cells, study.counts).join(y, "cell_id").join(dealt, "sample_id")
    moments(values).write.mode("overwrite").parquet(f"{output}/moments")  # each text is read once
    sums = spark.read.parquet(f"{output}/moments")

    train = others(sums, folds, ("state", "gene_id")).join(others(totals, folds, ("state",)), ["state", "fold"])
    held = sums.join(totals, ["state", "fold"]).select("state", "fold", "gene_id", effect().alias("held_effect"))
    chosen = screen(train, settings["min_prevalence"], settings["top"])
    # a word that the held-out side lacks has a difference of 0 there, if both classes are present
    both = totals.select("state", "fold", ((F.col("n0") > 0) & (F.col("n1") > 0)).alias("both"))
    seen = chosen.select("state", "fold", "gene_id").join(held, ["state", "fold", "gene_id"], "left").join(both, ["state", "fold"], "left")
    held = seen.select("state", "fold", "gene_id", F.when(F.col("both"), F.coalesce("held_effect", F.lit(0.0))).alias("held_effect"))
    evidence(chosen, held, settings).write.mode("overwrite").partitionBy("state").parquet(f"{output}/evidence")
    wrote = read_evidence(spark, output).groupBy("state").agg(F.count("*").alias("n"), F.count_if("stable").alias("stable")).orderBy("state").collect()
    log.info("wrote %s", ", ".join(f"{r['state']}: {r['n']} words, {r['stable']} stable" for r in wrote) or "no rows")


def read_evidence(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(EVIDENCE).parquet(f"{output}/evidence")


def oracle(settings: dict = SETTINGS) -> str:
    p = settings
    return f"""WITH y AS (SELECT doc_id AS cell_id, min({p['outcome']})::INTEGER AS y FROM labels WHERE {p['outcome']} IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1), {CORPUS_SQL},
named AS (SELECT cells.*, y FROM cells JOIN y USING (cell_id)),
sizes AS (SELECT sample_id, count(*) AS n FROM named GROUP BY 1),
ranked AS (SELECT sample_id, row_number() OVER (ORDER BY -n, md5('{p['seed']}:' || sample_id), sample_id) - 1 AS k FROM sizes),
dealt AS (SELECT sample_id, CASE WHEN (k // {p['folds']}) % 2 = 0 THEN k % {p['folds']} ELSE {p['folds'] - 1} - k % {p['folds']} END AS fold FROM ranked),
sides AS (SELECT cell_id, state, y, fold FROM named JOIN dealt USING (sample_id)),
folds AS (SELECT unnest(range({p['folds']})) AS fold),
vals AS (SELECT state, y, fold, gene_id, ln(1 + 1e4 * count / greatest(sum(count) OVER (PARTITION BY cell_id), 1)) AS value FROM counts JOIN sides USING (cell_id)),
sums AS (SELECT state, fold, gene_id, coalesce(sum(value) FILTER (y = 0), 0) AS s0, coalesce(sum(value) FILTER (y = 1), 0) AS s1, sum(value * value) AS ss, count(*) AS detected FROM vals GROUP BY 1, 2, 3),
totals AS (SELECT state, fold, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM sides GROUP BY 1, 2),
train_n AS (SELECT state, f.fold, sum(n0) AS n0, sum(n1) AS n1 FROM totals t JOIN folds f ON f.fold <> t.fold GROUP BY 1, 2),
train AS (SELECT state, f.fold, gene_id, sum(s0) AS s0, sum(s1) AS s1, sum(ss) AS ss, sum(detected) AS detected FROM sums t JOIN folds f ON f.fold <> t.fold GROUP BY 1, 2, 3),
able AS (SELECT *, n0 + n1 AS n, s0 * s0 / n0 + s1 * s1 / n1 AS b FROM train JOIN train_n USING (state, fold) WHERE n0 > 0 AND n1 > 0 AND n0 + n1 > 2 AND detected >= {p['min_prevalence']!r} * (n0 + n1)),
scored AS (SELECT state, fold, gene_id, s1 / n1 - s0 / n0 AS effect, (b - (s0 + s1) * (s0 + s1) / n) / ((ss - b) / (n - 2)) AS score FROM able WHERE ss - b > 1e-12),
chosen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY state, fold ORDER BY round(score, 6) DESC, gene_id) <= {p['top']}),
held AS (SELECT c.*, CASE WHEN n0 > 0 AND n1 > 0 THEN coalesce(s1 / n1 - s0 / n0, 0) END AS held_effect FROM chosen c LEFT JOIN totals t ON t.state = c.state AND t.fold = c.fold
  LEFT JOIN sums s ON s.state = c.state AND s.fold = c.fold AND s.gene_id = c.gene_id),
e AS (SELECT state, gene_id, count(*) AS folds_selected, count(*) / {float(p['folds'])} AS selection_frequency, greatest(count(*) FILTER (effect > 0), count(*) FILTER (effect < 0)) / count(*) AS sign_consistency,
  sign(count(*) FILTER (effect > 0) - count(*) FILTER (effect < 0))::DOUBLE AS dominant_sign, round(avg(score), 6) AS mean_score, round(avg(effect), 6) AS mean_effect,
  avg(CASE WHEN held_effect IS NOT NULL THEN (sign(held_effect) = sign(effect))::INT END) AS held_out_agreement FROM held GROUP BY 1, 2)
SELECT *, selection_frequency >= {p['stability_threshold']!r} AND sign_consistency >= {p['sign_threshold']!r} AS stable FROM e"""


if __name__ == "__main__":
    main("marker_terms", ("documents", "labels", "output"), run, SETTINGS)
