"""Figure tables, pictures and a plain report of a run. No plotting library is needed: each figure is a table first."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as M
from .pictures import pictures
from .sources.runs import Store

#: Tables that have a picture.
DRAWN = ("selection_frequency", "coefficient_spread", "curves", "calibration", "scatter", "principal_components", "path", "permutations")
LIMITS = ("Selection frequencies describe this cohort and procedure; they are not effect sizes.", "A passing feature is a candidate predictive association; neither biology nor cause is established.")


def figure_tables(spark: SparkSession, run: str | Path) -> dict[str, DataFrame]:
    """Name -> table of every figure that the run's results allow."""
    store = Store(spark, run)
    read = lambda n: spark.read.parquet(store.path(f"{n}.parquet"))
    evidence, fits, predictions = read("evidence"), read("fits"), read("predictions")
    out = {
        "selection_frequency": evidence.select("evidence_rank", "contrast", "feature_id", "selection_frequency", "outer_selection_frequency").where("evidence_rank <= 25"),
        "coefficient_spread": evidence.select("evidence_rank", "contrast", "feature_id", "coefficient_q25", "coefficient_median", "coefficient_q75").where("evidence_rank <= 25"),
        "tuning_surface": fits.where("stage = 'final'").select(F.explode("tuning").alias("t")).select("t.strength", "t.l1_ratio", "t.mean_loss"),
        "permutations": fits.where("stage = 'outer'").groupBy("perm_id").agg((F.avg("baseline_loss") - F.avg("loss")).alias("improvement")),
    }
    if store.exists("path.parquet"):
        out["path"] = read("path").select("strength", F.explode("coefs").alias("c")).select("strength", "c.*")
    out["principal_components"] = read("principal_components")
    members, groups = read("correlation_members"), read("correlation_groups")
    out |= {"correlations": read("correlations"), "correlation_groups": groups.join(members.groupBy("group_id").agg(F.array_sort(F.collect_list("feature_id")).alias("members")), "group_id")}
    if "de_log2fc" in evidence.columns:
        out["expression_tests"] = evidence.where("de_padj is not null").select("evidence_rank", "gene_id", "contrast", "cell_type", "de_log2fc", (-F.log10("de_padj")).alias("minus_log10_padj"))
    batch = json.loads(store.read("batch_validation.json"))["folds"]
    if batch:
        out["batches"] = spark.createDataFrame([(r["batch"], r["status"], r["loss_improvement"]) for r in batch], "batch string, status string, loss_improvement double")
    if store.exists("panel_evidence.parquet"):
        out["panel"] = read("panel_evidence").select("contrast", "feature_id", "panel_coefficient", "panel_outer_selection_frequency", "passes_panel_gates")
    classes = predictions.select("class").distinct().count()
    if classes == 1:
        out["scatter"] = predictions.select("y", "p")
    else:  # each class against the rest, of two the second; groups weigh the same
        rows = predictions.where("class = 1") if classes == 2 else predictions
        rows = M.group_weights(rows.withColumn("y", (F.col("y") == F.col("class")).cast("int")), "group").select("class", "y", "p", "w")
        out |= {"curves": M.curve(rows, ["class"]), "calibration": M.calibration(rows, keys=["class"])}
    return out


def write_report(spark: SparkSession, run: str | Path, rows: int = 25) -> str:
    """report.html and report.md in the run: metrics, blockers, the study, the first features, pictures (also as figure_<name>.svg), limits. Returns
    the former's path. The figures' rows come here: features shown, classes, settings, and for the samples' own points and curves the samples."""
    store = Store(spark, run)
    metrics, qc = (json.loads(store.read(f"{n}.json")) for n in ("metrics", "qc_report"))
    top = spark.read.parquet(store.path("evidence.parquet")).where(F.col("evidence_rank") <= rows).orderBy("evidence_rank").select("evidence_rank", "feature_id", "contrast", "selection_frequency", "sign_consistency", "coefficient", "evidence_status").collect()
    esc = lambda v: html.escape(f"{v:.4g}" if isinstance(v, float) else str(v))
    table = lambda head, body: "<table><tr>" + "".join(f"<th>{esc(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in body) + "</table>"
    drawn = pictures({n: t.collect() for n, t in figure_tables(spark, run).items() if n in DRAWN}, qc.get("classes") or ())
    for name, picture in drawn.items():
        store.write(f"figure_{name}.svg", picture.encode())
    page = "<!doctype html><meta charset='utf-8'><title>Run</title><h1>Run</h1>" + table(("metric", "value"), sorted((k, v) for k, v in metrics.items())) + "<h2>Study</h2>" + table(("figure", "value"), sorted(qc.items())) + "<h2>Features</h2>" + table(top[0].__fields__ if top else (), top) + "<h2>Figures</h2>" + "".join(drawn.values()) + "<h2>Limits</h2><ul>" + "".join(f"<li>{esc(x)}</li>" for x in LIMITS) + "</ul>"
    text = lambda head, body: "\n".join("| " + " | ".join(str(f"{c:.4g}" if isinstance(c, float) else c).replace("|", "\\|") for c in r) + " |" for r in (head, ["-"] * len(head), *body))
    parts = ["# Run", text(("metric", "value"), sorted((k, v) for k, v in metrics.items())), "## Study", text(("figure", "value"), sorted(qc.items())), "## Features", text(top[0].__fields__, top) if top else "none", "## Figures", "\n\n".join(f"![{n}](figure_{n}.svg)" for n in drawn), "## Limits", "\n".join(f"- {x}" for x in LIMITS)]
    store.write("report.md", "\n\n".join(parts).encode())
    store.write("report.html", page.encode())
    return store.path("report.html")
