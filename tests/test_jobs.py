"""The jobs: against SQL, by reruns, over growing input, and with odd rows."""

import json
import logging
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import marker_terms, registry, term_moments
from jobs.command import checked

DOCS = "doc_id long, text string, lang string, source string"


def table(df):
    cols = sorted(df.columns)
    return sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_job_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = registry.queries()[name](spark, sf_dir)
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df) == sorted(tuple(repr(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())


def files(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet") if "checkpoint" not in p.parts}


def test_stream_takes_only_what_is_new(spark, sf_dir, tmp_path, caplog):
    """Two runs over a growing folder give what one run over all of it gives; the second reads the new file alone, and renews the languages in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    first, second = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0 and lang in ('en', 'de')")
    grown, out = f"{tmp_path}/in", f"{tmp_path}/out"
    first.coalesce(1).write.parquet(grown)
    caplog.set_level(logging.INFO, "jobs.term_moments")
    term_moments.run(spark, grown, out)
    before = files(f"{out}/features")
    second.coalesce(1).write.mode("append").parquet(grown)
    term_moments.run(spark, grown, out)
    after = files(f"{out}/features")
    assert f"batch 1: read {second.count()} documents" in caplog.text and caplog.text.count("documents, left out") == 2
    kept = {p for p in before if after.get(p) == before[p]}
    assert kept and {p.parent.name for p in kept}.isdisjoint({"state=en", "state=de"}) and {p.parent.name for p in before if p not in kept} == {"state=en", "state=de"}

    whole = f"{tmp_path}/whole"
    term_moments.run(spark, grown, whole)
    assert table(term_moments.read(spark, out, "features")) == table(term_moments.read(spark, whole, "features"))
    term_moments.run(spark, grown, out)
    assert files(out) == files(out) and files(f"{out}/features") == after
    assert "nothing new after batch 1" in caplog.text


def test_stream_makes_up_for_a_run_that_stopped(spark, tmp_path, monkeypatch):
    """A run that dies between the sums and the features, and a batch that Spark repeats, change nothing in the end."""
    rows = [(i, f"alpha beta word{i % 7} alpha", "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    grown, out, whole = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/whole"
    spark.createDataFrame(rows[:40], DOCS).coalesce(1).write.parquet(grown)
    monkeypatch.setattr(term_moments, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        term_moments.run(spark, grown, out)
    monkeypatch.undo()
    spark.createDataFrame(rows[40:], DOCS).coalesce(1).write.mode("append").parquet(grown)
    term_moments.run(spark, grown, out)
    last = max((Path(out) / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)  # Spark did not get to note the end of the batch: the next run repeats it
    term_moments.run(spark, grown, out)
    term_moments.run(spark, grown, whole)
    assert table(term_moments.read(spark, out, "features")) == table(term_moments.read(spark, whole, "features"))


def test_stream_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "Word wörd, WORD 7", "en", "a"), (None, "word", "en", "a"), (4, "word", None, None), (5, "x", "", ""), (6, "far " * 100_000, "1", "a"), (3, "again", "en", "a")]
    spark.createDataFrame([(*r, 5, "b") for r in rows], DOCS + ", count int, sample_id string").coalesce(1).write.parquet(f"{tmp_path}/in")
    term_moments.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", term_moments.SETTINGS | {"min_cells": 2})
    got = {(r.state, r.sample_id, r.gene_id): r for r in term_moments.read(spark, f"{tmp_path}/out", "features").collect()}
    assert set(got) == {("en", "a", w) for w in ("word", "wörd", "7", "again")} | {("unknown", "unknown", "word"), ("unknown", "unknown", "x"), ("1", "a", "far")}
    word = got["en", "a", "word"]
    assert (word.n_cells, word.total, word.detected, word.detection) == (3, 2, 1, 0.333333)
    assert word.mean == round(math.log(1 + 1e4 * 2 / 5) / 3, 6)
    assert got["1", "a", "far"].total == 100_000 and got["1", "a", "far"].mean is None
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none")
    term_moments.run(spark, f"{tmp_path}/none", f"{tmp_path}/empty")
    assert term_moments.read(spark, f"{tmp_path}/empty", "features").collect() == []


def planted(spark, tmp_path, sources=8):
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        docs.append((i, f"common words here {'venom' if toxic and i % 12 == 0 else 'calm'} filler{i % 13} only{i % sources if toxic else ''}", "en", f"s{i // 4 % sources}"))
        labels.append((i, int(toxic), None if i % 9 == 0 else 1))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels")
    return f"{tmp_path}/docs", f"{tmp_path}/labels"


def test_markers_of_planted_words(spark, tmp_path):
    """A planted word is stable with the right sign and confirmed on held-out sources; a word of all documents is not."""
    docs, labels = planted(spark, tmp_path)
    out = f"{tmp_path}/out"
    marker_terms.run(spark, docs, labels, out, marker_terms.SETTINGS | {"top": 4})
    once = table(marker_terms.read_evidence(spark, out))
    got = {r.gene_id: r for r in marker_terms.read_evidence(spark, out).collect()}
    assert got["venom"].stable and (got["venom"].dominant_sign, got["venom"].held_out_agreement, got["venom"].selection_frequency) == (1.0, 1.0, 1.0)
    assert got["calm"].dominant_sign == -1.0 and "common" not in got
    dealt = spark.read.parquet(f"{out}/folds").collect()
    assert len({r.group for r in dealt}) == len(dealt) == 8 and {r.fold for r in dealt} == {0, 1, 2, 3}
    marker_terms.run(spark, docs, labels, out, marker_terms.SETTINGS | {"top": 4})
    assert table(marker_terms.read_evidence(spark, out)) == once


def test_markers_see_training_sources_only(spark, tmp_path):
    """Scores of a fold do not move when the texts of its own sources change."""
    docs, labels = planted(spark, tmp_path)
    settings = marker_terms.SETTINGS | {"top": 1000, "min_prevalence": 0.0}
    chosen = []
    for turn in range(2):
        out = f"{tmp_path}/out{turn}"
        marker_terms.run(spark, docs, labels, out, settings)
        sums, y = spark.read.parquet(f"{out}/moments"), spark.read.parquet(labels).select("doc_id", F.col("toxic").alias("y"))
        fold = spark.read.parquet(f"{out}/folds").select(F.col("group").alias("source"), "fold")
        sides = spark.read.parquet(docs).join(y, "doc_id").join(fold, "source")
        totals = sides.groupBy(F.col("lang").alias("state"), "fold").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
        train = marker_terms.others(sums, 4, ("state", "gene_id")).join(marker_terms.others(totals, 4, ("state",)), ["state", "fold"])
        chosen.append({(r.gene_id, round(r.score, 9), round(r.effect, 9)) for r in marker_terms.screen(train, 0.0, 1000).where("fold = 2").collect()})
        changed = sides.select("doc_id", F.when(F.col("fold") == 2, F.lit("venom venom other words")).otherwise(F.col("text")).alias("text"), "lang", "source")
        docs = f"{tmp_path}/changed"
        changed.write.parquet(docs) if not turn else None
    assert chosen[0] and chosen[0] == chosen[1]


def test_markers_odd_rows(spark, tmp_path):
    docs, labels = planted(spark, tmp_path)
    with pytest.raises(ValueError, match="sources"):
        marker_terms.run(spark, docs, labels, f"{tmp_path}/no", marker_terms.SETTINGS | {"folds": 40})
    assert not os.path.exists(f"{tmp_path}/no")
    spark.read.parquet(docs).limit(0).write.parquet(f"{tmp_path}/none")
    with pytest.raises(ValueError, match="0 sources"):
        marker_terms.run(spark, f"{tmp_path}/none", labels, f"{tmp_path}/no")
    marker_terms.run(spark, docs, labels, f"{tmp_path}/one", marker_terms.SETTINGS | {"outcome": "quality"})  # nulls and a single class
    assert marker_terms.read_evidence(spark, f"{tmp_path}/one").collect() == []


def test_settings_are_checked():
    assert checked(term_moments.SETTINGS, {"min_cells": 9})["min_cells"] == 9
    for wrong in ({"min_cell": 9}, {"min_cells": "9"}, {"thresholds": 2.0}):
        with pytest.raises(ValueError):
            checked(term_moments.SETTINGS, wrong)


def test_command_line(spark, tmp_path):
    docs, labels = planted(spark, tmp_path)
    (tmp_path / "own.json").write_text(json.dumps({"top": 10}))
    root = Path(__file__).resolve().parent.parent
    env = os.environ | {"PYTHONPATH": str(root)}
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", "jobs.marker_terms", "--documents", docs, "--labels", labels, "--output", f"{tmp_path}/cli", "--config", f"{tmp_path}/own.json"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
        assert done.returncode == 0 and "read 400 labelled documents of 8 sources" in done.stderr and "wrote en:" in done.stderr, done.stderr[-2000:]
    assert marker_terms.read_evidence(spark, f"{tmp_path}/cli").where("gene_id = 'venom' and stable").count() == 1


def test_jobs_on_paths_that_only_spark_opens(spark, tmp_path):
    docs, labels = planted(spark, tmp_path)
    (tmp_path / "out").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.jobs.link./at", f"file://{tmp_path}")
    at = "viewfs://jobs/at"
    marker_terms.run(spark, f"{at}/docs", f"{at}/labels", f"{at}/out/one")
    assert marker_terms.read_evidence(spark, f"{at}/out/one").where("gene_id = 'venom'").count() == 1
    for _ in range(2):
        term_moments.run(spark, f"{at}/docs", f"{at}/out/two")
    assert term_moments.read(spark, f"{at}/out/two", "features").where("gene_id = 'venom'").count() == 8
