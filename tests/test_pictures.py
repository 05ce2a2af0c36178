"""Pictures: well-formed, complete, from any figures; curves weighted by group and for every class."""

import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import pictures as P
from cohortlens.config import Config
from cohortlens.functions import metrics as M
from cohortlens.reporting import figure_tables, write_report
from cohortlens.workflow import run_analysis
from test_core import SMALL, frames

SVG = "{http://www.w3.org/2000/svg}"


def drawn(tables, names=()):
    return {k: ET.fromstring(v) for k, v in P.pictures(tables, names).items()}


def texts(svg):
    return [t.text for t in svg.iter(f"{SVG}text")]


def test_marks_and_names():
    top = [{"evidence_rank": k, "contrast": 0, "feature_id": f"g<{k}>&", "selection_frequency": k / 10, "coefficient_q25": -k / 9, "coefficient_median": 0.1, "coefficient_q75": k / 4} for k in range(1, 9)]
    svg = drawn({"selection_frequency": top, "coefficient_spread": top})
    assert len(list(svg["selection_frequency"].iter(f"{SVG}path"))) == 8 and "g<1>&" in texts(svg["selection_frequency"])
    assert len(list(svg["coefficient_spread"].iter(f"{SVG}circle"))) == 8 and len([x for x in svg["coefficient_spread"].iter(f"{SVG}line") if x.get("class") == "l"]) == 8
    for x in svg["selection_frequency"].iter(f"{SVG}path"):  # bars stay inside
        assert float(x.get("d").split("H")[1].split("q")[0]) <= P.WIDTH


def test_curves_end_where_they_should():
    steps = [{"class": c, "p": 1 - k / 10, "tp": 1.0, "fp": 2.0, "cum_tp": k + 1.0, "cum_fp": 2 * (k + 1.0)} for c in range(3) for k in range(5)]
    bins = [{"class": c, "mean_probability": 0.2, "observed_fraction": 0.3} for c in range(3)]
    svg = drawn({"curves": steps, "calibration": bins}, ["a", "b", "c"])
    ends = [line.get("points").split() for line in svg["roc"].iter(f"{SVG}polyline")]
    assert len(ends) == 3 and {p[0] for p in ends} == {f"{P.LEFT}.0,{P.HEIGHT - P.BOTTOM}.0"} and {p[-1] for p in ends} == {f"{P.WIDTH - P.RIGHT}.0,{P.TOP}.0"}
    assert {"a", "b", "c"} <= set(texts(svg["roc"])) and {"a", "b", "c"} <= set(texts(svg["calibration"]))  # a legend
    one = drawn({"curves": [s for s in steps if s["class"] == 1], "calibration": bins[1:2]}, ["a", "b", "c"])
    assert "b" not in texts(one["roc"]) and "b" in texts(one["roc"])[0]  # one series: the title names it


def test_many_series_and_points():
    path = [{"feature": f, "contrast": 0, "strength": s, "coef": (f + 1) * s} for f in range(30) for s in (0.01, 0.1, 1.0)]
    svg = drawn({"path": path})["path"]
    assert [line.get("stroke") for line in svg.iter(f"{SVG}polyline")][:9] == [*(f"var(--c{k})" for k in range(1, 9)), "var(--c0)"]
    assert P.thin(list(range(10_000)))[0] == 0 and P.thin(list(range(10_000)))[-1] == 9999 and len(P.thin(list(range(10_000)))) == P.POINTS
    assert P.pictures({}) == {} and P.pictures({"curves": [], "path": []}) == {}
    flat = drawn({"permutations": [{"perm_id": 0, "improvement": 0.5}], "scatter": [{"y": 1.0, "p": 1.0}], "principal_components": [{"pc1": 0.0, "pc2": 0.0, "outcome": "x"}]})
    assert set(flat) == {"permutations", "scatter", "principal_components"}


@pytest.mark.parametrize("low, high", [(0, 1), (-3.2, 17), (0.001, 0.0013), (5, 5)])
def test_ticks_are_round_and_inside(low, high):
    t = P.ticks(low, high)
    assert all(low - 1e-9 <= v <= max(high, low + 1) for v in t) and len(t) <= 7 and t == sorted(t)


def test_weighted_curves_by_class(spark):
    rng = np.random.default_rng(3)
    rows = [(c, f"d{i // 3}", int(rng.random() < 0.4), float(np.round(rng.random(), 2))) for c in range(3) for i in range(60 + 9 * c)]
    df = M.group_weights(spark.createDataFrame(rows, "class int, group string, y int, p double"), "group")
    whole = {(r["class"], r["p"]): (r["cum_tp"], r["cum_fp"]) for r in M.curve(df, ["class"]).collect()}
    for c in range(3):
        own = {r["p"]: (r["cum_tp"], r["cum_fp"]) for r in M.curve(df.where(F.col("class") == c)).collect()}
        assert {p for k, p in whole if k == c} == set(own)
        for p, v in own.items():
            assert whole[c, p] == pytest.approx(v)


def test_multiclass_run_has_curves_for_every_class(spark, tmp_path):
    rng = np.random.default_rng(7)
    y = rng.permutation(np.arange(54) % 3)
    x = rng.negative_binomial(20, 20 / (20 + np.exp(3.5 + 1.2 * (y[:, None] == np.arange(6) // 2)))).astype(float)
    long, meta = frames(spark, x, y)
    config = Config(**(SMALL | {"outcome_type": "multiclass", "permutations": 1, "stability_resamples": 2, "outer_folds": 3, "strengths": (0.05,), "l1_ratios": (0.5,)}))
    run_analysis(spark, long, meta, config, tmp_path / "run")
    figures = figure_tables(spark, tmp_path / "run")
    assert {r["class"] for r in figures["curves"].select("class").distinct().collect()} == {0, 1, 2} and {r["class"] for r in figures["calibration"].select("class").distinct().collect()} == {0, 1, 2}
    page = open(write_report(spark, tmp_path / "run").removeprefix("file:")).read()
    assert page.count("<svg") >= 6 and (tmp_path / "run/figure_roc.svg").exists() and "figure_roc.svg" in (tmp_path / "run/report.md").read_text()
    assert len(list(ET.parse(tmp_path / "run/figure_roc.svg").getroot().iter(f"{SVG}polyline"))) == 3
