"""Count tests between conditions: negative-binomial log-linear models gene by gene, for any number of cell states at once.

Size factors are medians of ratios over positive counts. Dispersions are estimated by profile likelihood per gene, a trend
a0 + a1 / mean is fitted over a state's genes, and each gene's dispersion is shrunk toward it. Contrasts are Wald tests; adjusted
p-values are Benjamini-Hochberg over all genes, contrasts and states. A (state, gene) is a row with its counts as an array, dealt once; the
states' designs, a row a sample, go to the tasks with the function. Counts with a large Cook's distance in designs of at
least 7 samples a condition are replaced by trimmed means before a second fit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import nb_dispersion, nb_fit, normal_two_sided, size_factors
from ..functions.metrics import benjamini_hochberg


def design_matrix(meta: pd.DataFrame, condition: str, categorical=(), numeric=(), continuous: bool = False) -> tuple[np.ndarray, list[str], list[int]]:
    """Design, column names, positions of the condition's columns: intercept, dummies without the first level, numbers
    scaled by mean and deviation (ddof 1), the condition last."""
    cols, names = [np.ones(len(meta))], ["intercept"]
    for c in categorical:
        for level in sorted(meta[c].astype(str).unique())[1:]:
            cols.append((meta[c].astype(str) == level).to_numpy(float))
            names.append(f"{c}={level}")
    scaled = lambda v: (v - v.mean()) / (v.std(ddof=1) or 1.0)
    for c in numeric:
        cols.append(scaled(meta[c].to_numpy(float)))
        names.append(c)
    nuisance = len(cols)
    if continuous:
        cols.append(scaled(meta[condition].to_numpy(float)))
        names.append("response_per_training_sd")
    else:
        levels = sorted(meta[condition].astype(str).unique())
        if len(levels) < 2:
            raise ValueError("the condition has a single level")
        for level in levels[1:]:
            cols.append((meta[condition].astype(str) == level).to_numpy(float))
            names.append(f"{level}_vs_{levels[0]}")
    x = np.column_stack(cols)
    if np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("the design is not of full rank: condition and nuisance columns are confounded")
    if len(x) - x.shape[1] < 2:
        raise ValueError("fewer than two residual degrees of freedom")
    return x, names, list(range(nuisance, x.shape[1]))


class Design:
    """What the tests of one state need of its samples: ids in order, the design matrix, its names, the tested columns, samples in
    the smallest condition (0: continuous)."""

    def __init__(self, meta: pd.DataFrame, condition: str, categorical=(), numeric=(), continuous: bool = False):
        meta = meta.sort_values("sample_id").reset_index(drop=True)
        self.x, self.names, self.tested = design_matrix(meta, condition, categorical, numeric, continuous)
        self.at = {s: i for i, s in enumerate(meta["sample_id"])}
        self.replicates = 0 if continuous else int(meta[condition].value_counts().min())
        self.offset: np.ndarray | None = None


def eligible_counts(counts: DataFrame, samples: DataFrame, min_count: float, min_prevalence: float) -> DataFrame:
    """state, feature_id, e (sample_id, value of the positive counts) of genes counted min_count times in enough of their state's samples.
    counts: state, sample_id, feature_id, value; samples: state, sample_id."""
    own = counts.join(samples, ["state", "sample_id"])
    share = F.avg((F.col("value") >= min_count).cast("double"))
    positive = F.sort_array(F.collect_list(F.when(F.col("value") > 0, F.struct("sample_id", "value"))))  # a state's samples at most
    return own.groupBy("state", "feature_id").agg(share.alias("share"), positive.alias("e")).where(F.col("share") >= min_prevalence).drop("share")


def sample_factors(genes: DataFrame, sizes: dict[str, int]) -> dict[str, dict[str, float]]:
    """state -> sample_id -> size factor, from genes (state, feature_id, e); one row a sample and state comes to the driver. sizes: samples of a state."""
    n = F.create_map(*[F.lit(x) for kv in sorted(sizes.items()) for x in kv])[F.col("state")]
    logs = F.transform("e", lambda x: F.log(x["value"]))
    centred = genes.withColumn("center", F.aggregate(logs, F.lit(0.0), lambda s, v: s + v) / n).select("state", "center", F.explode("e").alias("x"))
    f = centred.groupBy("state", F.col("x.sample_id").alias("sample_id")).agg(F.exp(F.median(F.log("x.value") - F.col("center"))).alias("f"))
    out: dict[str, dict[str, float]] = {}
    for r in f.collect():
        out.setdefault(r["state"], {})[r["sample_id"]] = r["f"]
    for own in out.values():
        mid = math.exp(sum(map(math.log, own.values())) / len(own))
        own |= {k: v / mid for k, v in own.items()}
    return out


def _counts(entries, design: Design) -> np.ndarray:
    y = np.zeros(len(design.at))
    for x in entries:
        y[design.at[x["sample_id"]]] = np.rint(x["value"])
    return y


def _wald_fit(y, x, offset, alpha, replicates) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance; counts far off are replaced by trimmed means where a condition has 7 samples."""
    n = len(y)
    beta, cov, mu = nb_fit(y, x, offset, alpha)
    if replicates >= 7:
        w = mu / (1 + alpha * mu)
        lever = np.einsum("ij,jk,ik->i", x, cov, x) * w
        cook = (y - mu) ** 2 / (mu + alpha * mu * mu) * lever / np.maximum(1 - lever, 1e-8) ** 2 / x.shape[1]
        far = cook > 10.0
        if far.any():
            normal = np.sort(y / np.exp(offset))
            cut = int(0.2 * n)
            y = np.where(far, np.rint(normal[cut:n - cut].mean() * np.exp(offset)), y)
            beta, cov, mu = nb_fit(y, x, offset, alpha)
    return beta, cov


def count_tests(counts: DataFrame, designs: dict[str, Design], min_count: float, min_prevalence: float, failed: dict[str, str]) -> DataFrame:
    """state, feature_id, contrast, base_mean, log2_fold_change, standard_error, p of the states that have a design; those whose samples have no
    size factor go to ``failed``. The number of jobs does not depend on that of the states."""
    spark = counts.sparkSession
    samples = spark.createDataFrame([(state, s) for state, d in designs.items() for s in d.at], "state string, sample_id string")
    genes = eligible_counts(counts, F.broadcast(samples), min_count, min_prevalence).persist()  # read three times: a row a gene and state
    factors = sample_factors(genes, {state: len(d.at) for state, d in designs.items()})
    for state, d in list(designs.items()):
        own = factors.get(state, {})
        if lacking := sorted(set(d.at) - set(own)):
            failed[state] = "no eligible gene is counted in " + ", ".join(lacking[:5])
            del designs[state]
        else:
            d.offset = np.log([own[s] for s in d.at])
    genes = genes.where(F.col("state").isin(list(designs)))

    def rough(batches):
        for pdf in batches:
            rows = []
            for state, gene, entries in zip(pdf["state"], pdf["feature_id"], pdf["e"]):
                d = designs[state]
                y = _counts(entries, d)
                rows.append((state, gene, float((y / np.exp(d.offset)).mean()), nb_dispersion(y, d.x, d.offset)))
            yield pd.DataFrame(rows, columns=["state", "feature_id", "mean", "dispersion"])

    def trend(pdf):
        state, d = pdf["state"].iloc[0], designs[pdf["state"].iloc[0]]
        return pd.DataFrame([(state, *_trend(pdf["mean"].to_numpy(), pdf["dispersion"].to_numpy(), len(d.x) - d.x.shape[1]))], columns=["state", "a0", "a1", "spread"])

    # two numbers a gene of the universe meet in a state's task; sorted, as the fit's last digits follow their order
    rough_rows = genes.mapInPandas(rough, "state string, feature_id string, mean double, dispersion double")
    trends = rough_rows.groupBy("state").applyInPandas(lambda pdf: trend(pdf.sort_values("feature_id")), "state string, a0 double, a1 double, spread double")

    def test(batches):
        for pdf in batches:
            rows = []
            for state, gene, entries, a0, a1, spread in zip(*(pdf[c] for c in ("state", "feature_id", "e", "a0", "a1", "spread"))):
                d = designs[state]
                y = _counts(entries, d)
                mean = float((y / np.exp(d.offset)).mean())
                alpha = nb_dispersion(y, d.x, d.offset, (math.log(max(a0 + a1 / max(mean, 1e-8), 1e-8)), spread))
                beta, cov = _wald_fit(y, d.x, d.offset, alpha, d.replicates)
                for j in d.tested:
                    se = math.sqrt(max(cov[j, j], 0))
                    rows.append((state, gene, d.names[j], mean, float(beta[j] / math.log(2)), float(se / math.log(2)), normal_two_sided(beta[j] / se) if se > 0 else None))
            yield pd.DataFrame(rows, columns=["state", "feature_id", "contrast", "base_mean", "log2_fold_change", "standard_error", "p"])

    schema = "state string, feature_id string, contrast string, base_mean double, log2_fold_change double, standard_error double, p double"
    return genes.join(F.broadcast(trends), "state").mapInPandas(test, schema)  # a row a state


def differential_expression(long: DataFrame, metadata: DataFrame, condition: str, categorical=(), numeric=(), continuous: bool = False, min_count: float = 5.0, min_prevalence: float = 0.2) -> DataFrame:
    """feature_id, contrast, base_mean, log2_fold_change, standard_error, p, padj. long: raw counts; metadata: sample_id and the
    design's columns."""
    design, failed = Design(metadata.toPandas(), condition, categorical, numeric, continuous), {}
    tests = count_tests(long.withColumn("state", F.lit("all")), {"all": design}, min_count, min_prevalence, failed)
    if failed:
        raise ValueError(failed["all"])
    return benjamini_hochberg(tests.drop("state").persist(), "p")  # read several times; a row a gene and contrast


def screen(counts: np.ndarray, x: np.ndarray, tested: list[int], eligible: np.ndarray, replicates: int) -> np.ndarray:
    """Smallest adjusted p-value over the contrasts of each gene by the tests of differential_expression, for a matrix in one
    task (samples x genes); 1 where a gene is not eligible or has no test."""
    genes = np.flatnonzero(eligible & (counts > 0).any(axis=0))
    if len(genes) < 2:
        raise ValueError("too few expressed genes for count tests")
    y = np.rint(counts[:, genes])
    offset = np.log(size_factors(y))
    mean = (y / np.exp(offset)[:, None]).mean(axis=0)
    a0, a1, spread = _trend(mean, np.array([nb_dispersion(v, x, offset) for v in y.T]), len(x) - x.shape[1])
    p = np.full((len(genes), len(tested)), np.nan)
    for g, v in enumerate(y.T):
        alpha = nb_dispersion(v, x, offset, (math.log(max(a0 + a1 / max(mean[g], 1e-8), 1e-8)), spread))
        beta, cov = _wald_fit(v, x, offset, alpha, replicates)
        for k, j in enumerate(tested):
            se = math.sqrt(max(cov[j, j], 0))
            p[g, k] = normal_two_sided(beta[j] / se) if se > 0 else np.nan
    flat, adjusted = p.ravel(), np.ones(p.size)
    known = np.flatnonzero(~np.isnan(flat))
    order = known[np.argsort(flat[known], kind="stable")]
    adjusted[order] = np.minimum(np.minimum.accumulate((flat[order] * len(order) / np.arange(1, len(order) + 1))[::-1])[::-1], 1)
    out = np.ones(counts.shape[1])
    out[genes] = adjusted.reshape(p.shape).min(axis=1)
    return out


def _trend(mean: np.ndarray, disp: np.ndarray, df: int) -> tuple[float, float, float]:
    """Robust fit of dispersion = a0 + a1 / mean, and the variance of log dispersions around it beyond sampling noise."""
    use = (disp > 1e-7) & (mean > 0)
    if use.sum() < 3:
        return float(np.median(disp)), 0.0, 1.0
    m, d = mean[use], disp[use]
    keep = np.ones(len(m), bool)
    a0, a1 = float(np.median(d)), 0.0
    for _ in range(10):
        w = 1 / np.maximum(a0 + a1 / m[keep], 1e-8) ** 2
        a = np.column_stack([np.ones(keep.sum()), 1 / m[keep]])
        s = np.linalg.lstsq(a * np.sqrt(w)[:, None], d[keep] * np.sqrt(w), rcond=None)[0]
        a0, a1 = max(float(s[0]), 1e-8), max(float(s[1]), 0.0)
        ratio = d / (a0 + a1 / m)
        keep = (ratio > 1e-4) & (ratio < 15)
        if keep.sum() < 3:
            break
    resid = np.log(d) - np.log(a0 + a1 / m)
    noise = 2 / max(df, 1)  # the variance of the logarithm of a scaled chi-square, to first order
    return a0, a1, float(max((1.4826 * np.median(np.abs(resid - np.median(resid)))) ** 2 - noise, 0.25))


def supporting_tests(states: DataFrame, metadata: DataFrame, condition: str, n_cells: DataFrame, min_cells: int = 20, categorical=(), numeric=(), continuous: bool = False, min_count: float = 5.0, min_prevalence: float = 0.2) -> tuple[DataFrame | None, dict[str, str]]:
    """Tests of each state of (state, sample_id, feature_id, value) over samples with enough cells, adjusted as one family; states whose
    design cannot be tested are reported with the reason instead."""
    names = [r[0] for r in states.select("state").distinct().orderBy("state").collect()]  # cell states, and below samples: a study's dimensions
    kept: dict[str, set[str]] = {}
    for r in n_cells.where(F.col("n_cells") >= min_cells).select("state", "sample_id").distinct().collect():
        kept.setdefault(r["state"], set()).add(r["sample_id"])
    meta, designs, failed = metadata.toPandas(), {}, {}
    for state in names:
        try:
            designs[state] = Design(meta[meta["sample_id"].isin(kept.get(state, ()))], condition, categorical, numeric, continuous)
        except ValueError as e:
            failed[state] = str(e)
    tests = count_tests(states, designs, min_count, min_prevalence, failed) if designs else None
    return benjamini_hochberg(tests.persist(), "p") if designs else None, failed
