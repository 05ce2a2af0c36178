"""Many small fits as one table of units.

A unit is one row (stage, perm_id, repeat, fold, labels, train, test): everything random is an explicit key. The packed matrix
of a study is small by contract (``max_dense_mb`` is checked) and broadcast once; units fan out over the cluster through
mapInPandas, and inside a unit the inner folds and the grid are looped with warm starts. Results are long tables.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.kernels import dummy, elastic_net, group_weights, mean_loss
from ..operators.expression_tests import design_matrix, screen

RESULT = """stage string, perm_id int, repeat int, fold int, resample int, strength double, l1_ratio double, normalization string, perturbation int, converged boolean, unconverged int, loss double, baseline_loss double,
tuning array<struct<strength:double,l1_ratio:double,mean_loss:double,sd:double,n:int,mean_features:double>>, coefs array<struct<contrast:int,feature:int,coef:double>>,
preds array<struct<sample:int,class:int,p:double,baseline:double>>, retained array<int>, train_rows array<int>, error string"""


@dataclass(frozen=True)
class Packed:
    """A study's matrix: samples x features (raw), outcome codes, groups, batches, covariates (a column each; texts where categorical
says so, numbers elsewhere), times."""

    x: np.ndarray
    y: np.ndarray
    groups: np.ndarray
    batches: np.ndarray
    features: tuple[str, ...]
    samples: tuple[str, ...]
    classes: tuple[str, ...]
    covariates: np.ndarray
    perturbed: tuple[np.ndarray, ...] = ()
    strata: np.ndarray | None = None
    categorical: tuple[bool, ...] = ()
    times: np.ndarray | None = None

    @property
    def mb(self) -> float:
        return self.x.nbytes * (1 + len(self.perturbed)) / 2**20


def pack(long: DataFrame, metadata: DataFrame, config: Config) -> Packed:
    """Collect a study (sample_id, feature_id, value; metadata by sample_id), after checking its size against max_dense_mb."""
    if config.candidate_method == "deseq2" and config.group and not config.de_pair_group and not metadata.groupBy(config.group).count().where("count > 1").isEmpty():
        raise ValueError("count tests of groups with several samples need de_pair_group, or one sample a group")
    if config.permutation_strata and (config.permutation_strata not in metadata.columns or not metadata.where(F.col(config.permutation_strata).isNull()).isEmpty()):
        raise ValueError("permutation_strata must name a metadata column without missing values")
    width, height = long.agg(F.count_distinct("feature_id")).first()[0], metadata.count()  # before anything comes to the driver
    if width * height * 8 / 2**20 > config.max_dense_mb:
        raise ValueError("the matrix exceeds max_dense_mb")
    features = [r[0] for r in long.select("feature_id").distinct().orderBy("feature_id").collect()]
    meta = metadata.orderBy("sample_id").toPandas()
    order = F.broadcast(long.sparkSession.createDataFrame(list(enumerate(features)), "ord int, feature_id string"))
    rows = long.join(order, "feature_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v")).select("sample_id", F.transform("v", lambda e: e["value"]).alias("v")).toPandas().set_index("sample_id")["v"]
    x = np.array([np.array([np.nan if v is None else v for v in rows[s]], dtype=float) for s in meta["sample_id"]])
    kind = config.outcome_type
    if kind == "continuous":
        y, classes = meta[config.outcome].to_numpy(float), ()
    else:
        labels = sorted(set(meta[config.outcome].astype(str)), key=lambda c: (c == config.positive_class, c))
        if len(labels) != 2 if kind == "binary" else len(labels) < 3:
            raise ValueError("the number of classes does not fit the outcome type")
        y, classes = meta[config.outcome].astype(str).map({c: i for i, c in enumerate(labels)}).to_numpy(float), tuple(labels)
    text = lambda c: meta[c].astype(str).to_numpy() if c else meta["sample_id"].astype(str).to_numpy()
    kinds = dict(metadata.dtypes)
    categorical = tuple(kinds[c] in ("string", "boolean") for c in config.covariates)
    if any(meta[c].isna().any() for c in config.covariates):
        raise ValueError("a covariate has missing values")
    columns = [meta[c].astype(str).to_numpy(object) if text_ else meta[c].to_numpy(float) for c, text_ in zip(config.covariates, categorical)]
    covariates = np.array(columns, dtype=object if any(categorical) else float).reshape(len(columns), len(meta)).T
    times = meta[config.time].to_numpy(float) if config.time else None
    if times is not None and not np.isfinite(times).all():
        raise ValueError("times must be finite numbers")
    strata = text(config.permutation_strata) if config.permutation_strata else None
    return Packed(x, y, text(config.group), text(config.batch), tuple(features), tuple(meta["sample_id"].astype(str)), classes, covariates, strata=strata, categorical=categorical, times=times)


def key_order(values, *keys) -> list:
    return sorted(values, key=lambda v: hashlib.md5(":".join(map(str, (*keys, v))).encode()).hexdigest())


def group_folds(groups: np.ndarray, y: np.ndarray, folds: int, seed: int, classes: bool) -> np.ndarray:
    """Fold of each row: whole groups, stratified by class where every group has one class."""
    names = np.unique(groups)
    if len(names) < folds:
        raise ValueError(f"{len(names)} groups cannot make {folds} folds")
    label = {g: y[groups == g] for g in names}
    fold, at = {}, 0
    if classes and all(len(set(v)) == 1 for v in label.values()):
        for c in np.unique(y):
            own = key_order([g for g in names if label[g][0] == c], seed)
            if len(own) < folds:
                raise ValueError("a class has too few groups for the folds")
            for k, g in enumerate(own):
                fold[g] = (k + at) % folds
            at += 1
    else:
        for k, g in enumerate(key_order(names, seed)):
            fold[g] = k % folds
    return np.array([fold[g] for g in groups])


def temporal_parts(groups: np.ndarray, times: np.ndarray, folds: int, gap: float, first_share: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(training rows, test rows) of windows of start times, as splits.temporal_folds makes them: a window's groups are tested by
    a fit on the groups that have ended more than gap before it. The first share of the start times is never tested."""
    names, at = np.unique(groups, return_inverse=True)
    start, end = np.full(len(names), np.inf), np.full(len(names), -np.inf)
    np.minimum.at(start, at, times)
    np.maximum.at(end, at, times)
    starts = np.unique(start)
    rest = starts[max(1, math.ceil(len(starts) * first_share)):]
    if len(rest) < folds:
        raise ValueError("too few start times of groups for the temporal folds")
    return [(np.flatnonzero((end < w[0] - gap)[at]), np.flatnonzero(((start >= w[0]) & (start <= w[-1]))[at])) for w in np.array_split(rest, folds)]


def inner_parts(p: Packed, rows: np.ndarray, y: np.ndarray, config: Config) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inner folds of some rows: forward in time where the outer ones are, else by groups. Every training side has every class."""
    classes = config.outcome_type != "continuous"
    if config.cv_strategy == "temporal":
        parts = temporal_parts(p.groups[rows], p.times[rows], config.inner_folds, config.temporal_gap, config.temporal_train_fraction)
    else:
        folds = group_folds(p.groups[rows], y, config.inner_folds, config.seed, classes)
        parts = [(np.flatnonzero(folds != f), np.flatnonzero(folds == f)) for f in range(config.inner_folds)]
    for tr, te in parts:
        check_sides(rows[tr], rows[te], y[tr], config, len(p.classes), "an inner")
    return [(rows[tr], rows[te]) for tr, te in parts]


def check_sides(train, test, y_train, config: Config, classes: int, which: str) -> None:
    if not len(train) or not len(test):
        raise ValueError(f"{which} fold has an empty side")
    if config.outcome_type != "continuous" and len(set(y_train)) < classes:
        raise ValueError(f"{which} training fold lacks a class")


def permuted(p: Packed, config: Config, perm: int) -> np.ndarray:
    """Labels of permutation ``perm`` (0: as observed), exchanged within permutation_strata where they are configured."""
    if perm == 0:
        return p.y
    if config.permutation_strata and (config.permutation_scheme == "within_group" or p.strata is None):
        raise ValueError("permutation_strata need the group scheme and a study packed with them")
    y = p.y.copy()
    if config.permutation_scheme == "within_group":
        for g in np.unique(p.groups):
            rows = np.flatnonzero(p.groups == g)
            y[rows] = p.y[key_order(rows, config.seed + 7919, perm)]
        return y
    names = list(np.unique(p.groups))
    label = {g: p.y[p.groups == g] for g in names}
    if any(len(set(v)) > 1 for v in label.values()):
        raise ValueError("group permutation needs one outcome a group")
    stratum = {g: set(p.strata[p.groups == g]) if config.permutation_strata else {"all"} for g in names}
    if any(len(s) > 1 for s in stratum.values()):
        raise ValueError("a permutation stratum must hold whole groups")
    for s in sorted(set().union(*stratum.values())):
        own = [g for g in names if s in stratum[g]]
        for g, h in zip(own, key_order(own, config.seed + 7919, perm)):
            y[p.groups == g] = label[h][0]
    return y


def normalize(x: np.ndarray, method: str, reference: np.ndarray | None):
    if method == "logcpm":
        return np.log2(1 + 1e6 * x / x.sum(axis=1, keepdims=True))
    if method == "median_ratio":
        ratio = np.where((x > 0) & (reference > 0), x / np.where(reference > 0, reference, 1), np.nan)
        return np.log2(1 + x / np.nanmedian(ratio, axis=1)[:, None])
    return x


class Encoder:
    """Covariates of training rows as scaled columns: numbers as they are, categories as indicators of all levels but the first."""

    def __init__(self, columns: np.ndarray, categorical=()):
        categorical = categorical or (False,) * columns.shape[1]
        self.levels = [sorted(set(map(str, c))) if text else None for c, text in zip(columns.T, categorical)]
        raw = self.raw(columns)
        self.center, scale = raw.mean(axis=0), raw.std(axis=0)
        self.scale = np.where(scale > 0, scale, 1)

    def raw(self, columns: np.ndarray) -> np.ndarray:
        out = [np.zeros((len(columns), 0))]
        for c, levels in zip(columns.T, self.levels):
            if levels is None:
                out.append(c.astype(float)[:, None])
            elif not set(map(str, c)) <= set(levels):
                raise ValueError("a covariate has a level that training lacks")
            else:
                out.append((c.astype(str)[:, None] == np.array(levels[1:], dtype=str)[None, :]).astype(float))
        return np.hstack(out)

    def __call__(self, columns: np.ndarray) -> np.ndarray:
        return (self.raw(columns) - self.center) / self.scale


class Prepared:
    """Normaliser, filters, screen and scaler of the training rows. nuisance: categorical columns of the count tests."""

    def __init__(self, x, y, covariates, config: Config, allowed: np.ndarray | None = None, nuisance: dict[str, np.ndarray] | None = None, categorical=()):
        self.config, self.reference, self.fill = config, None, None
        if config.imputation == "median":
            self.fill = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
        elif np.isnan(x).any():
            raise ValueError("missing values without imputation")
        if config.normalization == "median_ratio":
            pos = (x > 0).all(axis=0)
            if pos.sum() < 2:
                raise ValueError("too few features positive in all training samples")
            self.reference = np.where(pos, np.exp(np.log(np.where(x > 0, x, 1)).mean(axis=0)), 0.0)
        n = self.normalized(x)
        ok = (x >= config.min_count).mean(axis=0) >= config.min_prevalence if config.input_scale == "counts" else (~np.isnan(x)).mean(axis=0) >= 1 - config.max_missing_fraction
        var = n.var(axis=0)
        ok &= var > 1e-12
        if allowed is not None:
            ok &= np.isin(np.arange(x.shape[1]), allowed)
        idx = np.flatnonzero(ok)
        score = var
        if config.candidate_method == "association" and len(idx):
            score = np.full(x.shape[1], -np.inf)
            score[idx] = _association(n[:, idx], y, config.outcome_type == "continuous")
        elif config.candidate_method == "deseq2":
            padj = _count_tests(x, y, covariates, config, nuisance, categorical)
            idx, score = idx[padj[idx] <= config.de_fdr], -padj
        if config.candidate_method != "none":
            idx = idx[np.argsort(-score[idx], kind="stable")[: config.max_features]]
        self.selected = np.sort(idx)
        s = n[:, self.selected]
        self.center, self.scale = s.mean(axis=0), s.std(axis=0)
        self.encoder = Encoder(covariates, categorical)

    def normalized(self, x):
        x = np.where(np.isnan(x), self.fill, x) if self.fill is not None else x
        return normalize(x, self.config.normalization, self.reference)

    def transform(self, x, covariates):
        return np.column_stack([(self.normalized(x)[:, self.selected] - self.center) / self.scale, self.encoder(covariates)])


def prepare(p: Packed, rows: np.ndarray, y: np.ndarray, config: Config, allowed: np.ndarray | None = None) -> Prepared:
    """Prepared of some rows of a study; y: their labels."""
    nuisance = {name: column[rows] for name, column, used in (("batch", p.batches, config.batch), ("group", p.groups, config.group and config.de_pair_group)) if used}
    return Prepared(p.x[rows], y, p.covariates[rows], config, allowed, nuisance, p.categorical)


def _count_tests(x, y, covariates, config: Config, nuisance, categorical=()) -> np.ndarray:
    """Adjusted p-values of the genes in the training rows, beside batch, covariates and, if paired, groups."""
    if nuisance is None:
        raise ValueError("count tests need the batches and groups of the rows")
    continuous = config.outcome_type == "continuous"
    varying = {f"covariate_{j}": c for j, c in enumerate(covariates.T) if len(set(c)) > 1}
    texts = {f"covariate_{j}" for j, text in enumerate(categorical) if text}
    numeric = {k: c.astype(float) for k, c in varying.items() if k not in texts}
    nuisance = nuisance | {k: c for k, c in varying.items() if k in texts}
    meta = pd.DataFrame({"condition": y if continuous else [f"{int(v):06d}" for v in y], **nuisance, **numeric})
    if "group" in nuisance and meta.duplicated(["group", "condition"]).any():
        raise ValueError("paired tests need one sample a group and condition")
    design, _, tested = design_matrix(meta, "condition", list(nuisance), list(numeric), continuous)
    replicates = 0 if continuous else int(meta["condition"].value_counts().min())
    return screen(x, design, tested, (x >= config.min_count).mean(axis=0) >= config.min_prevalence, replicates)


def _association(n, y, continuous):
    if continuous:
        a, b = n - n.mean(axis=0), y - y.mean()
        r2 = np.minimum((a * b[:, None]).sum(axis=0) ** 2 / ((a * a).sum(axis=0) * (b @ b)), 1 - 1e-15)
        return r2 / (1 - r2) * (len(y) - 2)
    groups = [n[y == c] for c in np.unique(y)]
    between = sum(len(g) * (g.mean(axis=0) - n.mean(axis=0)) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean(axis=0)) ** 2).sum(axis=0) for g in groups) / (len(n) - len(groups))
    return np.where(within > 0, between / np.where(within > 0, within, 1), np.finfo(float).max)


def tune(p: Packed, rows, y, config: Config, covariates_only: bool = False):
    """(strength, ratio, table, fits that did not converge) by inner folds over the grid; shared preparation and warm starts in a fold."""
    kind = config.outcome_type
    if covariates_only and config.candidate_method == "deseq2":  # genes are dropped below: no tests for them
        config = replace(config, candidate_method="none")
    losses: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for tr, te in inner_parts(p, rows, y[rows], config):
        prep = prepare(p, tr, y[tr], config)
        a, b = prep.transform(p.x[tr], p.covariates[tr]), prep.transform(p.x[te], p.covariates[te])
        if covariates_only:
            a, b = a[:, len(prep.selected):], b[:, len(prep.selected):]
        w = group_weights(p.groups[tr])
        for ratio in config.l1_ratios:
            start = None
            for strength in sorted(config.strengths, reverse=True):
                fit = net(a, y[tr], w, config, strength, ratio, start)
                start = fit
                value = mean_loss(y[te], fit.predict(b, kind), group_weights(p.groups[te]), kind) if fit.converged else np.inf
                losses.setdefault((strength, ratio), []).append((value, float((np.abs(fit.contrasts(kind)[:, : len(prep.selected)]) > config.coefficient_tolerance).any(axis=0).sum())))
    unconverged = sum(not np.isfinite(v) for x in losses.values() for v, _ in x)
    table = [(s, r, float(np.mean([v for v, _ in x])), float(np.std([v for v, _ in x], ddof=1)), len(x), float(np.mean([m for _, m in x]))) for (s, r), x in losses.items() if all(np.isfinite(v) for v, _ in x)]
    if not table:
        raise ValueError("no grid point converged in every inner fold")
    best = min(table, key=lambda t: (t[2], -t[0], -t[1]))
    if config.tuning_rule == "one_se":
        cut = best[2] + best[3] / np.sqrt(best[4])
        best = min((t for t in table if t[2] <= cut + 1e-12), key=lambda t: (t[5], -t[0], -t[1]))
    return best[0], best[1], table, unconverged


def net(a, y, w, config: Config, strength: float, ratio: float, start=None):
    """The elastic net of a configuration; its solver stops at moves of a thousandth of the tolerance."""
    return elastic_net(a, y, w, config.outcome_type, strength, ratio, tol=config.tolerance / 1000, max_iter=config.max_iter, start=start)


def run_unit(p: Packed, u: dict, config: Config) -> dict:
    """Tune (unless the unit fixes its parameters), refit on the training rows, predict the test rows."""
    kind, k = config.outcome_type, max(2, len(p.classes))
    y, train, test = np.asarray(u["labels"], float), np.asarray(u["train"], int), np.asarray(u["test"], int)
    config = replace(config, normalization=u["normalization"]) if u.get("normalization") else config
    if u.get("perturbation"):
        p = replace(p, x=p.perturbed[u["perturbation"] - 1])
    allowed = None
    if u.get("allowed") is not None:
        config, allowed = replace(config, candidate_method="none"), np.asarray(u["allowed"], int)
    check_sides(train, train, y[train], config, len(p.classes), "a")
    table, unconverged = [], 0
    if u.get("strength") is not None:
        strength, ratio = u["strength"], u["l1_ratio"]
    else:
        strength, ratio, table, unconverged = tune(p, train, y, config)
    prep = prepare(p, train, y[train], config, allowed)
    a, w = prep.transform(p.x[train], p.covariates[train]), group_weights(p.groups[train])
    fit = net(a, y[train], w, config, strength, ratio) if a.shape[1] else dummy(y[train], w, kind, k)
    m = len(prep.selected)
    base_a = a[:, m:]
    if base_a.shape[1]:
        bs, br, _, more = tune(p, train, y, config, covariates_only=True)
        base = net(base_a, y[train], w, config, bs, br)
        unconverged += more + (not base.converged)
    else:
        base = dummy(y[train], w, kind, k)
    out = {"strength": strength, "l1_ratio": ratio, "normalization": config.normalization, "perturbation": int(u.get("perturbation") or 0), "converged": fit.converged, "unconverged": int(unconverged + (not fit.converged)), "tuning": [dict(zip(("strength", "l1_ratio", "mean_loss", "sd", "n", "mean_features"), t)) for t in table], "retained": prep.selected.tolist(), "train_rows": train.tolist()}
    con = fit.contrasts(kind)[:, :m]
    out["coefs"] = [{"contrast": c, "feature": int(prep.selected[j]), "coef": float(con[c, j])} for c in range(con.shape[0]) for j in np.flatnonzero(con[c])]
    out["preds"], out["loss"], out["baseline_loss"] = [], None, None
    if len(test):
        b = prep.transform(p.x[test], p.covariates[test])
        pred, ref = fit.predict(b, kind), base.predict(b[:, m:], kind)
        wt = group_weights(p.groups[test])
        out["loss"], out["baseline_loss"] = mean_loss(y[test], pred, wt, kind), mean_loss(y[test], ref, wt, kind)
        cols = pred[:, None] if pred.ndim == 1 else pred
        refs = ref[:, None] if ref.ndim == 1 else ref
        out["preds"] = [{"sample": int(i), "class": c, "p": float(cols[r, c]), "baseline": float(refs[r, c])} for r, i in enumerate(test) for c in range(cols.shape[1])]
    return out


def run_units(spark: SparkSession, p: Packed, units: list[dict], config: Config) -> DataFrame:
    """RESULT rows of all units, spread over the cluster."""
    if p.mb > config.max_dense_mb:
        raise ValueError("the matrix exceeds max_dense_mb")
    sent = spark.sparkContext.broadcast(tuple(getattr(p, f.name) for f in fields(p)))  # plain values: workers need no package
    plan = spark.createDataFrame([(i, u) for i, u in enumerate(map(_json, units))], "id long, unit string").repartition(min(len(units), 4096), "id")

    def run(batches):
        import json
        import os

        os.environ.setdefault("OMP_NUM_THREADS", "1")
        packed = Packed(*sent.value)
        for pdf in batches:
            rows = []
            for text in pdf["unit"]:
                u = json.loads(text)
                keys = {k: u.get(k, 0) for k in ("stage", "perm_id", "repeat", "fold", "resample")}
                try:
                    rows.append(keys | run_unit(packed, u, config) | {"error": None})
                except (ValueError, np.linalg.LinAlgError) as e:
                    rows.append(keys | {"error": str(e), "tuning": [], "coefs": [], "preds": [], "retained": [], "train_rows": u["train"], "strength": None, "l1_ratio": None, "normalization": None, "perturbation": None, "converged": False, "unconverged": 0, "loss": None, "baseline_loss": None})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT_COLUMNS])

    return plan.mapInPandas(run, RESULT)


RESULT_COLUMNS = ("stage", "perm_id", "repeat", "fold", "resample", "strength", "l1_ratio", "normalization", "perturbation", "converged", "unconverged", "loss", "baseline_loss", "tuning", "coefs", "preds", "retained", "train_rows", "error")


def _json(u: dict) -> str:
    import json

    return json.dumps({k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in u.items()})


def outer_parts(p: Packed, y: np.ndarray, config: Config, repeat: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if config.cv_strategy == "temporal":
        parts = temporal_parts(p.groups, p.times, config.outer_folds, config.temporal_gap, config.temporal_train_fraction)
        for train, test in parts:
            check_sides(train, test, y[train], config, len(p.classes), "an outer")
        return parts
    if config.cv_strategy == "leave_batch_out":
        return [(np.flatnonzero(~np.isin(p.groups, p.groups[p.batches == b])), np.flatnonzero(p.batches == b)) for b in np.unique(p.batches)]
    if config.cv_strategy == "leave_group_out":
        _, folds = np.unique(p.groups, return_inverse=True)
    else:
        folds = group_folds(p.groups, y, config.outer_folds, config.seed + repeat, config.outcome_type != "continuous")
    return [(np.flatnonzero(folds != f), np.flatnonzero(folds == f)) for f in range(folds.max() + 1)]


def outer_units(p: Packed, config: Config, permutations: int = 0) -> list[dict]:
    """Nested validation of the observed labels (perm_id 0) and of permutations, as units."""
    out = []
    for perm in range(permutations + 1):
        y = permuted(p, config, perm)
        for repeat in range(config.repeats):
            out += [{"stage": "outer", "perm_id": perm, "repeat": repeat, "fold": f, "labels": y, "train": tr, "test": te} for f, (tr, te) in enumerate(outer_parts(p, y, config, repeat))]
    return out


def subsample(p: Packed, rows: np.ndarray, y: np.ndarray, config: Config, *keys) -> np.ndarray:
    """Rows of a share of the groups, without replacement, that supports inner folds; keys make it random."""
    names = list(np.unique(p.groups[rows]))
    size = min(len(names) - 1, max(config.inner_folds, math.ceil(len(names) * config.stability_fraction - 1e-9)))
    for attempt in range(200):
        some = rows[np.isin(p.groups[rows], key_order(names, config.seed + 101, *keys, attempt)[:size])]
        try:
            check_sides(some, some, y[some], config, len(p.classes), "a subsample")
            inner_parts(p, some, y[some], config)
            return some
        except ValueError:
            continue
    raise ValueError("no subsample of groups supports inner folds")


def _views(p: Packed, config: Config, i: int) -> dict:
    norms = config.stability_normalizations or (config.normalization,)
    return {"normalization": norms[i % len(norms)], "perturbation": i % (len(p.perturbed) + 1)}


def stability_units(p: Packed, config: Config) -> list[dict]:
    """Whole-group subsamples, rotating over normalisations and cell perturbations."""
    rows = np.arange(len(p.y))
    return [{"stage": "stability", "perm_id": 0, "repeat": 0, "fold": i, "labels": p.y, "train": subsample(p, rows, p.y, config, i), "test": np.zeros(0, int), **_views(p, config, i)} for i in range(config.stability_resamples)]


def panel_search_units(p: Packed, units: list[dict], config: Config) -> list[dict]:
    """Stability selection inside the training rows of each unit: its resamples, as units. Units that support none are left out."""
    out = []
    for u in units:
        train, y = np.asarray(u["train"], int), np.asarray(u["labels"], float)
        keys = tuple(u[k] for k in ("stage", "perm_id", "repeat", "fold"))
        try:
            out += [u | {"stage": f"{u['stage']}_search", "resample": i, "train": subsample(p, train, y, config, *keys, i), "test": np.zeros(0, int), **_views(p, config, i)} for i in range(config.stability_resamples)]
        except ValueError:
            continue
    return out


def panel_units(searches: DataFrame, units: list[dict], config: Config) -> list[dict]:
    """For each unit with searches (results of panel_search_units): the refit of its own panel, its parameters the most frequent ones
    of its resamples. A row a unit, with at most panel_max_features features, comes to the driver."""
    from ..operators import evidence as E

    keys = ["stage", "perm_id", "repeat", "fold"]
    fits = searches.where("error is null").withColumn("stage", F.regexp_replace("stage", "_search$", ""))
    n = fits.groupBy(*keys).agg(F.count("*").alias("n"))
    coefs = fits.select(*keys, F.concat_ws(":", *keys, "resample").alias("fit_id"), F.explode("coefs").alias("x")).select(*keys, "fit_id", "x.*").where(F.abs("coef") > config.coefficient_tolerance)
    seen = E.average_ranks(coefs).groupBy(*keys, "contrast", "feature").agg(F.count("*").alias("k"), F.abs(F.sum(F.signum("coef"))).alias("d"), F.median("rank").alias("rank"))
    seen = seen.join(n, keys).select(*keys, "contrast", "feature", "rank", (F.col("k") / F.col("n")).alias("frequency"), ((F.col("k") + F.col("d")) / 2 / F.col("k")).alias("sign"))
    fit = seen.where((F.col("frequency") >= config.selection_threshold) & (F.col("sign") >= config.sign_threshold))
    placed = fit.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("frequency"), F.desc("sign"), "rank", "feature", "contrast")))
    first = placed.groupBy(*keys, "feature").agg(F.min("place").alias("place"))
    panel = first.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy("place"))).where(F.col("position") <= config.panel_max_features).groupBy(*keys).agg(F.collect_list("feature").alias("features"))
    points = fits.groupBy(*keys, "strength", "l1_ratio").agg(F.count("*").alias("k"))
    mode = points.withColumn("o", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("k"), F.desc("strength"), F.desc("l1_ratio")))).where("o = 1")
    own = {tuple(r[k] for k in keys): r for r in mode.join(panel, keys, "left").collect()}
    out = []
    for u in units:
        r = own.get(tuple(u[k] for k in keys))
        if r is not None:
            out.append(u | {"stage": f"{u['stage']}_panel", "allowed": sorted(r["features"] or []), "strength": r["strength"], "l1_ratio": r["l1_ratio"]})
    return out


def batch_units(p: Packed, config: Config) -> list[dict]:
    return [u | {"stage": "batch"} for u in outer_units(p, replace(config, cv_strategy="leave_batch_out", repeats=1))]


def final_unit(p: Packed, stage: str = "final", **fixed) -> dict:
    rows = np.arange(len(p.y))
    return {"stage": stage, "perm_id": 0, "repeat": 0, "fold": 0, "labels": p.y, "train": rows, "test": np.zeros(0, int), **fixed}


def path_units(p: Packed, ratio: float, strengths) -> list[dict]:
    return [final_unit(p, "path", strength=float(s), l1_ratio=ratio) | {"fold": i} for i, s in enumerate(strengths)]


def losses(results: DataFrame) -> DataFrame:
    """stage, perm_id, loss, baseline_loss, improvement: means over folds (each test row is predicted once a repeat)."""
    g = results.groupBy("stage", "perm_id").agg(F.avg("loss").alias("loss"), F.avg("baseline_loss").alias("baseline_loss"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return g.withColumn("improvement", F.col("baseline_loss") - F.col("loss"))


def predictions(results: DataFrame, p: Packed, stage: str = "outer") -> DataFrame:
    """sample_id, y, repeat, fold, class, p, baseline of the observed labels."""
    spark = results.sparkSession
    meta = F.broadcast(spark.createDataFrame([(i, s, float(v)) for i, (s, v) in enumerate(zip(p.samples, p.y))], "sample int, sample_id string, y double"))
    rows = results.where((F.col("stage") == stage) & (F.col("perm_id") == 0)).select("repeat", "fold", F.explode("preds").alias("x")).select("repeat", "fold", "x.*")
    return rows.join(meta, "sample").select("sample_id", "y", "repeat", "fold", "class", "p", "baseline")


def coefficients(results: DataFrame, p: Packed, stage: str) -> DataFrame:
    """fit_id, contrast, feature_id, coef, normalization, perturbation on the complete grid of fits, contrasts and features."""
    spark = results.sparkSession
    n = {"multiclass": len(p.classes) - 1}.get("multiclass" if len(p.classes) > 2 else "", 1)
    feats = F.broadcast(spark.createDataFrame([(c, i, f) for c in range(n) for i, f in enumerate(p.features)], "contrast int, feature int, feature_id string"))
    fits = results.where(F.col("stage") == stage).where("error is null and perm_id = 0").select((F.col("repeat") * 100_000 + F.col("fold")).alias("fit_id"), "normalization", "perturbation", "coefs")
    grid = fits.select("fit_id", "normalization", "perturbation", F.lit(1).alias("one")).join(feats.withColumn("one", F.lit(1)), "one").drop("one")
    got = fits.select("fit_id", F.explode("coefs").alias("x")).select("fit_id", "x.*")
    return grid.join(got, ["fit_id", "contrast", "feature"], "left").select("fit_id", "contrast", "feature_id", F.coalesce("coef", F.lit(0.0)).alias("coef"), "normalization", "perturbation")
