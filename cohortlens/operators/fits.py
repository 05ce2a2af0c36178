"""Fits of many contexts as tables.

A unit is one fit: an outer fold of a repeat of a permutation, a held-out batch, a stability resample, or one of their inner folds. Its sides are
rows (unit, sample_id, group, batch, y, role). From there on everything is keyed by unit: training statistics, filters, the screen, the scaler
and the standardised rows are aggregates and joins, folds and permutations are ranks of hashes, tuning is an aggregation over inner folds.
Only the solver sees a unit as a whole, at most max_features columns of its samples; Spark deals the units. The study is neither collected nor
broadcast, and the plan does not grow with the number of units.

Study: long (sample_id, feature_id, value on the complete grid) and samples (sample_id, y, group, batch, and stratum if permuted within strata).
y: class codes from 0, or the response. Covariates come as a table of their own (``covariate_values``). Views of perturbed cells are not taken here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.kernels import dummy, elastic_net, group_weights, mean_loss
from ..functions.metrics import benjamini_hochberg
from ..sources.shared import written
from . import evidence as E
from . import expression_tests as X
from . import prep as P
from . import splits as S

KEYS = ("stage", "perm_id", "repeat", "fold")
SIDE = ("unit", "sample_id", "group", "batch", "y", "role")
FITS = "unit string, strength double, l1_ratio double, converged boolean, loss double, baseline_loss double, coefs array<struct<contrast:int,position:int,coef:double>>, preds array<struct<sample_id:string,class:int,p:double,baseline:double>>"


def unit_name(*keys: Column) -> Column:
    return F.concat_ws(":", *[k.cast("string") for k in keys])


# sides ----------------------------------------------------------------------------------------------------------------

def group_folds(rows: DataFrame, folds: int, seed: Column, classes: bool) -> DataFrame:
    """rows (context, sample_id, group, y, ...) with fold: whole groups, stratified by class in contexts whose groups have one class each. null
    where the groups, or those of a class, are fewer than the folds."""
    groups = rows.groupBy("context", "group").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.min(seed).alias("seed"))
    mixed = groups.groupBy("context").agg(F.bool_or(F.col("low") != F.col("high")).alias("mixed"))
    groups = groups.join(mixed, "context").withColumn("label", F.when(~F.col("mixed") & F.lit(classes), F.col("low")))
    own = W.partitionBy("context", "label")  # groups of a study
    k = F.row_number().over(own.orderBy(S.shuffled(F.col("seed"), F.col("group")), "group")) - 1
    at = F.dense_rank().over(W.partitionBy("context").orderBy("label")) - 1
    fold = F.when(F.count("*").over(own) >= folds, (k + at) % folds)
    return rows.join(groups.select("context", "group", fold.cast("int").alias("fold")), ["context", "group"])


def dealt(rows: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """rows with their own fold -> once for each fold, with role."""
    out = rows.withColumnRenamed("fold", "__own").withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return out.withColumn("role", F.when(F.col("__own") == F.col(fold), "test").when(F.col("__own").isNotNull(), "train")).drop("__own")


def permuted(samples: DataFrame, config: Config, permutations: int) -> DataFrame:
    """samples with perm_id from 0 (as observed): the labels of whole groups exchanged, within strata where they are configured."""
    if not permutations:
        return samples.withColumn("perm_id", F.lit(0))
    if config.permutation_scheme != "group":
        raise ValueError("labels are exchanged between whole groups here")
    stratum = F.col("stratum") if config.permutation_strata else F.lit("all")
    groups = samples.groupBy("group").agg(F.min("y").alias("label"), F.max("y").alias("high"), F.min(stratum).alias("stratum"), F.max(stratum).alias("last"))
    if not groups.where("label <> high or stratum <> last").isEmpty():
        raise ValueError("group permutation needs one outcome and one stratum a group")
    groups = groups.select("group", "label", "stratum", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm_id"))
    part = W.partitionBy("perm_id", "stratum")
    h = S.shuffled(F.lit(config.seed + 7919), F.col("perm_id"), F.col("group"))
    places = groups.select("perm_id", "stratum", "group", F.row_number().over(part.orderBy("group")).alias("k"))
    labels = groups.select("perm_id", "stratum", F.col("label").alias("y"), F.row_number().over(part.orderBy(h, "group")).alias("k"))
    exchanged = places.join(labels, ["perm_id", "stratum", "k"]).select("perm_id", "group", "y")
    others = samples.drop("y").join(exchanged, "group")
    return samples.withColumn("perm_id", F.lit(0)).unionByName(others.select(*samples.columns, "perm_id"))


def outer_sides(samples: DataFrame, config: Config, permutations: int = 0) -> DataFrame:
    """Sides and KEYS of nested validation of the observed labels and of permutations."""
    rows = permuted(samples, config, permutations).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(config.repeats - 1))))
    rows = rows.withColumn("context", unit_name(F.col("perm_id"), F.col("repeat")))
    if config.cv_strategy == "grouped":
        rows = dealt(group_folds(rows, config.outer_folds, F.lit(config.seed) + F.col("repeat"), config.outcome_type != "continuous"), config.outer_folds)
    elif config.cv_strategy == "temporal":
        raise ValueError("outer folds in time are not made here")
    else:
        rows = rows.join(held_out(samples, config.cv_strategy == "leave_batch_out"), "sample_id")
    return _named(rows.withColumn("stage", F.lit("outer")))


def held_out(samples: DataFrame, batches: bool) -> DataFrame:
    """sample_id, fold, role: each group, or each batch, held out in the order of their names; rows of a held-out batch's groups in other
    batches have no role."""
    key = "batch" if batches else "group"
    number = samples.select(F.col(key).alias("held")).distinct().withColumn("fold", (F.dense_rank().over(W.orderBy("held")) - 1).cast("int"))  # a study's
    if batches:
        return S.leave_batch_out(samples, "group", "batch").withColumnRenamed("batch", "held").join(number, "held").select("sample_id", "fold", "role")
    folds = samples.select("sample_id", F.col(key).alias("held")).join(number, "held").drop("held")
    return dealt(folds, number.count())


def batch_sides(samples: DataFrame) -> DataFrame:
    """Sides and KEYS: each batch held out, its groups' other rows left out."""
    rows = held_out(samples, True).join(samples, "sample_id")
    return _named(rows.select("*", F.lit("batch").alias("stage"), F.lit(0).alias("perm_id"), F.lit(0).alias("repeat")))


def whole_side(samples: DataFrame, stage: str = "final") -> DataFrame:
    return _named(samples.select("*", F.lit(stage).alias("stage"), F.lit(0).alias("perm_id"), F.lit(0).alias("repeat"), F.lit(0).alias("fold"), F.lit("train").alias("role")))


def stability_sides(samples: DataFrame, config: Config, tries: int = 200) -> DataFrame:
    """Sides and KEYS of the resamples (fold: their number): a share of the groups each, that leaves every class enough of them for the inner
    folds. All resamples that still lack one try together, so the jobs follow the tries needed, not the resamples."""
    classes = config.outcome_type != "continuous"
    groups = samples.groupBy("group").agg(F.min("y").alias("label"))
    size = S.subsample_size(groups.count(), config.stability_fraction, config.inner_folds)
    need = groups.select(F.count_distinct("label")).first()[0] if classes else 1
    left, chosen = list(range(config.stability_resamples)), None
    for turn in range(tries):
        h = S.shuffled(F.lit(config.seed + 101), F.col("fold"), F.lit(turn), F.col("group"))
        some = groups.select("*", F.explode(F.array(*map(F.lit, left))).alias("fold"))
        some = some.withColumn("k", F.row_number().over(W.partitionBy("fold").orderBy(h, "group"))).where(F.col("k") <= size).drop("k")  # groups of a study
        label = F.col("label") if classes else F.lit(0)
        per = some.groupBy("fold", label.alias("label")).agg(F.count("*").alias("n")).groupBy("fold").agg(F.count("*").alias("c"), F.min("n").alias("n"))
        good = [r["fold"] for r in per.where((F.col("c") == need) & (F.col("n") >= config.inner_folds)).collect()]
        new = some.where(F.col("fold").isin(good)).select("group", "fold")
        chosen = new if chosen is None else chosen.unionByName(new)
        left = [i for i in left if i not in set(good)]
        if not left:
            rows = samples.join(chosen, "group")
            return _named(rows.select("*", F.lit("stability").alias("stage"), F.lit(0).alias("perm_id"), F.lit(0).alias("repeat"), F.lit("train").alias("role")))
    raise ValueError("no subsample leaves every class enough groups for the inner folds: raise the fraction, or add groups")


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("unit", unit_name(*[F.col(k) for k in KEYS])).select(*SIDE, *KEYS)


def inner_sides(sides: DataFrame, config: Config) -> DataFrame:
    """Sides of the inner folds of each unit's training rows, with parent: the unit."""
    rows = sides.where("role = 'train'").select(F.col("unit").alias("context"), "sample_id", "group", "batch", "y")
    rows = dealt(group_folds(rows, config.inner_folds, F.lit(config.seed), config.outcome_type != "continuous"), config.inner_folds, "inner")
    return rows.select(F.concat_ws("/", "context", F.col("inner").cast("string")).alias("unit"), "sample_id", "group", "batch", "y", "role", F.col("context").alias("parent"))


def faults(sides: DataFrame, classes: int, held_out: bool) -> DataFrame:
    """unit, error (null: none): rows without a fold, empty sides, training sides that lack a class."""
    train, test = F.col("role") == "train", F.col("role") == "test"
    g = sides.groupBy("unit").agg(F.count_if(train).alias("a"), F.count_if(test).alias("b"), F.count_if(F.col("role").isNull()).alias("none"), F.count_distinct(F.when(train, F.col("y"))).alias("c"))
    lacks = F.col("c") < classes if classes else F.lit(False)
    text = F.when(F.col("none") > 0, "too few groups for the folds").when((F.col("a") == 0) | (F.lit(held_out) & (F.col("b") == 0)), "a fold has an empty side").when(lacks, "a training fold lacks a class")
    return g.select("unit", text.alias("error"))


# preparation ----------------------------------------------------------------------------------------------------------

def normalized(long: DataFrame, sides: DataFrame, config: Config) -> DataFrame:
    """unit, sample_id, group, batch, y, role, feature_id, raw, value: the units' rows under the configured normalisation and imputation, both learnt
    from each unit's training rows."""
    raw = long.withColumn("raw", F.col("value"))
    if config.normalization == "logcpm":
        raw = raw.drop("value").join(P.log_cpm(long), ["sample_id", "feature_id"])
    rows = raw.join(sides.select(*SIDE), "sample_id")
    if config.normalization == "median_ratio":
        n = sides.where("role = 'train'").groupBy("unit").agg(F.count("*").alias("n"))
        positive = rows.where("raw > 0")
        reference = positive.where("role = 'train'").groupBy("unit", "feature_id").agg(F.exp(F.avg(F.log("raw"))).alias("reference"), F.count("*").alias("k")).join(n, "unit").where("k = n")
        factor = positive.join(reference.select("unit", "feature_id", "reference"), ["unit", "feature_id"]).groupBy("unit", "sample_id").agg(F.median(F.col("raw") / F.col("reference")).alias("factor"))  # a study's features
        rows = rows.join(factor, ["unit", "sample_id"]).withColumn("value", F.log2(1 + F.col("raw") / F.col("factor"))).drop("factor")
    if config.imputation == "median":
        fill = rows.where("role = 'train'").groupBy("unit", "feature_id").agg(F.median("value").alias("fill"))  # a study's samples
        return rows.join(fill, ["unit", "feature_id"]).withColumn("value", F.coalesce("value", "fill", F.lit(0.0))).drop("fill")
    return rows.withColumn("value", F.coalesce("value", F.raise_error(F.lit("missing values without imputation")).cast("double")))


def selected(rows: DataFrame, config: Config, allowed: DataFrame | None = None) -> DataFrame:
    """unit, feature_id, position, center, scale of the features that each unit's training rows select, in order of their names. allowed: feature_id."""
    train = rows.where("role = 'train'")
    v, raw = F.col("value"), F.col("raw")
    kept = F.avg((raw >= config.min_count).cast("double")) >= config.min_prevalence if config.input_scale == "counts" else F.count("raw") / F.count("*") >= 1 - config.max_missing_fraction
    moments = train.groupBy("unit", "feature_id").agg(F.avg(v).alias("center"), F.stddev_pop(v).alias("scale"), F.var_pop(v).alias("score"), kept.alias("kept"))
    moments = moments.where("kept and score > 1e-12").drop("kept")
    moments = moments.join(F.broadcast(allowed.select("feature_id")), "feature_id", "left_semi") if allowed is not None else moments  # a panel
    if config.candidate_method == "association":
        moments = moments.drop("score").join(_association(train, config.outcome_type == "continuous"), ["unit", "feature_id"])
    elif config.candidate_method == "deseq2":
        tested = expression_screen(train, config).where(F.col("padj") <= config.de_fdr)
        moments = moments.drop("score").join(tested.select("unit", "feature_id", (-F.col("padj")).alias("score")), ["unit", "feature_id"])
    if config.candidate_method != "none":
        best = W.partitionBy("unit").orderBy(F.desc(F.round("score", 9)), "feature_id")
        moments = moments.withColumn("k", F.row_number().over(best)).where(F.col("k") <= config.max_features).drop("k")
    return moments.select("unit", "feature_id", (F.row_number().over(W.partitionBy("unit").orderBy("feature_id")) - 1).alias("position"), "center", "scale")


def _association(train: DataFrame, continuous: bool) -> DataFrame:
    """unit, feature_id, score: ANOVA F over classes, or the regression's F."""
    from .contracts import pearson

    v, keys = F.col("value"), ["unit", "feature_id"]
    if continuous:
        r2 = F.least(F.col("r") * F.col("r"), F.lit(1 - 1e-15))
        return train.groupBy(*keys).agg(pearson(v, F.col("y")).alias("r"), F.count("*").alias("n")).select(*keys, (r2 / (1 - r2) * (F.col("n") - 2)).alias("score"))
    g = train.groupBy(*keys, "y").agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    return t.select(*keys, F.when(F.col("within") > 0, between / F.when(F.col("within") > 0, F.col("within") / (F.col("n") - F.col("k")))).otherwise(1e300).alias("score"))


def expression_screen(train: DataFrame, config: Config) -> DataFrame:
    """unit, feature_id, padj of the raw counts (train: unit, sample_id, group, batch, y, feature_id, raw of training rows): the least adjusted p-value over
    the contrasts of a gene, each unit's tests one family. The tests of all units are one plan; a row a unit and sample makes the designs."""
    continuous = config.outcome_type == "continuous"
    beside = [c for c, used in (("batch", config.batch), ("group", config.de_pair_group)) if used]
    rows = train.select("unit", "sample_id", "group", "batch", "y").distinct().toPandas()
    rows["condition"] = rows["y"] if continuous else rows["y"].map(lambda v: f"{int(v):06d}")
    designs_ = {unit: X.Design(own, "condition", beside, (), continuous) for unit, own in rows.groupby("unit")}
    failed: dict[str, str] = {}
    tests = X.count_tests(train.select(F.col("unit").alias("state"), "sample_id", "feature_id", F.col("raw").alias("value")), designs_, config.min_count, config.min_prevalence, failed)
    if failed:
        raise ValueError("; ".join(f"{k}: {v}" for k, v in sorted(failed.items())))
    adjusted = benjamini_hochberg(written(tests, "screen-tests"), "p", ["state"])
    return adjusted.groupBy(F.col("state").alias("unit"), "feature_id").agg(F.coalesce(F.min("padj"), F.lit(1.0)).alias("padj"))


def covariate_values(metadata: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """sample_id, at (the covariate's number), level (null: a number), value. A null covariate is an error where it is read."""
    kinds, parts = dict(metadata.dtypes), None
    for at, c in enumerate(covariates):  # declared
        text = kinds[c] in ("string", "boolean")
        known = F.coalesce(F.col(c).cast("string" if text else "double"), F.raise_error(F.lit("a covariate has missing values")).cast("string" if text else "double"))
        part = metadata.select("sample_id", F.lit(at).alias("at"), (known if text else F.lit(None).cast("string")).alias("level"), (F.lit(1.0) if text else known).alias("value"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def unseen_levels(sides: DataFrame, values: DataFrame) -> DataFrame:
    """unit of those with a held-out level that training lacks."""
    rows = sides.join(values.where("level is not null"), "sample_id")
    of = lambda role: rows.where(F.col("role") == role).select("unit", "at", "level").distinct()
    return of("test").join(of("train"), ["unit", "at", "level"], "left_anti").select("unit").distinct()


def covariate_vectors(sides: DataFrame, values: DataFrame) -> DataFrame:
    """unit, sample_id, c: numbers and indicators of all levels but the first, of each unit's training rows, scaled by these rows."""
    rows = sides.select("unit", "sample_id", "role").join(values, "sample_id")
    n = sides.where("role = 'train'").groupBy("unit").agg(F.count("*").alias("n"))
    g = rows.where("role = 'train'").groupBy("unit", "at", "level").agg(F.sum("value").alias("s"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).join(n, "unit")
    share = F.col("s") / F.col("n")
    g = g.withColumns({"center": F.when(F.col("level").isNull(), F.col("mean")).otherwise(share), "sd": F.when(F.col("level").isNull(), F.col("sd")).otherwise(F.sqrt(share * (1 - share)))})
    place = F.row_number().over(W.partitionBy("unit", "at").orderBy("level"))  # levels: a covariate has few
    columns = g.withColumn("k", place).where("level is null or k > 1").select("unit", "at", F.col("level").alias("of"), "center", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd"))
    own = F.when(F.col("of").isNull(), F.col("value")).otherwise((F.col("of") == F.col("level")).cast("double"))
    each = rows.join(columns, ["unit", "at"]).select("unit", "sample_id", F.struct("at", "of", ((own - F.col("center")) / F.col("sd")).alias("z")).alias("x"))
    return each.groupBy("unit", "sample_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("unit", "sample_id", F.col("x.z").alias("c"))


def designs(long: DataFrame, sides: DataFrame, config: Config, allowed: DataFrame | None = None, covariates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(unit, sample_id, group, batch, y, role, v: the standardised selected features in order, c: the covariates' columns), and the table of
    ``selected``."""
    rows = normalized(long, sides, config)
    state = written(selected(rows, config, allowed), "selected")
    z = rows.join(state, ["unit", "feature_id"]).select(*SIDE, "position", ((F.col("value") - F.col("center")) / F.col("scale")).alias("z"))
    vectors = z.groupBy(*SIDE).agg(F.sort_array(F.collect_list(F.struct("position", "z"))).alias("e"))  # at most max_features, or a panel
    none = sides.select(*SIDE).join(state.select("unit").distinct(), "unit", "left_anti").withColumn("v", F.array().cast("array<double>"))  # nothing selected
    both = vectors.select(*SIDE, F.col("e.z").alias("v")).unionByName(none)
    beside = covariate_vectors(sides, covariates) if covariates is not None else None
    both = both.join(beside, ["unit", "sample_id"], "left") if beside is not None else both.withColumn("c", F.lit(None).cast("array<double>"))
    return both.select(*SIDE, "v", F.coalesce("c", F.array().cast("array<double>")).alias("c")), state


# fits -----------------------------------------------------------------------------------------------------------------

def _sides(pdf: pd.DataFrame):
    import numpy as np

    pdf, widths = pdf.sort_values("sample_id"), {k: len(pdf[k].iloc[0]) for k in ("v", "c")}
    for role in ("train", "test"):
        own = pdf[pdf["role"] == role]
        x, c = (np.array([np.asarray(v, float) for v in own[k]]).reshape(len(own), n) for k, n in widths.items())
        yield x, c, own["y"].to_numpy(float), group_weights(own["group"].to_numpy()) if len(own) else np.zeros(0), own["sample_id"].tolist()


def inner_losses(designs_: DataFrame, config: Config, covariates_only: bool = False) -> DataFrame:
    """unit, strength, l1_ratio, loss (infinite where the fit did not converge), n_selected: the grid on each inner fold."""
    kind, tolerance, tol, steps = config.outcome_type, config.coefficient_tolerance, config.tolerance / 1000, config.max_iter
    strengths, ratios = sorted(config.strengths, reverse=True), config.l1_ratios

    def run(pdf):
        import numpy as np

        (x, c, y, w, _), (xt, ct, yt, wt, _) = _sides(pdf)
        a, b, m = (c, ct, 0) if covariates_only else (np.hstack([x, c]), np.hstack([xt, ct]), x.shape[1])
        rows = []
        for ratio in ratios:
            start = None
            for strength in strengths:
                start = elastic_net(a, y, w, kind, strength, ratio, tol, steps, start)
                loss = mean_loss(yt, start.predict(b, kind), wt, kind) if start.converged else np.inf
                rows.append((pdf["unit"].iloc[0], strength, ratio, loss, float((np.abs(start.contrasts(kind)[:, :m]) > tolerance).any(axis=0).sum())))
        return pd.DataFrame(rows, columns=["unit", "strength", "l1_ratio", "loss", "n_selected"])

    return designs_.groupBy("unit").applyInPandas(run, "unit string, strength double, l1_ratio double, loss double, n_selected double")


def tuned(long: DataFrame, sides: DataFrame, config: Config, classes: int, covariates: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(the tuning table by context, the unit; unit, strength, l1_ratio chosen; the latter for covariates alone, if any). Units with a faulty inner
    fold have none."""
    inner = written(inner_sides(sides, config), "inner-sides")
    bad = faults(inner, classes, True).where("error is not null").select("unit")
    bad = bad.unionByName(unseen_levels(inner, covariates)) if covariates is not None else bad
    broken = inner.join(bad, "unit", "left_semi").select("parent").distinct()
    inner = inner.join(broken, "parent", "left_anti")
    vectors = designs(long, inner, config, None, covariates)[0]
    if covariates is None:
        return *_best(inner_losses(vectors, config), config), None
    vectors = written(vectors, "inner-designs")
    return *_best(inner_losses(vectors, config), config), _best(inner_losses(vectors, config, True), config)[1]


def _best(losses: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The tuning table of inner losses, and the point that the rule chooses for each unit."""
    table = written(E.tuning_table(losses.withColumn("context", F.substring_index("unit", "/", 1))), "tuning")
    if config.tuning_rule == "one_se":
        best = E.one_standard_error(table)
    else:
        order = W.partitionBy("context").orderBy("mean_loss", F.desc("strength"), F.desc("l1_ratio"))
        best = table.withColumn("k", F.row_number().over(order)).where("k = 1")
    return table, best.select(F.col("context").alias("unit"), "strength", "l1_ratio")


def refits(designs_: DataFrame, chosen: DataFrame, config: Config, classes: int) -> DataFrame:
    """FITS of units at their parameters (unit, strength, l1_ratio; several a unit are several fits; base_strength and base_ratio for the covariates
    alone), the test rows predicted beside a fit of the covariates alone, or without predictors."""
    kind, tol, steps, k = config.outcome_type, config.tolerance / 1000, config.max_iter, max(2, classes)
    columns = [c.split()[0] for c in FITS.split(", ")]

    def run(pdf):
        import numpy as np

        unit, strength, ratio = pdf["unit"].iloc[0], float(pdf["strength"].iloc[0]), float(pdf["l1_ratio"].iloc[0])
        (x, c, y, w, _), (xt, ct, yt, wt, names) = _sides(pdf)
        a, b, m = np.hstack([x, c]), np.hstack([xt, ct]), x.shape[1]
        fit = elastic_net(a, y, w, kind, strength, ratio, tol, steps) if a.shape[1] else dummy(y, w, kind, k)
        con = fit.contrasts(kind)[:, :m]
        coefs = [{"contrast": int(c), "position": int(j), "coef": float(con[c, j])} for c in range(len(con)) for j in np.flatnonzero(con[c])]
        loss = base = None
        preds = []
        if len(yt):
            p = fit.predict(b, kind)
            bs, br = pdf["base_strength"].iloc[0], pdf["base_ratio"].iloc[0]
            base_fit = elastic_net(c, y, w, kind, float(bs), float(br), tol, steps) if c.shape[1] else dummy(y, w, kind, k)
            q = base_fit.predict(ct, kind)
            loss, base = mean_loss(yt, p, wt, kind), mean_loss(yt, q, wt, kind)
            p, q = (v[:, None] if v.ndim == 1 else v for v in (p, q))
            preds = [{"sample_id": s, "class": c, "p": float(p[i, c]), "baseline": float(q[i, c])} for i, s in enumerate(names) for c in range(p.shape[1])]
        return pd.DataFrame([(unit, strength, ratio, bool(fit.converged), loss, base, coefs, preds)], columns=columns)

    if "base_strength" not in chosen.columns:
        chosen = chosen.withColumns({"base_strength": F.lit(None).cast("double"), "base_ratio": F.lit(None).cast("double")})
    return designs_.join(chosen, "unit").groupBy("unit", "strength", "l1_ratio").applyInPandas(run, FITS)


def stability_fits(long: DataFrame, samples: DataFrame, config: Config, classes: int, covariates: DataFrame | None = None) -> list[tuple[str, Fits]]:
    """(normalisation, fits) of the stability resamples, which take the configured normalisations in turn."""
    sides = written(stability_sides(samples, config), "stability-sides")
    methods = config.stability_normalizations or (config.normalization,)
    own = lambda i: sides.where(F.col("fold") % len(methods) == i)
    return [(m, Fits(long, own(i), replace(config, normalization=m), classes, held_out=False, covariates=covariates)) for i, m in enumerate(methods)]


class Fits:
    """Tuned fits of sides: ``fits`` (KEYS and FITS, error where a unit could not be fitted), ``tuning`` by context, ``state`` (the features that
    each unit selected)."""

    def __init__(self, long: DataFrame, sides: DataFrame, config: Config, classes: int, held_out: bool = True, chosen: DataFrame | None = None, allowed: DataFrame | None = None, covariates: DataFrame | None = None):
        self.config, self.classes, self.long = config, classes, long
        sides = written(sides, "sides")
        errors = written(faults(sides, classes, held_out), "faults")
        if covariates is not None:
            unseen = unseen_levels(sides, covariates).withColumn("unseen", F.lit("a covariate has a level that training lacks"))
            errors = written(errors.join(unseen, "unit", "left").select("unit", F.coalesce("error", "unseen").alias("error")), "faults")
        sound = sides.join(errors.where("error is null").select("unit"), "unit")
        self.tuning = None
        if chosen is None:
            self.tuning, chosen, base = tuned(long, sound, config, classes, covariates)
            chosen = chosen.join(base.select("unit", F.col("strength").alias("base_strength"), F.col("l1_ratio").alias("base_ratio")), "unit") if base is not None else chosen
        elif covariates is not None and held_out:
            raise ValueError("held-out fits with covariates are tuned, as their baseline is")
        if allowed is not None:
            config = replace(config, candidate_method="none")
        vectors, self.state = designs(long, sound, config, allowed, covariates)
        fits = written(refits(vectors, chosen, config, classes), "fits")
        units = sides.select("unit", *KEYS).distinct().join(errors, "unit")
        fitted = units.join(fits, "unit", "left")
        self.fits = fitted.withColumn("error", F.coalesce("error", F.when(F.col("converged").isNull(), "no grid point converged in every inner fold")))

    def predictions(self) -> DataFrame:
        """sample_id, repeat, fold, class, p, baseline of the observed labels."""
        rows = self.fits.where("perm_id = 0").select("repeat", "fold", F.explode("preds").alias("x"))
        return rows.select("x.sample_id", "repeat", "fold", "x.class", "x.p", "x.baseline")

    def losses(self) -> DataFrame:
        """stage, perm_id, loss, baseline_loss, failed, improvement: means over folds."""
        g = self.fits.groupBy("stage", "perm_id").agg(F.avg("loss").alias("loss"), F.avg("baseline_loss").alias("baseline_loss"), F.count_if(F.col("error").isNotNull()).alias("failed"))
        return g.withColumn("improvement", F.col("baseline_loss") - F.col("loss"))

    def coefficients(self) -> DataFrame:
        """fit_id, contrast, feature_id, coef on the complete grid of sound fits of the observed labels, contrasts and features."""
        sound = self.fits.where("error is null and perm_id = 0").select("unit", "coefs")
        contrasts = self.classes - 1 if self.classes > 2 else 1
        names = self.long.select("feature_id").distinct().withColumn("contrast", F.explode(F.sequence(F.lit(0), F.lit(contrasts - 1))))
        names = F.broadcast(names.agg(F.collect_list(F.struct("feature_id", "contrast")).alias("n")))  # one row: a study's features
        grid = sound.select("unit").join(names).select("unit", F.explode("n").alias("n")).select("unit", "n.*")
        got = sound.select("unit", F.explode("coefs").alias("x")).select("unit", "x.*").join(self.state.select("unit", "position", "feature_id"), ["unit", "position"])
        out = grid.join(got.select("unit", "contrast", "feature_id", "coef"), ["unit", "contrast", "feature_id"], "left")
        return out.select(F.col("unit").alias("fit_id"), "contrast", "feature_id", F.coalesce("coef", F.lit(0.0)).alias("coef"))
