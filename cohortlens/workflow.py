"""The stages of an analysis in order, from a long matrix to gated evidence, and external scoring of a frozen run."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, replace
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, load_config
from .functions import metrics as M
from .functions.kernels import dummy, group_weights
from .operators import contracts as K
from .operators import evidence as E
from .operators import expression_tests as X
from .plans import fitgrid as G
from .sources.runs import Run, Store, read_record, strict, verify


def check_study(long: DataFrame, metadata: DataFrame, config: Config) -> list[str]:
    """Raises on a broken contract; returns what blocks the gates."""
    group = config.group or "sample_id"
    bad = [r["check_id"] for r in K.dataset_contract(metadata, long.select("feature_id").distinct(), group).where("violations > 0").collect()]
    if config.input_scale == "counts":
        bad += [r["check_id"] for r in K.count_contract(long).where("violations > 0").collect()]
    bad += ["samples_differ"] if not K.key_differences(long, metadata, "sample_id").isEmpty() else []
    if config.input_scale != "features" and not K.profile_duplicates(long, metadata.select("sample_id", F.col(group).alias("group"))).isEmpty():  # summaries may tie
        bad.append("profile_in_several_groups")
    bad += [f"covariate_leakage:{c}" for c in leaking_covariates(metadata, config)]
    if bad:
        raise ValueError("the study breaks its contract: " + ", ".join(bad))
    blockers = []
    if config.outcome_type != "continuous":
        balance = K.class_balance(metadata, config.outcome, group).collect()
        blockers += ["few_groups_in_a_class"] if any(r["few_groups"] for r in balance) else []
    y = metadata.select("sample_id", (F.col(config.outcome).cast("double") if config.outcome_type == "continuous" else F.xxhash64(config.outcome).cast("double")).alias("y"))
    if config.outcome_type != "multiclass" and not K.target_copies(long, y, 2 if config.outcome_type == "binary" else None, config.min_count if config.input_scale == "counts" else None).where("copies_target").isEmpty():
        blockers.append("target_copy")
    if metadata.select(group).distinct().count() < config.min_groups_gate:
        blockers.append("small_cohort")
    return blockers


def leaking_covariates(metadata: DataFrame, config: Config) -> list[str]:
    """Covariates that give the outcome away: texts with too many levels or one outcome each, numbers that copy it."""
    text = [c for c, kind in metadata.dtypes if c in config.covariates and kind == "string"]
    out = [r["covariate"] for r in K.covariate_leakage(metadata, text, config.outcome).where("high_cardinality" + (" or determines_outcome" if config.outcome_type != "continuous" else "")).collect()] if text else []
    numbers = [c for c in config.covariates if c not in text]
    if numbers and config.outcome_type != "multiclass":
        one = metadata.agg(F.max(config.outcome)).first()[0]
        y = F.col(config.outcome).cast("double") if config.outcome_type == "continuous" else (F.col(config.outcome) == one).cast("double")
        r = metadata.agg(*[K.pearson(F.col(c).cast("double"), y).alias(c) for c in numbers]).first()
        out += [c for c in numbers if abs(r[c] or 0.0) > 1 - 1e-12]
    return sorted(out)


def study_warnings(long: DataFrame, metadata: DataFrame, config: Config) -> list[str]:
    """What a reader of the run should know: labels in sample ids, libraries far from the others."""
    out = []
    if config.outcome_type != "continuous":
        labels = metadata.select(F.col(config.outcome).cast("string").alias("label")).distinct()
        out += ["id_contains_outcome"] if not K.ids_with_labels(metadata, labels).isEmpty() else []
    if config.input_scale == "counts":
        far = K.library_outliers(long.groupBy("sample_id").agg(F.sum("value").alias("library"))).where("outlier").orderBy("sample_id")
        out += [f"library_outlier:{r['sample_id']}" for r in far.select("sample_id").collect()]
    return out


def batch_record(metadata: DataFrame, config: Config) -> tuple[dict, list[str], list[str]]:
    """How the batch goes with the outcome: (record, blockers, warnings)."""
    if not config.batch:
        return {"status": "not_assessed"}, [], []
    if config.outcome_type == "continuous":
        eta = K.eta_squared(metadata.withColumn("__y", F.col(config.outcome).cast("double")), config.batch, "__y").first()["eta_squared"] or 0.0
        return {"status": "observed", "eta_squared": eta}, ["perfect_batch_confounding"] if eta > 1 - 1e-10 else [], ["batch_association"] if eta > 0.5 else []
    r = K.cramers_v(metadata, config.batch, config.outcome).first()
    v, perfect = r["cramers_v"] or 0.0, r["purity"] == 1
    cells = [x.asDict() for x in K.crosstab(metadata, config.batch, config.outcome).orderBy(config.batch, config.outcome).collect()]  # batches x classes
    return {"status": "observed", "cramers_v": v, "purity": r["purity"], "table": cells}, ["perfect_batch_confounding"] if perfect else [], ["batch_association"] if not perfect and v > 0.5 else []


def correlation_groups(spark: SparkSession, p: G.Packed, coefs: DataFrame, stability: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Correlations of the best-ranked selected features over all samples (descriptive), their complete-linkage groups,
    the groups' selection frequencies and the members' substitutions."""
    chosen = [r["feature_id"] for r in E.candidates(stability, config.correlation_max_features).collect()]  # bounded by the setting
    plain = replace(config, candidate_method="none")
    n = G.prepare(p, np.arange(len(p.y)), p.y, plain).normalized(p.x)
    at = {f: j for j, f in enumerate(p.features)}
    chosen = [f for f in chosen if n[:, at[f]].std() > 1e-12]
    values = [(s, f, float(n[i, at[f]])) for f in chosen for i, s in enumerate(p.samples)]
    matrix = E.correlation_matrix(spark.createDataFrame(values, "sample_id string, feature_id string, value double"), spark.createDataFrame([(f,) for f in chosen], "feature_id string"))
    r = {(x["a"], x["b"]): x["r"] for x in matrix.collect()}
    members = spark.createDataFrame(list(E.complete_linkage(chosen, r, config.correlation_threshold).items()) if chosen else [], "feature_id string, group_id string")
    tol = config.coefficient_tolerance
    return matrix, members, E.group_frequencies(coefs, members, tol), E.substitution(coefs, members, tol)


def expression_support(spark: SparkSession, p: G.Packed, long: DataFrame, metadata: DataFrame, config: Config, state_counts: DataFrame | None, state_cells: DataFrame | None) -> tuple[DataFrame | None, dict[str, str]]:
    """gene_id, contrast, cell_type, de_log2fc, de_padj of exploratory count tests, one family over the states; and why states have none.
    Bulk counts are one state."""
    if state_counts is None:
        if config.input_scale != "counts":
            raise ValueError("supporting expression tests of distribution features need the counts by state")
        name = config.cell_type_value or "bulk"
        state_counts = long.withColumn("state", F.lit(name))
        state_cells = metadata.select("sample_id", F.lit(name).alias("state"), F.lit(config.min_cells).alias("n_cells"))
    continuous = config.outcome_type == "continuous"
    codes = spark.createDataFrame([(c, f"{k:06d}") for k, c in enumerate(p.classes)], "__label string, __condition string")
    meta = metadata.withColumn("__condition", F.col(config.outcome).cast("double")) if continuous else metadata.withColumn("__label", F.col(config.outcome).cast("string")).join(F.broadcast(codes), "__label")
    texts = [c for c, text in zip(config.covariates, p.categorical) if text]
    nuisance = [c for c in (config.batch, config.group if config.de_pair_group else None) if c] + texts
    meta = meta.select("sample_id", "__condition", *nuisance, *[F.col(c).cast("double").alias(c) for c in config.covariates if c not in texts])
    tests, failed = X.supporting_tests(state_counts.select("state", "sample_id", "feature_id", "value"), meta, "__condition", state_cells, config.min_cells, categorical=nuisance, numeric=[c for c in config.covariates if c not in texts], continuous=continuous, min_count=config.min_count, min_prevalence=config.min_prevalence)
    if tests is None:
        return None, failed
    contrast = F.lit(0) if continuous else F.substring("contrast", 1, 6).cast("int") - 1
    return tests.select(F.col("feature_id").alias("gene_id"), contrast.alias("contrast"), F.col("state").alias("cell_type"), F.col("log2_fold_change").alias("de_log2fc"), F.col("padj").alias("de_padj"), "p", "base_mean", "standard_error"), failed


def outcome_metrics(scored: DataFrame, config: Config) -> dict:
    """Weighted metrics of scored rows: sample_id, y (code or response), class, p, and the row's group."""
    if config.outcome_type == "continuous":
        rows = M.group_weights(scored, "group")
        return rows.agg(M.mean_of((F.col("y") - F.col("p")) ** 2).alias("mse")).first().asDict() | M.regression(rows).first().asDict()
    if config.outcome_type == "binary":
        rows = M.group_weights(scored.where("class = 1"), "group").withColumn("y", F.col("y").cast("int"))
        figures = M.ranking(rows).first().asDict() | M.brier(rows).first().asDict() | M.confusion(rows, config.decision_threshold).first().asDict() | M.log_loss(rows).first().asDict()
        return figures | {"calibration": [r.asDict() for r in M.calibration(rows).orderBy("bin").collect()]}
    keys = [c for c in ("repeat", "fold") if c in scored.columns]
    probs = F.transform(F.array_sort(F.collect_list(F.struct("class", "p"))), lambda x: x["p"])
    wide = scored.groupBy("sample_id", "group", *keys).agg(F.first("y").cast("int").alias("y"), probs.alias("probs"))
    rows = M.group_weights(wide, "group")
    return M.macro_ranking(rows).first().asDict() | M.multiclass(rows).first().asDict()


def fits_of(spark: SparkSession, run: Run, p: G.Packed, config: Config, batches: bool) -> DataFrame:
    """All fits of a run, written in two steps: those that need nothing else, then the panels chosen inside training rows."""
    outer, batch = G.outer_units(p, config, config.permutations), G.batch_units(p, config) if batches else []
    units = [*outer, *batch, *G.stability_units(p, config), G.final_unit(p)]
    searched = [*outer, *batch] if config.panel_validation else []
    units += G.panel_search_units(p, searched, config)
    fits = run.table("fits", G.run_units(spark, p, units, config))
    if not searched:
        return fits
    final = fits.where("stage = 'stability'").withColumns({"stage": F.lit("final_search"), "resample": F.col("fold"), "fold": F.lit(0)})
    more = G.panel_units(fits.where("stage like '%_search'").unionByName(final), [*searched, G.final_unit(p)], config)
    return fits.unionByName(run.table("panel_fits", G.run_units(spark, p, more, config)))


def permutation_test(losses: dict, stage: str, permutations: int) -> float | None:
    """Share of permutations as good as the observed labels; one that failed counts as at least as good."""
    if not permutations or (stage, 0) not in losses:
        return None
    seen = losses[stage, 0]["improvement"]
    null = [losses[stage, k]["improvement"] if (stage, k) in losses and not losses[stage, k]["failed"] else None for k in range(1, permutations + 1)]
    return (1 + sum(x is None or x >= (-math.inf if seen is None else seen) - 1e-12 for x in null)) / (1 + permutations)


def batch_validation(fits: DataFrame, p: G.Packed) -> dict:
    """Status of every held-out batch; complete only if each could be tested."""
    names = np.unique(p.batches)
    panel = {r["fold"]: r["g"] for r in fits.where("stage = 'batch_panel'").select("fold", (F.col("baseline_loss") - F.col("loss")).alias("g")).collect()}
    rows = []
    for r in fits.where("stage = 'batch'").select("fold", "loss", "baseline_loss", "error").orderBy("fold").collect():
        tested = r["error"] is None
        rows.append({"batch": str(names[r["fold"]]), "status": "tested" if tested else "unidentifiable", "reason": r["error"], "loss": r["loss"], "baseline_loss": r["baseline_loss"], "loss_improvement": r["baseline_loss"] - r["loss"] if tested else None, "panel_loss_improvement": panel.get(r["fold"])})
    return {"status": "tested" if rows and all(r["status"] == "tested" for r in rows) else "incomplete" if rows else "not_assessed", "folds": rows}


def _stability_columns(coefs: DataFrame, config: Config, name: str) -> DataFrame:
    f = E.frequency_and_sign(coefs, config.coefficient_tolerance)
    return f.select("contrast", "feature_id", F.col("frequency").alias(f"{name}_selection_frequency"), F.col("consistency").alias(f"{name}_sign_consistency"), F.col("dominant_sign").alias(f"{name}_dominant_sign"))


def write_tensors(run: Run, fits: DataFrame, p: G.Packed, config: Config) -> None:
    """coefficients.npz: fits x contrasts x features of each stage, with labels, if the arrays keep within max_dense_mb."""
    contrasts = max(1, len(p.classes) - 1)
    stages = {name: fits.where(f"stage = '{name}' and perm_id = 0 and error is null") for name in ("stability", "outer", "outer_panel", "batch")}
    sizes = {name: f.count() for name, f in stages.items()}
    if sum(sizes.values()) * contrasts * len(p.features) * 8 / 2**20 > config.max_dense_mb:
        raise ValueError("the coefficients exceed max_dense_mb")
    arrays = {"features": np.array(p.features, dtype=str), "classes": np.array(p.classes, dtype=str)}
    for name, f in stages.items():
        arrays[name] = np.zeros((sizes[name], contrasts, len(p.features)))
        rows = f.orderBy("repeat", "fold").select("repeat", "fold", "coefs").collect()
        arrays[f"{name}_fits"] = np.array([(r["repeat"], r["fold"]) for r in rows], dtype=int).reshape(-1, 2)
        for i, r in enumerate(rows):
            for c in r["coefs"]:
                arrays[name][i, c["contrast"], c["feature"]] = c["coef"]
    run.tensor("coefficients", **arrays)


def run_analysis(spark: SparkSession, long: DataFrame, metadata: DataFrame, config: Config, output: str | Path, perturbed: Sequence[DataFrame] = (), identity: DataFrame | None = None, symbols: DataFrame | None = None, state_counts: DataFrame | None = None, state_cells: DataFrame | None = None, contract: dict | None = None, digests: DataFrame | None = None, extra: dict[str, DataFrame] | None = None) -> dict:
    """long: sample_id, feature_id, value; metadata: sample_id and the configured columns; perturbed: the same features from
    subsamples of the cells; identity: feature_id, kind, cell_type, source, unit of features that are not genes; symbols: gene_id,
    gene_symbol; state_counts (state, sample_id, feature_id, value) and state_cells (state, sample_id, n_cells): counts behind distribution
    features; contract: what external cells must share; digests: sample_id, digest of the samples' cells (default: of the profiles); extra:
    further tables to write. Writes the run; returns its summary."""
    if config.de_pair_group and not (config.candidate_method == "deseq2" or config.supporting_de):
        raise ValueError("de_pair_group has no count tests to apply to")
    with Run(spark, output, {"configuration": asdict(config), "version": "0.2.0", "cell_feature_contract": contract}) as run:
        blockers = check_study(long, metadata, config)
        warnings = study_warnings(long, metadata, config)
        batch, more, also = batch_record(metadata, config)
        blockers, warnings = [*blockers, *more], [*warnings, *also]
        p = G.pack(long, metadata, config)
        p = replace(p, perturbed=tuple(G.pack(v, metadata, config).x for v in perturbed))
        run.record("qc_report", {"samples": len(p.samples), "features": len(p.features), "groups": len(set(p.groups)), "classes": list(p.classes), "gate_blockers": blockers, "warnings": warnings, "batch": batch})
        run.record("feature_universe", {"features": list(p.features), "samples": list(p.samples), "classes": list(p.classes)})
        run.table("profile_hashes", K.profile_digests(long) if digests is None else digests.select("sample_id", "digest"))
        for name, df in (extra or {}).items():
            run.table(name, df)
        run.table("principal_components", principal_components(spark, p, config))
        batches = config.assess_batches and config.batch is not None and len(np.unique(p.batches)) > 1
        fits = fits_of(spark, run, p, config, batches)
        broken = fits.where("error is not null and perm_id = 0 and stage not like 'batch%' and stage not like '%_search'").select("stage", "error").first()
        if broken:
            raise ValueError(f"a fit of the observed labels failed ({broken['stage']}): {broken['error']}")
        loss = {(r["stage"], r["perm_id"]): r for r in G.losses(fits).collect()}  # one row a stage and permutation
        seen, pvalue = loss["outer", 0], permutation_test(loss, "outer", config.permutations)
        panel = {"improvement": loss["outer_panel", 0]["improvement"] if ("outer_panel", 0) in loss else None, "pvalue": permutation_test(loss, "outer_panel", config.permutations)} if config.panel_validation else None
        validation = batch_validation(fits, p)
        run.record("batch_validation", validation)
        group = metadata.select("sample_id", F.col(config.group or "sample_id").cast("string").alias("group"))
        predictions = run.table("predictions", G.predictions(fits, p).join(group, "sample_id"))
        coefs = lambda stage: G.coefficients(fits, p, stage)
        tol, tested = config.coefficient_tolerance, validation["status"] == "tested"
        stability = run.table("stability", E.stability_summary(coefs("stability"), tol))
        final = coefs("final").select("contrast", "feature_id", F.col("coef").alias("coefficient"), E.direction(F.col("coef"), tol).alias("coefficient_direction"))
        table = stability.join(_stability_columns(coefs("outer"), config, "outer"), ["contrast", "feature_id"]).join(final, ["contrast", "feature_id"])
        if tested:
            table = table.join(_stability_columns(coefs("batch"), config, "batch"), ["contrast", "feature_id"])
        unconverged = fits.agg(F.sum("unconverged")).first()[0] or 0
        blockers = E.global_blockers(config.permutations, config.permutation_alpha, pvalue, seen["improvement"], bool(config.batch), tested, [r["loss_improvement"] for r in validation["folds"]], blockers, panel=panel, batch_panel=[r["panel_loss_improvement"] for r in validation["folds"]], unconverged=unconverged)
        norms = config.stability_normalizations or (config.normalization,)
        table = table.join(E.frequency_by(coefs("stability"), "normalization", norms, tol), ["contrast", "feature_id"])
        needed = [f"frequency_{n}" for n in norms]
        if config.cell_resamples:
            views = range(config.cell_resamples + 1)
            table = table.join(E.frequency_by(coefs("stability"), "perturbation", views, tol, "frequency_cells_"), ["contrast", "feature_id"])
            needed += [f"frequency_cells_{v}" for v in views]
        parts = correlation_groups(spark, p, coefs("stability"), stability, config)
        for name, part in zip(("correlations", "correlation_members", "correlation_groups", "substitutions"), parts):
            run.csv(name, run.table(name, part))
        members, groups = parts[1], parts[2].select(F.col("group_id").alias("correlated_feature_group"), "contrast", F.col("selection_frequency").alias("correlated_group_frequency"))
        table = table.join(F.broadcast(members.withColumnRenamed("group_id", "correlated_feature_group")), "feature_id", "left").join(F.broadcast(groups), ["correlated_feature_group", "contrast"], "left")
        if config.input_scale == "counts":
            table = table.join(long.groupBy("feature_id").agg((F.count_if(F.col("value") > 0) / len(p.samples)).alias("expression_prevalence")), "feature_id", "left")
        table = annotate(table, identity, symbols, config.cell_type_value or "bulk")
        if config.supporting_de:
            tests, failed = expression_support(spark, p, long, metadata, config, state_counts, state_cells)
            run.record("de_design", {"unavailable": failed})
            if tests is not None:
                tests = run.table("differential_expression", tests)
                table = E.join_expression_tests(table, tests.select("gene_id", "contrast", "cell_type", "de_log2fc", "de_padj"))
        gated = E.feature_gates(table, blockers, config.selection_threshold, config.sign_threshold, config.outer_selection_threshold, tol, needed, tested)
        evidence = run.table("evidence", E.final_order(gated))
        if identity is not None:
            run.table("specimen_evidence", specimen_evidence(evidence, long, metadata, config))
        run.csv("biomarkers", evidence.orderBy("evidence_rank"))
        run.csv("biomarker_stability", stability.orderBy("contrast", "feature_id"))
        run.csv("coefficients", evidence.select("evidence_rank", "contrast", "feature_id", "kind", "cell_type", "coefficient", "coefficient_direction").orderBy("evidence_rank"))
        run.csv("cv_results", fits.where("perm_id = 0 and error is null").select("stage", "repeat", "fold", "resample", F.explode("tuning").alias("t")).select("stage", "repeat", "fold", "resample", "t.*"))
        run.csv("out_of_fold_predictions", predictions.orderBy("repeat", "sample_id", "class"))
        run.table("panel", E.select_panel(stability, config.selection_threshold, config.sign_threshold, config.panel_max_features))
        write_tensors(run, fits, p, config)
        best = fits.where("stage = 'final'").select("strength", "l1_ratio").first()
        run.table("path", G.run_units(spark, p, G.path_units(p, best["l1_ratio"], sorted(config.strengths)), config))
        run.record("model", freeze(p, config, best["strength"], best["l1_ratio"]))
        metrics = {"loss": seen["loss"], "baseline_loss": seen["baseline_loss"], "loss_improvement": seen["improvement"], "pvalue": pvalue, "blockers": blockers, "warnings": warnings, "unconverged": unconverged, "passing": evidence.where("passes_robustness_gates").count()}
        metrics |= outcome_metrics(predictions, config)
        if panel is not None:
            metrics["panel"] = panel | panel_results(run, fits, p, config, evidence, coefs) | {f"oof_{k}": v for k, v in outcome_metrics(G.predictions(fits, p, "outer_panel").join(group, "sample_id"), config).items()}
        run.record("metrics", metrics)
    return metrics


def specimen_evidence(evidence: DataFrame, long: DataFrame, metadata: DataFrame, config: Config, features: int = 6) -> DataFrame:
    """The values behind the best-ranked features, a row a specimen and feature, with the outcome and the batch."""
    top = evidence.groupBy("feature_id", "kind", "cell_type", "gene_id", "unit").agg(F.min("evidence_rank").alias("evidence_rank")).orderBy("evidence_rank").limit(features)
    about = metadata.select("sample_id", F.col(config.outcome).alias("outcome"), (F.col(config.batch) if config.batch else F.lit(None).cast("string")).alias("batch"))
    return long.join(F.broadcast(top), "feature_id").join(about, "sample_id")


def annotate(table: DataFrame, identity: DataFrame | None, symbols: DataFrame | None, cell_type: str) -> DataFrame:
    """table with kind, cell_type, unit, gene_id (the gene a feature is of, or its own name) and gene_symbol ('' if unknown)."""
    if identity is None:
        table = table.withColumns({"kind": F.lit("gene_expression"), "cell_type": F.lit(cell_type), "unit": F.lit("count"), "gene_id": F.col("feature_id")})
    else:
        table = E.join_identity(table, identity).join(F.broadcast(identity.select("feature_id", F.col("source").alias("gene_id"))), "feature_id", "left")
    if symbols is None:
        return table.withColumn("gene_symbol", F.lit(""))
    return table.join(F.broadcast(symbols.select("gene_id", "gene_symbol")), "gene_id", "left").withColumn("gene_symbol", F.coalesce("gene_symbol", F.lit("")))


def panel_results(run: Run, fits: DataFrame, p: G.Packed, config: Config, evidence: DataFrame, coefs) -> dict:
    """Writes the panel's evidence, gates and frozen state; returns its features and parameters."""
    r = fits.where("stage = 'final_panel'").select("retained", "strength", "l1_ratio").first()
    if r is None:
        raise ValueError("no panel could be chosen from the resamples")
    features = [p.features[j] for j in r["retained"]]
    own = coefs("final_panel").where(F.col("feature_id").isin(features)).select("contrast", "feature_id", F.col("coef").alias("panel_coefficient"))
    table = evidence.join(own, ["contrast", "feature_id"]).join(_stability_columns(coefs("outer_panel"), config, "panel_outer"), ["contrast", "feature_id"])
    gated = run.table("panel_evidence", E.panel_gates(table, config.outer_selection_threshold, config.sign_threshold, config.coefficient_tolerance))
    run.csv("panel_evidence", gated)
    run.record("panel_model", freeze(p, config, r["strength"], r["l1_ratio"], r["retained"]))
    return {"features": features, "strength": r["strength"], "l1_ratio": r["l1_ratio"], "passing": gated.where("passes_panel_gates").count()}


def principal_components(spark: SparkSession, p: G.Packed, config: Config) -> DataFrame:
    """sample_id, pc1, pc2, ratio1, ratio2, outcome, batch over all samples (descriptive): the packed matrix is on the driver already."""
    plain = replace(config, candidate_method="none")
    a = G.prepare(replace(p, covariates=p.covariates[:, :0], categorical=()), np.arange(len(p.y)), p.y, plain).transform(p.x, p.covariates[:, :0])
    u, s, _ = np.linalg.svd(a - a.mean(axis=0), full_matrices=False)
    whole = float((s**2).sum()) or 1.0
    axes = np.zeros((len(p.y), 2))
    axes[:, : min(2, len(s))] = (u * s)[:, :2]
    ratio = [float(v) for v in np.r_[s[:2] ** 2 / whole, 0.0, 0.0][:2]]
    outcome = [p.classes[int(v)] if p.classes else str(float(v)) for v in p.y]
    return spark.createDataFrame([(i, float(x), float(y), *ratio, o, str(b)) for i, (x, y), o, b in zip(p.samples, axes, outcome, p.batches)], "sample_id string, pc1 double, pc2 double, ratio1 double, ratio2 double, outcome string, batch string")


def freeze(p: G.Packed, config: Config, strength: float, ratio: float, allowed: Sequence[int] | None = None) -> dict:
    """All that scoring new samples needs. allowed: the features of a panel."""
    if allowed is not None:
        config = replace(config, candidate_method="none")
    prep, w = G.prepare(p, np.arange(len(p.y)), p.y, config, None if allowed is None else np.asarray(allowed, int)), group_weights(p.groups)
    a = prep.transform(p.x, p.covariates)
    fit = G.net(a, p.y, w, config, strength, ratio) if a.shape[1] else dummy(p.y, w, config.outcome_type, max(2, len(p.classes)))
    return {
        "features": list(p.features), "classes": list(p.classes), "selected": prep.selected.tolist(), "center": prep.center.tolist(), "scale": prep.scale.tolist(), "reference": None if prep.reference is None else prep.reference.tolist(),
        "fill": None if prep.fill is None else prep.fill.tolist(), "covariates": [{"name": n, "levels": v} for n, v in zip(config.covariates, prep.encoder.levels)], "covariate_center": prep.encoder.center.tolist(), "covariate_scale": prep.encoder.scale.tolist(),
        "coef": fit.coef.tolist(), "intercept": fit.intercept.tolist(), "samples": list(p.samples), "groups": sorted(set(p.groups)),
    }


def covariate_columns(model: dict, covariates: DataFrame) -> list:
    """The scaled columns of a frozen encoder, as expressions; raises on levels that training lacks."""
    raw = []
    for c in model["covariates"]:
        if c["levels"] is None:
            raw.append(F.col(c["name"]).cast("double"))
            continue
        text = F.col(c["name"]).cast("string")
        if not covariates.where(text.isNull() | ~text.isin(*c["levels"])).isEmpty():
            raise ValueError(f"covariate {c['name']} has a level that training lacks")
        raw += [(text == level).cast("double") for level in c["levels"][1:]]
    return [(x - m) / s for x, m, s in zip(raw, model["covariate_center"], model["covariate_scale"])]


def score_frozen(spark: SparkSession, model: dict, long: DataFrame, config: Config, covariates: DataFrame | None = None) -> DataFrame:
    """sample_id, class, p (or the response) of new samples, as joins with the frozen state."""
    universe = spark.createDataFrame([(i, f) for i, f in enumerate(model["features"])], "ord int, feature_id string")
    if not K.key_differences(long, universe, "feature_id").isEmpty():
        raise ValueError("the features differ from the training universe")
    x = long
    if model["fill"] is not None:
        fill = F.broadcast(spark.createDataFrame(list(zip(model["features"], model["fill"])), "feature_id string, fill double"))
        x = x.join(fill, "feature_id").select("sample_id", "feature_id", F.coalesce("value", "fill").alias("value"))
    if config.normalization == "logcpm":
        from .operators.prep import log_cpm

        x = log_cpm(x)
    elif config.normalization == "median_ratio":
        from .operators.prep import median_ratio

        x = median_ratio(x, spark.createDataFrame([(f, r) for f, r in zip(model["features"], model["reference"]) if r > 0], "feature_id string, reference double"))
    state = [(model["features"][j], c, s) for j, c, s in zip(model["selected"], model["center"], model["scale"])]
    coefs = [(k, model["features"][j], float(model["coef"][k][i])) for k in range(len(model["coef"])) for i, j in enumerate(model["selected"])]
    classes = spark.createDataFrame([(k, float(b)) for k, b in enumerate(model["intercept"])], "class int, intercept double")
    if state:
        from .operators.prep import standardize

        z = standardize(x, F.broadcast(spark.createDataFrame(state, "feature_id string, center double, scale double")))
        scores = E.linear_scores(z, spark.createDataFrame(coefs, "class int, feature_id string, coef double"), classes)
    else:
        scores = x.select("sample_id").distinct().withColumn("class", F.explode(F.array(*map(F.lit, range(len(model["intercept"])))))).join(classes, "class").select("sample_id", "class", F.col("intercept").alias("score"))
    if model.get("covariates"):
        if covariates is None:
            raise ValueError("the model needs its covariates")
        m, parts = len(model["selected"]), covariate_columns(model, covariates)
        add = F.array(*[sum((part * float(model["coef"][k][m + i]) for i, part in enumerate(parts)), F.lit(0.0)) for k in range(len(model["coef"]))])
        scores = scores.join(covariates.select("sample_id", add.alias("__add")), "sample_id").select("sample_id", "class", (F.col("score") + F.element_at("__add", F.col("class") + 1)).alias("score"))
    if config.outcome_type == "continuous":
        return scores.select("sample_id", "class", F.col("score").alias("p"))
    if config.outcome_type == "binary":
        one = E.sigmoid(F.col("score"))
        return scores.select("sample_id", F.explode(F.array(F.struct(F.lit(0).alias("class"), (1 - one).alias("p")), F.struct(F.lit(1).alias("class"), one.alias("p")))).alias("x")).select("sample_id", "x.*")
    return E.softmax(scores)


def external_validate(spark: SparkSession, run: str | Path, long: DataFrame, metadata: DataFrame, model_kind: str = "full", contract: dict | None = None, digests: DataFrame | None = None) -> DataFrame:
    """Predictions of a complete, unchanged run for samples, groups and profiles that it has not seen. model_kind: full or panel;
    contract and digests: of the cells that distribution features come from (distribution.contract, cells.multiset_digest); the former
    must equal the run's, the latter must be new."""
    if model_kind not in ("full", "panel"):
        raise ValueError("model_kind must be full or panel")
    name = "model" if model_kind == "full" else "panel_model"
    manifest = verify(run, [name, "feature_universe"], spark)
    config = load_config(None, manifest["configuration"])
    if manifest.get("cell_feature_contract") != (strict(contract) if contract else None):
        raise ValueError("the cells' gene universe or normalisation differs from the training run's")
    model = read_record(spark, run, name)
    seen = spark.createDataFrame([(s,) for s in model["samples"]], "sample_id string")
    if not metadata.select("sample_id").join(seen, "sample_id", "left_semi").isEmpty():
        raise ValueError("a sample of the training study is in the external one")
    if config.group:
        groups = spark.createDataFrame([(g,) for g in model["groups"]], f"`{config.group}` string")
        if not metadata.select(F.col(config.group).cast("string").alias(config.group)).join(groups, config.group, "left_semi").isEmpty():
            raise ValueError("a group of the training study is in the external one")
    known = spark.read.parquet(Store(spark, run).path("profile_hashes.parquet"))
    own = digests if digests is not None else K.profile_digests(long) if config.input_scale != "features" else None  # summaries may tie
    if own is not None and not own.join(known.select("digest"), "digest", "left_semi").isEmpty():
        raise ValueError("a profile of the training study is in the external one under another name")
    covariates = metadata.select("sample_id", *config.covariates) if config.covariates else None
    return score_frozen(spark, model, long, config, covariates)


def evaluate_external(spark: SparkSession, run: str | Path, long: DataFrame, metadata: DataFrame, output: str | Path, model_kind: str = "full", contract: dict | None = None, digests: DataFrame | None = None) -> dict:
    """external_validate with metrics against the outcomes in metadata, written as a run of its own."""
    scored = external_validate(spark, run, long, metadata, model_kind, contract, digests)
    config = load_config(None, verify(run, ["model"], spark)["configuration"])
    classes = read_record(spark, run, "model")["classes"]
    y, group = F.col(config.outcome), F.col(config.group or "sample_id").cast("string").alias("group")
    if config.outcome_type == "continuous":
        truth = metadata.select("sample_id", group, y.cast("double").alias("y"))
    else:
        codes = spark.createDataFrame([(c, float(k)) for k, c in enumerate(classes)], "__label string, y double")
        truth = metadata.select("sample_id", group, y.cast("string").alias("__label")).join(F.broadcast(codes), "__label", "left")
        if not truth.where("y is null").isEmpty():
            raise ValueError("the external study has an outcome class that training lacks")
    with Run(spark, output, {"training_run": str(run), "model_kind": model_kind, "training_transform_refit": False}) as out:
        table = out.table("external_predictions", scored)
        out.csv("external_predictions", table)
        metrics = outcome_metrics(table.join(truth.select("sample_id", "group", "y"), "sample_id"), config)
        out.record("external_metrics", {"metrics": metrics, "classes": classes, "model_kind": model_kind})
    return metrics


def family(configs_by_type: dict[str, Config]) -> dict[str, Config]:
    """One run for each cell type, its alpha divided by their number."""
    n = len(configs_by_type)
    return {t: replace(c, permutation_alpha=c.permutation_alpha / n) for t, c in configs_by_type.items()}
