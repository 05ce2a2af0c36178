"""Specimen features from the distributions of cells: all configured blocks as one long table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import cells as C


def feature_config(config: Config) -> Config:
    """Distribution features are modelled as they are, with medians for missing states."""
    return replace(config, input_scale="features", normalization="none", imputation="median")


def quality_cells(cells: DataFrame, counts: DataFrame, config: Config) -> DataFrame:
    prefix = config.mitochondrial_prefix
    q = C.cell_quality(cells, counts, prefix or "")
    q = q if prefix else q.withColumn("mito_fraction", F.lit(0.0))
    return q.where(C.passes(config.cell_min_counts, config.cell_min_genes, config.max_mito_fraction)).select(*cells.columns)


def distribution_features(cells: DataFrame, counts: DataFrame, config: Config, perturbation: int = 0) -> DataFrame:
    """sample_id, feature_id, kind, state, source, value on the complete grid of samples and features; values are null where
    a state has under min_cells cells of a sample. perturbation > 0: from that keyed subsample of the cells."""
    spark = cells.sparkSession
    kept = quality_cells(cells, counts, config)
    if perturbation:
        kept = C.subsample(kept, config.cell_fraction, config.seed, perturbation)
    states = list(config.cell_states) or sorted(r[0] for r in cells.select("state").distinct().collect())  # cell types: a small dimension
    modeled = C.select_states(kept, states)
    # every sample meets every state, so that a state without cells is missing, not absent
    samples = cells.select("sample_id").distinct()
    groups = samples.select("sample_id", F.explode(F.array(*map(F.lit, states))).alias("state")).join(C.cell_totals(modeled), [*C.KEY], "left").na.fill(0, ["n_cells"])
    enough = lambda v: F.when(F.col("n_cells") >= config.min_cells, v)
    blocks, parts = set(config.feature_blocks), []
    if "abundance" in blocks:
        parts.append(samples.join(C.abundance(kept, states), "sample_id", "left").select("sample_id", F.lit("abundance").alias("kind"), "state", F.lit("").alias("source"), "value"))
    values = C.log_normalize(modeled, counts)
    gene_blocks = blocks & {"gene_mean", "gene_detection", "gene_variance", "gene_tail"}
    if gene_blocks:
        genes = spark.createDataFrame([(g,) for g in config.feature_genes], "gene_id string") if config.feature_genes else counts.select("gene_id").distinct()
        limits = config.gene_thresholds if "gene_tail" in blocks else ()
        grid = C.on_grid(groups, genes, C.gene_moments(values.join(F.broadcast(genes) if config.feature_genes else genes, "gene_id"), limits))
        parts.append(C.gene_blocks(grid, limits, config.min_cells).where(F.col("kind").isin(*gene_blocks)).select("sample_id", "kind", "state", "source", "value"))
    if "gene_correlation" in blocks and config.gene_pairs:
        pairs = spark.createDataFrame([tuple(p) for p in config.gene_pairs], "a string, b string")
        m = C.pair_moments(values, pairs).join(groups, [*C.KEY])
        parts.append(m.select("sample_id", F.lit("gene_correlation").alias("kind"), "state", F.to_json(F.array("a", "b")).alias("source"), enough(C.correlation("sa", "sb", "ssa", "ssb", "ab")).alias("value")))
    program_blocks = blocks & {"program_mean", "program_variance", "program_q90", "program_fraction"}
    if config.programs and (program_blocks or "program_correlation" in blocks):
        members = spark.createDataFrame([(p, g) for p, gs in config.programs.items() for g in gs], "program string, gene_id string")
        scores = C.program_scores(modeled, values, members)
        if program_blocks:
            wide = C.program_blocks(scores, dict(config.program_thresholds), config.min_cells)
            each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in sorted(program_blocks)]))
            parts.append(wide.select("sample_id", "state", F.col("program").alias("source"), each.alias("x")).select("sample_id", "x.kind", "state", "source", "x.value"))
        if "program_correlation" in blocks and len(config.programs) > 1:
            pc = C.program_correlations(scores, config.programs).join(groups, [*C.KEY])
            parts.append(pc.select("sample_id", F.lit("program_correlation").alias("kind"), "state", F.to_json(F.array("a", "b")).alias("source"), enough(F.col("value")).alias("value")))
    if not parts:
        raise ValueError("no feature block is configured")
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = long.where("state is not null").withColumn("feature_id", F.to_json(F.array("kind", "state", "source")))
    features = long.select("feature_id", "kind", "state", "source").distinct()
    grid = samples.join(F.broadcast(features.agg(F.collect_list(F.struct("feature_id", "kind", "state", "source")).alias("f")))).select("sample_id", F.explode("f").alias("f")).select("sample_id", "f.*")
    return grid.join(long.select("sample_id", "feature_id", "value"), ["sample_id", "feature_id"], "left")


def feature_schema(features: DataFrame) -> DataFrame:
    """feature_id, kind, cell_type, source, unit, label of each feature."""
    unit = F.when(F.col("kind") == "abundance", "log odds").when(F.col("kind").isin("gene_detection", "gene_tail", "program_fraction"), "share of cells").when(F.col("kind").endswith("correlation"), "correlation").otherwise("log1p CP10K")
    return features.select("feature_id", "kind", F.col("state").alias("cell_type"), "source", unit.alias("unit"), F.concat_ws(" | ", "source", "state", "kind").alias("label")).distinct()


def contract(counts: DataFrame, config: Config) -> dict:
    """What external cells must share to be scored by a run on these: the gene universe's hash and how features are made."""
    universe = counts.agg(F.sha2(F.to_json(F.array_sort(F.collect_set("gene_id"))), 256)).first()[0]
    return {"version": 1, "gene_universe": universe, "normalization": "log1p CP10K", "min_cells": config.min_cells, "blocks": sorted(config.feature_blocks)}
