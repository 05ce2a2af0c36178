"""Command line: bulk, single-cell, simulate, external, import-mtx. Exit status 1 on bad input."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields, replace

from .config import EVERY_CELL, Config

#: Keys of the configuration that single-cell and bulk runs take as lists, by the name of their option.
LISTS = {"covariates": "covariate", "cell_states": "cell-state", "feature_blocks": "feature-block", "feature_genes": "feature-gene"}


def _add_settings(p: argparse.ArgumentParser) -> None:
    """An option for every setting that is a single value, and for some lists; they win over the configuration file."""
    for f in fields(Config):
        flag = "--" + f.name.replace("_", "-")
        if f.name in LISTS:
            p.add_argument("--" + LISTS[f.name], action="append", dest=f.name)
        elif isinstance(f.default, bool):
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        elif f.default is None or isinstance(f.default, (str, int, float)):
            p.add_argument(flag, type=str if f.default is None else type(f.default))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cohortlens")
    sub = top.add_subparsers(dest="command", required=True)
    bulk = sub.add_parser("bulk", help="delimited expression matrix and metadata")
    bulk.add_argument("--expression", required=True)
    bulk.add_argument("--annotations", help="CSV with gene_id, gene_symbol, joined after modelling")
    cells = sub.add_parser("single-cell", help="an H5AD file, or Parquet tables cells and counts")
    cells.add_argument("--h5ad")
    cells.add_argument("--cells")
    cells.add_argument("--counts")
    external = sub.add_parser("external", help="score and evaluate new samples with a complete run")
    external.add_argument("--run", required=True)
    external.add_argument("--expression")
    external.add_argument("--metadata")
    external.add_argument("--cells", help="with --counts, of a run on distribution features")
    external.add_argument("--counts")
    external.add_argument("--h5ad", help="in place of both")
    external.add_argument("--model-kind", choices=("full", "panel"), default="full")
    mtx = sub.add_parser("import-mtx", help="Matrix Market to Parquet tables")
    for name in ("matrix", "genes", "barcodes"):
        mtx.add_argument(f"--{name}", required=True)
    mtx.add_argument("--numeric-column", action="append", default=[])
    simulate = sub.add_parser("simulate", help="a synthetic study with planted effects")
    simulate.add_argument("--modality", choices=("bulk", "single-cell"), default="bulk")
    simulate.add_argument("--samples", type=int, default=80, help="donors, for cells")
    simulate.add_argument("--features", type=int, default=200)
    simulate.add_argument("--seed", type=int, default=7)
    simulate.add_argument("--scenario", default="signal")
    for p in (bulk, mtx):
        p.add_argument("--metadata", required=True)
    for p in (bulk, external):
        p.add_argument("--orientation", choices=("auto", "samples", "features"), default="auto")
    for p in (bulk, cells):
        p.add_argument("--config")
        _add_settings(p)
    for p in (bulk, cells, external, mtx, simulate):
        p.add_argument("--output", required=True)
    return top


def settings(args: argparse.Namespace) -> Config:
    from .config import load_config

    own = {f.name: getattr(args, f.name, None) for f in fields(Config)}
    return load_config(args.config, own)


def pseudobulk_studies(cells, counts, config) -> dict:
    """state -> (long counts, configuration): sums of the cells that pass quality control, of cell_type_value only if it is
    set; alpha is divided by the number of states run."""
    from pyspark.sql import functions as F

    from .operators import cells as C
    from .operators.distribution import quality_cells
    from .workflow import family

    states = sorted(r[0] for r in cells.select("state").distinct().collect())
    if config.cell_type_value:
        if config.cell_type_value not in states:
            raise ValueError("the requested cell type is absent")
        states = [config.cell_type_value]
    kept, configs = quality_cells(cells, counts, config), family({s: replace(config, cell_type_value=s) for s in states})
    bulk = {s: C.pseudobulk(C.select_states(kept, [s]), counts, config.min_cells) for s in states}
    return {s: (b.select("sample_id", F.col("gene_id").alias("feature_id"), F.col("count").cast("double").alias("value")), configs[s]) for s, b in bulk.items()}


def read_cells(spark, args, config):
    """(cells with sample_id, state and the columns that have a role, counts); the state is the configured cell type's column. Columns that
    lack, or have blanks, are errors."""
    from pyspark.sql import functions as F

    from .operators import contracts as K
    from .sources.h5ad import read_h5ad

    if bool(args.h5ad) == bool(args.cells) or bool(args.cells) != bool(args.counts):
        raise ValueError("give either --h5ad, or --cells and --counts")
    cells, counts = read_h5ad(spark, args.h5ad, config.layer, config.chunk_size) if args.h5ad else (spark.read.parquet(args.cells), spark.read.parquet(args.counts))
    if not config.cell_type and "state" not in cells.columns:
        cells = cells.withColumn("state", F.lit(EVERY_CELL))
    roles = dict.fromkeys([config.outcome, *config.covariates, *(c for c in (config.group, config.batch, config.permutation_strata, config.time) if c)])
    source = {"cell_id": "cell_id", "sample_id": config.sample_id, "state": config.cell_type or "state"} | {c: c for c in roles if c != config.sample_id}
    if lacking := sorted(set(source.values()) - set(cells.columns)):
        raise ValueError("the cells lack the columns " + ", ".join(lacking))
    cells = cells.select(*[F.col(f"`{c}`").cast("string").alias(n) if n in ("sample_id", "state") else F.col(f"`{c}`").alias(n) for n, c in source.items()])
    blank = [r["column"] for r in K.missing_cells(cells, list(source)).where("violations > 0").collect()]
    if blank:
        raise ValueError("the cells have blanks in " + ", ".join(sorted(blank)))
    return cells, counts


def specimen_metadata(cells):
    """One row a specimen; its columns must not vary within it."""
    from .operators import contracts as K

    columns = [c for c in cells.columns if c not in ("cell_id", "state", "sample_id")]
    varying = [r["column"] for r in K.variant_columns(cells, "sample_id", columns).where("violations > 0").collect()] if columns else []
    if varying:
        raise ValueError("metadata vary within a sample: " + ", ".join(sorted(varying)))
    return K.first_per_key(cells, "sample_id", columns) if columns else cells.select("sample_id").distinct()


def cell_digests(kept, counts, config):
    """sample_id, digest of the cells that pass quality control."""
    from .operators import cells as C
    from .operators import distribution as D

    return C.multiset_digest(C.profile_hash(counts, kept, D.contract(counts, config)["gene_universe"]))


def run_cells(spark, args) -> None:
    from pyspark.sql import functions as F

    from .operators import cells as C
    from .operators import distribution as D
    from .operators.evidence import safe_name
    from .workflow import run_analysis

    config = settings(args)
    cells, counts = read_cells(spark, args, config)
    meta = specimen_metadata(cells)
    if config.single_cell_mode == "distribution":
        config = D.feature_config(config)
        views = [D.distribution_features(cells, counts, config, i) for i in range(config.cell_resamples + 1)]
        schema, kept = D.feature_schema(views[0]), D.quality_cells(cells, counts, config)
        prefix = config.mitochondrial_prefix
        quality = C.cell_quality(cells, counts, prefix or "")
        quality = C.technical(quality if prefix else quality.withColumn("mito_fraction", F.lit(0.0)), C.passes(config.cell_min_counts, config.cell_min_genes, config.max_mito_fraction))
        totals = C.pseudobulk(kept, counts, config.min_cells).select("state", "sample_id", F.col("gene_id").alias("feature_id"), F.col("count").cast("double").alias("value"))
        print(run_analysis(spark, views[0].select("sample_id", "feature_id", "value"), meta, config, args.output, [v.select("sample_id", "feature_id", "value") for v in views[1:]], identity=schema, state_counts=totals, state_cells=C.cell_totals(kept), contract=D.contract(counts, config), digests=cell_digests(kept, counts, config), extra={"feature_schema": schema, "cell_quality": quality}))
        return
    studies = pseudobulk_studies(cells, counts, config)
    names = {s: spark.range(1).select(safe_name(F.lit(s))).first()[0] for s in studies}
    for k, (state, (part, one)) in enumerate(studies.items()):
        target = args.output if len(studies) == 1 else f"{args.output}/{k:03d}_{names[state]}"
        print(state, run_analysis(spark, part, meta.join(part.select("sample_id").distinct(), "sample_id", "left_semi"), one, target))


def run_bulk(spark, args) -> None:
    from .sources import matrices as S
    from .workflow import run_analysis

    config = settings(args)
    named = [c for c in (config.group, config.batch, config.permutation_strata) if c] + ([config.outcome] if config.outcome_type != "continuous" else [])
    meta = S.read_metadata(spark, args.metadata, named, config.covariates)
    meta = meta.withColumnRenamed(meta.columns[0], "sample_id")
    symbols = S.read_annotations(spark, args.annotations) if args.annotations else None
    print(run_analysis(spark, S.to_long(S.read_delimited(spark, args.expression), meta, args.orientation), meta, config, args.output, symbols=symbols))


def run_external(spark, args) -> None:
    from .config import load_config
    from .operators import distribution as D
    from .sources import matrices as S
    from .sources.runs import verify
    from .workflow import evaluate_external

    of_cells = bool(args.cells or args.counts or args.h5ad)
    if bool(args.expression) == of_cells or bool(args.expression) != bool(args.metadata):
        raise ValueError("give either --expression and --metadata, or --h5ad, or --cells and --counts")
    config = load_config(None, verify(args.run, ["model"], spark)["configuration"])
    contract, digests = None, None
    if of_cells:
        cells, counts = read_cells(spark, args, config)
        meta = specimen_metadata(cells)
        if config.single_cell_mode == "distribution":
            long, contract = D.distribution_features(cells, counts, config).select("sample_id", "feature_id", "value"), D.contract(counts, config)
            digests = cell_digests(D.quality_cells(cells, counts, config), counts, config)
        else:
            if not config.cell_type_value:
                raise ValueError("the run has no cell type to select")
            long = pseudobulk_studies(cells, counts, config)[config.cell_type_value][0]
            meta = meta.join(long.select("sample_id").distinct(), "sample_id", "left_semi")
    else:
        named = [c for c in (config.group, config.batch) if c] + ([config.outcome] if config.outcome_type != "continuous" else [])
        meta = S.read_metadata(spark, args.metadata, named, config.covariates)
        meta = meta.withColumnRenamed(meta.columns[0], "sample_id")
        long = S.to_long(S.read_delimited(spark, args.expression), meta, args.orientation)
    print(evaluate_external(spark, args.run, long, meta, args.output, args.model_kind, contract, digests))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from .sources import matrices as S
    from .sources import synthetic as Y

    spark = SparkSession.builder.getOrCreate()
    try:
        if args.command == "import-mtx":
            meta = S.read_metadata(spark, args.metadata, None, args.numeric_column, numeric=True)
            meta, counts = S.read_matrix_market(spark, args.matrix, args.genes, args.barcodes, meta.withColumnRenamed(meta.columns[0], "cell_id"))
            meta.write.mode("errorifexists").parquet(f"{args.output}/cells")
            counts.write.mode("errorifexists").parquet(f"{args.output}/counts")
        elif args.command == "simulate":
            Y.write_example(spark, args.output, args.modality, args.samples, args.features, args.seed, args.scenario)
        elif args.command == "external":
            run_external(spark, args)
        elif args.command == "bulk":
            run_bulk(spark, args)
        else:
            run_cells(spark, args)
        return 0
    except (ValueError, OSError, ImportError, PySparkException) as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
