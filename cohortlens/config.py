"""The configuration of an analysis: one frozen record; each setting's range stands beside it."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


def _number(x: Any, kind: type) -> bool:
    return not isinstance(x, bool) and isinstance(x, int if kind is int else (int, float)) and math.isfinite(x)


def _setting(default: Any, fits, must: str) -> Any:
    return field(default=default, metadata={"fits": fits, "must": must})


def whole(default: int, least: int) -> Any:
    return _setting(default, lambda x: _number(x, int) and x >= least, f"be a whole number of at least {least}")


def share(default: float) -> Any:
    """Something of a whole, or all of it."""
    return _setting(default, lambda x: _number(x, float) and 0 < x <= 1, "be above 0 and at most 1")


def part(default: float) -> Any:
    """Something of a whole, not all of it."""
    return _setting(default, lambda x: _number(x, float) and 0 < x < 1, "lie between 0 and 1")


def amount(default: float, zero: bool = False) -> Any:
    return _setting(default, lambda x: _number(x, float) and (x > 0 or zero and x == 0), "be 0 or more" if zero else "be positive")


def word(default: str, *words: str) -> Any:
    return _setting(default, lambda x: x in words, "be one of " + ", ".join(words))


def grid(default: tuple[float, ...], most: float = math.inf) -> Any:
    fits = lambda xs: bool(xs) and _distinct(xs) and all(_number(x, float) and 0 < x <= most for x in xs)
    return _setting(default, fits, "be distinct positive numbers" + (f" of at most {most:g}" if most < math.inf else ""))


def _distinct(values) -> bool:
    return len(set(values)) == len(values)


def _named(x: Any) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _names(xs: Any) -> bool:
    """Several names, each once: a text is not a list of its letters."""
    return isinstance(xs, (tuple, list)) and all(map(_named, xs)) and _distinct(xs)


def switch(default: bool) -> Any:
    return _setting(default, lambda x: isinstance(x, bool), "be true or false")


def name(default: str | None = None) -> Any:
    """A column, or another name; None: there is none."""
    return _setting(default, lambda x: x is None and default is None or _named(x), "be a name that is not blank")


def names(default: tuple[str, ...] = ()) -> Any:
    return _setting(default, _names, "be distinct names that are not blank")


# The keys, their defaults and the accepted words are the public configuration format.
NORMALIZATIONS = ("logcpm", "median_ratio", "none")
EVERY_CELL = "all_cells"
FEATURE_BLOCKS = ("abundance", "gene_mean", "gene_detection", "gene_variance", "gene_tail", "gene_correlation", "program_mean", "program_variance", "program_q90", "program_fraction", "program_correlation")


@dataclass(frozen=True)
class Config:
    outcome: str = name("phenotype")
    outcome_type: str = word("binary", "binary", "multiclass", "continuous")
    sample_id: str = name("sample_id")
    group: str | None = name()
    batch: str | None = name()
    covariates: tuple[str, ...] = names()
    positive_class: str | None = name()
    input_scale: str = word("counts", "counts", "log_expression", "features")
    normalization: str = word("logcpm", *NORMALIZATIONS)
    candidate_method: str = word("variance", "variance", "association", "deseq2", "none")
    max_features: int = whole(1000, 1)
    min_count: float = amount(5.0)
    min_prevalence: float = share(0.2)
    de_fdr: float = share(0.1)
    supporting_de: bool = switch(False)
    de_pair_group: bool = switch(False)
    outer_folds: int = whole(5, 2)
    inner_folds: int = whole(3, 2)
    repeats: int = whole(1, 1)
    cv_strategy: str = word("grouped", "grouped", "leave_group_out", "leave_batch_out", "temporal")
    seed: int = whole(42, 0)
    strengths: tuple[float, ...] = grid((0.01, 0.05, 0.2))
    l1_ratios: tuple[float, ...] = grid((0.2, 0.5, 0.9), 1)
    max_iter: int = whole(10000, 1)
    tolerance: float = amount(0.0001)
    tuning_rule: str = word("one_se", "one_se", "minimum_loss")
    coefficient_tolerance: float = amount(1e-7)
    decision_threshold: float = part(0.5)
    stability_resamples: int = whole(50, 2)
    stability_fraction: float = part(0.75)
    stability_normalizations: tuple[str, ...] = names()
    selection_threshold: float = share(0.8)
    sign_threshold: float = share(0.9)
    outer_selection_threshold: float = share(0.5)
    permutations: int = whole(99, 0)
    permutation_scheme: str = word("group", "group", "within_group")
    permutation_strata: str | None = name()
    permutation_alpha: float = share(0.05)
    min_groups_gate: int = whole(20, 2)
    correlation_threshold: float = share(0.85)
    correlation_max_features: int = whole(100, 1)
    assess_batches: bool = switch(True)
    cell_type: str | None = name()
    cell_type_value: str | None = name()
    layer: str | None = name()
    min_cells: int = whole(20, 1)
    cell_min_counts: int = whole(1, 1)
    cell_min_genes: int = whole(1, 1)
    mitochondrial_prefix: str | None = name()
    max_mito_fraction: float = share(1.0)
    chunk_size: int = whole(2048, 1)
    max_dense_mb: int = whole(2048, 1)
    imputation: str = word("reject", "reject", "median")
    max_missing_fraction: float = share(0.5)
    single_cell_mode: str = word("pseudobulk", "pseudobulk", "distribution")
    cell_states: tuple[str, ...] = names()
    feature_genes: tuple[str, ...] = names()
    gene_thresholds: tuple[float, ...] = grid((1.0, 2.0, 3.0))
    gene_pairs: tuple[tuple[str, str], ...] = _setting((), lambda xs: isinstance(xs, (tuple, list)), "be a list of pairs")
    feature_blocks: tuple[str, ...] = names(("abundance", "gene_mean", "gene_detection", "program_mean", "program_variance"))
    programs: dict[str, tuple[str, ...]] = field(default_factory=dict)
    program_thresholds: dict[str, float] = field(default_factory=dict)
    cell_resamples: int = whole(0, 0)
    cell_fraction: float = part(0.75)
    panel_validation: bool = switch(False)
    panel_max_features: int = whole(20, 1)
    time: str | None = name()
    temporal_gap: float = amount(0.0, zero=True)
    temporal_train_fraction: float = part(0.5)

    def __post_init__(self):
        problems = [f"{f.name} must {f.metadata['must']}" for f in fields(self) if f.metadata and not f.metadata["fits"](getattr(self, f.name))]
        if not problems:  # rules between settings may then rely on their kinds
            problems = [text for fine, text in (*_roles(self), *_scales(self), *_resampling(self), *_cells(self)) if not fine]
        if problems:
            raise ValueError("; ".join(problems))


def _roles(c: Config) -> list[tuple[bool, str]]:
    """(fine, text): which metadata columns may play which parts."""
    named = [x for x in (c.outcome, c.sample_id, c.group, c.batch, c.time) if x is not None]
    return [
        (c.outcome not in (c.sample_id, c.group), "the outcome cannot identify samples or groups"),
        (not set(named) & set(c.covariates), "a covariate has another role already"),
        (c.cell_type is None or c.cell_type not in (*named, c.permutation_strata), "the cell type has another role already"),
        (c.group is not None or not c.de_pair_group, "paired tests need a group"),
        (c.batch is not None or c.cv_strategy != "leave_batch_out", "leave_batch_out needs a batch"),
        (c.cv_strategy != "temporal" or c.time is not None and c.repeats == 1, "temporal folds need a time and one repeat"),
    ]


def _scales(c: Config) -> list[tuple[bool, str]]:
    """(fine, text): what raw counts need and other scales must not have."""
    raw = c.input_scale == "counts"
    return [
        (raw == (c.normalization != "none"), "counts are normalised, other scales are not"),
        (not raw or c.imputation == "reject", "counts are not imputed"),
        (raw or c.candidate_method != "deseq2", "expression tests need raw counts"),
        (raw or not c.supporting_de or c.single_cell_mode == "distribution", "supporting expression tests need raw counts"),
        (all(n in NORMALIZATIONS and raw == (n != "none") for n in c.stability_normalizations), "stability_normalizations do not fit the input"),
    ]


def _resampling(c: Config) -> list[tuple[bool, str]]:
    """(fine, text): every normalisation and every view of the cells needs a resample."""
    return [
        (_distinct(c.stability_normalizations) and len(c.stability_normalizations) <= c.stability_resamples, "stability_normalizations must be distinct and have a resample each"),
        (c.cell_resamples < c.stability_resamples, "cell_resamples need a resample each, beside the cells as they are"),
        (not c.cell_resamples or c.single_cell_mode == "distribution", "cell_resamples need distribution features"),
    ]


def _cells(c: Config) -> list[tuple[bool, str]]:
    """(fine, text): features of the distributions of cells, and what a block cannot do without."""
    blocks, genes = set(c.feature_blocks), list(c.programs.values()) if isinstance(c.programs, dict) else []
    limits = c.program_thresholds if isinstance(c.program_thresholds, dict) else {}
    pairs = all(isinstance(p, (tuple, list)) and len(p) == 2 and _names(p) for p in c.gene_pairs)
    return [
        (bool(blocks) and blocks <= set(FEATURE_BLOCKS) and _distinct(c.feature_blocks), "feature_blocks must be distinct known blocks, one at least"),
        (pairs and _distinct([frozenset(p) for p in c.gene_pairs]), "gene_pairs must name two genes each, and no pair twice in either order"),
        (isinstance(c.programs, dict) and all(map(_named, c.programs)) and all(g and _names(g) for g in genes), "a program needs a name and a list of distinct genes"),
        (isinstance(c.program_thresholds, dict) and set(limits) <= set(c.programs) and all(_number(x, float) for x in limits.values()), "program_thresholds must be numbers by program"),
        (bool(c.gene_pairs) or "gene_correlation" not in blocks, "gene_correlation needs gene_pairs"),
        (len(genes) > 1 or "program_correlation" not in blocks, "program_correlation needs two programs"),
        (set(limits) == set(c.programs) or "program_fraction" not in blocks, "program_fraction needs a threshold for every program"),
        (not c.cell_states or c.cell_type is not None or tuple(c.cell_states) == (EVERY_CELL,), "cell_states need a cell_type"),
        (c.cell_type_value is None or c.single_cell_mode != "distribution", "distribution features take cell_states in place of cell_type_value"),
    ]


def load_config(path: str | Path | None = None, overrides: dict[str, Any] | None = None) -> Config:
    """A configuration from JSON, TOML or YAML; overrides (None: not given) win. Unknown keys are errors; numbers written as
    text, such as 1e-3 in YAML, are accepted for numeric keys."""
    values: dict[str, Any] = {}
    if path is not None:
        text, kind = Path(path).read_text(encoding="utf-8"), Path(path).suffix.lower()
        if kind == ".json":
            values = json.loads(text)
        elif kind == ".toml":
            import tomllib

            values = tomllib.loads(text)
        else:
            import yaml

            values = yaml.safe_load(text) or {}
    values |= {k: v for k, v in (overrides or {}).items() if v is not None}
    known = {f.name: f.default for f in fields(Config)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"unknown configuration keys: {', '.join(unknown)}")

    def fit(key, x):
        if isinstance(x, str) and isinstance(known[key], float):
            return float(x)
        if isinstance(x, list):
            return tuple(fit_item(key, v) for v in x)
        return {k: tuple(v) if isinstance(v, list) else v for k, v in x.items()} if isinstance(x, dict) else x

    def fit_item(key, v):
        if isinstance(v, list):
            return tuple(v)
        return float(v) if isinstance(v, str) and key in ("strengths", "l1_ratios", "gene_thresholds") else v

    return Config(**{k: fit(k, v) for k, v in values.items()})
