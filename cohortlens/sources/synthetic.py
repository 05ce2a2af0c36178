"""Synthetic studies with planted effects, for examples, tests and trials of scale. Counts are drawn on executors, each sample or cell from a
generator of its own, keyed by the seed and its number: a study depends neither on partitions nor on its order."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import Store, as_json

# The scenarios, their sizes and their effects are part of the examples' format.
SCENARIOS = ("signal", "noise", "correlated", "batch_confounded", "batch_specific", "imbalance", "outliers", "multiclass", "continuous")
EFFECT, CLASS_EFFECT, BATCH_EFFECT = 1.7, 1.6, 2.0


def labels(samples: int, scenario: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(outcome, batch) of each sample: a row of metadata each. Balanced classes in random order, unless the scenario says otherwise."""
    rng = np.random.default_rng([seed, 0])
    y = rng.permutation(np.arange(samples) % (3 if scenario == "multiclass" else 2))
    if scenario == "imbalance":
        y = np.zeros(samples, int)
        y[rng.choice(samples, max(6, samples // 5), replace=False)] = 1
    if scenario == "continuous":
        y = rng.normal(size=samples)
    batch = np.where(y == 1, "batch_case", "batch_control") if scenario == "batch_confounded" else np.array([f"batch_{i % 3}" for i in range(samples)])
    return y, batch


def planted(scenario: str) -> dict[int, int]:
    """Features with an effect of the outcome and its sign. A batch that is the outcome plants nothing."""
    if scenario in ("noise", "batch_confounded"):
        return {}
    if scenario in ("correlated", "multiclass"):
        return dict.fromkeys(range(6), 1)
    return dict.fromkeys(range(4), 1) if scenario == "batch_specific" else {0: 1, 1: 1, 2: -1, 3: -1}


def log_means(i: int, y: float, batch: str, base: np.ndarray, scenario: str, seed: int) -> np.ndarray:
    """Logarithms of one sample's expected counts."""
    rng, mu = np.random.default_rng([seed, 2, i]), base.copy()
    if scenario == "batch_confounded":
        mu[:20] += CLASS_EFFECT * y
    elif scenario == "batch_specific":
        mu[:4] += BATCH_EFFECT * y * (batch == "batch_0")
    elif scenario == "multiclass":
        mu[2 * int(y):2 * int(y) + 2] += CLASS_EFFECT
    elif scenario == "correlated":  # six features follow one hidden factor, which follows the outcome
        mu[:6] = np.log(50) + EFFECT * y + rng.normal(0, 0.25) + rng.normal(0, 0.04, len(mu[:6]))
    else:
        for j, sign in planted(scenario).items():
            mu[j:j + 1] += sign * EFFECT * y
    return mu + rng.normal(0, 0.2)


def bulk(spark: SparkSession, samples: int = 80, features: int = 200, seed: int = 7, scenario: str = "signal") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(long counts, metadata, planted features with their signs): negative-binomial counts of dispersion 1/20."""
    if scenario not in SCENARIOS:
        raise ValueError(f"scenario must be one of {', '.join(SCENARIOS)}")
    y, batch = labels(samples, scenario, seed)
    rows = [(i, f"s{i:04d}", f"d{i:04d}", float(v), str(b)) for i, (v, b) in enumerate(zip(y, batch))]
    meta = spark.createDataFrame(rows, "i long, sample_id string, donor string, y double, batch string")

    def draw(batches):
        base = np.log(np.random.default_rng([seed, 1]).uniform(20, 100, features))
        names = pa.array([f"gene_{j:04d}" for j in range(features)])
        for b in batches:
            for i, sample, v, at in zip(*(b.column(c).to_pylist() for c in ("i", "sample_id", "y", "batch"))):
                mu = np.exp(log_means(i, v, at, base, scenario, seed))
                counts = np.random.default_rng([seed, 3, i]).negative_binomial(20, 20 / (20 + mu)).astype(float)
                counts *= 1000 if scenario == "outliers" and i == 0 else 1
                yield pa.RecordBatch.from_arrays([pa.array([sample] * features), names, pa.array(counts)], ["sample_id", "feature_id", "value"])

    long = meta.select("i", "sample_id", "y", "batch").mapInArrow(draw, "sample_id string, feature_id string, value double")
    outcome = F.col("y") if scenario == "continuous" else F.col("y").cast("int").cast("string")
    return long, meta.select("sample_id", "donor", outcome.alias("phenotype"), "batch"), {f"gene_{j:04d}": s for j, s in planted(scenario).items() if j < features}


def cells(spark: SparkSession, donors: int = 24, genes: int = 100, cells_each: int = 30, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(cells, counts): donors x 2 conditions x 2 cell types; four genes respond to the condition. Counts that are zero are left out."""
    k = spark.range(donors * 4 * cells_each).withColumn("group", F.floor(F.col("id") / cells_each))  # four groups a donor
    donor, condition = F.floor(F.col("group") / 4), F.floor(F.col("group") / 2) % 2
    name = F.format_string("c%07d", "id")
    table = k.select(
        name.alias("cell_id"), F.format_string("d%03d_s%d", donor, condition).alias("sample_id"), F.format_string("d%03d", donor).alias("donor"), condition.cast("string").alias("phenotype"),
        F.when(F.col("group") % 2 == 0, "type_A").otherwise("type_B").alias("state"), F.format_string("batch_%d", donor % 3).alias("batch"))

    def draw(batches):
        names, own = np.array([f"gene_{j:04d}" for j in range(genes)], object), {}
        for b in batches:
            ids, at, values = [], [], []
            for i, cell, d, c in zip(*(b.column(x).to_pylist() for x in ("id", "cell_id", "donor", "condition"))):
                if d not in own:
                    own.clear()  # donors come one after another
                    own[d] = np.log(2) + np.random.default_rng([seed, 1, d]).normal(0, 0.35, genes)
                mu = own[d].copy()
                mu[:4] += EFFECT * c
                x = np.random.default_rng([seed, 2, i]).negative_binomial(5, 5 / (5 + np.exp(mu)))
                j = np.flatnonzero(x)
                ids += [cell] * len(j)
                at.append(j)
                values.append(x[j])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(names[np.concatenate(at)]), pa.array(np.concatenate(values).astype(np.int64))], ["cell_id", "gene_id", "count"])

    return table, k.select("id", name.alias("cell_id"), donor.alias("donor"), condition.alias("condition")).mapInArrow(draw, "cell_id string, gene_id string, count long")


def write_example(spark: SparkSession, folder: str | Path, modality: str = "bulk", samples: int = 80, features: int = 200, seed: int = 7, scenario: str = "signal") -> None:
    """A study as files that the command line reads, its planted features and a configuration: bulk as expression.csv and
    metadata.csv, cells as Parquet tables."""
    if modality not in ("bulk", "single-cell"):
        raise ValueError("modality must be bulk or single-cell")
    store = Store(spark, folder)
    if store.names():
        raise ValueError("the output folder is not empty")
    store.create()
    if modality == "bulk":
        long, meta, truth = bulk(spark, samples, features, seed, scenario)
        wide = long.groupBy("sample_id").pivot("feature_id").agg({"value": "first"}).orderBy("sample_id").toPandas()
        store.write("expression.csv", wide.to_csv(index=False).encode())
        store.write("metadata.csv", meta.orderBy("sample_id").toPandas().to_csv(index=False).encode())
        kind = scenario if scenario in ("multiclass", "continuous") else "binary"
    else:
        if scenario != "signal":
            raise ValueError("cells have the scenario signal only")
        table, counts = cells(spark, samples, features, seed=seed)
        table.write.mode("errorifexists").parquet(store.path("cells.parquet"))
        counts.write.mode("errorifexists").parquet(store.path("counts.parquet"))
        truth, kind = {f"gene_{j:04d}": sign for j, sign in enumerate((1, 1, 1, 1))}, "binary"
    store.write("truth.json", as_json(truth))
    store.write("config.json", as_json({"group": "donor", "batch": "batch", "outcome_type": kind, "seed": seed}))
