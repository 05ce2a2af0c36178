"""Cells to specimens: quality control, pseudobulk and distribution features.

Counts are sparse (an absent (cell, gene) row is a zero), so every mean, share and moment divides by a number of cells
taken from the cell table, never by a number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digests import summed
from ..functions.ranks import quantiles

KEY = ("sample_id", "state")


def cell_quality(cells: DataFrame, counts: DataFrame, mito_prefix: str) -> DataFrame:
    """cells with library, detected, mito_fraction (0 for empty libraries); cells without counts included."""
    per_cell = counts.groupBy("cell_id").agg(
        F.sum("count").alias("library"), F.count_if(F.col("count") > 0).alias("detected"),
        F.sum(F.when(F.col("gene_id").startswith(mito_prefix), F.col("count"))).alias("mito"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = cells.join(per_cell, "cell_id", "left").withColumns({c: zero(c) for c in ("library", "detected", "mito")})
    return out.withColumn("mito_fraction", F.col("mito") / F.greatest("library", F.lit(1))).drop("mito")


def passes(min_counts: int, min_genes: int, max_mito: float) -> Column:
    return (F.col("library") >= min_counts) & (F.col("detected") >= min_genes) & (F.col("mito_fraction") <= max_mito)


def select_states(cells: DataFrame, states: Sequence[str]) -> DataFrame:
    return cells.where(F.col("state").isin(list(states)))


def cell_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEY).agg(F.count("*").alias("n_cells"))


def pseudobulk(cells: DataFrame, counts: DataFrame, min_cells: int = 1, genes: DataFrame | None = None) -> DataFrame:
    """state, sample_id, gene_id, count, n_cells on the complete grid of kept (state, sample) and genes (default: of the counts)."""
    groups = cell_totals(cells).where(F.col("n_cells") >= min_cells)
    sums = counts.join(cells.select("cell_id", *KEY), "cell_id").groupBy(*KEY, "gene_id").agg(F.sum("count").alias("count"))
    universe = (counts if genes is None else genes).agg(F.array_sort(F.collect_set("gene_id")).alias("g"))  # one row: the gene dimension
    grid = groups.join(F.broadcast(universe)).select(*KEY, "n_cells", F.explode("g").alias("gene_id"))
    return grid.join(sums, [*KEY, "gene_id"], "left").select("state", "sample_id", "gene_id", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "n_cells")


def log_normalize(cells: DataFrame, counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """counts with value = ln(1 + scale * count / library); the library is of the full gene universe."""
    library = F.sum("count").over(W.partitionBy("cell_id"))  # a cell's genes at most
    return counts.withColumn("library", library).join(cells.select("cell_id", *KEY), "cell_id").withColumn("value", F.log1p(F.lit(scale) * F.col("count") / F.greatest("library", F.lit(1))))


def gene_moments(values: DataFrame, thresholds: Sequence[float] = ()) -> DataFrame:
    """One aggregation for all gene blocks: sums, squares, detections and tails by (sample, state, gene). Additive: partial
    results of any split of the cells merge by addition."""
    tails = [F.count_if(F.col("value") > t).alias(f"tail_{i}") for i, t in enumerate(thresholds)]
    return values.groupBy(*KEY, "gene_id").agg(F.sum("count").alias("total"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.count_if(F.col("count") > 0).alias("detected"), *tails)


def merge_moments(partials: DataFrame) -> DataFrame:
    sums = [c for c in partials.columns if c not in (*KEY, "gene_id")]
    return partials.groupBy(*KEY, "gene_id").agg(*[F.sum(c).alias(c) for c in sums])


def on_grid(groups: DataFrame, genes: DataFrame, moments: DataFrame) -> DataFrame:
    """Every (sample, state) with n_cells and every gene of a declared list, zeros where no cell has a count."""
    declared = F.broadcast(genes.agg(F.array_sort(F.collect_set("gene_id")).alias("g")))  # one row
    grid = groups.join(declared).select(*KEY, "n_cells", F.explode("g").alias("gene_id"))
    sums = [c for c in moments.columns if c not in (*KEY, "gene_id")]
    return grid.join(moments, [*KEY, "gene_id"], "left").na.fill(0, sums)


def _if_enough(value: Column, min_cells: int) -> Column:
    return F.when(F.col("n_cells") >= min_cells, value)


def mean(total: str = "s") -> Column:
    return F.col(total) / F.col("n_cells")


def variance(s: str = "s", ss: str = "ss") -> Column:
    """Sample variance over all cells, null under two."""
    n = F.col("n_cells")
    return F.when(n >= 2, F.greatest(F.col(ss) - F.col(s) * F.col(s) / n, F.lit(0.0)) / (n - 1))


def correlation(a: str, b: str, aa: str, bb: str, ab: str) -> Column:
    """Pearson over all cells from sums; null under three cells or without spread; within [-1, 1]."""
    n = F.col("n_cells")
    va, vb = F.col(aa) - F.col(a) * F.col(a) / n, F.col(bb) - F.col(b) * F.col(b) / n
    r = (F.col(ab) - F.col(a) * F.col(b) / n) / F.sqrt(va * vb)
    return F.when((n >= 3) & (va > 1e-10) & (vb > 1e-10), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def abundance(cells: DataFrame, states: Sequence[str]) -> DataFrame:
    """sample_id, state, value: log odds of a state's share, offset .001, over all cells, those of other states included."""
    per = cells.groupBy("sample_id").agg(F.count("*").alias("n_all"), *[F.count_if(F.col("state") == s).alias(f"n_{i}") for i, s in enumerate(states)])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"n_{i}").alias("n")) for i, s in enumerate(states)])).alias("x")
    p = F.col("x.n") / F.col("n_all")
    return per.select("sample_id", "n_all", each).select("sample_id", F.col("x.state").alias("state"), F.log((p + 0.001) / (1 - p + 0.001)).alias("value"))


def gene_blocks(grid: DataFrame, thresholds: Sequence[float], min_cells: int) -> DataFrame:
    """Long features (sample_id, state, kind, source, value) of the gene blocks, null where a state has too few cells."""
    tails = [F.struct(F.lit("gene_tail").alias("kind"), F.concat("gene_id", F.lit(f">{t}")).alias("source"), mean(f"tail_{i}").alias("value")) for i, t in enumerate(thresholds)]
    plain = {"gene_mean": mean(), "gene_detection": mean("detected"), "gene_variance": variance()}
    blocks = [F.struct(F.lit(k).alias("kind"), F.col("gene_id").alias("source"), v.alias("value")) for k, v in plain.items()]
    long = grid.select(*KEY, "n_cells", F.explode(F.array(*blocks, *tails)).alias("f"))
    return long.select(*KEY, "f.kind", "f.source", _if_enough(F.col("f.value"), min_cells).alias("value"))


#: Doubles of a dense block of cells, and of their products.
BLOCK = 1 << 21


def _gram(size: int, left: list[int], right: list[int]):
    """Rows (sample_id, state, at, v), a cell's places among the declared names and its values there, sorted by group -> for each group of a
    task the sums by place (a = b), the sums of products by pair, and at a = b = -1 the cells (sample_id, state, a, b, s, ss). Cells are
    multiplied a dense block at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rows = max(1, BLOCK // max(size, len(left), 1))
        key, sums = None, None

        def flush():
            s, ss, ab, cells = sums
            a, b = np.r_[np.arange(-1, size), left].astype(np.int32), np.r_[np.arange(-1, size), right].astype(np.int32)
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.string()), pa.array(a), pa.array(b), pa.array(np.r_[cells, s, np.zeros(len(left))]), pa.array(np.r_[0.0, ss, ab])], ["sample_id", "state", "a", "b", "s", "ss"])

        for batch in batches:
            keys = list(zip(batch.column("sample_id").to_pylist(), batch.column("state").to_pylist()))
            begins = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])] if keys else []
            for begin, end in zip(begins, [*begins[1:], len(keys)]):
                if keys[begin] != key:
                    if key is not None:
                        yield flush()
                    key, sums = keys[begin], [np.zeros(size), np.zeros(size), np.zeros(len(left)), 0.0]
                for k in range(begin, end, rows):
                    part = batch.slice(k, min(rows, end - k))
                    at, v = part.column("at"), part.column("v")
                    x = np.zeros((part.num_rows, size))
                    x[np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = v.flatten().to_numpy()
                    sums[3] += part.num_rows
                    sums[0] += x.sum(axis=0)
                    sums[1] += (x * x).sum(axis=0)
                    sums[2] += np.einsum("ij,ij->j", x[:, left], x[:, right])
        if key is not None:
            yield flush()

    return run


def pair_sums(values: DataFrame, name: str, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """sample_id, state, n_rows, a, b, sa, ssa, sb, ssb, ab of each group that has a row and each declared pair of names: sums over its cells,
    an absent value being a zero; n_rows: its cells with a row. values: cell_id, sample_id, state and the two columns. A cell's declared
    values form one row; rows are dealt by ranges of (group, cell), so a group of any size is split evenly and a task meets few groups;
    tasks multiply blocks of cells and send on a row a group and pair. The plan does not grow with the pairs."""
    spark, declared = values.sparkSession, sorted({n for p in pairs for n in p})
    place = {n: i for i, n in enumerate(declared)}
    places = F.broadcast(spark.createDataFrame(list(place.items()), f"{name} string, __at int"))  # declared names
    entry = F.when(F.col("__at").isNotNull() & (F.col(value) != 0), F.struct("__at", F.col(value).cast("double").alias("__v")))
    own = values.join(places, name, "left").groupBy("cell_id", *KEY).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    own = own.select("cell_id", *KEY, F.col("e.__at").alias("at"), F.col("e.__v").alias("v"))
    dealt = own.repartitionByRange(*KEY, "cell_id").sortWithinPartitions(*KEY).drop("cell_id")
    found = dealt.mapInArrow(_gram(len(declared), [place[a] for a, _ in pairs], [place[b] for _, b in pairs]), "sample_id string, state string, a int, b int, s double, ss double")
    found = found.groupBy(*KEY, "a", "b").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    sums = found.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b"), F.struct("s", "ss")))).alias("m"))  # a group's declared names and pairs
    wanted = spark.createDataFrame([(a, b, place[a], place[b]) for a, b in pairs], "a string, b string, i int, j int")
    grid = sums.join(F.broadcast(wanted.agg(F.collect_list(F.struct("*")).alias("p")))).select(*KEY, "m", F.explode("p").alias("p"))  # one row: the declared pairs
    at = lambda i, j, part: F.try_element_at("m", F.struct(i.alias("a"), j.alias("b")))[part]
    i, j, none = F.col("p.i"), F.col("p.j"), F.lit(-1)
    columns = {"sa": at(i, i, "s"), "ssa": at(i, i, "ss"), "sb": at(j, j, "s"), "ssb": at(j, j, "ss"), "ab": at(i, j, "ss")}
    return grid.select(*KEY, at(none, none, "s").cast("long").alias("n_rows"), "p.a", "p.b", *[v.alias(c) for c, v in columns.items()])


def pair_moments(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of genes, declared: the sums of pair_sums."""
    return pair_sums(values, "gene_id", "value", sorted({(r["a"], r["b"]) for r in pairs.select("a", "b").collect()})).drop("n_rows")


def program_scores(cells: DataFrame, values: DataFrame, programs: DataFrame) -> DataFrame:
    """cell_id, sample_id, state, program, score for every cell: sum of its members' values over the program's size;
    absent genes count as 0, and cells without any member score 0."""
    size = programs.groupBy("program").agg(F.count("*").alias("size"))
    hit = values.join(F.broadcast(programs), "gene_id").groupBy("cell_id", "program").agg(F.sum("value").alias("v"))
    names = F.broadcast(size.agg(F.collect_list(F.struct("program", "size")).alias("p")))
    all_cells = cells.join(names).select("cell_id", *KEY, F.explode("p").alias("p")).select("cell_id", *KEY, "p.program", "p.size")
    return all_cells.join(hit, ["cell_id", "program"], "left").select("cell_id", *KEY, "program", (F.coalesce("v", F.lit(0.0)) / F.col("size")).alias("score"))


def program_blocks(scores: DataFrame, thresholds: dict[str, float], min_cells: int) -> DataFrame:
    """sample_id, state, program with mean, variance, q90 and fraction above the program's threshold (null for programs without one)."""
    limit = F.lit(None).cast("double")
    for program, least in thresholds.items():  # declared
        limit = F.when(F.col("program") == program, F.lit(float(least))).otherwise(limit)
    g = scores.groupBy(*KEY, "program").agg(
        F.count("*").alias("n_cells"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"),
        F.when(F.max(limit).isNotNull(), F.count_if(F.col("score") > limit)).alias("over"),
    ).join(quantiles(scores, [*KEY, "program"], "score", {"q90": 0.9}), [*KEY, "program"])
    cols = {"program_mean": mean(), "program_variance": variance(), "program_q90": F.col("q90"), "program_fraction": mean("over")}
    return g.select(*KEY, "program", *[_if_enough(v, min_cells).alias(k) for k, v in cols.items()])


def program_correlations(scores: DataFrame, programs: Sequence[str] | None = None) -> DataFrame:
    """For every pair of programs (a < b), the correlation of their scores within each (sample, state). programs: their declared names."""
    names = sorted(programs if programs is not None else [r[0] for r in scores.select("program").distinct().collect()])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    found = pair_sums(scores, "program", "score", pairs).withColumnRenamed("n_rows", "n_cells")
    return found.select(*KEY, "a", "b", correlation("sa", "sb", "ssa", "ssb", "ab").alias("value"))


def technical(quality: DataFrame, keep: Column) -> DataFrame:
    """Per sample: cells, failed cells, and means of library, detected genes and mito share over all its cells."""
    return quality.groupBy("sample_id").agg(
        F.count("*").alias("cells"), F.count_if(~keep).alias("failed"), F.avg("library").alias("mean_library"), F.avg("detected").alias("mean_detected"), F.avg("mito_fraction").alias("mean_mito"),
    )


def keyed_uniform(cell_id: Column, seed: int, perturbation: int) -> Column:
    """A uniform in [0, 1) that depends on the cell's id, the seed and the perturbation only (48 bits of an MD5)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(perturbation), cell_id.cast("string"))), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def subsample(cells: DataFrame, fraction: float, seed: int, perturbation: int) -> DataFrame:
    return cells.where(keyed_uniform(F.col("cell_id"), seed, perturbation) < fraction)


def cap_cells(cells: DataFrame, per_sample: int, seed: int) -> DataFrame:
    """At most so many cells of each sample, drawn by hash (the operator is a cap)."""
    from pyspark.sql import Window as W

    order = W.partitionBy("sample_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("cell_id").cast("string"))), "cell_id")
    return cells.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_sample).drop("k")


def profile_hash(counts: DataFrame, cells: DataFrame, universe: str) -> DataFrame:
    """cell_id, sample_id, digest: SHA-256 of the gene universe, the state and the sorted (gene, count) list of the cell."""
    entry = F.concat_ws(":", "gene_id", F.col("count").cast("string"))
    lists = counts.groupBy("cell_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("entries"))
    return cells.join(lists, "cell_id", "left").select("cell_id", "sample_id", F.sha2(F.concat_ws("|", F.lit(universe), "state", F.coalesce("entries", F.lit(""))), 256).alias("digest"))


def multiset_digest(profiles: DataFrame) -> DataFrame:
    """sample_id, n_cells, digest: the sum of the cells' digests modulo 2**256, in hexadecimal."""
    return summed(profiles, ["sample_id"], F.col("digest"), "n_cells")
