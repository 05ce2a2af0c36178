"""H5AD files as a Python data source, where h5py is installed (it is optional).

``read_h5ad`` gives a file's cells and counts as the other sources do. Below it, ``format("h5ad")`` reads one table of a file: ``obs`` and
``var`` (position, name and the decoded columns) or ``counts`` (row, col, count: positions and values that are not zero). Names are read with
their own table alone and joined by position, whatever the number of partitions. A partition is a block of rows, or of columns where the
matrix is compressed by columns: either way its entries come out as they lie, so no layout needs a transposing pass.

A local path, or one that pyarrow's file systems open (s3, gs, hdfs), is read in byte ranges by every partition. Any other path that
Spark reaches is fetched with SparkContext.addFile, which leaves a whole copy on every machine.
"""

from __future__ import annotations

from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGED = ("", "file", "s3", "s3a", "gs", "hdfs")
#: A fetched copy, by its name.
FETCHED = "fetched:"
#: Entries that leave in one batch.
BATCH = 1 << 20
#: Genes that are broadcast with their names (some 10 MB).
BROADCAST_GENES = 200_000


def open_file(path: str):
    """The file, open for reading."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading H5AD files needs h5py") from e
    if path.startswith(FETCHED):
        from pyspark import SparkFiles

        return h5py.File(SparkFiles.get(path.removeprefix(FETCHED)), "r")
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return h5py.File(parts.path if parts.scheme else path, "r")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return h5py.File(system.open_input_file(name), "r")


def text(x) -> str:
    return x.decode() if isinstance(x, bytes) else str(x)


def attribute(node, *names: str):
    """The first of these attributes that a node has, text as text."""
    for name in names:
        if name in node.attrs:
            value = node.attrs[name]
            return value.decode() if isinstance(value, bytes) else value
    return None


class Frame:
    """obs or var: a group of columns of equal length."""

    def __init__(self, group, called: str):
        if not hasattr(group, "keys"):
            raise ValueError(f"{called} is stored as one compound array: write the file again with a current version")
        self.group, self.index = group, text(attribute(group, "_index") or "_index")
        order = attribute(group, "column-order")
        names = [text(x) for x in order] if order is not None else sorted(k for k in group.keys() if k not in (self.index, "__categories"))
        self.columns = [n for n in names if n != self.index]
        self.rows = len(group[self.index])

    def categories(self, name: str):
        """Categories and codes of a categorical column, of either way to store it; else None."""
        node = self.group[name]
        if hasattr(node, "keys") and "categories" in node:
            return node["categories"], node["codes"]
        old = self.group["__categories"] if "__categories" in self.group else {}
        return (old[name], node) if name in old else None

    def kind(self, name: str) -> T.DataType:
        pair = self.categories(name)
        node = pair[0] if pair else self.group[name]
        if hasattr(node, "keys"):  # values and a mask
            node = node["values"]
        return {"b": T.BooleanType(), "i": T.LongType(), "u": T.LongType(), "f": T.DoubleType()}.get(node.dtype.kind, T.StringType())

    def values(self, name: str, a: int, b: int) -> pa.Array:
        """Rows a to b of a column; missing categories, masked values and NaN are null."""
        kind, pair, node = self.kind(name), self.categories(name), self.group[name]
        if pair:
            codes = np.asarray(pair[1][a:b], np.int64)
            missing, values = codes < 0, np.asarray(pair[0][:])[np.maximum(codes, 0)] if len(pair[0]) else np.full(b - a, "", object)
        elif hasattr(node, "keys"):
            missing, values = np.asarray(node["mask"][a:b], bool), np.asarray(node["values"][a:b])
        else:
            values = np.asarray(node[a:b])
            missing = np.zeros(len(values), bool)
        if isinstance(kind, T.StringType):
            return pa.array([None if m else text(v) for m, v in zip(missing, values)], pa.string())
        if isinstance(kind, T.DoubleType):
            missing = missing | np.isnan(values)
        types = {T.BooleanType: pa.bool_(), T.LongType: pa.int64(), T.DoubleType: pa.float64()}
        return pa.array(values.astype({T.BooleanType: bool, T.LongType: np.int64, T.DoubleType: float}[type(kind)]), types[type(kind)], mask=missing)


class Matrix:
    """X or a layer: dense, or compressed by rows or columns. shape: what obs and var say; a matrix of another is refused."""

    def __init__(self, file, layer: str, shape: tuple[int, int]):
        if layer != "X" and ("layers" not in file or layer not in file["layers"]):
            raise ValueError(f"the file has no layer {layer}")
        self.node = file["X"] if layer == "X" else file["layers"][layer]
        if hasattr(self.node, "keys"):
            name = str(attribute(self.node, "encoding-type", "h5sparse_format") or "")
            if name[:3] not in ("csr", "csc"):
                raise ValueError(f"the matrix has an unknown layout: {name or 'none is given'}")
            self.by, own = name[:3], attribute(self.node, "shape", "h5sparse_shape")
            ends = self.node["indptr"]
            if len(ends) - 1 != shape[self.by == "csc"] or len(self.node["indices"]) != len(self.node["data"]) or int(ends[len(ends) - 1]) != len(self.node["data"]):
                raise ValueError("the matrix's pointers, indices and values do not fit each other")
        else:
            self.by, own = "dense", self.node.shape
        if own is None or tuple(int(x) for x in own) != shape:
            raise ValueError(f"the matrix is {own}, the names are {shape}")
        self.shape = shape

    def blocks(self, rows: int) -> list[tuple[int, int]]:
        """Borders of blocks of about so many rows, or of as many columns as have as many entries; dense ones end where a stored chunk does."""
        n, step = self.shape[0], rows
        if self.by == "csc":
            n, step = self.shape[1], max(1, rows * self.shape[1] // max(self.shape[0], 1))
        elif self.by == "dense" and getattr(self.node, "chunks", None):
            step = -(-rows // self.node.chunks[0]) * self.node.chunks[0]
        return [(a, min(a + step, n)) for a in range(0, n, step)]

    def entries(self, a: int, b: int):
        """(rows, columns, values) of a block in parts of bounded size, zeros left out."""
        if self.by == "dense":
            few = max(1, BATCH // max(self.shape[1], 1))
            for k in range(a, b, few):
                block = np.asarray(self.node[k:min(k + few, b)], float)
                rows, columns = np.nonzero(block)
                yield rows + k, columns, block[rows, columns]
            return
        ends = np.asarray(self.node["indptr"][a:b + 1], np.int64)
        for start in range(int(ends[0]), int(ends[-1]), BATCH):
            stop = min(start + BATCH, int(ends[-1]))
            major = a + np.searchsorted(ends, np.arange(start, stop), side="right") - 1
            minor, values = np.asarray(self.node["indices"][start:stop], np.int64), np.asarray(self.node["data"][start:stop], float)
            if len(minor) and (minor.min() < 0 or minor.max() >= self.shape[self.by == "csr"]):
                raise ValueError("the matrix points beyond its names")
            full = values != 0
            yield (major[full], minor[full], values[full]) if self.by == "csr" else (minor[full], major[full], values[full])


class H5adSource(DataSource):
    """spark.read.format("h5ad").option("path", ...).option("table", "counts" | "obs" | "var"), for counts also layer and chunk_size."""

    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def schema(self) -> T.StructType | str:
        table = self.options.get("table", "counts")
        if table == "counts":
            return "row long, col long, count double"
        with open_file(self.options["path"]) as f:
            frame = Frame(f[table], table)
            return T.StructType([T.StructField("position", T.LongType()), T.StructField("name", T.StringType()), *(T.StructField(c, frame.kind(c)) for c in frame.columns)])

    def reader(self, schema) -> DataSourceReader:
        return H5adReader(self.options, schema)


class Block(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))


class H5adReader(DataSourceReader):
    def __init__(self, options, schema=None):
        self.path, self.table = options["path"], options.get("table", "counts")
        self.layer, self.rows = options.get("layer", "X"), int(options.get("chunk_size", 2048))
        self.names = [f.name for f in schema.fields] if schema is not None else ["row", "col", "count"]

    def _matrix(self, f) -> Matrix:
        return Matrix(f, self.layer, (Frame(f["obs"], "obs").rows, Frame(f["var"], "var").rows))

    def partitions(self):
        with open_file(self.path) as f:
            if self.table == "counts":
                borders = self._matrix(f).blocks(self.rows)
            else:
                n = Frame(f[self.table], self.table).rows
                borders = [(a, min(a + (1 << 18), n)) for a in range(0, n, 1 << 18)]
        return [Block(a, b) for a, b in borders] or [Block(0, 0)]

    def read(self, partition):
        a, b = partition.value
        with open_file(self.path) as f:
            if self.table == "counts":
                for rows, columns, values in self._matrix(f).entries(a, b) if a < b else ():
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(columns, pa.int64()), pa.array(values, pa.float64())], ["row", "col", "count"])
            elif a < b:
                frame = Frame(f[self.table], self.table)
                names = pa.array([text(x) for x in frame.group[frame.index][a:b]], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b), pa.int64()), names, *(frame.values(c, a, b) for c in frame.columns)], self.names)


def read_h5ad(spark: SparkSession, path: str, layer: str | None = None, chunk_size: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(cells, counts): cell_id and the columns of obs; cell_id, gene_id, count. Repeated names of cells or genes are refused, and values that
    are no counts fail the query that reads them. Repeated entries add up, zeros are left out."""
    from .study import canonical_counts

    if urlsplit(path).scheme not in RANGED:
        spark.sparkContext.addFile(path)
        path = FETCHED + path.rstrip("/").rsplit("/", 1)[1]
    spark.dataSource.register(H5adSource)
    table = lambda name: spark.read.format("h5ad").option("path", path).option("table", name)
    obs, var = table("obs").load(), table("var").load()
    for called, names in (("cells", obs), ("genes", var)):
        if not names.groupBy("name").count().where("count > 1").isEmpty():
            raise ValueError(f"{path} repeats names of {called}")
    if "cell_id" in obs.columns:
        raise ValueError("obs has a column cell_id, which is what the names of the cells become")
    value = F.col("count")
    whole = F.when((value >= 0) & (F.abs(value - F.rint(value)) <= 1e-6), F.rint(value)).otherwise(F.raise_error(F.lit("counts must be finite non-negative whole numbers")).cast("double"))
    genes = var.select(F.col("position").alias("col"), F.col("name").alias("gene_id"))
    genes = F.broadcast(genes) if genes.count() <= BROADCAST_GENES else genes
    raw = table("counts").option("layer", layer or "X").option("chunk_size", str(chunk_size)).load()
    named = raw.withColumn("count", whole).join(genes, "col").join(obs.select(F.col("position").alias("row"), F.col("name").alias("cell_id")), "row")
    return obs.drop("position").withColumnRenamed("name", "cell_id"), canonical_counts(named.select("cell_id", "gene_id", "count"))
