"""Tables to the long model and back: delimited files, Matrix Market, annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, text_columns: Sequence[str] = ()) -> DataFrame:
    """A CSV or TSV file (tab where the name has .tsv; gzip as it comes) whose first column is a string id. "NA" stays text
    in text columns and the id; other columns become doubles. Repeated headers and fewer than two columns are errors."""
    sep = "\t" if ".tsv" in path.lower() else ","
    names = [x.strip() for x in spark.read.text(path).first()[0].split(sep)]
    if len(names) < 2:
        raise ValueError(f"{path}: at least two columns are needed")
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: repeated column names")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.csv(path, schema=schema, sep=sep, header=True, nullValue="\x00", emptyValue="")
    text = {names[0], *text_columns}
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    return raw.select(*[F.col(f"`{c}`") if c in text else number(c).alias(c) for c in names])


def read_metadata(spark: SparkSession, path: str, named: Sequence[str] | None, covariates: Sequence[str] = (), numeric: bool = False) -> DataFrame:
    """A delimited file of samples or cells: named columns (None: all) stay text, and so do covariates with a value that is not a number;
    others become doubles. numeric: the covariates must be numbers."""
    every = read_delimited(spark, path, spark.read.text(path).first()[0].replace("\t", ",").split(","))
    texts, first = every, every.columns[0]
    names = {c.strip() for c in every.columns}
    if missing := sorted(set([*(named or ()), *covariates]) - names):
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    odd = lambda c: F.count_if(F.col(c).isNotNull() & (F.trim(c) != "") & F.expr(f"try_cast(`{c}` AS double)").isNull()).alias(c)
    found = texts.agg(*[odd(c) for c in covariates]).first() if covariates else {}
    words = {c for c in covariates if found[c]}
    if numeric and words:
        raise ValueError(f"not numbers: {', '.join(sorted(words))}")
    text = {first, *words} | (set(named) if named is not None else names - set(covariates))
    return every.select(*[F.col(f"`{c}`") if c in text else F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in every.columns])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, gene_symbol of a delimited file; genes must be unique."""
    table = read_metadata(spark, path, None)
    if not {"gene_id", "gene_symbol"} <= set(table.columns) or not table.groupBy("gene_id").count().where("count > 1").isEmpty():
        raise ValueError("annotations need unique gene_id and gene_symbol")
    return table.select("gene_id", "gene_symbol")


def to_long(wide: DataFrame, sample_ids: DataFrame, orientation: str = "auto") -> DataFrame:
    """sample_id, feature_id, value from a matrix with one id column. sample_ids: sample_id. The orientation is that in which
    the ids of exactly one axis equal the samples; NaN becomes null."""
    first, *columns = wide.columns
    if orientation == "auto":
        wanted = sample_ids.select(F.col("sample_id").cast("string").alias("id")).distinct()
        equal = lambda ids: wanted.exceptAll(ids).isEmpty() and ids.exceptAll(wanted).isEmpty()
        by_row, by_column = equal(wide.select(F.col(f"`{first}`").cast("string").alias("id"))), equal(wide.sparkSession.createDataFrame([(c,) for c in columns], "id string"))
        if by_row == by_column:
            raise ValueError("the samples must match exactly one axis of the matrix")
        orientation = "samples" if by_row else "features"
    long = wide.unpivot([first], columns, "other", "value")
    names = {"samples": (first, "other"), "features": ("other", first)}[orientation]
    value = F.when(F.isnan("value"), None).otherwise(F.col("value")).cast("double")
    return long.select(F.col(f"`{names[0]}`").cast("string").alias("sample_id"), F.col(f"`{names[1]}`").cast("string").alias("feature_id"), value.alias("value"))


def to_wide(long: DataFrame, features: Sequence[str]) -> DataFrame:
    return long.groupBy("sample_id").pivot("feature_id", list(features)).agg(F.first("value"))


def annotate(df: DataFrame, annotations: DataFrame, key: str = "gene_id") -> DataFrame:
    """Left join of gene_symbol, '' where unknown; annotations must be unique by key."""
    if not annotations.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("annotations repeat a gene")
    return df.join(annotations.select(key, "gene_symbol"), key, "left").withColumn("gene_symbol", F.coalesce("gene_symbol", F.lit("")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (1-based, in file order), text of one file: places within its splits, shifted by the lines of the splits before."""
    lines = spark.read.text(path).select(F.col("value").alias("text"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = lines.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("start"))  # a row a split
    return lines.join(F.broadcast(starts), "part").select((F.col("start") + F.col("at") + 1).alias("line"), "text")


def read_matrix_market(spark: SparkSession, matrix: str, genes: str, barcodes: str, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, counts) of a coordinate Matrix Market file of genes x cells with gene and barcode lists. metadata: cell_id and
    others, matched to the barcodes exactly. Genes of a type other than "Gene Expression" are left out. Entries are parsed where
    they lie; the line of sizes is the first that is no comment, and its sizes must equal the lists'."""
    parts = F.split(F.trim("text"), r"\s+")
    lines = spark.read.text(matrix).select(F.col("value").alias("text")).where(~F.col("text").startswith("%") & (F.trim("text") != ""))
    head = lines.first()
    if head is None or len(head[0].split()) != 3:
        raise ValueError("the matrix has no line of sizes")
    sizes = [int(x) for x in head[0].split()]
    rows = lines.select(parts[0].cast("long").alias("g"), parts[1].cast("long").alias("c"), parts[2].cast("double").alias("count"), F.col("text"))
    # an entry may read as the line of sizes does; only one row of that text is the line itself
    again = rows.where(F.col("text") == head[0])
    n, twins = rows.count() - 1, again.count() - 1
    if n != sizes[2]:
        raise ValueError("the matrix does not have the number of entries that it declares")
    entries = rows.where(F.col("text") != head[0]).unionByName(again.limit(twins)).drop("text")
    col = F.split("text", "\t")
    gene = numbered_lines(spark, genes).select(F.col("line").alias("g"), col[0].alias("gene_id"), F.when(F.size(col) > 2, col[2]).otherwise("Gene Expression").alias("kind")).where("kind = 'Gene Expression'")
    cell = numbered_lines(spark, barcodes).select(F.col("line").alias("c"), F.trim("text").alias("cell_id"))
    if numbered_lines(spark, genes).count() != sizes[0] or cell.count() != sizes[1]:
        raise ValueError("the lists of genes and barcodes do not fit the matrix")
    if not cell.select("cell_id").exceptAll(metadata.select("cell_id")).isEmpty() or not metadata.select("cell_id").exceptAll(cell.select("cell_id")).isEmpty():
        raise ValueError("metadata and barcodes differ")
    if not entries.where("count < 0 or abs(count - rint(count)) > 1e-6").isEmpty():
        raise ValueError("counts must be non-negative integers")
    counts = entries.join(gene, "g").join(cell, "c").groupBy("cell_id", "gene_id").agg(F.sum("count").cast("long").alias("count")).where("count != 0")
    return metadata, counts
