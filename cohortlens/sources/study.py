"""The canonical study model, and how the driver's tables stand in for one.

cells: cell_id, sample_id, donor, batch, state, outcome, account, day. counts: cell_id, gene_id, count (absent = 0).
An order is a cell, nation x market segment a specimen, a nation its donor, a region its batch, an order status a cell
state, a part brand a gene and the sum of quantities a raw count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRAMS = {"low": ("Brand#1", "Brand#2", "Brand#3"), "high": ("Brand#23", "Brand#24", "Brand#25")}
PAIRS = (("Brand#1", "Brand#2"), ("Brand#1", "Brand#3"), ("Brand#23", "Brand#24"))
THRESHOLDS = (2.0, 5.0, 7.5)
MITO_PREFIX = "Brand#2"
#: Entries that a task takes, about, of a study dealt by cell: it sums, sorts and joins them in some hundred MB.
ENTRIES = 250_000
#: Rows up to which Spark broadcasts a table in a join, about. A join with a longer one sorts both of its sides.
LONG = 2_000_000


@dataclass(frozen=True)
class Study:
    """genes: the declared universe, gene_id once each."""

    cells: DataFrame
    counts: DataFrame
    genes: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def study(spark: SparkSession, sf_dir: str) -> Study:
    t = lambda name: table(spark, sf_dir, name)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    people = t("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))  # a dimension of nations
    orders, lines, parts = t("orders"), t("lineitem"), t("part").select("p_partkey", F.col("p_brand").alias("gene_id"))
    number = lines.count()
    if number > LONG:  # else no table here is long
        orders, lines = spread(orders, "o_custkey", t("customer")), spread(lines, "l_partkey", parts, number)
    cells = orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("cell_id"), F.concat("n_name", F.lit(":"), "c_mktsegment").alias("sample_id"), F.col("n_name").alias("donor"), F.col("r_name").alias("batch"),
        F.col("o_orderstatus").alias("state"), F.col("c_mktsegment").alias("outcome"), F.col("c_acctbal").alias("account"), F.to_date("o_orderdate").alias("day"), F.col("c_custkey").alias("customer"),
    )
    entries = lines.select("l_orderkey", "l_partkey", "l_quantity").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    counts = canonical_counts(entries.select(F.col("l_orderkey").alias("cell_id"), "gene_id", F.col("l_quantity").alias("count")), number)
    return Study(cells, counts.join(cells.select("cell_id"), "cell_id", "left_semi"), parts.select("gene_id").distinct())


def dealt(df: DataFrame, size: int | None = None, share: int = ENTRIES) -> DataFrame:
    """df dealt by cell_id. size: of what its cells hold, in entries or whatever share counts; the partitions grow with it, so that a task's
    share and memory do not. (Adaptive execution sizes partitions by compressed bytes, which say little of rows, and splits none of them.)
    Unknown or less than a share: left to it."""
    if size is None or size <= share:
        return df.repartition("cell_id")
    return df.repartition(max(-(-size // share), df.sparkSession.sparkContext.defaultParallelism), "cell_id")


def spread(df: DataFrame, key: str, other: DataFrame, size: int | None = None) -> DataFrame:
    """df for its join by key with other. Where other is long, df is dealt by key into partitions that grow with its rows (size, where known),
    as such a join sorts whatever a task takes and adaptive execution sizes its tasks by compressed bytes. Else df is left as it is."""
    if other.count() <= LONG:
        return df
    return df.repartition(max(-(-(df.count() if size is None else size) // ENTRIES), df.sparkSession.sparkContext.defaultParallelism), key)


def canonical_counts(entries: DataFrame, number: int | None = None) -> DataFrame:
    """Sum repeated (cell, gene) entries and drop explicit zeros. Dealt by cell once: sums, libraries and joins by cell then need no
    other exchange. number: of the entries, where it is known."""
    return dealt(entries, number).groupBy("cell_id", "gene_id").agg(F.sum("count").cast("long").alias("count")).where("count != 0")


CELLS_SQL = """cells AS (SELECT o_orderkey AS cell_id, n_name || ':' || c_mktsegment AS sample_id, n_name AS donor, r_name AS batch, o_orderstatus AS state, c_mktsegment AS outcome,
  c_acctbal AS account, o_orderdate::DATE AS day, c_custkey AS customer
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
COUNTS_SQL = """counts AS (SELECT l_orderkey AS cell_id, p_brand AS gene_id, sum(l_quantity)::BIGINT AS count FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_orderkey IN (SELECT cell_id FROM cells) GROUP BY 1, 2 HAVING sum(l_quantity)::BIGINT <> 0)"""
BASE_SQL = f"WITH {CELLS_SQL}, {COUNTS_SQL}"
