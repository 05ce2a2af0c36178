"""What several operators of this subpackage share: shared storage, checked broadcasts, salted joins."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: spark.checkpoint.dir. Where that is unset, a temporary folder for each
    application on one machine (tests); on a cluster, whose executors could not reach that, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="cohortlens-")
        path = _own[app]
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet under the shared folder and read it back. Unlike a local checkpoint this
    outlives any executor, and unlike persist() it is columnar and prunable."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    scopes = _open.get()
    if scopes:
        scopes[-1].append(path)
    return out


#: Paths written inside each open scratch() of this thread or task, innermost last: another one's tables are its own affair.
_open: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Inside, an operator that ends with its own last materialize() names what outlives it: the tables that materialize() wrote here are
    deleted at the end, but those given to the function that this yields."""
    kept: set[str] = set()
    outer, made = _open.get(), []
    token = _open.set((*outer, made))
    try:
        yield lambda *tables: kept.update(t._table_path for t in tables)
    finally:
        _open.reset(token)
        for path in made:
            if path not in kept:
                delete(spark, path)
            elif outer:
                outer[-1].append(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A table may be broadcast when it has at most so many (narrow) rows: about 20 MB.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within limit, else as it is (Spark then joins by shuffle,
    and adaptive execution splits skewed partitions)."""
    return F.broadcast(df) if rows <= limit else df


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, for loaded vocabularies and memos."""
    import builtins

    return builtins.__dict__.setdefault("_cohortlens_state", {})


def tidied(run):
    """run, a function for mapInArrow, that hands its freed memory back to the system when a task ends: workers live on
    through many stages, and what their allocators keep adds up."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return go


def free_prefix(df: DataFrame, prefix: str) -> str:
    """prefix, with underscores behind it until no column of df begins with it (in whatever case)."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def add_column(df: DataFrame, name: str, kind: str, values, reads: str = "text", keep: bool = True) -> DataFrame:
    """df with one more column, made from its column ``reads`` (which goes unless keep) by Arrow batches. values() is called once a
    task and returns a function from a list of values to a list of results."""
    from pyspark.sql import types as T

    field = {"double": T.DoubleType(), "long": T.LongType(), "double[]": T.ArrayType(T.DoubleType())}[kind]
    at = df.columns.index(reads)
    rest = [k for k in range(len(df.columns)) if keep or k != at]
    schema = T.StructType([*(df.schema.fields[k] for k in rest), T.StructField(name, field)])

    def run(batches):
        import pyarrow as pa

        made = {"double": pa.float64(), "long": pa.int64(), "double[]": pa.list_(pa.float64())}[kind]
        give = values()
        for batch in batches:
            texts, new = batch.column(at), []
            for a in range(0, len(texts), PART_ROWS):
                new += give([x.as_py() or "" for x in texts.slice(a, PART_ROWS)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(new, made)], [*(batch.schema.names[k] for k in rest), name])

    return df.mapInArrow(tidied(run), schema)


#: Rows of whole texts that go to Python at once, where the session sets no number of its own; and those that are Python strings at a time.
TEXT_ROWS = 2000
PART_ROWS = 500


@contextlib.contextmanager
def text_batches(spark: SparkSession):
    """Smaller Arrow batches than Spark's 10,000 rows while an operator sends whole texts to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) != "10000":
        yield
        return
    spark.conf.set(key, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, "10000")


def crc_fold(doc_id) -> "F.Column":
    """crc32 of the id as text, modulo 3; 1 marks rows held out from training."""
    return F.crc32(doc_id.cast("string")) % 3
