"""Run folders on any file system that Spark reaches: a manifest with the life of a run, result tables, frozen states, and hash checks."""

from __future__ import annotations

import io
import json
import math
from pathlib import Path
from typing import Any

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a file that an executor hashes as one value.
HASHED = 1 << 28


def strict(value: Any) -> Any:
    """JSON-ready: numbers that are not finite become null, tuples lists, keys text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [strict(v) for v in (sorted(value) if isinstance(value, set) else value)]
    return strict(value.item()) if hasattr(value, "item") else value


class Store:
    """A folder reached through Hadoop's file system API, as Spark's own readers and writers reach it."""

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, hadoop = spark, spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(str(folder))
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = hadoop.FileSystem.newInstance(path.getFileSystem(conf).getUri(), conf)  # its own, as the next line changes it
        self.fs.setWriteChecksum(False)
        self.make, self.root = hadoop.Path, str(self.fs.makeQualified(path))

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return bool(self.fs.exists(self.make(self.path(name))))

    def names(self) -> list[str]:
        """Of what lies directly in the folder."""
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.make(self.root))) if self.exists() else []

    def create(self) -> None:
        self.fs.mkdirs(self.make(self.root))

    def write(self, name: str, data: bytes) -> None:
        out = self.fs.create(self.make(self.path(name)), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.make(self.path(name)))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def hashes(self) -> dict[str, str]:
        """name -> SHA-256 of every data file below the folder. Executors hash files of up to HASHED bytes, each one value; larger ones stream
        through the driver's JVM in a buffer, as a hash has no parts."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        own = {r["path"]: r["h"] for r in files.where(F.col("length") <= HASHED).select("path", F.sha2("content", 256).alias("h")).collect()}
        own |= {r["path"]: self.digest(r["path"]) for r in files.where(F.col("length") > HASHED).select("path").collect()}
        return {k.removeprefix(self.root + "/"): v for k, v in own.items()}

    def digest(self, path: str) -> str:
        """SHA-256 of one file, read in a buffer."""
        jvm = self.spark.sparkContext._jvm
        stream = jvm.java.security.DigestInputStream(self.fs.open(self.make(path)), jvm.java.security.MessageDigest.getInstance("SHA-256"))
        try:
            jvm.org.apache.commons.io.IOUtils.copyLarge(stream, jvm.java.io.OutputStream.nullOutputStream())
        finally:
            stream.close()
        return bytes(stream.getMessageDigest().digest()).hex()


def as_json(value: Any) -> bytes:
    return json.dumps(strict(value), sort_keys=True, indent=1, allow_nan=False).encode()


class Run:
    """A run folder; as a context it ends as complete, or as failed with the error."""

    def __init__(self, spark: SparkSession, folder: str | Path, about: dict[str, Any]):
        self.spark, self.store, self.about = spark, Store(spark, folder), dict(about)
        if self.store.names():
            raise ValueError("the output folder is not empty")
        self.store.create()

    def _manifest(self, status: str, **more: Any) -> None:
        self.store.write("manifest.json", as_json(self.about | {"status": status} | more))

    def __enter__(self) -> Run:
        self._manifest("running")
        return self

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = self.store.path(f"{name}.parquet")
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.parquet(path)

    def csv(self, name: str, df: DataFrame) -> None:
        """A folder name.csv with one file, with a header. For evidence tables: a few rows for each feature of the study."""
        df.coalesce(1).write.mode("errorifexists").option("header", "true").csv(self.store.path(f"{name}.csv"))

    def record(self, name: str, value: Any) -> None:
        self.store.write(f"{name}.json", as_json(value))

    def tensor(self, name: str, **arrays: Any) -> None:
        """Labelled arrays as name.npz."""
        out = io.BytesIO()
        np.savez_compressed(out, **arrays)
        self.store.write(f"{name}.npz", out.getvalue())

    def __exit__(self, kind, error, _) -> bool:
        if error is not None:
            self._manifest("failed", error=str(error))
            return False
        self._manifest("complete", outputs={k: v for k, v in self.store.hashes().items() if k != "manifest.json"})
        return False


def read_record(spark: SparkSession, folder: str | Path, name: str) -> Any:
    return json.loads(Store(spark, folder).read(f"{name}.json"))


def verify(folder: str | Path, names: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, Any]:
    """The manifest of a complete run whose files (or the records of these names) still have their hashes."""
    store = Store(spark or SparkSession.active(), folder)
    manifest = json.loads(store.read("manifest.json"))
    if manifest.get("status") != "complete":
        raise ValueError("the run is not complete")
    want = {k: v for k, v in manifest["outputs"].items() if names is None or k.rsplit(".", 1)[0] in names}
    if names is not None and (lacking := set(names) - {k.rsplit(".", 1)[0] for k in want}):
        raise ValueError(f"the run has no {', '.join(sorted(lacking))}")
    try:
        got = store.hashes() if names is None else {k: store.digest(store.path(k)) for k in want if store.exists(k)}
    except (Py4JJavaError, PySparkException) as e:
        raise ValueError("a file of the run has changed and cannot be read") from e
    for name, digest in want.items():
        if got.get(name) != digest:
            raise ValueError(f"{name} has changed since the run")
    return manifest
