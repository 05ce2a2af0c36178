"""Public inputs fetched once and pinned by their checksums."""

from __future__ import annotations

import hashlib
import urllib.request
from pathlib import Path

from pyspark.sql import SparkSession

from .runs import Store


def pinned(spark: SparkSession, url: str, sha256: str, folder: str | Path, name: str, timeout: float = 60.0) -> str:
    """The path of folder/name, fetched from url unless it is there already. A file with another SHA-256 than the pinned one is an error,
    and is not kept; the only step of the library that uses a network."""
    store = Store(spark, folder)
    data = store.read(name) if store.exists(name) else None
    if data is None:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310  the checksum decides
            data = answer.read()
    if hashlib.sha256(data).hexdigest() != sha256.lower():
        raise ValueError(f"{name} does not have the pinned checksum")
    if not store.exists(name):
        store.create()
        store.write(name, data)
    return store.path(name)
