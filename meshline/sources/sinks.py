"""Writing node and edge tables, and named query catalogues."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A table as Parquet; partitions take the place of write batches (SNK-01)."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def files_of(spark: SparkSession, path: str) -> tuple[object, Callable[[str], object]]:
    """The file system of a path, and what makes a path object."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def settle(spark: SparkSession, path: str) -> None:
    """Finish a swap that a lost driver left between its two renames: the new
    table takes the name if it was written whole, else the old one comes back.
    Call it before reading a table that replace() keeps."""
    fs, at = files_of(spark, path)
    new, old = f"{path}.new", f"{path}.old"
    if not fs.exists(at(path)):
        if fs.exists(at(f"{new}/_SUCCESS")):
            fs.rename(at(new), at(path))
        elif fs.exists(at(old)):
            fs.rename(at(old), at(path))
    if fs.exists(at(path)):
        fs.delete(at(old), True)


def replace(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a table that `df` may itself read: write beside it, then swap by
    two renames. A failed job leaves the old table; settle() mends a swap that
    was cut off."""
    settle(spark, path)
    fs, at = files_of(spark, path)
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by a join key, so later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def statements(text: str) -> dict[str, str]:
    """Named statements of a query file: each follows a line '// -- name' (SRC-18)."""
    found = re.split(r"^(?://|--)\s*[─\-]{2,}\s*(.+?)\s*[─\-]*\s*$", text, flags=re.M)
    return {name.strip(): body.strip().rstrip(";") for name, body in zip(found[1::2], found[2::2]) if body.strip()}


def config(path: str) -> dict:
    """A JSON configuration file, or YAML where that library is installed (SRC-18)."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML is not installed; use JSON") from e
    return yaml.safe_load(text)
