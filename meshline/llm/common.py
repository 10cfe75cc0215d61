"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts can be long, so a batch is small.
BATCH_ROWS = 512

#: Separators of words become spaces and A-Z becomes a-z; bytes from 0x80 belong to words.
WORD_BYTES = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


#: A worker process lives through many stages; each operator's caches are cleared
#: when another operator begins in the process, so they never add up.
CACHES: dict[str, Callable[[], None]] = {}


def begin(name: str, clear: Callable[[], None]) -> None:
    """Operator `name` begins in this worker; `clear` empties its caches."""
    for other in [x for x in CACHES if x != name]:
        CACHES.pop(other)()
    CACHES[name] = clear


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that one Arrow batch holds, for tables of long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def exact(df: DataFrame, name: str) -> Column:
    """Column `name`, whatever dots or clashes with other names it has."""
    return df["`" + name.replace("`", "``") + "`"]


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text binary): UTF-8 bytes reach Python without a decode."""
    small_batches(docs.sparkSession)
    return docs.select(exact(docs, doc_id).cast("long").alias("doc_id"), exact(docs, text).cast("binary").alias("text"))


def pieces(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of `batch` in order, in slices of about `most_bytes` of its binary column."""
    col, at, n = batch.column(column), 0, batch.num_rows
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
    held, first = 0, 0
    for at in range(n):
        if held and held + sizes[at] > most_bytes:
            yield batch.slice(first, at - first)
            held, first = 0, at
        held += sizes[at]
    if n:
        yield batch.slice(first, n - first)


def filtered(docs: DataFrame, keeper: Callable[[], Callable[[list, list], list]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, for which `keeper()(ids, texts as bytes
    or None)` is true; `keeper` is called once for each task. No shuffle, and no
    column is added, so no name can clash."""
    small_batches(docs.sparkSession)
    at_id, at_text = docs.columns.index(doc_id), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keeper()
        for whole in batches:
            for batch in pieces(whole, at_text):
                texts = batch.column(at_text).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array(keep(batch.column(at_id).to_pylist(), texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def by_hash(*columns: Column) -> Column:
    """A fixed pseudo-random order."""
    return F.xxhash64(*columns)
