"""Token-id output: ORC files of token ids, ascending by document id.

Ids go through ORC's integer run-length encoding as ``array<int>``; row indexes
(min and max of each group of rows) and Bloom filters on ``doc_id`` let a lookup
skip stripes and row groups, and a scan reads stripes in parallel. A file holds
one range of document ids; what stands before it is the sum of the files before.

Defined cases: a null text counts as empty; every document, empty ones too,
ends with the end id; rows with equal doc_id stand together, ordered by their
text's hash; a null doc_id sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshline.llm.bpe import ChunkEncoder, gathered, id_lists
from meshline.llm.common import begin, id_and_text, small_batches
from meshline.session import scratch_path

#: The most files whose offsets are broadcast: 16 bytes each, so 16 MB.
BROADCAST_FILES = 1_000_000

#: Pre-tokens that the library encodes in one call; it keeps about 100 bytes for each id.
LINES = 20_000

WRITE_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


class LibraryEncoder(ChunkEncoder):
    """The tokenizers library, asked once for each pre-token that a worker has
    not met lately. A file with another pre-tokenizer than the byte-level one,
    or with a normaliser, is asked for each whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"] and not spec["post_processor"]
        self.break_id = self.library("\n").tolist()
        super().__init__([t["content"] for t in spec["added_tokens"]], self.library, self.lines)

    def undivided(self, text: str) -> bool:
        return not self.byte_level or super().undivided(text)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each) of pre-tokens, LINES in a call: a
        line each, cut at the id of the line break."""
        if len(pieces) > LINES:
            parts = [self.lines(pieces[a : a + LINES]) for a in range(0, len(pieces), LINES)]
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([sizes for _, sizes in parts])
        if "\n" in pieces:  # in order, apart from the others
            at = pieces.index("\n")
            parts = [self.lines(x) for x in (pieces[:at], pieces[at + 1 :])]
            mid = np.array(self.break_id, np.uint32)
            return np.concatenate([parts[0][0], mid, parts[1][0]]), np.concatenate([parts[0][1], [len(mid)], parts[1][1]])
        if pieces and len(self.break_id) == 1 and not any("\n" in p for p in pieces):
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.break_id[0])
            if len(cuts) == len(pieces) - 1:
                return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        found = [self.library(p) for p in pieces]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)


@functools.lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write (part, doc_id, before, n_tokens, ids)
    as ORC, in ascending doc_id. `before` counts the ids earlier in the file.

    The one shuffle deals texts by ranges of (doc_id, hash of the text), so that
    rows of one repeated id can lie in several files; AQE sizes the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("token_orc", library_encoder.cache_clear)
        encoder, part, before = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in gathered(batches):
            ids, sizes = encoder.encode_column(batch.column(1), end_id)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part, np.int32)), batch.column(0), pa.array(before + ends - sizes), pa.array(sizes), id_lists(ids, sizes)],
                ["part", "doc_id", "before", "n_tokens", "ids"],
            )
            before += int(ends[-1])

    small_batches(docs.sparkSession)
    rows = id_and_text(docs, doc_id, text)
    tie = F.xxhash64("text")
    ordered = rows.withColumn("tie", tie).repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    ordered.mapInArrow(run, "part int, doc_id long, before long, n_tokens long, ids array<int>").write.options(**WRITE_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; a filter on doc_id reaches
    the row indexes and Bloom filters."""
    files = spark.read.orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("file_start"))
    if totals.count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    return files.join(starts, "part").select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            raw = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * 4
            bounds = [0, *ends.tolist()]
            crc = [zlib.crc32(raw[a:b]) for a, b in itertools.pairwise(bounds)]
            counted = [(b - a) // 4 for a, b in itertools.pairwise(bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counted, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    small_batches(tokens.sparkSession)
    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files into the shared folder, read them back, and digest."""
    path = scratch_path(docs.sparkSession, "token-orc")
    write_tokens(docs, path, tokenizer, end_id)
    return digests(read_tokens(docs.sparkSession, path))
