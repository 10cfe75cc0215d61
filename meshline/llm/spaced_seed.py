"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a window of tokens; positions outside the
mask are ignored, so a window still hashes alike when words there were replaced.
The windows of the benchmark, under every mask, form a table of hashes; those of
each document are looked up in it. Around each hit the item is laid over the
document at the hit's offset and compared token by token: the stretch with the
best score (equal +1, replaced -2) counts as an overlap if it is long enough and
alike enough; if it isn't, the longest stretch that is alike enough is tried.

The masks lose nothing: a stretch of 10 tokens or more that is 80 % equal holds
one of 10 tokens with two replaced or of 15 with three (a longer one has a half
that is as alike), and the masks hit all of those; whole items of 5 to 9 tokens,
of which one may be replaced, have masks of four tokens of their own, and items of up to four tokens, none of
which may be replaced, are looked up whole. This holds for LEAST_TOKENS and
LEAST_EQUAL, and for stricter limits.

The benchmark is a query set: it is read in blocks of a bounded number of
windows, whose table is broadcast, and each block is held against all documents.
Of several blocks, one at a time is in memory: its result is written to the
shared folder before the next is read.

Tokens are words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after letters become
lower case, so case and punctuation play no part. Defined cases: null and empty
texts have no tokens and no overlap; an item of fewer tokens than the least
overlap must overlap whole, alike enough, down to items of SHORTEST tokens; an
item with a null item_id is searched too and gives a null item_id; repeated rows
each give their own result; texts are searched whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from meshline.llm.common import WORD_BYTES, begin, exact, filtered, id_and_text, pieces
from meshline.session import cut

#: An overlap has this many tokens (or the whole item), of which this share is equal.
LEAST_TOKENS, LEAST_EQUAL = 10, 0.8
#: Tokens of the shortest item that is searched: 1, so all are.
SHORTEST = 1
#: Fixed masks for items of LEAST_TOKENS and more, each of six tokens of at most ten, for shorter ones, and for those that may have no token replaced.
LONG_MASKS = ("1101111", "10111011", "11110101", "111010011", "1100001111")
SHORT_MASKS = ("1111", "10111", "11011", "11101")
WHOLE_MASKS = ("111", "11", "1")
MASKS = LONG_MASKS + SHORT_MASKS + WHOLE_MASKS
#: The least and most tokens of the items that each mask is for.
SEARCHED = [(LEAST_TOKENS, 1 << 62)] * len(LONG_MASKS) + [(len(m), LEAST_TOKENS - 1) for m in SHORT_MASKS] + [(len(m), len(m)) for m in WHOLE_MASKS]
#: Windows of the benchmark in one broadcast table: with five masks and 24 bytes an entry about 60 MB.
BLOCK_WINDOWS = 500_000

OFFSETS = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == 49).tolist() for m in MASKS]
FACTORS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1) for k in range(max(map(len, MASKS)))]


class TokenHashes(dict):
    """Word -> 64-bit hash, for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        found = xxh64_intdigest(word)
        if len(word) <= 40:
            self[word] = found
        return found


HASHES = TokenHashes()


def tokens(raw: bytes | None) -> np.ndarray:
    raw = raw or b""
    if not raw.isascii():
        raw = raw.decode("utf-8", "replace").lower().encode()
    words = raw.translate(WORD_BYTES).split()
    if len(HASHES) > 300_000:
        HASHES.clear()
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def scaled(ids: np.ndarray) -> list[np.ndarray]:
    """The tokens times the factor of each place in a window."""
    return [ids * f for f in FACTORS]


def seeds(places: list[np.ndarray], mask: int) -> np.ndarray:
    """The hash of each window under a mask, from scaled() tokens."""
    offsets = OFFSETS[mask]
    n = len(places[0]) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = places[0][:n] + np.uint64(mask + 1)
    for o in offsets[1:]:
        out += places[o][o : o + n]
    return out ^ (out >> np.uint64(29))


class Overlap(NamedTuple):
    item: int
    start: int  # first token in the document
    item_start: int
    length: int
    equal: int


class Table(NamedTuple):
    """For each mask: hashes, sorted, with (item, position) of each; a bit map of
    their upper bits rules out nearly all windows of a document."""

    items: list[np.ndarray]
    hashes: list[np.ndarray]
    item: list[np.ndarray]
    at: list[np.ndarray]
    maps: list[np.ndarray]
    shift: int

    @classmethod
    def build(cls, items: list[np.ndarray]) -> Table:
        total = sum(map(len, items))
        bits = min(26, max(16, (32 * max(1, total)).bit_length()))
        shift, parts = 64 - bits, ([], [], [], [])
        places = [scaled(ids) for ids in items]
        for mask, (fewest, most) in enumerate(SEARCHED):
            searched = [i for i, ids in enumerate(items) if fewest <= len(ids) <= most]
            own = [seeds(places[i], mask) for i in searched]
            h = np.concatenate([np.zeros(0, np.uint64), *own])
            item = np.repeat(np.array(searched, np.int32), [len(x) for x in own])
            at = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(x), dtype=np.int32) for x in own)])
            order = np.argsort(h, kind="stable")
            marks = np.zeros(1 << bits if len(h) else 0, bool)
            marks[(h >> np.uint64(shift)).astype(np.int64)] = True
            for held, x in zip(parts, (h[order], item[order], at[order], marks)):
                held.append(x)
        return cls(items, *parts, shift)

    def hits(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, offset of the item's start from the document's) of all hits."""
        found: set[tuple[int, int]] = set()
        places = scaled(ids)
        for mask, (hashes, marks) in enumerate(zip(self.hashes, self.maps)):
            if not len(hashes):
                continue
            h = seeds(places, mask)
            where = np.flatnonzero(marks[(h >> np.uint64(self.shift)).astype(np.int64)])
            if not len(where):
                continue
            own = h[where]
            first, last = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for w, a, b in zip(where[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist()):
                found.update(zip(self.item[mask][a:b].tolist(), (w - self.at[mask][a:b]).tolist()))
        return found

    def overlaps(self, ids: np.ndarray, least: int = LEAST_TOKENS, share: float = LEAST_EQUAL) -> list[Overlap]:
        """The best verified overlap with each item."""
        best: dict[int, Overlap] = {}
        part = Fraction(share).limit_denominator(1000)
        for i, offset in sorted(self.hits(ids)):
            item = self.items[i]
            a, b = max(0, -offset), min(len(item), len(ids) - offset)
            equal = item[a:b] == ids[offset + a : offset + b]
            asked = min(least, len(item))
            lo, hi = best_stretch(equal)
            if hi - lo < asked or equal[lo:hi].sum() < part * (hi - lo):
                lo, hi = longest_stretch(equal, part, asked)
            n = int(equal[lo:hi].sum())
            if hi - lo >= asked and (i not in best or n > best[i].equal):
                best[i] = Overlap(i, offset + a + lo, a + lo, hi - lo, n)
        return list(best.values())


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Bounds of the stretch of the largest sum of +1 (equal) and -2 (not)."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(total)
    hi = int((total - low).argmax())
    return int(total[: hi + 1].argmin()), hi


def longest_stretch(equal: np.ndarray, share: Fraction, least: int) -> tuple[int, int]:
    """Bounds of the longest stretch with this share of equal tokens; unequal
    tokens at its ends go as long as `least` are left."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, share.denominator, 0) - share.numerator)])
    above = np.maximum.accumulate(total[::-1])[::-1]  # never rises, so the last end that is not below a start is found by bisection
    last = np.searchsorted(-above, -total, "right") - 1
    lo = int((last - np.arange(len(total))).argmax())
    hi = int(last[lo])
    while hi - lo > least and not equal[hi - 1]:
        hi -= 1
    while hi - lo > least and not equal[lo]:
        lo += 1
    return lo, hi


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Item ids and tokens, in blocks of at most BLOCK_WINDOWS windows; an item
    that is longer is a block of its own."""
    rows = benchmark.select(exact(benchmark, item_id).cast("long").alias("i"), exact(benchmark, text).cast("binary").alias("t")).where("t is not null")
    ids: list[int | None] = []
    items: list[np.ndarray] = []
    held = 0
    for r in rows.toLocalIterator():
        own = tokens(bytes(r["t"]))
        if len(own) < SHORTEST:
            continue
        if items and held + len(own) > BLOCK_WINDOWS:
            yield ids, items
            ids, items, held = [], [], 0
        ids.append(r["i"])
        items.append(own)
        held += len(own)
    if items:
        yield ids, items


SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, length long, equal long, score double"


def with_more(found: Iterator[tuple]) -> Iterator[tuple]:
    """Each element, and whether there are more than one in all."""
    first, second = next(found, None), next(found, None)
    for x in itertools.chain([first] if first else [], [second] if second else [], found):
        yield *x, second is not None


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_TOKENS, share: float = LEAST_EQUAL) -> DataFrame:
    """A row (SCHEMA) for each document and item that overlap, the best overlap;
    clean documents have none. One narrow pass for each block of the benchmark."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    for ids, items, more in with_more(blocks(benchmark)):
        held = spark.sparkContext.broadcast((ids, items))
        found = id_and_text(docs, doc_id, text).mapInArrow(searcher(held, least, share), SCHEMA)
        if more:
            found = cut(found, "overlaps")
            held.unpersist()
        out = out.unionAll(found)
    return out


def searcher(held, least: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("spaced_seed", HASHES.clear)
        ids, items = held.value
        table = Table.build(items)
        for whole in batches:
            for batch in pieces(whole, 1):
                rows = []
                for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows += [(d, ids[o.item], o.start, o.item_start, o.length, o.equal, o.equal / o.length) for o in table.overlaps(tokens(raw), least, share)]
                kinds = [pa.int64()] * 6 + [pa.float64()]
                columns = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "doc_start", "item_start", "length", "equal", "score"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TOKENS, share: float = LEAST_EQUAL) -> DataFrame:
    """The rows of `docs`, all columns, that overlap with no item."""
    for _, items, more in with_more(blocks(benchmark)):
        held = docs.sparkSession.sparkContext.broadcast(items)
        docs = filtered(docs, keeper(held, least, share))
        if more:
            docs = cut(docs, "decontaminated")
            held.unpersist()
    return docs


def keeper(held, least: int, share: float):
    def begun():
        begin("spaced_seed", HASHES.clear)
        table = Table.build(held.value)
        return lambda ids, texts: [not table.overlaps(tokens(t), least, share) for t in texts]

    return begun
