"""Near-duplicates by SimHash fingerprints and vantage-point trees.

1. A fingerprint of every whole text, in Arrow batches (no shuffle).
2. Equal fingerprints become one row, with their smallest doc_id (partial
   aggregation, so a third of all rows being copies costs nothing more).
3. A vantage-point tree over a bounded sample gives the top levels: each node
   has a vantage point and a radius m. A fingerprint at distance d from it goes
   inside if d <= m, else outside; one outside with d <= m + 3 goes inside too,
   as by the triangle inequality only those can have a neighbour inside. So each
   pair at distance 3 or less meets in the shard of one of the two. The largest
   shard is split next, by the cheapest of a few vantage points and all radii,
   never so that one side keeps nearly all.
4. Each shard goes on splitting in the same way in numpy and compares small
   leaves exactly. It returns the spanning links of what it found, at most one
   for each fingerprint that it holds, not all pairs.
5. Links of all shards are joined into components by rounds of large-star and
   small-star, each written to the shared folder; links never visit the driver.

near_duplicates() does this with one fingerprint of three-word shingles and all
links. one_of_each(), the filtering stage, takes near copies as texts that share
80 % or more of their five-word shingles: eight fingerprints of each text's set
of words, eight trees, and each candidate link is verified by the shingles. Texts
with as many changed words differ in few bits of a set of words, in more of
shingles: of the 48 near copies among 10,000 documents, radius 3 holds 46 there
and 6 with fingerprints of shingles. Only spanning links are verified there; what
they leave apart, and copies beyond radius 3, an exact search completes: texts
that have so much in common share one of the first fifth of their shingles, in
any order that all texts have in common, so rare() compares those that do and are
not joined yet. No link is lost.

Defined cases: a null or empty text, or one without words, has fingerprint zero,
linked like any other; under three words the whole sequence is one shingle;
repeated rows share a component; a null doc_id takes part but names a component
only if nothing else is in it.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from meshline.llm.common import begin, exact, id_and_text, pieces, small_batches
from meshline.session import cut, discard

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints that the tree is grown on, at least and at most; fingerprints that a shard should hold, at least and at most; the most shards; rows that a leaf compares all with all.
SAMPLE, MOST_SAMPLE, LEAST_ROWS, SHARD_ROWS, MOST_SHARDS, LEAF = 8192, 1 << 18, 2_000, 20_000, 1 << 16, 512
#: The filtering stage: words of a shingle, the share of shingles that near copies have in common, and tables of word-set fingerprints that give the candidates.
STAGE_WORDS, STAGE_SHARE, TABLES = 5, 0.8, 8
#: Texts that tell which shingles are frequent, texts of those that a frequent one is in at least, and frequent ones at most; they only order the search.
ORDER_TEXTS, FREQUENT_IN, MOST_FREQUENT = 8192, 3, 1 << 17
#: Shared shingles before one that tell whether two texts have met already; they only spare repeated rows.
EARLIER = 4
#: Bits that tell of a text's shingles, a multiple of 64.
MARKS = 512
#: Hashes of texts that are broadcast at most, 8 bytes each.
BROADCAST_ROWS = 1_000_000
#: A node is split only if neither side keeps more than this share of it, and by the best of so many vantage points.
MOST_KEPT, VANTAGES = 0.9, 4
#: Bit b of byte value v.
BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(raw: bytes | None) -> int:
    words = (raw or b"").lower().split()  # bytes: only A-Z change, and only the six ASCII spaces split
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    h = np.fromiter(map(xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, len(words) - 2)
    by_byte = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(by_byte[:, k], minlength=256) @ BITS_OF
        out |= int(sum(1 << b for b in range(8) if 2 * ones[b] > len(h))) << (8 * k)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, h long): the 64 bits of each row as a signed long, and
    the hash of its text, as text_hash() gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash_vp", lambda: None)
        for whole in batches:
            for batch in pieces(whole, 1):
                texts = batch.column(1).to_pylist()
                fp = np.array([fingerprint(t) for t in texts], np.uint64)
                h = np.array([SEED if t is None else xxh64_intdigest(t, SEED) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), pa.array(h.view(np.int64))], ["doc_id", "fp", "h"])

    return id_and_text(docs, doc_id, text).mapInArrow(run, "doc_id long, fp long, h long")


def text_hash(docs: DataFrame, text: str = "text") -> Column:
    """The same hash in the JVM, a null text's included."""
    return F.xxhash64(exact(docs, text).cast("binary"))


class Tree(NamedTuple):
    """Nodes with a vantage point, a radius, and children: other nodes, or
    ``~shard``. Without nodes there is one shard."""

    vantage: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray

    @property
    def shards(self) -> int:
        return len(self.vantage) + 1


def best_split(values: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """(vantage point, radius, distances) of the cheapest split of some sorted
    fingerprints, by the work in the inside with its border and in the outside;
    none if each would leave more than MOST_KEPT of them on one side."""
    best, n = None, len(values)
    for v in values[n // (2 * VANTAGES) :: max(1, n // VANTAGES)][:VANTAGES]:
        d = np.bitwise_count(values ^ v).astype(np.int64)
        count = np.cumsum(np.bincount(d, minlength=65 + RADIUS))
        widened, outside = count[RADIUS : 65 + RADIUS], n - count[:65]
        cost = np.where(np.maximum(widened, outside) <= MOST_KEPT * n, widened**1.6 + outside**1.6, np.inf)
        m = int(cost.argmin())
        if cost[m] < np.inf and (best is None or cost[m] < best[0]):
            best = (cost[m], int(v), m, d)
    return best and best[1:]


def grow(sample: np.ndarray, rows: float, most: int = MOST_SHARDS) -> Tree:
    """Split the largest shard again and again, until each holds at most `rows`
    of the sample, can't be split, or there are `most`."""
    nodes: list[list[int]] = []
    shards = 1
    heap = [(-len(sample), 0, np.sort(sample), -1, 0)]  # size, order, rows, and the place that names the shard
    names: list[tuple[int, int]] = []
    tick = 0
    while heap:
        size, _, own, node, side = heapq.heappop(heap)
        found = best_split(own) if -size > max(2, rows) and shards < most else None
        if found is None:
            names.append((node, side))
            continue
        vantage, m, d = found
        nodes.append([vantage, m, 0, 0])
        shards += 1
        if node >= 0:
            nodes[node][side] = len(nodes) - 1
        for k, part in ((2, own[d <= m + RADIUS]), (3, own[d > m])):
            tick += 1
            heapq.heappush(heap, (-len(part), tick, part, len(nodes) - 1, k))
    for shard, (node, side) in enumerate(names):
        if node >= 0:
            nodes[node][side] = ~shard
    columns = list(zip(*nodes)) or [(), (), (), ()]
    return Tree(np.array(columns[0], np.uint64), *(np.array(c, np.int64) for c in columns[1:]))


def route(fps: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) for each shard that a fingerprint visits."""
    row, at = np.arange(len(fps)), np.full(len(fps), 0 if len(tree.vantage) else ~0, np.int64)
    rows, shards = [], []
    while True:
        ended = at < 0
        rows.append(row[ended])
        shards.append(~at[ended])
        row, at = row[~ended], at[~ended]
        if not len(row):
            return np.concatenate(rows), np.concatenate(shards)
        d = np.bitwise_count(fps[row] ^ tree.vantage[at]).astype(np.int64)
        m = tree.radius[at]
        inside = d <= m
        near = ~inside & (d <= m + RADIUS)
        row = np.concatenate([row, row[near]])
        at = np.concatenate([np.where(inside, tree.inside[at], tree.outside[at]), tree.inside[at[near]]])


class Union:
    """Union-find over positions, the smallest position as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def spanning_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) positions that span the components of distinct `fps` under links
    of RADIUS or less, each fingerprint with the root of its component."""
    union = Union(len(fps))
    todo = [np.arange(len(fps))]
    while todo:
        own = todo.pop()
        values = fps[own]
        found = best_split(values) if len(own) > LEAF else None
        if found:
            _, m, d = found
            todo += [own[d <= m + RADIUS], own[d > m]]
            continue
        # A leaf, or rows that no vantage point parts well: compare in blocks, so
        # that memory is bounded by LEAF x LEAF; each block's rows take the least
        # root that they reach, so a dense group costs no union for each pair.
        for a in range(0, len(own), LEAF):
            for b in range(a, len(own), LEAF):
                close = np.bitwise_count(values[a : a + LEAF, None] ^ values[None, b : b + LEAF]) <= RADIUS
                if a == b and close.sum() == len(close) or not close.any():
                    continue
                left, right = own[a : a + LEAF], own[b : b + LEAF]
                i, j = np.nonzero(close)
                if len(i) <= 2 * LEAF:  # few pairs, those of rows with themselves included
                    union.join(left[i], right[j])
                    continue
                x = np.array([union.root(i) for i in left.tolist()])
                y = np.array([union.root(i) for i in right.tolist()])
                while True:
                    x2 = np.minimum(x, np.where(close, y[None, :], len(fps)).min(axis=1))
                    y2 = np.minimum(y, np.where(close, x2[:, None], len(fps)).min(axis=0))
                    if (x2 == x).all() and (y2 == y).all():
                        break
                    x, y = x2, y2
                union.join(left, x)
                union.join(right, y)
    linked = np.array([union.root(i) for i in range(len(fps))], np.int64)
    child = np.flatnonzero(linked != np.arange(len(fps)))
    return linked[child], child


def links(classes: DataFrame, count: int) -> DataFrame:
    """(k int, a long, b long): spanning links between distinct fingerprints
    `fp` of each kind `k`, a tree for each kind; `count` is that of all rows."""
    spark = classes.sparkSession
    taken = min(MOST_SAMPLE, max(SAMPLE, 16 * count // SHARD_ROWS))
    sample = classes.select("k", "fp").orderBy(F.xxhash64("k", "fp"), "k", "fp").limit(taken).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "k int, a long, b long")
    kinds = sorted(sample["k"].unique().tolist())
    rows, most = max(LEAST_ROWS, min(SHARD_ROWS, count / (8 * len(kinds)))) * len(sample) / count, max(1, MOST_SHARDS // len(kinds))
    trees = [grow(sample.loc[sample["k"] == k, "fp"].to_numpy(np.int64).view(np.uint64), rows, most) for k in kinds]
    first = list(itertools.accumulate((t.shards for t in trees), initial=0))
    forest = spark.sparkContext.broadcast(dict(zip(kinds, zip(trees, first))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in np.unique(kind).tolist():
                tree, start = forest.value.get(k, (Tree(*(np.zeros(0, np.int64),) * 4), first[-1] + k))
                own = fps[kind == k]
                row, shard = route(own.view(np.uint64), tree)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(start + shard), pa.array(own[row])], ["k", "shard", "fp"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        a, b = spanning_links(fps)
        return pd.DataFrame({"k": np.full(len(a), pdf["k"].iloc[0], np.int32), "a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    # few bytes, much work: the number of partitions is set, as AQE would join them by their size
    dealt = classes.select("k", "fp").mapInArrow(deal, "k int, shard long, fp long").repartition(max(4, 2 * first[-1]), "shard")
    return dealt.groupBy("shard").applyInPandas(search, "k int, a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    Rounds of large-star and small-star; each keeps components as they are and
    ends with stars. A round is written to the shared folder, and the signature
    of its links (count and sum of hashes) tells when nothing changes. Rounds
    grow with the logarithm of a component's length; more than `most_rounds` are
    an error, never a partial result."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        met = both.join(least, both.a == least.k)
        if large:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    now, seen = cut(edges.where("a <> b").distinct(), "links"), None
    for _ in range(most_rounds):
        after = cut(star(star(now, True), False), "stars")
        signature = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(now)
        now = after
        if signature == seen or not signature[0]:
            break
        seen = signature
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, h) for every row of `docs`, and (class, component_id) for
    every fingerprint: the smallest doc_id of those that links reach."""
    rows = cut(fingerprints(docs, doc_id, text), "fingerprints")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    tree = components(links(classes.select(F.lit(0).alias("k"), "fp"), classes.count()).select("a", "b"))
    # roots stand in the tree only as roots; each class with links gets the smallest doc_id of its tree
    known = tree.unionAll(tree.select(F.col("root").alias("node"), "root").distinct())
    named = known.join(classes, known.node == classes.fp).select("fp", "root", "least")
    smallest = named.groupBy("root").agg(F.min("least").alias("smallest"))
    joined = named.join(smallest, "root").select(F.col("fp").alias("linked"), "smallest")
    of_class = classes.join(joined, classes.fp == joined.linked, "left").select(F.col("fp").alias("class"), F.coalesce("smallest", "least").alias("component_id"))
    return rows, cut(of_class, "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`."""
    rows, of_class = grouped(docs, doc_id, text)
    return rows.join(of_class, rows.fp == of_class["class"], "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class WordHashes(dict):
    """Word -> 64-bit hash, for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        found = xxh64_intdigest(word, SEED)
        if len(word) <= 40 and len(self) < 300_000:
            self[word] = found
        return found


HASHES = WordHashes()


def word_sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """TABLES fingerprints of each text's distinct words, each table by hashes
    of its own; a text without words has fingerprint zero."""
    out = [np.zeros(len(texts), np.uint64) for _ in range(TABLES)]
    sets = [set(words) for words in texts]
    at = np.array([i for i, own in enumerate(sets) if own], np.int64)
    if not len(at):
        return out
    sizes = np.array([len(sets[i]) for i in at.tolist()])
    h = np.fromiter(map(HASHES.__getitem__, itertools.chain.from_iterable(sets)), np.uint64, int(sizes.sum()))
    for k, found in enumerate(out):
        x = h * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
        found[at] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, g, bits, f0, f1, ...) of every row: the hash of its text as
    text_hash() gives it, that of its words, the marks() of its shingles, and its
    word_sets()."""
    names = ["doc_id", "h", "g", *(f"f{k}" for k in range(TABLES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash_vp", HASHES.clear)
        for whole in batches:
            for batch in pieces(whole, 1, 1 << 20):
                raws = batch.column(1).to_pylist()
                texts = [(t or b"").lower().split() for t in raws]
                h = np.array([SEED if t is None else xxh64_intdigest(t, SEED) for t in raws], np.uint64)
                g = np.array([xxh64_intdigest(b" ".join(words), SEED) for words in texts], np.uint64)
                bits = pa.array([marks(sequences(words)) for words in texts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in (h, g, *word_sets(texts))), bits], [*names, "bits"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names[1:]) + ", bits array<long>")


def shingles(raw: bytes | None) -> np.ndarray:
    """Hashes of the distinct five-word shingles, sorted; of fewer words, of the
    whole sequence."""
    words = (raw or b"").lower().split()
    own = map(b" ".join, zip(*(words[k:] for k in range(STAGE_WORDS)))) if len(words) >= STAGE_WORDS else [b" ".join(words)] if words else []
    return np.unique(np.array([xxh64_intdigest(x, SEED) for x in own], np.uint64))


def shingle_sets(docs: DataFrame, wanted: DataFrame, count: int, narrow: bool) -> DataFrame:
    """(u, n, s): how many shingles the texts whose hash is in `wanted` (u,
    `count` rows) have, and the shingles: array<long>, or if `narrow` the distinct
    values of 16 bits of each, array<short>. Only those texts move, and copies of
    one leave early."""
    small_batches(docs.sparkSession)
    wanted = F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted
    own = docs.select(text_hash(docs).alias("u"), exact(docs, "text").cast("binary").alias("t")).join(wanted, "u", "left_semi")
    of = pa.int16() if narrow else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash_vp", HASHES.clear)
        met: set[int] = set()
        for whole in batches:
            for batch in pieces(whole, 1):
                rows = {u: t for u, t in zip(*(c.to_pylist() for c in batch.columns)) if u not in met}
                met.update(rows)
                sets = [sequence_hashes((t or b"").lower().split()) if narrow else shingles(t) for t in rows.values()]
                held = [np.unique(x.astype(np.uint16)).view(np.int16) if narrow else x.view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(held, pa.list_(of))], ["u", "n", "s"])

    return own.mapInArrow(run, f"u long, n int, s array<{'short' if narrow else 'long'}>").dropDuplicates(["u"])


def alike(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links between the distinct texts `u` of `texts` (u, f0, f1, ...)
    that share STAGE_SHARE of their five-word shingles or more. Candidates are
    the spanning links of the trees of all tables, and links from the texts of
    one fingerprint to the first of them."""
    tables = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"f{k}").alias("fp")) for k in range(TABLES)))).alias("x")
    flat = texts.select("u", tables).select("u", "x.k", "x.fp")
    classes = cut(flat.groupBy("k", "fp").agg(F.min("u").alias("rep"), F.count("*").alias("n")), "classes")
    shared = classes.where("n > 1").drop("n")
    inner = flat.join(shared, ["k", "fp"]).where("u <> rep").select(F.col("u").alias("a"), F.col("rep").alias("b"))
    side = lambda name: classes.select("k", F.col("fp").alias(name), F.col("rep").alias(f"{name}_rep"))
    met = cut(links(classes, classes.count()), "links")
    outer = met.join(side("a"), ["k", "a"]).join(side("b"), ["k", "b"]).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    return verified(cut(inner.unionAll(outer).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs"), docs)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b), hashes of texts, that share STAGE_SHARE of their
    five-word shingles or more. 16 bits of each shingle, a quarter of the bytes,
    tell of most others that they don't; only what is left moves as whole sets."""
    return compared(cut(compared(pairs, docs, True), "pairs"), docs, False)


def compared(pairs: DataFrame, docs: DataFrame, narrow: bool) -> DataFrame:
    """Those of `pairs` (a, b) whose sets share STAGE_SHARE or more; by `narrow`
    sets those that may. Shingles in common have their 16 bits in common, and no
    more of them fall together than each text has shingles above its distinct
    values, so the bound is never below what two texts share."""
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct(), "ends")
    sets = shingle_sets(docs, ends, ends.count(), narrow)  # read twice by one exchange
    one = lambda name: sets.select(F.col("u").alias(name), F.col("n").alias(f"{name}_n"), F.col("s").alias(f"{name}_s"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    common, total = F.size(F.array_intersect("a_s", "b_s")), F.col("a_n") + F.col("b_n")
    fallen = F.least(F.col("a_n") - F.size("a_s"), F.col("b_n") - F.size("b_s"))
    return both.select("a", "b", (common + fallen).alias("c"), total.alias("t")).where(F.col("c") >= STAGE_SHARE * (F.col("t") - F.col("c"))).select("a", "b")


def sequences(words: list[bytes]) -> np.ndarray:
    """Hashes of the five-word shingles as shingles() takes them, by the hashes of
    their words: equal where the shingles are."""
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    k = min(STAGE_WORDS, len(h))
    x = np.zeros(len(h) - k + 1 if k else 0, np.uint64)
    for j in range(k):
        x ^= h[j : j + len(x)]
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def sequence_hashes(words: list[bytes]) -> np.ndarray:
    """The distinct sequences(), sorted."""
    return np.unique(sequences(words))


def marks(x: np.ndarray) -> np.ndarray:
    """MARKS bits, those set that the hashes name: where one text has a bit that
    another lacks, it has a shingle that the other lacks."""
    bits = np.zeros(MARKS, np.uint8)
    bits[(x >> np.uint64(40)) % np.uint64(MARKS)] = 1
    return np.packbits(bits).view(np.int64)


def leading(x: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of the sorted hashes `x`, `frequent` ones (sorted, with counts)
    last: two sets with STAGE_SHARE in common have one of these in common."""
    most = len(x) - math.ceil(STAGE_SHARE * len(x) - 1e-6) + 1
    if not len(frequent) or not len(x):
        return x[:most]
    at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
    weight = np.where(frequent[at] == x, counts[at], 0)
    return x[np.argsort(weight, kind="stable")[:most]] if weight.any() else x[:most]


def text_shingles(own: DataFrame, frequent: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(u, n, s array<long>) of texts `own` (u, t binary): how many shingles each
    has, and its leading ones; without `frequent` all."""
    order = own.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash_vp", HASHES.clear)
        for whole in batches:
            for batch in pieces(whole, 1):
                rows = dict(zip(*(c.to_pylist() for c in batch.columns)))
                sets = [sequence_hashes((t or b"").lower().split()) for t in rows.values()]
                first = sets if order.value is None else [leading(x, *order.value) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.view(np.int64) for x in first], pa.list_(pa.int64()))], ["u", "n", "s"])

    return own.mapInArrow(run, "u long, n int, s array<long>")


def frequent_shingles(texts: DataFrame, docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a bounded number of texts hold, and in how many."""
    some = F.broadcast(texts.select("u").orderBy(F.xxhash64("u"), "u").limit(ORDER_TEXTS))
    own = docs.select(text_hash(docs).alias("u"), exact(docs, "text").cast("binary").alias("t")).join(some, "u", "left_semi").dropDuplicates(["u"])
    counts = text_shingles(own, None).select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_IN)
    found = counts.orderBy(F.desc("n"), "x").limit(MOST_FREQUENT).toPandas()
    x = found["x"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(x)
    return x[order], found["n"].to_numpy(np.int64)[order]


def rare(texts: DataFrame, tree: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): the links between texts `u` of `texts` that `tree` (node, root)
    leaves in different trees, all of them.

    Of n shingles, the first n - 0.8 n + 1 in a common order hold one that any
    text with 80 % in common has among its first, too. Frequent shingles come
    last, so most texts meet nobody; shingles within one tree are left out before
    they pair. Sizes, the places of a shared shingle and marks() bound what two
    texts can have in common. Two texts meet at the first shingle that they share; at a later
    one they don't if a shared one is among the EARLIER before it, so that they are
    a row once, not once for each shingle. What is left is verified."""
    small_batches(docs.sparkSession)
    order = frequent_shingles(texts, docs)
    own = text_shingles(docs.select(text_hash(docs).alias("u"), exact(docs, "text").cast("binary").alias("t")), order).dropDuplicates(["u"])
    named = texts.select("u").join(tree, F.col("u") == F.col("node"), "left").select("u", F.coalesce("root", "u").alias("tree"))
    rows = own.join(named, "u").select("u", "tree", "n", F.posexplode("s").alias("at", "x"))
    same, earlier = Window.partitionBy("x"), Window.partitionBy("u").orderBy("at").rowsBetween(-EARLIER, -1)
    shared = rows.withColumns({"low": F.min("tree").over(same), "high": F.max("tree").over(same)}).where("low < high").drop("low", "high")
    met = cut(shared.withColumn("before", F.collect_list("x").over(earlier)).join(texts.select("u", "bits"), "u"), "shared")
    a, b = (met.select("x", *(F.col(c).alias(f"{side}_{c}") for c in ("u", "tree", "n", "at", "before", "bits"))) for side in "ab")
    left = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    enough = STAGE_SHARE / (1 + STAGE_SHARE) * (F.col("a_n") + F.col("b_n")) - 1e-6
    first = ~F.arrays_overlap("a_before", "b_before")
    lacks = lambda s, o: sum(F.bit_count(F.col(f"{s}_bits")[k].bitwiseAND(F.bitwise_not(F.col(f"{o}_bits")[k]))) for k in range(MARKS // 64))
    few = (lacks("a", "b") <= F.col("a_n") - enough) & (lacks("b", "a") <= F.col("b_n") - enough)
    pairs = a.join(b, "x").where((F.col("a_tree") < F.col("b_tree")) & (left >= enough) & few & first).select(F.least("a_u", "b_u").alias("a"), F.greatest("a_u", "b_u").alias("b")).distinct()
    return verified(cut(pairs, "pairs"), docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns: of each group of near-duplicates the one
    with the smallest doc_id, nulls last, then the smallest hash of its text.

    Texts of equal words are one group; groups are joined by alike(), and what
    that leaves apart by rare(). Ids play no part in what is a copy; rows alike in
    id and text leave one."""
    rows = cut(sketches(docs), "sketches")
    best = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h").alias("best")
    texts = cut(rows.select("g", "h", best, "bits", *(f"f{k}" for k in range(TABLES))).groupBy("g").agg(F.min("h").alias("u"), F.min("best").alias("best"), F.min("bits").alias("bits"), *(F.min(f"f{k}").alias(f"f{k}") for k in range(TABLES))), "texts")
    tree = cut(components(alike(texts.drop("g", "best", "bits"), docs)), "trees")
    tree = components(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(rare(texts, tree, docs)))
    linked = texts.select("u", "best").join(tree, F.col("u") == F.col("node"), "left").select(F.coalesce("root", "u").alias("tree"), "best")
    least = linked.groupBy("tree").agg(F.min("best").alias("best"))
    wanted = least.select(F.col("best.doc_id").alias("keep_id"), F.col("best.h").alias("keep_h"))
    repeats = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "h")
    wanted = cut(wanted.join(repeats, wanted.keep_id.eqNullSafe(repeats.doc_id) & (wanted.keep_h == repeats.h), "left").select("keep_id", "keep_h", F.col("h").isNotNull().alias("again")), "near-duplicates")
    at, h = exact(docs, "doc_id").cast("long"), text_hash(docs)

    def rows_of(keys: DataFrame) -> DataFrame:
        return docs.join(keys, at.eqNullSafe(keys.keep_id) & (h == keys.keep_h), "left_semi")

    row = F.struct(*(exact(docs, c) for c in docs.columns))
    whole = rows_of(wanted.where("again")).groupBy(at.alias("id"), h.alias("h")).agg(F.first(row).alias("row")).select("row.*")
    return rows_of(wanted.where("not again")).unionAll(whole)
