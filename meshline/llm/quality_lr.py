"""Quality verdicts: a few exact rules and a calibrated linear model.

The model is a logistic regression over hashed word n-grams (1 and 2 words) and
character n-grams (2 to 4 code points), each family as relative frequencies in a table of
2**16 weights. It is trained in numpy on a bounded sample of labelled rows and
its score calibrated (Platt) on a part of the sample kept out of training.
Documents are scored in Arrow batches, whole texts, against a fixed threshold.

Defined cases: a null text has no words and fails the word count; a text with no
n-gram gets the calibrated score of the bias; without labelled rows of both
kinds the model keeps what the rules keep.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.llm.common import begin, by_hash, exact, filtered, id_and_text, pieces, small_batches

BITS = 16
#: Rows of each label that training looks at; their texts are whole.
SAMPLE_ROWS = 1500
#: A document stays if the calibrated probability of good quality reaches this.
THRESHOLD = 0.5
#: Fixed values of the rules.
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

MIX, NEXT = np.uint32(2654435761), np.uint32(0x01000193)
FAMILIES = 5


def grams(raw: bytes, words: list[bytes] | None = None, known: dict[bytes, int] | None = None) -> list[np.ndarray]:
    """Table slots of each n-gram: words 1, 2, then characters 2, 3, 4."""
    words = raw.split() if words is None else words
    known = WORD_HASHES if known is None else known
    if len(known) > 200_000:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
    c = np.frombuffer(raw, np.uint8).astype(np.uint32) if raw.isascii() else np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    two = c[:-1] * NEXT + c[1:]
    three = two[:-1] * NEXT + c[2:]
    four = three[:-1] * NEXT + c[3:]
    pairs = w[:-1] * np.uint32(0x9E3779B1) + w[1:]
    shift = np.uint32(32 - BITS)
    return [(x * MIX) >> shift for x in (w, pairs, two, three, four)]


class WordHashes(dict):
    """Word -> 32-bit hash; entries are forgotten by grams() when there are many."""

    def __missing__(self, word: bytes) -> int:
        import zlib

        found = zlib.crc32(word)
        if len(word) <= 40:
            self[word] = found
        return found


WORD_HASHES = WordHashes()


class Model(NamedTuple):
    """weights: FAMILIES x 2**BITS; probability = 1 / (1 + exp(-(slope * margin + offset)))."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, raw: bytes, words: list[bytes] | None = None) -> float:
        return self.bias + sum(float(self.weights[f][g].mean()) for f, g in enumerate(grams(raw, words)) if len(g))

    def probability(self, raw: bytes, words: list[bytes] | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(raw, words) + self.offset, -40, 40))))


def train(rows: list[tuple[bytes, int]], steps: int = 120, rate: float = 2.0, decay: float = 1e-5) -> Model | None:
    """Fit on three quarters of the rows, calibrate on the rest (every fourth)."""
    held = [i % 4 == 3 for i in range(len(rows))]
    fit = [r for r, h in zip(rows, held) if not h]
    if len({y for _, y in fit}) < 2:
        return None
    sparse = [gathered(raw) for raw, _ in fit]
    index, value = np.concatenate([i for i, _ in sparse]), np.concatenate([v for _, v in sparse])
    bounds = np.cumsum([0] + [len(i) for i, _ in sparse])
    del sparse  # as large as what was made of it
    row = np.repeat(np.arange(len(fit)), np.diff(bounds))
    y = np.array([y for _, y in fit], np.float64)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    size = FAMILIES << BITS
    weights, bias, seen, seen_bias = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(steps):  # full-batch Adagrad: the order of rows plays no part
        margin = np.bincount(row, weights[index] * value, len(fit)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) * balance
        slope = np.bincount(index, error[row] * value, size) + decay * weights
        seen += slope**2
        weights -= rate * slope / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= 0.1 * rate * error.sum() / np.sqrt(seen_bias)
    model = Model(weights.reshape(FAMILIES, -1).astype(np.float32), float(bias), 1.0, 0.0)
    kept = [(model.margin(raw), label) for raw, label in (r for r, h in zip(rows, held) if h)]
    return model._replace(**dict(zip(("slope", "offset"), platt(kept))))


def gathered(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's features: slots over all families, and their relative frequencies."""
    slots, values = [], []
    for f, g in enumerate(grams(raw)):
        if len(g):
            found, n = np.unique(g, return_counts=True)
            slots.append(found.astype(np.int64) + (f << BITS))
            values.append((n / len(g)).astype(np.float32))
    return (np.concatenate(slots), np.concatenate(values)) if slots else (np.zeros(0, np.int64), np.zeros(0, np.float32))


def platt(kept: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and offset of the calibrated log odds, by Newton steps; targets are
    drawn in from 0 and 1 by the counts, so separable margins stay finite."""
    good = sum(y for _, y in kept)
    if not kept or good in (0, len(kept)):
        return 1.0, 0.0
    x = np.array([[m, 1.0] for m, _ in kept])
    t = np.array([(good + 1) / (good + 2) if y else 1 / (len(kept) - good + 2) for _, y in kept])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t) + 1e-6 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[bytes, int]]:
    """At most `rows` labelled documents of each quality, those of the smallest
    hash of their id, with whole texts. Ids and labels are chosen first, so only
    chosen documents' texts move; repeated rows of one id count once."""
    small_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q")).where("id is not null and q in (0, 1)").distinct()
    chosen = marks.where("q = 0").orderBy(by_hash(F.col("id")), "id").limit(rows).unionAll(marks.where("q = 1").orderBy(by_hash(F.col("id")), "id").limit(rows))
    held = {(r["id"], r["q"]) for r in chosen.collect()}  # at most 2 x rows
    if not held:
        return []
    few = docs.sparkSession.createDataFrame(sorted(held), "id long, q int")
    own = docs.select(exact(docs, "doc_id").cast("long").alias("id"), exact(docs, "text").alias("text")).where("text is not null")
    found = own.join(F.broadcast(few), "id").groupBy("id", "q").agg(F.min("text").alias("text"))
    got = sorted((r["id"], r["q"], r["text"]) for r in found.toLocalIterator())
    return [(x.encode(), q) for _, q, x in sorted(got, key=lambda r: hash_order(r[0]))]


def hash_order(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (2**64 - 1)


def measure(raw: bytes | None) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words."""
    raw = raw or b""
    words = raw.split()
    # code points are bytes that don't continue one
    chars = sum(map(len, words)) - (0 if raw.isascii() else int(((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80).sum()))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words), words


def repeated(words: list[bytes]) -> int:
    """Words inside a window of three that the text holds twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    n = len(ids)
    if n < 2_000_000:  # else the key would overflow 63 bits
        key = (w[:-2] * n + w[1:-1]) * n + w[2:]
    else:
        _, pair = np.unique(w[:-1] * n + w[1:], return_inverse=True)
        key = pair[:-1] * n + w[2:]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[where] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


def score_quality(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, probability) of every row; one narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality_lr", WORD_HASHES.clear)
        m = held.value
        for whole in batches:
            for batch in pieces(whole, 1):
                out = []
                for raw in batch.column(1).to_pylist():
                    *counts, words = measure(raw)
                    failed = base_failed(counts[0], counts[4])
                    p = m.probability(raw or b"", words) if m else 1.0
                    out.append((*counts, failed, not failed and p >= threshold, p))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    return id_and_text(docs, doc_id, text).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def keep_quality(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score_quality() keeps, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keeper() -> Callable[[list, list], list]:
        begin("quality_lr", WORD_HASHES.clear)
        m = held.value

        def stays(raw: bytes | None) -> bool:
            n, _, _, _, again, words = measure(raw)
            return not base_failed(n, again) and (m is None or m.probability(raw or b"", words) >= threshold)

        return lambda ids, texts: [stays(raw) for raw in texts]

    return filtered(docs, keeper)


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model | None:
    return train(labelled_sample(docs, labels))
