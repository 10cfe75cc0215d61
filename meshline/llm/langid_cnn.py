"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of 256. In each, bytes are embedded,
filters of several widths slide over them, each filter's largest response is
kept, and a linear layer with softmax gives the languages' probabilities; a
text's are the mean over all its windows, weighted by their bytes. The network
is trained in numpy on labelled text, a bounded sample of rows.

For scoring, embedding and filter are multiplied out: a filter of width w is the
sum of w/2 rows of tables over byte pairs, so a response costs gathers and adds.

Defined cases: null texts and texts without a letter are `und` with score 0;
without any labelled row all are `und`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshline.llm.common import begin, by_hash, exact, filtered, id_and_text, pieces, small_batches

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
#: The bound of the training sample: rows in all, dealt evenly to the languages; their texts are whole.
SAMPLE_ROWS = 4096
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


class Network(NamedTuple):
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # for each width: (width * EMBED) x FILTERS
    filter_bias: np.ndarray
    out: np.ndarray  # (widths * FILTERS) x languages
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, rows of responses by byte pair (or the last byte)."""
        found = []
        for w, f in zip(WIDTHS, self.filters):
            single = [self.embed @ f[k * EMBED : (k + 1) * EMBED] for k in range(w)]
            pairs = [(single[k][None, :, :] + single[k + 1][:, None, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            found.append([np.ascontiguousarray(t, np.float32) for t in pairs + ([single[-1]] if w % 2 else [])])
        return found


def windows_of(raw: bytes) -> np.ndarray:
    """All bytes of a text in rows of WINDOW, the last padded with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """Probabilities of windows. Positions lead, so pooling runs over whole rows."""

    BLOCK = 128

    def __init__(self, network: Network):
        self.net, self.by_width = network, network.tables()

    def windows(self, rows: np.ndarray) -> np.ndarray:
        out = [self.block(rows[a : a + self.BLOCK]) for a in range(0, len(rows), self.BLOCK)]
        return np.concatenate(out) if out else np.zeros((0, len(self.net.languages)))

    def block(self, rows: np.ndarray) -> np.ndarray:
        b = np.ascontiguousarray(rows.T).astype(np.intp)
        pair = b[:-1] | b[1:] << 8
        pooled = []
        for k, (w, tables) in enumerate(zip(WIDTHS, self.by_width)):
            last = WINDOW - w + 1
            response = tables[0][pair[:last]]
            for t in tables[1:]:
                at = w - 1 if len(t) == 256 else 2
                response += t[b[at : at + last]] if len(t) == 256 else t[pair[at : at + last]]
            pooled.append(np.maximum(response.max(axis=0) + self.net.filter_bias[k * FILTERS : (k + 1) * FILTERS], 0))
        return softmax(np.concatenate(pooled, axis=1) @ self.net.out + self.net.out_bias)

    def texts(self, raws: list[bytes | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text."""
        known = [raw is not None and bool(self.net.languages) and LETTER.search(raw.decode("utf-8", "replace")) is not None for raw in raws]
        rows = [windows_of(raw) for raw, k in zip(raws, known) if k]
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(raws)
        if not rows:
            return out
        p = self.windows(np.concatenate(rows))
        at = 0
        for i in (i for i, k in enumerate(known) if k):
            n = -(-len(raws[i]) // WINDOW)
            weight = np.full(n, float(WINDOW))
            weight[-1] = len(raws[i]) - (n - 1) * WINDOW
            mean = weight @ p[at : at + n] / weight.sum()
            at += n
            best = int(mean.argmax())
            out[i] = (self.net.languages[best], min(1.0, float(mean[best])))
        return out


def train(rows: list[tuple[bytes, str]], steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam over windows drawn evenly from the languages, their texts and the
    windows of each text."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    texts = {lang: [windows_of(raw) for raw, x in rows if x == lang] for lang in languages}

    def window(lang: str) -> np.ndarray:
        own = texts[lang][rng.integers(len(texts[lang]))]
        return own[rng.integers(len(own))]

    wide = sum(WIDTHS) * EMBED
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "bias": np.zeros(len(WIDTHS) * FILTERS),
        "out": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, max(1, len(languages)))),
        "out_bias": np.zeros(max(1, len(languages))),
    } | {f"f{w}": rng.normal(0, 1 / np.sqrt(wide), (w * EMBED, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        y = rng.integers(0, len(languages), batch)
        x = np.stack([window(languages[c]) for c in y])
        cut = rng.integers(32, WINDOW + 1, batch)  # short texts occur too
        x = np.where(np.arange(WINDOW) < np.where(rng.random(batch) < 0.3, cut, WINDOW)[:, None], x, 0)
        e = p["embed"][x]
        pooled, where = [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(batch, WINDOW - w + 1, w * EMBED)
            response = view @ p[f"f{w}"]
            at = response.argmax(axis=1)
            where.append((view, at))
            pooled.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
        before = np.concatenate(pooled, axis=1) + p["bias"]
        hidden = np.maximum(before, 0)
        prob = softmax(hidden @ p["out"] + p["out_bias"])
        d = prob.copy()
        d[np.arange(batch), y] -= 1
        d /= batch
        g = {"out": hidden.T @ d, "out_bias": d.sum(0)}
        dh = (d @ p["out"].T) * (before > 0)
        g["bias"] = dh.sum(0)
        de = np.zeros_like(e)
        for k, w in enumerate(WIDTHS):
            view, at = where[k]
            own = dh[:, k * FILTERS : (k + 1) * FILTERS]
            picked = view[np.arange(batch)[:, None], at]  # batch x FILTERS x (w * EMBED)
            g[f"f{w}"] = np.einsum("bfi,bf->if", picked, own)
            back = (own[:, :, None] * p[f"f{w}"].T[None]).reshape(batch, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(de, (np.arange(batch)[:, None], at + j), back[:, :, j])
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], x.ravel(), de.reshape(-1, EMBED))
        for name, grad in g.items():
            first[name] = 0.9 * first[name] + 0.1 * grad
            second[name] = 0.999 * second[name] + 0.001 * grad * grad
            p[name] = p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p["embed"], [p[f"f{w}"] for w in WIDTHS], p["bias"], p["out"], p["out_bias"])


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[bytes, str]]:
    """At most `rows` rows with a language, none held out, evenly many of each
    language (by the hash of their id), with whole texts. Ids are chosen first,
    so only chosen documents' texts move."""
    small_batches(docs.sparkSession)
    own = docs.select(exact(docs, "doc_id").cast("long").alias("id"), exact(docs, "lang").cast("string").alias("lang"), exact(docs, "text").alias("text"))
    usable = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    ids = usable.select("id", "lang")
    frequent = ids.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not frequent:
        return []
    each = max(1, rows // len(frequent))
    # only ids whose hash lies below a language's share are ranked: about twice as many as are taken
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2.0 * each / max(1, r["n"]) + 1e-9 * each)) for r in frequent], "of string, share double")
    place = F.pmod(by_hash(F.col("id")), F.lit(1 << 31)) / F.lit(float(1 << 31))
    low = ids.join(F.broadcast(share), F.col("lang") == F.col("of")).where(place < F.col("share")).select("id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(by_hash(F.col("id")), "id"))
    chosen = low.withColumn("r", rank).where(F.col("r") <= each).limit(rows).select("id").distinct()
    few = docs.sparkSession.createDataFrame([(r["id"],) for r in chosen.collect()], "id long")  # at most `rows`
    got = usable.join(F.broadcast(few), "id").groupBy("id", "lang").agg(F.min("text").alias("text"))
    return [(x.encode(), lang) for _, lang, x in sorted((r["id"], r["lang"], r["text"]) for r in got.toLocalIterator())]


def fit_language(docs: DataFrame) -> Network:
    return train(labelled_sample(docs))


def identify(docs: DataFrame, network: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row from its whole text."""
    net = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid_cnn", lambda: None)
        scorer = Scorer(net.value)
        for whole in batches:
            for batch in pieces(whole, 1):
                found = scorer.texts(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    found = id_and_text(docs, doc_id, text).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, network: Network, languages: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """The rows of `docs` with a language, of probability `least` or more and
    among `languages` where given; all columns. Texts without a letter go; if no
    labelled row was there to learn from, all rows stay."""
    if not network.languages:
        return docs
    net = docs.sparkSession.sparkContext.broadcast(network)

    def keeper() -> Callable[[list, list], list]:
        begin("langid_cnn", lambda: None)
        scorer = Scorer(net.value)
        return lambda ids, texts: [x != UNKNOWN and s >= least and (languages is None or x in languages) for x, s in scorer.texts(texts)]

    return filtered(docs, keeper)
