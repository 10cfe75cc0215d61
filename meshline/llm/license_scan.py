"""Fuzzy search for short license notices.

A notice is a few words that may be misspelt in at most k characters. Split into
k + 1 pieces, any such occurrence has one piece unchanged (pigeonhole). An
Aho-Corasick automaton finds all pieces of all notices in one pass; around each
find the `regex` library's bounded-error matching, best match first, decides and
gives the span and the number of edits.

Texts are matched as words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z
become a-z) joined by single spaces, as UTF-8 bytes, so edits count bytes. A
match begins and ends with whole words; a number that is a word of the notice
(its version) takes no edits and stands next to no other digit, so "version 3"
or "version two" is no "version 2". Of matches that overlap, the least edited
stays, then the longest, then the first.

Defined cases: a null or empty text has no words, labels or spans and score 0;
every place counts, repeated ones too; a text is matched whole, however long.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from meshline.llm.common import WORD_BYTES, begin, id_and_text, pieces


class Notice(NamedTuple):
    """base: it also counts where its words stand consecutively, unchanged."""

    label: str
    phrase: str
    edits: int
    base: bool = False


#: The phrases of the contract, then further short notices. A phrase
#: under 15 characters takes no edits, as other words are too near to it.
NOTICES = (
    Notice("mit", "under the mit license", 2, True),
    Notice("apache-2", "apache license version 2", 2, True),
    Notice("cc-by-nc", "cc by nc", 0, True),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("apache-2", "licensed under the apache license version 2 0", 4),
    Notice("gpl-2", "gnu general public license version 2", 3),
    Notice("gpl-3", "gnu general public license version 3", 3),
    Notice("lgpl-3", "gnu lesser general public license version 3", 4),
    Notice("agpl-3", "gnu affero general public license version 3", 4),
    Notice("mpl-2", "mozilla public license version 2", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("bsd-3", "3 clause bsd license", 2),
    Notice("cc-by", "creative commons attribution 4 0 international", 4),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("unlicense", "released into the public domain", 2),
    Notice("all-rights-reserved", "all rights reserved", 1),
)

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start_word:long,end_word:long,edits:int,matched:string>>"


def pattern(notice: Notice) -> regex.Pattern:
    """A notice between word borders, with bounded errors between its numbers,
    best match first."""
    parts = regex.split(r"(?<![^ ])([0-9]+)(?![^ ])", notice.phrase)
    bound = f"{{e<={notice.edits}}}" if notice.edits else ""
    own = [rf"(?<![0-9]){x}(?![0-9])" if k % 2 else f"(?:{regex.escape(x, literal_spaces=True)}){bound}" for k, x in enumerate(parts) if x]
    return regex.compile(f"(?b)(?<![^ ]){''.join(own)}(?![^ ])")


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        self.base = [(n.label, b" " + n.phrase.encode() + b" ") for n in notices if n.base]
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            cuts = [round(i * len(n.phrase) / (n.edits + 1)) for i in range(n.edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                found.setdefault(n.phrase[a:b], []).append((k, a))
        for seed, where in found.items():
            self.seeds.add_word(seed, (len(seed), tuple(where)))
        self.seeds.make_automaton()
        self.patterns = [pattern(n) for n in notices]
        self.exact = [n.phrase for n in notices]

    def candidates(self, text: str) -> set[tuple[int, int]]:
        """(notice, where it would start) by an unchanged piece; an occurrence
        with few enough edits starts at most so many places from there."""
        return {(k, end + 1 - size - offset) for end, (size, where) in self.seeds.iter(text) for k, offset in where}

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, notice) of the verified matches, by position."""
        found, n = set(), len(text)
        for k, start in self.candidates(text):
            notice, phrase = self.notices[k], self.exact[k]
            a, b = max(0, start - notice.edits), min(n, start + len(phrase) + notice.edits)
            end = start + len(phrase)
            if start >= 0 and text.startswith(phrase, start) and (start == 0 or text[start - 1] == " ") and (end == n or text[end] == " "):
                found.add((start, end, 0, k))
                continue
            if b < n:  # no match ends inside a word
                b = text.rfind(" ", a, b + 1)
            m = self.patterns[k].search(text, a, b) if b > a else None
            if m and sum(m.fuzzy_counts) <= notice.edits:
                found.add((*m.span(), sum(m.fuzzy_counts), k))
        out: list[tuple[int, int, int, int]] = []
        for x in sorted(found, key=lambda x: (x[2], x[0] - x[1], x[0], x[3])):
            at = bisect.bisect_left(out, x)
            if (at == len(out) or x[1] <= out[at][0]) and (at == 0 or out[at - 1][1] <= x[0]):
                out.insert(at, x)
        return out

    def scan(self, raw: bytes | None) -> tuple:
        words = (raw or b"").translate(WORD_BYTES).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0, []
        padded = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for label, phrase in self.base:
            at = padded.find(phrase)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = padded.find(phrase, at + 1)
        starts = {at: padded.count(b" ", 0, at) for at in ({min(places), max(places)} if places else ())}
        base_labels = ",".join(sorted(labels))
        text, score, spans = padded[1:-1].decode("latin-1"), 1.0 if places else 0.0, []
        first, upto = 0, 0
        for s, e, edits, k in self.spans(text):
            n = self.notices[k]
            labels.add(n.label)
            score = max(score, 1 - edits / len(n.phrase))
            first, upto = first + text.count(" ", upto, s), s
            spans.append({"label": n.label, "start_word": first, "end_word": first + text.count(" ", s, e) + 1, "edits": edits, "matched": text[s:e].encode("latin-1").decode("utf-8", "replace")})
        return len(words), len(places), starts[min(places)] if places else None, starts[max(places)] if places else None, base_labels, ",".join(sorted(labels)), score, spans


@functools.lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """SCHEMA for every row of `docs`; one narrow pass. n_base, first_word,
    last_word and base_labels are of the base phrases; labels adds those of the
    spans; score is the best 1 - edits / length, 0 without a match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("license_scan", scanner.cache_clear)
        scan = scanner(notices).scan
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())]))]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for whole in batches:
            for batch in pieces(whole, 1):
                rows = [scan(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *names])

    return id_and_text(docs, doc_id, text).mapInArrow(run, SCHEMA)
