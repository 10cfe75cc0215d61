"""Byte-level BPE: exact encoding by backtracking, decoding by an offset table.

Encoding a pre-token walks it left to right. An Aho-Corasick automaton over the
vocabulary gives the longest token at each start; a token is taken if it is
*compatible* with the one before it, that is if merging the bytes of the two
would leave exactly these two. If not, the next shorter token is tried, and when
none is left the last token is taken back. A position from which no way leads on
is marked, so each is left once: the work is linear in the pre-token's length,
and the result equals that of applying the merges in order of rank.

Defined cases: a null text counts as empty; an empty text has no ids; special
tokens in a text are recognised, as the tokenizers library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from meshline.llm.common import begin, id_and_text, pieces

#: Fixed values of the public byte-level format: its pre-token pattern.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens and ids that a worker's table holds before it is emptied: about 50 MB.
CACHE_ENTRIES, CACHE_IDS = 700_000, 4 << 20
#: Bytes of text that are encoded together: the more, the fewer distinct pre-tokens for each text.
GATHERED_BYTES = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: printable Latin-1 bytes stand for themselves, the others take
    the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceTable:
    """Pre-token -> its ids, as a stretch of one growing array.

    A pre-token of up to 15 bytes is its own key, two 64-bit words with its
    length in the last byte; keys stand in two sorted parts, the smaller of which
    takes what is new. So an entry costs about 50 bytes and a batch is looked up
    by gathers; longer pre-tokens are encoded each time. A table that new
    pre-tokens would fill past its bounds is emptied before they enter it: it
    holds no more than its bounds or one batch's."""

    def __init__(self, new_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.new_pieces = new_pieces
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        nothing = tuple(np.zeros(1, kind) for kind in (np.uint64, np.uint64, np.uint64, np.int64, np.int64))  # "", behind a chunk's last pre-token
        self.parts = [nothing, tuple(x[:0] for x in nothing)]

    def __len__(self) -> int:
        return sum(len(part[0]) for part in self.parts)

    def look_up(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) in `flat` of the ids of each of some distinct pre-tokens,
        until the next call."""
        low, high, long = piece_keys(pieces)
        mixed = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        start, size = np.full(len(pieces), -1, np.int64), np.zeros(len(pieces), np.int64)
        for keys, lows, highs, starts, sizes in self.parts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, mixed), len(keys) - 1)
                same = (keys[at] == mixed) & (lows[at] == low) & (highs[at] == high) & ~long
                start[same], size[same] = starts[at[same]], sizes[at[same]]
        unknown = np.flatnonzero(start < 0)
        if not len(unknown):
            return start, size
        kept = unknown[~long[unknown]]
        if len(self) > 1 and (len(self) + len(kept) > CACHE_ENTRIES or self.used > CACHE_IDS):
            self.clear()
            return self.look_up(pieces)
        # those to be kept first: the others' ids stand behind, where the next call's go
        unknown = np.concatenate([kept, unknown[long[unknown]]])
        ids, sizes = self.new_pieces(strings(pieces.take(pa.array(unknown))))
        self.flat = grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        start[unknown], size[unknown] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += int(size[kept].sum())
        self.learn((mixed[kept], low[kept], high[kept], start[kept], size[kept]))
        return start, size

    def learn(self, new: tuple[np.ndarray, ...]) -> None:
        large, small = self.parts
        small = merged(small, new)
        if len(small[0]) > 20_000 + len(large[0]) // 6:
            large, small = merged(large, small), tuple(x[:0] for x in small)
        self.parts = [large, small]


def piece_keys(pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first 8 bytes, next 7 and the length, whether there are more) of each."""
    n = len(pieces)
    bounds = np.frombuffer(pieces.buffers()[1], np.int32, n + 1, 4 * pieces.offset)
    first, length = bounds[:-1].astype(np.int64), np.diff(bounds)
    out, at = np.zeros((n, 16), np.uint8), np.arange(n)
    data = np.frombuffer(pieces.buffers()[2], np.uint8) if length.any() else None
    for k in range(15):
        at = at[length[at] > k]
        if not len(at):
            break
        out[at, k] = data[first[at] + k]
    out[:, 15] = np.minimum(length, 255)
    words = out.view("<u8")
    return words[:, 0].copy(), words[:, 1].copy(), length > 15


def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))


def grown(array: np.ndarray, least: int) -> np.ndarray:
    if least <= len(array):
        return array
    out = np.zeros(max(least, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class ChunkEncoder:
    """Encodes a column of texts by way of its distinct pre-tokens.

    A chunk is a run of non-spaces with the one space or line break before it;
    no pre-token crosses such a border. Chunks are split, told apart and split
    into pre-tokens in Arrow's columns; Python sees each distinct pre-token of a
    batch once, asks for the ids of those that the worker has not met lately,
    and spreads the ids out again by gathers. `piece` gives the ids of a
    pre-token as little-endian 32-bit bytes, `new_pieces`, if given, those of
    many at once, `whole` those of a text that can't be split."""

    #: Texts in which chunks can't be told by single spaces and line breaks alone.
    UNEVEN = ("  ", "\n\n", " \n", "\n ")
    OTHER = "[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    #: Spaces on which regular expression libraries and Unicode's White_Space differ.
    ODD_SPACES = re.compile("[\x1c-\x1f]")
    #: PRE_TOKENS inside a chunk, where no white space follows white space.
    IN_CHUNK = r"\n|'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+| "

    def __init__(self, specials: list[str], whole: Callable[[str], np.ndarray], new_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.specials, self.whole = specials, whole
        self.pattern = regex.compile(PRE_TOKENS)
        self.pieces = PieceTable(new_pieces)
        self.line_break = len(new_pieces(["\n"])[0])

    def undivided(self, text: str) -> bool:
        """Whether the text must be encoded as a whole."""
        return self.ODD_SPACES.search(text) is not None or any(x in text for x in self.specials)

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text without special tokens, by its pre-tokens."""
        found = self.pattern.findall(text)
        if not found:
            return np.zeros(0, np.uint32)
        distinct = pa.array(found, pa.string()).dictionary_encode()
        at, size = self.pieces.look_up(distinct.dictionary)
        entry = distinct.indices.to_numpy()
        return gather(self.pieces.flat, at[entry], size[entry])

    def encode_uneven(self, text: str) -> np.ndarray:
        return self.whole(text) if self.undivided(text) else self.plain(text)

    def encode_column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each), `end` after each
        text where given. A null text is empty."""
        try:
            texts = pc.fill_null(texts.cast(pa.string()), "")
        except pa.ArrowInvalid:  # not UTF-8
            texts = pa.array([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        uneven = pc.match_substring_regex(texts, self.OTHER)
        for part in (*self.UNEVEN, *self.specials):
            uneven = pc.or_(uneven, pc.match_substring(texts, part))
        uneven = uneven.to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~uneven))
        # each line break opens a chunk, as does one put before the text, whose id is left out below
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(even, "\n", " \n"), ""), " ")
        chunks = lists.flatten().dictionary_encode()
        distinct = chunks.dictionary
        spaced = pc.if_else(pc.starts_with(distinct, "\n"), distinct, pc.binary_join_element_wise(" ", distinct, ""))
        inside = pc.split_pattern(pc.replace_substring_regex(spaced, self.IN_CHUNK, "\\0\x1f"), "\x1f")
        pieces = inside.flatten().dictionary_encode()
        at, length = self.pieces.look_up(pieces.dictionary)
        entry = pieces.indices.to_numpy()
        length = length[entry]
        chunk_ids = gather(self.pieces.flat, at[entry], length)
        upto = np.concatenate([[0], np.cumsum(length)])
        bounds = np.concatenate([[0], np.cumsum(inside.value_lengths().to_numpy(zero_copy_only=False))])
        chunk_size = upto[bounds[1:]] - upto[bounds[:-1]]

        # beside the chunks, the entries to spread are the uneven texts and the end
        others = [self.encode_uneven(t) for t in texts.filter(pa.array(uneven)).to_pylist()]
        tail = np.array([] if end is None else [end], np.uint32)
        flat = np.concatenate([chunk_ids, *others, tail])
        size = np.concatenate([chunk_size, [len(x) for x in (*others, tail)]]).astype(np.int64)
        start = np.cumsum(size) - size
        per_text = np.ones(len(texts), np.int64)
        per_text[~uneven] = lists.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(per_text + 1)
        first = ends - per_text - 1
        entry = np.full(int(ends[-1]), len(size) - 1, np.int64)
        body = np.ones(len(entry), bool)
        body[ends - 1] = False
        from_chunks = np.repeat(~uneven, per_text)
        entries = np.empty(len(from_chunks), np.int64)
        entries[from_chunks] = chunks.indices.to_numpy()
        entries[~from_chunks] = len(chunk_size) + np.arange(len(others))
        entry[body] = entries
        at, length = start[entry], size[entry]
        cut = first[~uneven]
        at[cut] += self.line_break
        length[cut] -= self.line_break
        return gather(flat, at, length), np.add.reduceat(length, first)


def gather(flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that start at `at`, one after the other."""
    upto = np.cumsum(length)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    index = np.repeat((at - (upto - length)).astype(kind), length)
    index += np.arange(total, dtype=kind)
    return flat[index]


def strings(array: pa.StringArray) -> list[str]:
    """As to_pylist(), by one split where no value holds U+001F."""
    if not len(array) or pc.any(pc.match_substring(array, "\x1f")).as_py():
        return array.to_pylist()
    whole = pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
    return pc.binary_join(whole, "\x1f")[0].as_py().split("\x1f")


class Codec:
    """Vocabulary, pair-compatibility table, automaton and offset table."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(max(vocab.values()), *self.special.values(), 0) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(alphabet[c] for c in token)
        ids = {b: i for i, b in enumerate(self.bytes) if b}
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        # A merged pair's rank: the place in the merge list. Ids ascend with it here, but that isn't relied on.
        self.rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int]] = {}
        self.order = [-1] * size
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (ids[bytes(alphabet[c] for c in part)] for part in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = ids[self.bytes[left] + self.bytes[right]]
            self.rank[left, right] = rank
            if whole not in self.made_of:
                self.made_of[whole], self.order[whole] = (left, right), rank
        reachable = {i for i, b in enumerate(self.bytes) if len(b) == 1} | set(self.made_of)
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            if i in reachable:
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.ids_of = {b: i for b, i in ids.items() if i in reachable}
        #: The longest token that is a proper prefix of each, or -1.
        self.shorter = [-1] * size
        for b, i in self.ids_of.items():
            self.shorter[i] = next((self.ids_of[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ids_of), -1)
        self.compatible_pairs: dict[int, bool] = {}
        self.pattern = regex.compile(PRE_TOKENS)
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.size = [len(b) for b in self.bytes]
        lengths = np.array(self.size, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.texts = ChunkEncoder(list(self.special), self.encode_whole, self.encode_pieces)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, merged together, end as exactly a, b.

        The merges inside a and b are undone newest first. Before each, the two
        tokens that face each other at the border must not merge earlier than
        the merge just undone; of merges of equal rank the leftmost is first."""
        key = a << 32 | b
        x, y, bar = a, b, len(self.rank)
        while True:
            across = self.rank.get((x, y))
            if across is not None and across < bar:
                result = False
                break
            ox, oy = self.order[x], self.order[y]
            if ox < 0 and oy < 0:
                result = True
                break
            if ox > oy:
                x, bar = self.made_of[x][1], ox  # the merge inside a lies left of the border and goes first
            else:
                y, bar = self.made_of[y][0], oy + 1
        if len(self.compatible_pairs) >= 300_000:
            self.compatible_pairs.clear()
        self.compatible_pairs[key] = result
        return result

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        n = len(piece)
        if n == 1:
            return [self.ids_of[piece]]
        text = piece.decode("latin-1")
        size, known, shorter, longest = self.size, self.compatible_pairs, self.shorter, self.automaton.iter_long
        matches = longest(text)  # leftmost longest tokens; every byte is one, so they are gapless
        blocked: set[int] = set()
        out: list[int] = []
        at, last, token = 0, -1, next(matches)[1]
        while True:
            end = at + size[token]
            if end not in blocked:
                fits = last < 0 or known.get(last << 32 | token)
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, next(matches)[1]
                    continue
            token = shorter[token]
            while token < 0:  # nothing fits here: leave this position for good
                blocked.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = shorter[token]
            matches = longest(text, at + size[token])

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each)."""
        found = [self.encode_piece(p.encode()) for p in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def encode_whole(self, text: str) -> np.ndarray:
        """The ids of a text in which special tokens can stand."""
        if self.split_special is None:
            return self.texts.plain(text)
        return np.concatenate([np.array([self.special[x]], np.uint32) if x in self.special else self.texts.plain(x) for x in self.split_special.split(text)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, little-endian unsigned 32-bit."""
        return self.texts.encode_column(pa.array([text], pa.string()))[0].tobytes()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, by one gather over the offset table."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        return self.blob[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of every
    whole text; one narrow pass, no shuffle. `tokenizer` is the path of a
    byte-level BPE file, present on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe", codec.cache_clear)
        c = codec(tokenizer)
        for batch in gathered(batches):
            ids, sizes = c.texts.encode_column(batch.column(1))
            ends = np.cumsum(sizes)
            held = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
            columns = [
                batch.column(0),
                pa.array(sizes),
                pa.array([hashlib.sha256(h.tobytes()).hexdigest() for h in held], pa.string()),
                pa.array([hashlib.sha256(c.decode(h).encode()).hexdigest() for h in held], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(id_lists(ids, sizes))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return id_and_text(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def id_lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Ids of consecutive texts -> a list column, without a Python object for each id."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.ascontiguousarray(ids).view(np.int32)))


def gathered(batches: Iterator[pa.RecordBatch], least_bytes: int = GATHERED_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches`, texts second, in batches of about `least_bytes`;
    after each, memory that Arrow no longer uses goes back to the system."""
    held, size = [], 0
    for whole in batches:
        for batch in pieces(whole, 1, least_bytes):
            held.append(batch)
            size += batch.nbytes
            if size >= least_bytes:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
