import hashlib
import pathlib
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from meshline.llm import bpe, token_orc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_strings(n):
    rng = random.Random(4)
    parts = list("abcdefgh  \n\n\t'sStLl.,!?0129éßñ中字عر🙂🏽‍  \x1c\x85́²½Ⅷ_-\r\x00") + ["<|endoftext|>", "'re", " the", "aaaaaaa", "       "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)] + ["".join(rng.choices("ab \n", k=rng.randint(0, 9))) for _ in range(n)]


def by_text(encoder, texts):
    ids, sizes = encoder.encode_column(pa.array(texts))
    ends = np.cumsum(sizes)
    return [(t, ids[e - n : e]) for t, e, n in zip(texts, ends, sizes)]


def test_codec_equals_library(library):
    codec = bpe.codec(PATH)
    for text, ids in by_text(codec.texts, odd_strings(4000)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_decoding_broken_utf8(library):
    rng = random.Random(8)
    codec = bpe.codec(PATH)
    for _ in range(300):
        ids = [rng.randrange(256) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


def naive(codec, piece):
    parts = [codec.ids_of[bytes([b])] for b in piece]
    while len(parts) > 1:
        ranks = [(codec.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))]
        rank, i = min(ranks)
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [codec.ids_of[codec.bytes[parts[i]] + codec.bytes[parts[i + 1]]]]
    return parts


def test_backtracking_equals_merging_in_order():
    codec, rng = bpe.codec(PATH), random.Random(2)
    for _ in range(3000):
        piece = bytes(rng.choices(b"aehinorst ", k=rng.randint(1, 14)))
        assert codec.encode_piece(piece) == naive(codec, piece)


def test_long_piece_is_linear(library):
    text = "".join(random.Random(3).choices("ab", k=60_000))
    assert np.frombuffer(bpe.codec(PATH).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_library_encoder_equals_library(library):
    for text, ids in by_text(token_orc.library_encoder(PATH), odd_strings(4000)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_encode_documents(edge_docs, library):
    rows = bpe.encode_documents(edge_docs, PATH).collect()
    source = {r["doc_id"]: r["text"] or "" for r in edge_docs.collect()}
    assert len(rows) == edge_docs.count()
    for r in rows:
        ids = library.encode(source[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_table(edge_docs, library):
    rows = sorted(token_orc.token_table(edge_docs, PATH).collect(), key=lambda r: r["start"])
    source = {r["doc_id"]: r["text"] or "" for r in edge_docs.collect()}
    at = 0
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in edge_docs.collect()), key=lambda i: -1 if i is None else i)
    for r in rows:
        ids = [*library.encode(source[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_table(no_docs):
    assert token_orc.token_table(no_docs, PATH).count() == 0
    assert bpe.encode_documents(no_docs, PATH).count() == 0


def test_files_have_indexes_and_bloom_filters(spark, corpus, tmp_path):
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(corpus, path, PATH, 2)
    few = token_orc.read_tokens(spark, path).where("doc_id = 7")
    plan = few._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan and few.count() == 1
    import pyarrow.orc as orc

    file = next((tmp_path / "tokens").glob("*.orc"))
    assert orc.ORCFile(str(file)).nrows > 0


def test_memory_of_a_worker_that_meets_only_new_words():
    """Growth of the process, its peak included, stays below 300 MB."""
    code = """
import random, resource, sys
import pyarrow as pa
from meshline.llm import bpe, token_orc
encoder = token_orc.library_encoder(sys.argv[1])
encoder.encode_column(pa.array([b"some words"]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rng = random.Random(1)
word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 12)))
def batches():
    for _ in range(3):
        texts = [" ".join(word() for _ in range(700)).encode() for _ in range(512)]
        yield pa.RecordBatch.from_arrays([pa.array(range(512)), pa.array(texts)], ["doc_id", "text"])
for batch in bpe.gathered(batches()):
    encoder.encode_column(batch.column(1), 2)
    assert len(encoder.pieces) <= bpe.CACHE_ENTRIES
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    grown = subprocess.run([sys.executable, "-c", code, PATH], capture_output=True, text=True, check=True, cwd=str(pathlib.Path(__file__).parents[2]))
    assert int(grown.stdout) < 300


def test_full_table_is_emptied(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 300)
    encoder = token_orc.LibraryEncoder(PATH)
    for k in range(0, 400, 50):
        for text, ids in by_text(encoder, odd_strings(400)[k : k + 50]):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
