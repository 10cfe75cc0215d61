import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from meshline.llm import langid_cnn, license_scan, quality_lr, simhash_vp, spaced_seed

# --- license notices ----------------------------------------------------------------


def plain_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_plain_scan(spark, corpus, edge_texts):
    texts = [r["text"] for r in corpus.collect()] + edge_texts + ["Under the MIT license, under the mit-license; CC BY-NC 4.0 Apache License, Version 2.0 apache license version 2", "cc by ncé", "cc by nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan_licenses(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(texts[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_every_notice_within_its_edits_is_found():
    """Random edits of all letters at all places; a version number takes none and no digit beside it."""
    scanner, rng = license_scan.Scanner(), random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789 "
    for notice in license_scan.NOTICES:
        numbers = [m.start() for m in re.finditer(r"(?<![^ ])[0-9](?![^ ])", notice.phrase)]
        for _ in range(100):
            s = [[c] for c in notice.phrase]
            for _ in range(notice.edits):
                at, c, kind = rng.randrange(len(s)), rng.choice(letters), rng.randrange(3)
                if at in numbers or c.isdigit() and any(abs(at - x) <= 1 for x in numbers) or kind == 1 and {at - 1, at + 1} <= set(numbers):
                    continue
                s[at] = [c] if kind == 0 else [] if kind == 1 else [c, *s[at]] if at else s[at]
            text = " ".join("".join(itertools.chain.from_iterable(s)).split())
            spans = scanner.spans(f"lorem ipsum {text} dolor sit")
            assert notice.label in {scanner.notices[k].label for *_, k in spans}, text


def test_long_text_of_one_notice_in_little_time():
    began = time.process_time()
    raw = b"under the mit license permision is hereby granted free of charge " * 16_000
    found = license_scan.Scanner().scan(raw)
    assert found[1] == 16_000 and len(found[7]) == 32_000 and time.process_time() - began < 20
    assert [x["start_word"] for x in found[7][:4]] == [0, 4, 11, 15]


def test_other_versions_and_plain_text_are_not_matched():
    scan = license_scan.Scanner().scan
    assert scan(b"gnu general public license version 4")[5] == ""
    assert scan(b"gnu general public license version two")[5] == "" and scan(b"under the m1t license")[5] == "mit"
    assert scan(b"cc by nd")[5] == "" and scan(b"the rights of all were reserved")[5] == ""
    two = scan(b"Permision is hereby granted, free of charge. GNU General Public Licence version 2.")
    assert two[5] == "gpl-2,mit" and [s["edits"] for s in two[7]] == [1, 1] and two[7][1]["matched"] == "gnu general public licence version 2"


# --- quality --------------------------------------------------------------------------


def plain_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_measures_equal_plain_ones(corpus, edge_docs):
    for docs in (corpus, edge_docs):
        source = {r["doc_id"]: r["text"] for r in docs.collect()}
        found = quality_lr.score_quality(docs, None).collect()
        assert len(found) == docs.count()
        for r in found:
            want = plain_measure(source[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert r["kept"] == (not r["base_failed"])


def test_quality_model_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_lr.labelled_sample(docs, labels, 300)
    assert rows == quality_lr.labelled_sample(docs.repartition(7), labels.repartition(3), 300)
    random.Random(1).shuffle(rows)
    cut = len(rows) * 2 // 3
    model = quality_lr.train(rows[:cut])
    right = [(model.probability(raw) >= 0.5) == bool(y) for raw, y in rows[cut:]]
    assert np.mean(right) > 0.9
    assert quality_lr.train([(b"one", 1)] * 8) is None


def test_quality_stage_keeps_columns(edge_docs, no_docs):
    kept = quality_lr.keep_quality(edge_docs, None)
    assert kept.schema == edge_docs.schema and kept.count() == quality_lr.score_quality(edge_docs, None).where("kept").count()
    assert quality_lr.keep_quality(no_docs, None).count() == 0


# --- language -------------------------------------------------------------------------


def test_language_on_held_out_rows(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sample = langid_cnn.labelled_sample(docs, 800)
    assert len(sample) <= 800 and sample == langid_cnn.labelled_sample(docs.repartition(5), 800)
    net = langid_cnn.train(sample)
    found = langid_cnn.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 250 and np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.97
    for r in found:
        assert zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and 0 <= r["score"] <= 1
    odd = {r["doc_id"]: r for r in langid_cnn.identify(edge_docs, net).collect()}
    assert [odd[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und"] * 4 and odd[4]["lang_pred"] in net.languages and odd[23]["lang_pred"] == "und"
    assert langid_cnn.identify(no_docs, net).count() == 0
    kept = langid_cnn.keep_identified(edge_docs, net, least=0.0)
    assert kept.schema == edge_docs.schema and {r["doc_id"] for r in kept.collect()} == {i for i, r in odd.items() if r["lang_pred"] != "und"}


def test_no_labels_gives_und(edge_docs, no_docs):
    net = langid_cnn.fit_language(no_docs)
    assert {r["lang_pred"] for r in langid_cnn.identify(edge_docs, net).collect()} == {"und"}
    assert langid_cnn.keep_identified(edge_docs, net).count() == edge_docs.count()


def test_tables_equal_convolution():
    rng = np.random.default_rng(0)
    net = langid_cnn.Network(["a", "b"], rng.normal(size=(256, 8)), [rng.normal(size=(w * 8, 16)) for w in langid_cnn.WIDTHS], rng.normal(size=48), rng.normal(size=(48, 2)), np.zeros(2))
    rows = rng.integers(0, 256, (3, 256)).astype(np.uint8)
    pooled = []
    for w, f in zip(langid_cnn.WIDTHS, net.filters):
        pooled.append(np.stack([np.max([np.concatenate([net.embed[x] for x in row[i : i + w]]) @ f for i in range(256 - w + 1)], axis=0) for row in rows]))
    want = langid_cnn.softmax(np.maximum(np.concatenate(pooled, axis=1) + net.filter_bias, 0) @ net.out)
    assert np.allclose(langid_cnn.Scorer(net).windows(rows), want, atol=1e-4)


# --- SimHash --------------------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    up = {i: i for i in fps}
    ids = sorted(fps)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, corpus):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    base = [t for _, t in rows if len(t) > 4000][:6]
    for k in range(120):  # near copies: a word changed in a long text
        words = rng.choice(base).split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE two")]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(fps)
    found = simhash_vp.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]
    assert len(set(want.values())) < len(rows) - 100


def test_spark_and_library_hashes_agree(spark):
    text = "a few words é"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == simhash_vp.signed(xxh64_intdigest(text.encode(), 42))


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = base[:900] ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64))
    dense = np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(1500)], np.uint64)
    fps = np.unique(np.concatenate([base, near, near ^ np.uint64(1 << 40), dense]))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    tree = simhash_vp.grow(rng.permutation(fps)[:2000], 60)
    assert tree.shards > 20
    row, shard = simhash_vp.route(fps, tree)
    homes = [set() for _ in fps]
    for r, s in zip(row.tolist(), shard.tolist()):
        homes[r].add(s)
    for a, b in zip(*np.nonzero(close)):
        assert homes[a] & homes[b]
    whole, mine = simhash_vp.Union(len(fps)), simhash_vp.Union(len(fps))
    whole.join(*np.nonzero(close))
    a, b = simhash_vp.spanning_links(fps)
    assert len(a) < len(fps)
    mine.join(a, b)
    assert [whole.root(i) for i in range(len(fps))] == [mine.root(i) for i in range(len(fps))]


@pytest.mark.parametrize("depth", [4, 8, 12])
@pytest.mark.parametrize("clustered", [False, True])
def test_tree_has_no_shard_that_keeps_all(depth, clustered):
    """200,000 fingerprints: the largest shard, and copies made at the borders."""
    rng = np.random.default_rng(depth)
    fps = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 200_000).astype(np.uint64)
    if clustered:  # 200 centres, a fifth of the bits of each drawn anew
        centre, flips = fps[:200][rng.integers(0, 200, len(fps))], np.zeros(len(fps), np.uint64)
        for b in range(64):
            flips |= (rng.random(len(fps)) < 0.1).astype(np.uint64) << np.uint64(b)
        fps = np.unique(centre ^ flips)
    sample = rng.permutation(fps)[: 8 << depth]
    tree = simhash_vp.grow(sample, 0, 1 << depth)
    assert tree.shards == 1 << depth
    row, shard = simhash_vp.route(fps, tree)
    sizes = np.bincount(shard, minlength=tree.shards)
    assert sizes.max() <= 3 * sizes.mean() + 50
    assert len(row) <= 1.35**depth * len(fps)


def plain_groups(rows):
    """Groups of near copies: five-word shingles, 80 % or more in common, tried for all pairs."""
    words = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for i, t in rows}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in words.items()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for i, w in words.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    holders = {}
    for i, own in sets.items():
        for x in own or [()]:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in holders.values() for a, b in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if sets[a] == sets[b] or n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links += sets[a] != sets[b]
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in sets}, links


def test_one_of_each_equals_brute_force(spark):
    """Near copies of many kinds: nothing but copies goes, and nearly all do."""
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    long = [t for _, t in rows if t and len(t.split()) > 80]
    for k in range(300):
        words = rng.choice(long).split(" ")
        for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.choice([0.002, 0.01, 0.02, 0.05])))):
            words[at] = f"swap{rng.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(words[rng.randrange(3) :])))
    groups, links = plain_groups(rows)
    kept = {r["doc_id"] for r in simhash_vp.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = set(groups.values())
    assert links > 100 and wanted <= kept  # the smallest id of each group stays
    gone, should = len(rows) - len(kept), len(rows) - len(wanted)
    print(f"{gone} of {should} copies found, {links} links")
    assert gone >= 0.95 * should


def test_one_of_each(edge_docs, no_docs):
    kept = simhash_vp.one_of_each(edge_docs)
    assert kept.schema == edge_docs.schema
    groups, _ = plain_groups([(r["doc_id"], r["text"]) for r in edge_docs.collect() if r["doc_id"] is not None])
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(groups.values()))
    assert simhash_vp.one_of_each(no_docs).count() == 0 and simhash_vp.near_duplicates(no_docs).count() == 0


def test_near_copies_in_great_number(spark):
    """A dense group: each of 400 texts differs from a common one in its own word."""
    words = [f"w{j}" for j in range(120)]
    rows = [(i, " ".join(f"own{i}" if j == i % 120 else w for j, w in enumerate(words))) for i in range(400)] + [(900, "some other words that stand alone here")]
    kept = simhash_vp.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 900]


def test_no_near_copy_is_left_out(spark):
    """Pairs with 80 % in common whose word sets are more than 3 bits apart, and
    texts just under the share, with a line that all of them hold."""
    rng = random.Random(6)
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    common, rows, pairs = say(12), [], []
    for k in range(60):
        words = say(90)
        other = words[:40] + say(3 if k % 3 else 9) + words[43 if k % 3 else 49 :]
        pairs.append((words, other))
        rows += [(2 * k, " ".join(words + common)), (2 * k + 1, " ".join(common + other) if k % 2 else " ".join(other + common))]
    apart = [k for k, pair in enumerate(pairs) if min(int(a ^ b).bit_count() for a, b in (f.tolist() for f in simhash_vp.word_sets([[w.encode() for w in x] for x in pair]))) > 3]
    assert len(apart) > 10
    groups, links = plain_groups(rows)
    kept = [r["doc_id"] for r in simhash_vp.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert 0 < links < 60 and sorted(kept) == sorted(set(groups.values()))


def test_texts_of_a_family_do_not_move_for_each_pair(spark, monkeypatch):
    """160 texts, each two with half of their shingles in common, that all share
    leading shingles: few whole sets move, and the one near copy is found."""
    monkeypatch.setattr(simhash_vp, "MOST_FREQUENT", 0)
    rng = random.Random(11)
    words = [f"w{j}" for j in range(400)]
    rows = [(i, " ".join(f"own{i}x{j}" if (j + i) % 33 == 0 else w for j, w in enumerate(words))) for i in range(160)]
    rows.append((500, rows[77][1].replace("w200 ", f"new{rng.randrange(99)} ")))
    ends, cut = [], simhash_vp.cut

    def counted(df, what="cut"):
        out = cut(df, what)
        if what in ("pairs", "ends"):
            ends.append((what, out.count()))
        return out

    monkeypatch.setattr(simhash_vp, "cut", counted)
    kept = simhash_vp.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups, links = plain_groups(rows)
    assert links and sorted(r["doc_id"] for r in kept) == sorted(set(groups.values()))
    print(ends)
    assert ends[-1][0] == "ends" and ends[-1][1] <= 20  # texts whose whole sets move


def test_bounds_of_shared_shingles_hold(spark):
    """16 bits of a shingle and marks() never tell less in common than there is."""
    rng = np.random.default_rng(5)
    for n in (1, 7, 90, 4000):
        x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.unique(x[: n + n // 9]), np.unique(x[n // 9 : n + n // 5])
        both = len(np.intersect1d(a, b))
        p, q = (np.unique(y.astype(np.uint16)) for y in (a, b))
        assert len(np.intersect1d(p, q)) + min(len(a) - len(p), len(b) - len(q)) >= both
        m, o = (simhash_vp.marks(y) for y in (a, b))
        assert np.bitwise_count(m & ~o).sum() <= len(a) - both and np.bitwise_count(o & ~m).sum() <= len(b) - both


@pytest.mark.parametrize("frequent", [False, True])
def test_leading_shingles_lose_no_pair(frequent):
    rng = np.random.default_rng(3)
    some = np.sort(rng.choice(2000, 300, replace=False)).astype(np.uint64) if frequent else np.zeros(0, np.uint64)
    counts = rng.integers(3, 90, len(some))
    for n in (*range(1, 30), 100, 333):
        for gone in range(n + 1):
            x = rng.choice(2000, 2 * n, replace=False).astype(np.uint64)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[gone:n], x[n : n + rng.integers(0, gone + 1)]]))
            both = len(np.intersect1d(a, b))
            if both >= 0.8 * (len(a) + len(b) - both):
                assert len(np.intersect1d(simhash_vp.leading(a, some, counts), simhash_vp.leading(b, some, counts)))


def test_one_of_each_by_component(spark):
    """Null and repeated ids: each unrelated text stays, each copy goes."""
    rng = random.Random(8)
    a, b, c, d, e, f = (" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(9999)}" for _ in range(60)) for _ in range(6))
    rows = [(None, a), (None, b), (None, b.upper()), (None, c), (7, d), (7, e), (8, d), (3, f), (7, f), (7, f), (9, c), (5, None), (None, ""), (2, "x y z"), (2, "x y z")]
    kept = simhash_vp.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = Counter((r["doc_id"], (r["text"] or "").lower()) for r in kept)
    assert found == Counter([(None, a), (None, b), (7, d), (7, e), (3, f), (9, c), (5, ""), (2, "x y z")])


# --- decontamination ------------------------------------------------------------------


def plain_tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def test_planted_overlaps_are_found_and_clean_ones_left(spark, corpus):
    rng = random.Random(5)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    exact = {(r["doc_id"], i) for r in corpus.collect() for i, t in items.items() if t in r["text"]}
    assert {(r["doc_id"], r["item_id"]) for r in spaced_seed.contaminated(corpus, bench).collect()} == exact
    clean = [r["text"] for r in corpus.collect() if not any(t in r["text"] for t in items.values())][:40]
    rows, planted = [], set()
    for k, text in enumerate(clean):
        words = plain_tokens(items[k % len(items)])
        for at in rng.sample(range(len(words)), len(words) // 8):  # an eighth of the words replaced
            words[at] = f"swap{at}"
        passage = " ".join(words).upper()
        half = " ".join(plain_tokens(items[k % len(items)])[: max(10, len(words) // 2)])
        rows.append((k, text.replace("\n", " ", 1) + "\n" + (passage if k % 2 else half) + ". " + text[:200]))
        planted.add((k, k % len(items)))
    docs = spark.createDataFrame(rows + [(900, clean[0]), (901, None), (902, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in spaced_seed.contaminated(docs, bench).collect()} == planted
    assert {r["doc_id"] for r in spaced_seed.decontaminate(docs, bench).collect()} == {900, 901, 902}


def test_equal_to_comparing_at_every_offset():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(n) for n in (1, 2, 3, 4, 5, 6, 8, 12, 20, 30)]
    ids = [spaced_seed.tokens(" ".join(x).encode()) for x in items]
    table = spaced_seed.Table.build(ids)
    for _ in range(60):
        doc = say(40)
        i = rng.randrange(len(items))
        piece = list(items[i])
        if len(piece) >= 12:
            piece[len(piece) // 2] = "other"
        at = rng.randrange(40)
        doc[at:at] = piece
        found = {o.item for o in table.overlaps(spaced_seed.tokens(" ".join(doc).encode()))}
        want = set()
        for k, item in enumerate(items):
            for offset in range(-len(item) + 1, len(doc)):
                equal = [0 <= offset + j < len(doc) and doc[offset + j] == item[j] for j in range(len(item))]
                run = max((sum(1 for _ in g) for v, g in __import__("itertools").groupby(equal) if v), default=0)
                if run >= min(10, len(item)):  # an exact run as long as asked for
                    want.add(k)
        assert want <= found
        assert i in found


def test_no_benchmark_and_no_documents(spark, edge_docs, no_docs):
    empty = spark.createDataFrame([(1, None), (2, ""), (3, ".!")], "item_id long, text string")
    assert spaced_seed.contaminated(edge_docs, empty).count() == 0
    assert spaced_seed.decontaminate(edge_docs, empty).count() == edge_docs.count()
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    assert spaced_seed.contaminated(no_docs, bench).count() == 0 and spaced_seed.decontaminate(no_docs, bench).count() == 0


def test_items_without_id_and_short_items(spark):
    bench = spark.createDataFrame([(None, "alpha beta gamma delta epsilon zeta"), (2, "omega"), (None, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta"), (2, "an Omega."), (3, "one two four three"), (4, "one, two; three")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["item_id"]) for r in spaced_seed.contaminated(docs, bench).collect())) == [(1, None), (2, 2), (4, None)]
    assert [r["doc_id"] for r in spaced_seed.decontaminate(docs, bench).collect()] == [3]


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spaced_seed, "BLOCK_WINDOWS", 20)
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{j}" for j in range(15))) for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "some words here " + " ".join(f"b{i}x{j}" for j in range(15))) for i in range(8)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in spaced_seed.contaminated(docs, bench).collect()} == {(i, i) for i in range(6)}
    assert {r["doc_id"] for r in spaced_seed.decontaminate(docs, bench).collect()} == {6, 7}


@pytest.mark.parametrize("equal, bounds", [([1, 1, 0, 1], (0, 2)), ([0, 1, 1, 1, 0, 1, 1, 1], (1, 8)), ([0, 0], (0, 0))])
def test_best_stretch(equal, bounds):
    assert spaced_seed.best_stretch(np.array(equal, bool)) == bounds


def test_every_overlap_within_the_limits_is_found():
    """All ways to replace 2 of 10 and 3 of 15 tokens, and 1 of a short item."""
    for length, replaced in ((5, 1), (6, 1), (7, 1), (8, 1), (9, 1), (10, 2), (15, 3)):
        item = [f"w{j}" for j in range(length)]
        table = spaced_seed.Table.build([spaced_seed.tokens(" ".join(item).encode())])
        for at in itertools.combinations(range(length), replaced):
            piece = [f"swap{j}" if j in at else w for j, w in enumerate(item)]
            found = table.overlaps(spaced_seed.tokens(" ".join(["before"] * 3 + piece + ["after"] * 3).encode()))
            assert len(found) == 1 and found[0].equal >= 0.8 * found[0].length and found[0].length >= min(10, length), (length, at)


@pytest.mark.parametrize("parts", [(50, 24, 50, 24, 50), (20, 9, 20, 9, 20), (11, 5, 11, 5, 11)])
def test_verbatim_runs_apart_are_found(parts):
    item, words = [f"w{j}" for j in range(sum(parts))], []
    for k, n in enumerate(parts):
        words += [f"swap{j}" for j in range(n)] if k % 2 else item[len(words) : len(words) + n]
    table = spaced_seed.Table.build([spaced_seed.tokens(" ".join(item).encode())])
    (found,) = table.overlaps(spaced_seed.tokens(" ".join(words).encode()))
    assert found.length >= max(parts) and found.equal >= 0.8 * found.length


def test_equal_to_trying_every_window():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 2, 3, 4, 5, 7, 9, 10, 14, 25)]
    table = spaced_seed.Table.build([spaced_seed.tokens(" ".join(x).encode()) for x in items])
    for _ in range(60):
        doc = [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        want = set()
        for k, item in enumerate(items):
            for offset in range(-len(item) + 1, len(doc)):
                a, b = max(0, -offset), min(len(item), len(doc) - offset)
                equal = [doc[offset + j] == item[j] for j in range(a, b)]
                if any(5 * sum(equal[x:y]) >= 4 * (y - x) for x in range(len(equal)) for y in range(x + min(10, len(item)), len(equal) + 1)):
                    want.add(k)
        assert {o.item for o in table.overlaps(spaced_seed.tokens(" ".join(doc).encode()))} == want
