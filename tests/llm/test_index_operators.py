"""Pieces, ids, vectors, near copies and passages against plain versions."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import documents

from aircapture.llm import addressable, pieces, pivots, probminhash, substrings
from aircapture.llm.common import components, table
from aircapture.llm.fmindex import FmIndex

ODD = [None, "", " ", "a", "a  b   c\n\tx  ", "日本語 text 🙂", "ab" * 3000, "word " * 5000, "it's <|endoftext|> 'x", "x\u0085y ▁z"]


# ---------------------------------------------------------------- pieces


def plain_viterbi(v, text):
    s = "▁" + text.replace(" ", "▁")
    best, back = [0.0] + [-math.inf] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - v.longest), j):
            node = v.trie
            for c in s[i:j]:
                node = node[0].get(c)
                if node is None:
                    break
            if node is not None and node[1] and best[i] + node[1][0][1] > best[j]:
                best[j], back[j] = best[i] + node[1][0][1], (i, [node[1][0][0]])
        raw = s[j - 1].encode()
        if best[j - 1] + pieces.BYTE_SCORE * len(raw) > best[j]:
            best[j], back[j] = best[j - 1] + pieces.BYTE_SCORE * len(raw), (j - 1, [v.byte_ids[b] for b in raw])
    out, j = [], len(s)
    while j:
        out, j = back[j][1] + out, back[j][0]
    return out


def weight(v, ids):
    total = 0.0
    for i in ids:
        node = v.trie
        for c in v.bytes_of[i].decode("utf-8", "replace").replace(" ", "▁"):
            node = node[0].get(c, ({}, []))
        total += next((w for k, w in node[1] if k == i), pieces.BYTE_SCORE)
    return total


def test_pieces_equal_a_plain_viterbi(spark, sf_dir):
    encoder = pieces.Encoder(pieces.model_path())
    texts = [t for t in ODD if t] + [r["text"][:1500] for r in table(spark, sf_dir, "documents").limit(25).collect()]
    for t in texts:
        ids = encoder.encode(t)
        # of equal weight up to rounding, of which sums over the whole text and over its segments have a different share
        got, want = list(memoryview(ids).cast("i")), plain_viterbi(encoder.v, t)
        assert got == want or weight(encoder.v, got) == pytest.approx(weight(encoder.v, want), abs=1e-7)
        assert encoder.decode(ids).decode() == t.replace("▁", " ")
    stream = pieces.StreamingViterbi(encoder.v, every=16)
    for at in range(0, 60_000, 7):
        stream.feed(("▁" + "abcde" * 12_000)[at : at + 7])
    assert stream.held < 200  # the window, not the text
    assert list(stream.finish())[:50] == plain_viterbi(encoder.v, "abcde" * 100)[:50]


def test_piece_rows(spark):
    docs = documents(spark, [*enumerate(ODD), (3, "a"), (None, "n")])
    out = pieces.encode(docs)
    rows = out.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert r["n_ids"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes())
        assert r["round_trip"] == (r["doc_id"] != 9)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(out).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD) if i != 9)
    assert pieces.encode(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- ids in files


def test_any_id_can_be_read_alone():
    rnd = random.Random(1)
    ids = np.array([rnd.choice((0, 5, 255, 256, 50_000, 65_535, 65_536, 2**24, 2**32 - 1)) for _ in range(5000)], np.uint32)
    codes = addressable.Codes(addressable.pack(ids))
    assert (codes.all() == ids).all() and [codes[i] for i in range(5000)] == ids.tolist()
    assert len(addressable.Codes(addressable.pack(ids[:0])).all()) == 0


def test_files_hold_the_ids_of_the_library(spark, sf_dir, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(addressable, "SEGMENT", 3000)
    library = Tokenizer.from_file(addressable.tokenizer_path())
    real = [(r["doc_id"] + 100, r["text"]) for r in table(spark, sf_dir, "documents").limit(60).collect()]
    rows = [*enumerate(ODD), *real, (5, "again"), (5, "again"), (None, "none")]
    docs = documents(spark, rows)
    got = addressable.round_trip(docs).collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert addressable.round_trip(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library_on_any_text(name, monkeypatch):
    monkeypatch.setattr(addressable, "MEMORY", 200)
    encoder = addressable.TextEncoder(addressable.tokenizer_path(name))
    draw = random.Random(7)
    bits = [" ", "\n", "  ", "\n\n", "\t", "a", "Foo", "bar.", "1", "...", "!?,", "\r\n", "é", "中", "\u200b", "\ufeff", "\u180e", "'s"]
    bits += ["<|endoftext|>", "\x1c", "\u3000", "\xa0", "Ġ", "Ċ", "x" * 70, " \n", "\n "]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 14))) for _ in range(4000)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert encoder.encode(part) == [i.tobytes() for i in encoder._ids(part)]
        assert max(map(len, encoder.known), default=0) <= addressable.LONG


# ---------------------------------------------------------------- components


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5)]
    edges += [(k, k + 1) for k in range(2000, 2060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- vectors


def vectors(rng, groups=12, dims=16):
    rows = [rng.normal(size=dims) for _ in range(150)]
    for _ in range(groups):
        center = rng.normal(size=dims)
        rows += [center + rng.normal(size=dims) * rng.choice((0.05, 0.15, 0.25)) for _ in range(rng.integers(2, 9))]
    rows += [rows[-1]] * 3 + [rows[-1] * 2]
    return rows


@pytest.mark.parametrize("block", [3, 1024])
def test_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", block)
    x = vectors(np.random.default_rng(5))
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("unit", F.lit(1)).withColumn("n", F.lit(1))
    got = {r["vec_id"]: r for r in pivots.links(df, pivots=None).collect()}
    assert len(got) == len(rows)
    u = np.array([r[1] for r in rows[: len(x)]], np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    comp = np.arange(len(u))
    while (new := np.minimum(comp, np.where(link, comp[None, :], len(u)).min(1))).tolist() != comp.tolist():
        comp = new
    found = sum(got[i]["n_links"] for i in range(len(u)))
    assert found >= 0.9 * link.sum() > 50 and all(got[i]["n_links"] <= link[i].sum() for i in range(len(u)))
    assert np.mean([got[i]["component_id"] == comp[i] for i in range(len(u))]) > 0.97
    for i in range(1000, 1007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert pivots.links(df.limit(0)).count() == 0 and pivots.links(df.where("vec_id >= 1000 and vec_id < 1006")).count() == 6


def test_vectors_of_each_length_and_of_any_size_link(spark):
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=3).tolist()) for i in range(20)] + [(100 + i, [1.0, 2.0, 3.0, 4.0 + 0.01 * i]) for i in range(3)]
    rows += [(200, [1e200, 1e200]), (201, [2e200, 2e200]), (202, [1.7e308, 1.7e308]), (203, [5e-324, 5e-324]), (204, [-1e200, 1e200])]
    rows += [(300, None), (301, [0.0, 0.0]), (302, [float("inf"), 1.0]), (303, [1.0, None]), (304, [7.0]), (305, [9.0]), (306, [-9.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in (100, 101, 102)] == [(2, 100)] * 3
    assert [got[i] for i in (200, 201, 202, 203, 204)] == [(3, 200)] * 4 + [(0, 204)]
    assert [got[i] for i in range(300, 304)] == [(0, i) for i in range(300, 304)]
    assert [got[i] for i in (304, 305, 306)] == [(1, 304), (1, 304), (0, 306)] and len(got) == len(rows)


DENSE = "/root/testdata/check_h"


@pytest.mark.skipif(not os.path.isdir(DENSE), reason="needs the table with a dense group of vectors")
def test_recall_on_the_table(spark):
    v = table(spark, DENSE, "embeddings").where("vec_id < 3000")
    rows = v.orderBy("vec_id").collect()
    u = np.array([r["embedding"] for r in rows], np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in pivots.links(v).collect()}
    assert sum(got.values()) >= 0.9 * link.sum() > 0
    assert all(got[r["vec_id"]] <= n for r, n in zip(rows, link, strict=True))


# ---------------------------------------------------------------- near copies


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        b = np.unique(np.concatenate([a[:150], rng.integers(0, 2**63, 40).astype(np.uint64)]))
        x, y = (a, rng.integers(1, 5, len(a)).astype(float)), (b, rng.integers(1, 5, len(b)).astype(float))
        gaps.append((probminhash.signature(*x) == probminhash.signature(*y)).mean() - probminhash.probability_jaccard(x, y))
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.07


def test_exact_similarity_follows_its_definition():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a = {int(k): float(rng.integers(1, 4)) for k in rng.integers(0, 20, 12)}
        b = {int(k): float(rng.integers(1, 4)) for k in rng.integers(0, 20, 12)}
        want = sum(
            1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys()
        )
        pair = [(np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)])) for s in (a, b)]
        assert probminhash.probability_jaccard(*pair) == pytest.approx(want)


def near_copies(rnd):
    rows, n = [], 0
    for g in range(25):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(rnd.choice((6, 30, 120, 300)))]
        for _ in range(rnd.choice((1, 2, 3, 12))):
            copy = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, 4))):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, None), (n + 4, "one two"), (n + 5, "one two"), (n + 6, "one"), (None, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize("rounds, block, sparse", [(2, 512, 2), (1, 2, 0)])
def test_groups_equal_brute_force(spark, rounds, block, sparse, monkeypatch):
    monkeypatch.setattr(probminhash, "BLOCK", block)
    monkeypatch.setattr(probminhash, "SPARSE", sparse)
    rows = near_copies(random.Random(4))
    docs = documents(spark, rows)
    got = probminhash.groups(docs, rounds=rounds).collect()
    assert len(got) == len(rows)
    texts = sorted({t for _, t in rows if t and t.split()})
    sets = [probminhash.shingles(t.encode()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if probminhash.probability_jaccard(sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i, t in rows:
        if t and t.split():
            groups[find(texts.index(t))].append(i)
    low = {k: min(v, key=lambda i: (i is not None, i or 0)) for k, v in groups.items()}
    place = {t: find(k) for k, t in enumerate(texts)}
    want = collections.Counter((i, low[place[t]] if t and t.split() else i) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["group_id"]) for r in got) == want
    kept = [r["doc_id"] for r in got if r["kept"]]
    silent = [i for i, t in rows if not (t and t.split())]
    assert sorted(kept, key=str) == sorted([*low.values(), *silent], key=str)
    one_each = probminhash.deduplicated(docs)
    assert one_each.columns == docs.columns and sorted((r["doc_id"] for r in one_each.collect()), key=str) == sorted(kept, key=str)
    assert probminhash.groups(docs.limit(0)).count() == 0


def test_remaining_pairs_of_a_band_leave_once(spark):
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2**16, probminhash.REGISTERS).astype(np.uint16)
    some = one.copy()
    some[80:] += 1  # 80 of 125 registers agree, as they do now and then at a similarity of 0.8
    apart = [list(range(25)), [*range(100, 103), 3, *range(104, 125)], [*range(200, 203), 3, 4, *range(205, 225)]]
    rows = [
        (band, band, k, k, apart[k], bytearray((some if k == 2 else one).tobytes()))
        for band in (3, 4) for k in range(3) if apart[k][band] == band
    ]
    members = spark.createDataFrame(rows, "band long, nth int, id long, component long, bands array<long>, registers binary")
    got = probminhash._remaining(members, probminhash.least_agreement(0.8)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1), (0, 2), (1, 2)]


# ---------------------------------------------------------------- passages


def test_backward_search_finds_all_places():
    rng = np.random.default_rng(6)
    s = np.concatenate([[0], rng.integers(1, 7, 2998), [0]])
    index = FmIndex(s, 7)
    starts = rng.integers(1, 2990, 200)
    lo, hi = index.search(s, starts, 8)
    for a, b, at in zip(lo, hi, starts, strict=True):
        want = {i for i in range(2993) if (s[i : i + 8] == s[at : at + 8]).all()}
        assert set(index.suffixes[a:b].tolist()) == want


def longest(index, text, most):
    """By trying: the words from each place of a text on that occur together in the index, and where."""
    places = []
    for i in range(len(text)):
        n, found = 0, list(range(len(index)))
        while n < min(most, len(text) - i):
            more = [p for p in found if p + n < len(index) and index[p + n] == text[i + n]]
            if not more:
                break
            n, found = n + 1, more
        places.append((n, set(found)))
    return places


@pytest.mark.parametrize("order, letters", [(8, 3), (20, 2), (5, 6)])
def test_matching_statistics_equal_brute_force(order, letters):
    rng = np.random.default_rng(order)
    known = np.concatenate([[0], rng.integers(1, letters + 1, 400), [0]])
    texts = [rng.integers(1, letters + 2, n) for n in (0, 1, 7, 40, 60)]  # one symbol is not in the index
    texts += [known[30:75], np.concatenate([known[5:40], known[100:130]])]
    index = FmIndex(known, letters + 1, order)
    symbols = np.concatenate(texts)
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths) - lengths
    matched, lo, hi = index.statistics(symbols, begins, lengths, order)
    for b, t in zip(begins, texts, strict=True):
        for i, (n, found) in enumerate(longest(known.tolist(), t.tolist(), order)):
            assert matched[b + i] == n
            if n:
                assert set(index.suffixes[lo[b + i] : hi[b + i]].tolist()) == found


def plain_removal(rows, window):
    seen, out = set(), []
    for i, _, t in sorted((i is not None, i or 0, t) for i, t in {(i, t or "") for i, t in rows}):
        w = t.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_cleaned_keeps_odd_columns_and_rows(spark):
    story = " ".join(f"w{k}" for k in range(30))
    rows = [(None, f"head {story}"), (None, f"{story} tail"), (None, f"{story} tail"), (3, None), (4, ""), (5, story)]
    docs = documents(spark, rows)
    for name in ("id", "h", "kept", "row", "_id", "d", "again"):
        docs = docs.withColumn(name, docs["doc_id"] * 2)
    docs = docs.withColumn("a.b", docs["doc_id"])
    got = substrings.cleaned(docs)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    texts = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
    # of rows without an id, the order of a hash tells which text comes first
    first = collections.Counter({(None, f"head {story}"): 1, (None, "tail"): 2})
    other = collections.Counter({(None, "head"): 1, (None, f"{story} tail"): 2})
    assert texts - collections.Counter({(3, None): 1, (4, ""): 1, (5, ""): 1}) in (first, other)
    assert all(r["id"] == (None if r["doc_id"] is None else 2 * r["doc_id"]) for r in got.collect())


@pytest.mark.parametrize("least", [1, 3])
def test_counts_by_many_ranges_and_chunks(spark, least, monkeypatch):
    monkeypatch.setattr(substrings, "COUNTED", least)  # more ranges than anchors
    monkeypatch.setattr(substrings, "CHUNK", 2)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 300)
    rnd = random.Random(least)
    line = [f"w{rnd.randrange(9)}" for _ in range(200)]
    rows = [(i, " ".join(line[(k := rnd.randrange(150)) : k + rnd.randrange(10, 50)])) for i in range(25)]
    got = substrings.spans(documents(spark, rows)).collect()
    want = [x[1:] for x in plain_removal(rows, 20)]
    assert collections.Counter((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == collections.Counter(want)


def test_passages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "INDEXED", 300)
    rnd = random.Random(8)
    passages = [[f"p{k}w{rnd.randrange(50)}" for _ in range(rnd.randrange(15, 60))] for k in range(6)]
    rows = [(0, None), (1, ""), (2, "a " * 19), (3, "a " * 45), (4, "a " * 20)]
    for i in range(5, 60):
        words = [f"d{i}w{k}" for k in range(rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            cut = rnd.randrange(len(p))
            words += p[:cut] if rnd.random() < 0.3 else p
        rows.append((i, rnd.choice((" ", "\n", "  ")).join(words)))
    rows += [(60, rows[20][1]), (61, "z\x1fz " * 30), (61, "z\x1fz " * 30)]
    docs = documents(spark, rows)
    got = substrings.spans(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter(r[1:] for r in ((0, *x[1:]) for x in plain_removal(rows, 20)))
    want[next(x[1:] for x in plain_removal([(61, rows[-1][1])], 20))] += 1  # the repeated row is one document
    assert collections.Counter((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    text = {i: (t or "").encode().split() for i, t in rows}
    for r in got:
        gone = {k for s in r["spans"] for k in range(s["start"], s["end"])}
        kept = b" ".join(w for k, w in enumerate(text[r["doc_id"]]) if k not in gone)
        assert hashlib.sha256(kept).hexdigest() == r["kept_sha256"] and len(gone) == r["n_removed"]
    cleaned = {r["doc_id"]: r["text"] for r in substrings.cleaned(docs).collect()}
    assert cleaned[0] is None and cleaned[2] == "a " * 19 and cleaned[4] == ""
    nulls = substrings.spans(documents(spark, [(None, "b " * 25), (7, "b " * 20), (7, "c")])).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in nulls} == {(None, 25, 24), (7, 20, 20), (7, 1, 0)}
    assert substrings.spans(docs.limit(0)).count() == 0


def test_a_frequent_phrase_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 4)
    rnd = random.Random(9)
    phrase = [f"of{k}" for k in range(12)]
    rows = []
    for i in range(60):
        left, right = ([f"x{rnd.randrange(10**6)}" for _ in range(30)] for _ in range(2))
        rows.append((i, " ".join(left + phrase + (right if i % 7 else [f"same{k}" for k in range(30)]))))
    rows += [(60, rows[3][1]), (61, rows[3][1] + " end"), (62, "a " * 90)]
    docs = documents(spark, rows)
    shared = substrings._snippets(substrings._prepared(docs), 20, texts=False)
    assert shared.groupBy("a").agg(F.countDistinct("sid").alias("n")).agg(F.max("n")).first()[0] <= 4
    got = substrings.spans(docs).collect()
    found = [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sorted(got, key=lambda r: r["doc_id"])]
    assert found == [x[1:] for x in plain_removal(rows, 20)]


@pytest.mark.parametrize("window", [6, 9, 21])
def test_windows_of_other_sizes(spark, window):
    rnd = random.Random(10)
    shared = [f"p{k}" for k in range(30)]
    rows = []
    for i in range(40):
        at = rnd.randrange(22)
        words = [f"d{i}w{k}" for k in range(12)]
        rows.append((i, " ".join(words + shared[at : at + rnd.randrange(4, 30)] + words[:8])))
    got = substrings.spans(documents(spark, rows), window).collect()
    found = [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sorted(got, key=lambda r: r["doc_id"])]
    assert found == [x[1:] for x in plain_removal(rows, window)]


@pytest.mark.parametrize("window", [5, 22])
def test_windows_beyond_the_place_bits_are_refused(spark, window):
    with pytest.raises(ValueError):
        substrings.spans(documents(spark, [(1, "a")]), window)


def test_many_variants_each_too_far_from_the_others_stay_apart_without_pairs(spark):
    # 240 variants of one text, most pairs between 0.6 and 0.8: blocks are dense, so members leave them, not pairs
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(240):
        words = base.copy()
        for at in rng.sample(range(200), 4 if k % 8 else 2):
            words[at] = f"x{k}-{at}"
        rows.append((k, " ".join(words)))
    docs = documents(spark, rows)
    got = {r["doc_id"]: r["group_id"] for r in probminhash.groups(docs).collect()}
    sets = [probminhash.shingles(t.encode()) for _, t in rows]
    root = list(range(240))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(240):
        for j in range(i):
            if probminhash.probability_jaccard(sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {k: find(k) for k in range(240)} and 20 < len(set(got.values())) < 240


def test_texts_signed_together_have_the_signature_of_each():
    rng = np.random.default_rng(9)
    sets = [(rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(1, 50, n).astype(float)) for n in (1, 3, 500, 40, 2)]
    together = probminhash.signatures_of(sets)
    assert all((probminhash.signature(*s) == together[k]).all() for k, s in enumerate(sets))


def test_an_encoder_is_that_of_its_path():
    from aircapture.llm.common import kept_in_worker

    made = [kept_in_worker("test", path, lambda p: [p]) for path in ("a", "a", "b", "a")]
    assert made == [["a"], ["a"], ["b"], ["a"]] and made[0] is made[1]
