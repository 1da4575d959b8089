"""Common lines, the Merkle manifest and hard negatives against plain versions."""

import hashlib
import math
import random
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import documents

from aircapture.llm import bond, lines, manifest
from aircapture.llm.common import shared_folder

# ---------------------------------------------------------------- lines

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_lines(docs, min_docs=5, min_chars=40):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(UPPER)
    order = lambda doc_id: -(2**63) if doc_id is None else doc_id
    holders = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(order(doc_id))
    out = []
    for doc_id, text in docs:
        found = (text or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != order(doc_id) for x in found]
        kept = "\n".join(x for x, g in zip(found, gone, strict=True) if not g)
        out.append((doc_id, None if text is None else kept, len(found), sum(gone)))
    return out


def told(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_common_lines_equal_a_plain_count(spark):
    rng = random.Random(4)
    common = [f"{'Shared line of a notice, long enough to count ' * 2}{i}" for i in range(6)]
    short = "Short shared line"
    pool = [*common, *(c.upper() for c in common), *(f" \t{c}\r" for c in common), short, "", "É" * 45, "é" * 45, "x" * 39, "x" * 40]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)) + [f"own {i}"])) for i in range(60)]
    docs += [(None, common[0]), (None, common[0] + "\n" + common[1]), (7, docs[7][1]), (7, docs[7][1]), (7, "\n\n"), (99, None), (98, ""), (97, "\n")]
    docs += [(1000, ("long text " * 9 + "\n") * 3000 + common[2])]
    got = lines.without_common_lines(documents(spark, docs)).collect()
    assert told(got, "doc_id", "text", "n_lines", "n_dropped") == sorted(plain_lines(docs), key=repr)
    assert sum(r["n_dropped"] for r in got) > 50


def test_common_lines_of_odd_tables(spark):
    assert lines.without_common_lines(documents(spark, [])).collect() == []
    only_null = documents(spark, [(None, "a" * 50)] * 9)
    assert told(lines.without_common_lines(only_null).collect(), "n_lines", "n_dropped") == [(1, 0)] * 9
    # columns with the names that the operator uses inside; its own results replace theirs
    names = ["positions", "of_doc", "hash", "line", "key", "n_docs", "last_doc", "n_dropped", "text_hash"]
    odd = documents(spark, [(i, "b" * 50 + "\nrest") for i in range(6)]).withColumns({n: F.lit(n) for n in names})
    out = lines.without_common_lines(odd)
    assert out.columns == [*(c for c in odd.columns if c != "n_dropped"), "n_lines", "n_dropped"]
    assert told(out.collect(), "doc_id", "text", "n_dropped", "hash") == [(i, "rest" if i < 5 else "b" * 50 + "\nrest", int(i < 5), "hash") for i in range(6)]


# ---------------------------------------------------------------- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha("".join(values))


def plain_tree(nodes):
    """Root, and of each leaf the (left, right) siblings on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a - a % 3
            paths[i].append(("".join(nodes[first:a]), "".join(nodes[a + 1 : first + 3])))
            at[i] = a // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    least = lambda x: (x is not None, x if x is not None else 0)
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in sources:
        ordered = sorted(trees[s], key=lambda r: (least(r[0]), plain_leaf(r)))
        done[s] = ordered, *plain_tree([plain_leaf(r) for r in ordered])
    root, tops = plain_tree([done[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for row, path in zip(done[s][0], done[s][2], strict=True):
            claim = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                claim = (*row[:4], row[4].replace("\n", ""))
            digest = plain_leaf(claim)
            for left, right in path + top:
                digest = sha(left + digest + right)
            proof = sha("".join(a + b for a, b in path + top))
            out.append((row[0], plain_leaf(row), done[s][1], root, proof, digest, digest == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
SHOWN = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def rows_of(n, source, at=0):
    return [(at + i, source, "en" if i % 3 else None, None if i % 5 == 0 else i, [None, "", "a\nb", "é\n", f"text {i}"][i % 5]) for i in range(n)]


@pytest.mark.parametrize("sizes", [[0], [1], [81, 82, 1], [700, 9, 10, 243, 244]])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rows = [r for k, n in enumerate(sizes) for r in rows_of(n, [None, "", "ä", "z", "n"][k], 10_000 * k)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert told(manifest.tamper_check(docs).collect(), *SHOWN) == (plain_manifest(rows) if rows else [])


def test_manifest_of_many_sources_null_and_repeated_rows(spark):
    rows = [r for k in range(200) for r in rows_of(1 + k % 3, f"s{k}", 100 * k)]
    rows += [rows_of(3, "hot")[2]] * 300 + [(None, "s1", "en", 1, "a\n"), (None, "s1", "en", 1, "b"), (None, None, None, None, None)]
    rows += [(7, "s2", "en", 3, "line\n" * 200_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("tree", "key", "digest", "idx", "claim", "path", "root")})
    assert told(manifest.tamper_check(docs).collect(), *SHOWN) == plain_manifest(rows)


def test_manifest_stays_in_its_folder_and_shows_paths(spark):
    rows = rows_of(100, "a") + rows_of(5, "b", 1000)
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    docs = spark.createDataFrame(rows, SCHEMA)
    manifest.write(docs, folder, carried={"lang": F.col("lang")})
    again = manifest.Manifest(spark, folder)
    proved = manifest.prove(again, carried=["lang"]).collect()
    assert len(proved) == 105 and all(r["verified"] and r["root"] == again.root() for r in proved)
    for r in proved:
        path = [s.asDict() for s in r["path"]]
        assert manifest.fold(r["leaf"], path) == again.root() and manifest.proof_digest(path) == r["proof_sha256"]
    # only every fourth level is stored: 100 leaves, then the 2 nodes four levels up, each level as groups of 81
    assert [again.groups("sources", k).select(F.sum(F.size("nodes"))).scalar() is not None for k in range(again.depth("sources"))] == [True, True]
    assert again.groups("sources", 1).select("n").distinct().collect()[0][0] == 2


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, anchors, positives=5, negatives=5):
    """rows: (vec_id, label, vector), one per vec_id."""
    def whole(v):
        return [max(min(math.floor(256 * x), bond.LARGEST), -bond.LARGEST) for x in v]

    fine = [(i, lb, whole(v)) for i, lb, v in rows if lb is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lb, v in fine:
        if i is None or not anchors(i):
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=True)), j, lx) for j, lx, w in fine if j != i and len(w) == len(v)]
        score.sort(key=lambda s: (-s[0], s[1] is None, s[1]))
        best = [s for s in score if s[2] == lb][:positives]
        for p, j, _ in best:
            found = [s for s in score if s[2] != lb and 80 * p <= 100 * s[0] <= 100 * p][:negatives]
            out += [(i, j, k + 1, n[1], p, n[0]) for k, n in enumerate(found)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"
PAIRS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lb) for i, lb, v in rows], VECTORS)


def random_rows(n, dims, seed, labels=3, step=0.25):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, dims))
    x = middle[rng.integers(0, 4, n)] + rng.normal(size=(n, dims)) * 0.5
    x = np.round(x / step) * step  # many equal scores
    return [(i, int(rng.integers(0, labels)), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 8, 24])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dims):
    rows = random_rows(400, dims, dims)
    monkeypatch.setattr(bond, "BLOCK_ROWS", 37)  # shipped by value, so tasks see it
    got = bond.hard_negatives(vectors(spark, rows).repartition(3), F.col("vec_id") % 20 == 0)
    want = plain_negatives(rows, lambda i: i % 20 == 0)
    assert told(got.collect(), *PAIRS) == want and len(want) > 50


def test_hard_negatives_of_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), [rng.choice([1.0, 0.5, -1.0]), 1.0]) for i in range(0, 60)]
    rows += [(100, None, [1.0, 1.0]), (200, 1, None), (300, 1, [None, 1.0]), (400, 1, [math.nan, 1.0]), (500, 0, [math.inf, 1.0])]
    rows += [(600, 0, [1.0, 1.0, 1.0]), (601, 0, [1.0, 1.0, 0.5]), (602, 1, [1.0, 1.0, 0.5]), (700, 1, []), (701, 1, []), (702, 0, [])]
    rows += [(800, 0, [3e38, 1.0]), (801, 0, [1e30, 0.0]), (802, 1, [1e30, 0.0]), (None, 0, [1.0, 1.0]), (900, 5, [0.1, 0.1])]
    frame = vectors(spark, rows).withColumns({c: F.lit(c) for c in ("v", "ids", "kind", "goals", "n")})
    want = plain_negatives(rows, lambda i: i % 100 == 0)
    assert told(bond.hard_negatives(frame, F.col("vec_id") % 100 == 0).collect(), *PAIRS) == want
    # a repeated row counts once
    twice = frame.unionByName(frame).unionByName(frame)
    assert told(bond.hard_negatives(twice, F.col("vec_id") % 100 == 0).collect(), *PAIRS) == want
    assert {r[0] for r in want} >= {0, 600, 700, 800}
    assert bond.hard_negatives(frame.where("false"), F.col("vec_id") % 100 == 0).collect() == []
    assert bond.hard_negatives(frame, F.lit(False)).collect() == []


def test_scan_leaves_out_what_cannot_be_among_the_best():
    rng = np.random.default_rng(5)
    # a few large components decide, so most rows leave after the first columns
    x = (rng.normal(size=(4000, 64)) * np.geomspace(4096, 1, 64)).astype(np.int32)
    row = {"dims": 64, "n": 4000, "ids": list(range(4000)), "labels": [0] * 4000, "columns": [c.astype("<i4").tobytes() for c in x.T],
           "least": x.min(0).tolist(), "most": x.max(0).tolist()}
    query = x[17].astype(np.int64)
    wanted = bond.Wanted(-(1 << 62), 1 << 62, 5, [])
    work = bond.scan(query, bond.Block(row), np.ones(4000, bool), [wanted])
    scores = x.astype(np.int64) @ query
    assert [i for _, i in wanted.found] == np.lexsort((np.arange(4000), -scores))[:5].tolist()
    assert work < 4000 * 64 / 4
