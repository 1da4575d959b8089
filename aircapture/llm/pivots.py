"""Near-duplicate vectors by an index of pivot permutations."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aircapture.llm.common import components, cut

PIVOTS = 256
NEAREST = 5
#: Vectors of one posting list that one task compares with as many others.
BLOCK = 1024


def fit_pivots(vectors: DataFrame, n_pivots: int = PIVOTS, sample: int = 4096, apart: float = 0.5) -> list[np.ndarray]:
    """Reference points for each length of vector, shortest first, one small job a length.

    They come from at most ``sample`` valid vectors of the length, those whose
    ids hash lowest. A vector becomes a pivot if its cosine to every pivot
    before it is below ``apart``: among pivots close to each other, noise would
    decide which of them are nearest to the vectors of one dense group.
    """
    valid = vectors.where("unit is not null")
    lengths = sorted(r["d"] for r in valid.select(F.size("unit").alias("d")).distinct().collect())
    found = []
    for d in lengths:
        rows = valid.where(F.size("unit") == d).orderBy(F.xxhash64("vec_id"), "vec_id", "unit").limit(sample).collect()
        chosen: list[list[float]] = []
        for r in rows:
            if len(chosen) == n_pivots:
                break
            if not chosen or (np.array(chosen) @ np.array(r["unit"])).max() < apart:
                chosen.append(r["unit"])
        found.append(np.array(chosen, np.float64))
    return found


def units(vectors: DataFrame) -> DataFrame:
    """vec_id and ``unit``: the vector over its length in double precision.

    Null where the vector is null, empty, zero or holds a null, NaN or infinity.
    Components are first divided by a power of two near the largest, which is
    exact, so that no square overflows or vanishes.
    """
    v = F.col("embedding").cast("array<double>")
    largest = F.array_max(F.transform(v, F.abs))
    power = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(largest)) - 1, F.lit(-1070)))
    power = F.when((largest > 0) & (largest < float("inf")), power)
    scaled = _once(power, lambda m: F.transform(v, lambda x: x / m))

    def unit(s: Column) -> Column:
        size = F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x)
        return _once(size, lambda z: F.when((z > 0) & (z < float("inf")), F.transform(s, lambda x: x / F.sqrt(z))))

    return vectors.select("vec_id", _once(scaled, unit).alias("unit"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, not once for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def postings(vectors: DataFrame, pivots: list[np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """(vec_id, near, key): a vector's nearest pivots and, one row each, its pairs of them.

    The posting list of a pair of pivots holds the vectors that have both among
    their nearest, so two vectors of a list share at least two pivots. Pivots
    are numbered through all lengths of vector: a list holds vectors of one.
    """
    total = sum(map(len, pivots))
    first = {p.shape[1]: sum(map(len, pivots[:i])) for i, p in enumerate(pivots)}
    of = {p.shape[1]: p for p in pivots}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("unit").value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                if d not in of:  # given pivots may lack a length
                    continue
                part = b.filter(pa.array(lengths == d))
                x = _matrix(part.column("unit"))
                k = min(nearest, len(of[d]))
                near = np.sort(np.argsort(-(x @ of[d].T), axis=1, kind="stable")[:, :k], axis=1) + first[d]
                pairs = list(combinations(range(k), 2)) or [(0, 0)]
                keys = np.stack([near[:, i] * total + near[:, j] for i, j in pairs], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), _lists(near.astype(np.int32), pa.int32()), _lists(keys, pa.int64())],
                    ["vec_id", "near", "keys"],
                )

    rows = vectors.select("vec_id", "unit").mapInArrow(run, "vec_id long, near array<int>, keys array<long>")
    return rows.select("vec_id", "near", F.explode("keys").alias("key"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(a.ravel(), kind))


def _compare(a: dict[str, np.ndarray], b: dict[str, np.ndarray], key: int, n_pivots: int, least: float, same: bool):
    """Links between two blocks of one posting list: (links of each row of a, of b, edges of a spanning forest).

    A pair is looked at only in the list of the two smallest pivots it shares,
    so that every pair counts once.
    """
    high = key % n_pivots
    cosine = a["unit"] @ b["unit"].T
    linked = cosine >= least
    if same:
        linked = np.triu(linked, 1)
    if not linked.any():
        return None
    before = np.arange(min(a["near"].min(), b["near"].min()), high)
    below = lambda near: (near[:, :, None] == before[None, None, :]).any(1).astype(np.float32)
    linked &= (below(a["near"]) @ below(b["near"]).T) < 1.5  # the smaller pivot of the key, and no other below
    if not linked.any():
        return None
    in_a, in_b = linked @ b["n"], a["n"] @ linked
    # label rows by the smallest row they reach, until nothing changes
    la, lb = np.arange(len(a["n"])), None
    if same:
        full = linked | linked.T
        while True:
            new = np.minimum(la, np.where(full, la[None, :], len(la)).min(1))
            new = new[new]
            if (new == la).all():
                break
            la = new
        moved = np.flatnonzero(la != np.arange(len(la)))
        edges = (a["id"][moved], a["id"][la[moved]])
    else:
        none = len(la)
        while True:
            lb = np.where(linked, la[:, None], none).min(0)
            new = np.minimum(la, np.where(linked, lb[None, :], none).min(1))
            if (new == la).all():
                break
            la = new
        moved, hit = np.flatnonzero(la != np.arange(len(la))), np.flatnonzero(lb < none)
        edges = (
            np.concatenate([a["id"][moved], b["id"][hit]]),
            np.concatenate([a["id"][la[moved]], a["id"][lb[hit]]]),
        )
    return in_a, in_b, edges


def links(vectors: DataFrame, least: float = 0.95, pivots: list[np.ndarray] | None = None, nearest: int = NEAREST) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Equal vectors are compared once, with their number, and vectors of each
    length among themselves. Long posting lists are dealt out in blocks, and
    each pair of blocks is one piece of work; a task emits, per block pair, a
    count for each linked vector and the edges of a spanning forest, never the
    pairs. Vectors that are null, zero or not finite link with nothing and are
    components of their own; so is one with a null vec_id, except that equal
    vectors share their class. The component of rows is the smallest vec_id of
    it. An empty table has no rows. Extra columns are not read.
    """
    rows = cut(units(vectors.select("vec_id", "embedding")))
    valid = rows.where("unit is not null")
    alone = rows.where("unit is null").select(
        "vec_id",
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
        (F.col("vec_id") == F.col("vec_id")).alias("kept"),
    )
    if pivots is None:
        pivots = fit_pivots(rows)
    if not pivots:
        return alone
    classes = valid.groupBy("unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    classes = cut(classes.where("vec_id is not null").select("vec_id", "n", "unit"))
    posted = cut(postings(classes, pivots, nearest))
    # blocks of each list; lists of one vector have no pair
    sizes = posted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    blocks = posted.join(sizes, "key").select(
        "key",
        "vec_id",
        "near",
        F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"),
        F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("m") / BLOCK)).cast("int").alias("block"),
    )
    mine = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j"))
    )
    dealt = blocks.select("key", "vec_id", "near", "block", F.explode(mine).alias("pair")).select(
        "key", "vec_id", "near", "block", "pair.i", "pair.j"
    )
    full = dealt.join(classes, "vec_id")
    n_pivots = sum(map(len, pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held)
            held.clear()
            if len(t) < 2:
                return
            t = t.combine_chunks()
            both = {
                "id": t["vec_id"].to_numpy(), "n": t["n"].to_numpy().astype(np.float64),
                "unit": _matrix(t["unit"].chunk(0)), "near": _matrix(t["near"].chunk(0)),
            }
            i, j, block = t["i"][0].as_py(), t["j"][0].as_py(), t["block"].to_numpy()
            a = {k: v[block == i] for k, v in both.items()}
            b = a if i == j else {k: v[block == j] for k, v in both.items()}
            if not len(a["n"]) or not len(b["n"]):
                return
            found = _compare(a, b, t["key"][0].as_py(), n_pivots, least, i == j)
            if found is None:
                return
            in_a, in_b, (u, v) = found
            ids, counts = np.concatenate([a["id"], b["id"]]), np.concatenate([in_a, in_b]).astype(np.int64)
            ids, counts = ids[counts > 0], counts[counts > 0]
            none = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), none(len(ids))], ["u", "links", "v"])
            yield pa.RecordBatch.from_arrays([pa.array(u), none(len(u)), pa.array(v)], ["u", "links", "v"])

        for b in batches:
            group = np.stack([b.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    if last is not None and last != tuple(group[s]):
                        yield from flush()
                    last = tuple(group[s])
                    held.append(b.slice(s, e - s))
        yield from flush()

    work = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = cut(
        work.select("key", "i", "j", "block", "vec_id", "n", "near", "unit").mapInArrow(run, "u long, links long, v long")
    )
    counts = found.where("links is not null").groupBy("u").agg(F.sum("links").alias("links"))
    joined = components(found.where("v is not null").select("u", "v"))
    per_class = (
        classes.join(counts, classes["vec_id"] == counts["u"], "left")
        .join(joined, classes["vec_id"] == joined["node"], "left")
        .select(
            "unit",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", classes["vec_id"]).alias("component_id"),
        )
    )
    linked = valid.join(per_class, "unit", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )
    return linked.union(alone)
