"""Near-duplicate texts by ProbMinHash signatures of weighted word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from aircapture.llm.common import components, cut, mix, rolling, word_numbers

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Texts that are signed together.
SIGNED = 200
_SEED = np.uint64(0x5851F42D4C957F2D)


def shingles(text: bytes, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles (64-bit numbers) and their weights, the number of times each occurs.

    A text of fewer than k words has one shingle of all its words; without words it has none.
    """
    numbers = word_numbers(text)
    if not len(numbers):
        return np.empty(0, np.uint64), np.empty(0)
    found, n = np.unique(rolling(numbers, min(k, len(numbers))), return_counts=True)
    return found, n.astype(np.float64)


def signatures_of(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of each set (elements, weights), none empty, one row per set.

    Two sets agree in a register with the probability of their probability
    Jaccard similarity. Each element has a Poisson process of arrivals at the
    rate of its weight, drawn from its own number, and each arrival goes to a
    random register, which keeps the element that came first. An element stops
    once its next arrival is later than the latest of all registers of its set:
    nothing it sends can win any more. All sets take their n-th arrivals together.
    """
    of = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    who, rate = (np.concatenate(x) for x in zip(*sets, strict=True))
    first = np.full(len(sets) * registers, np.inf)
    winner = np.zeros(len(first), np.uint64)
    state, clock = mix(who ^ _SEED), np.zeros(len(who))
    while len(who):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        clock = clock - np.log1p(-((state >> np.uint64(11)).astype(np.float64) / 2.0**53)) / rate
        alive = clock < first.reshape(len(sets), registers).max(1)[of]
        if not alive.all():
            who, state, rate, clock, of = who[alive], state[alive], rate[alive], clock[alive], of[alive]
        place = of * registers + (mix(state ^ _SEED) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(clock < first[place])
        np.minimum.at(first, place[early], clock[early])
        won = early[clock[early] == first[place[early]]]
        winner[place[won]] = who[won]
    return winner.reshape(len(sets), registers)


def signature(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The signature of one set."""
    return signatures_of([(elements, weights)], registers)[0]


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact similarity: the sum over shared d of 1 / sum over all e of max(a_e / a_d, b_e / b_d).

    With shared elements sorted by a/b, those above d count with a and the
    others with b, so running sums give every term. Elements of one set only
    have an infinite or a zero ratio.
    """
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i], b[1][j]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    above = only_x + x.sum() - np.cumsum(x)
    below = only_y + np.cumsum(y)
    return float((1.0 / (above / x + below / y)).sum())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key (128-bit hash of the text), bands and registers, one row per input row.

    bands and registers are null for a text without words: it is like nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SIGNED):
                part = b.slice(at, SIGNED)
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                sets = [shingles(r) for r in raw]
                rows = iter(signatures_of(some) if (some := [x for x in sets if len(x[0])]) else [])
                yield _signed(part, [xxh3_128_digest(r) for r in raw], [next(rows) if len(x[0]) else None for x in sets])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, key binary, bands array<long>, registers binary")


def _signed(part: pa.RecordBatch, keys: list[bytes], found: list[np.ndarray | None]) -> pa.RecordBatch:
    none = np.zeros(REGISTERS, np.uint64)
    s = np.stack([none if f is None else f for f in found])
    bands = rolling_rows(s.reshape(len(s), BANDS, ROWS)) ^ mix(np.arange(BANDS, dtype=np.uint64))
    n = np.array([0 if f is None else BANDS for f in found], np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    silent = pa.array([f is None for f in found])
    values = pa.array(bands.view(np.int64)[n > 0].ravel())
    short = mix(s).astype(np.uint16)  # enough of each register to count how many agree
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            part.column("text_hash"),
            pa.array(keys, pa.binary()),
            pa.ListArray.from_arrays(offsets, values, mask=silent),
            pa.array([None if f is None else r.tobytes() for f, r in zip(found, short, strict=True)], pa.binary()),
        ],
        ["doc_id", "text_hash", "key", "bands", "registers"],
    )


def rolling_rows(x: np.ndarray) -> np.ndarray:
    """One number for the last axis of an array of numbers."""
    out = np.zeros(x.shape[:-1], np.uint64)
    for i in range(x.shape[-1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x[..., i])
    return out


def verify(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (center, other) whose exact similarity is ``least`` or more.

    Pairs come sorted by center in each task, so the center's shingles are made once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ours = None, None
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            ids = b.column("center").to_pylist()
            mine, theirs = b.column("center_text"), b.column("other_text")
            for r, center in enumerate(ids):
                if center != last:
                    last, ours = center, shingles(mine[r].as_py().encode())
                keep[r] = probability_jaccard(ours, shingles(theirs[r].as_py().encode())) >= least - 1e-12
            yield pa.RecordBatch.from_arrays(
                [b.column("center").filter(pa.array(keep)), b.column("other").filter(pa.array(keep))], ["u", "v"]
            )

    one = texts.select(F.col("id").alias("center"), F.col("text").alias("center_text"))
    two = texts.select(F.col("id").alias("other"), F.col("text").alias("other_text"))
    full = pairs.select("center", "other").join(two, "other").join(one, "center").sortWithinPartitions("center")
    return full.select("center", "other", "center_text", "other_text").mapInArrow(run, "u long, v long")


#: Members of one band that one task pairs with as many others.
BLOCK = 512


def least_agreement(least: float) -> float:
    """The share of equal registers below which a pair of one band is not compared exactly: six standard errors under.

    At the threshold 0.8 a link falls below with a probability of 3e-8, far
    less than that of sharing no band at all (5e-5).
    """
    return least - 6 * (least * (1 - least) / REGISTERS) ** 0.5


#: Pairs of a block per member of it, above which the members are compared where they are and the pairs do not leave.
SPARSE = 2
_BLOCK_KEYS = ["band", "i", "j"]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after the other, from rows sorted by block."""
    held, last = [], None
    for b in batches:
        group = np.stack([b.column(c).to_numpy() for c in _BLOCK_KEYS], axis=1)
        cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                if last is not None and last != tuple(group[s]):
                    yield pa.Table.from_batches(held)
                    held = []
                last = tuple(group[s])
                held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _close_pairs(rows: pa.Table, agree: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in the rows of a block of its pairs that may be links.

    They are of different components, have no band in common before this one,
    and a share of ``agree`` or more of their registers is equal.
    """
    i, j, nth, block = rows["i"][0].as_py(), rows["j"][0].as_py(), rows["nth"][0].as_py(), rows["block"].to_numpy()
    comp = rows["component"].to_numpy()
    regs = np.frombuffer(b"".join(rows["registers"].to_pylist()), np.uint16).reshape(len(comp), -1)
    bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(comp), -1)
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    one, two = [], []
    for r in a:
        apart = b[comp[b] != comp[r]]
        if i == j:
            apart = apart[apart > r]
        if len(apart):
            # a pair is looked at in the first band that it shares, and in no other
            apart = apart[(bands[apart] == bands[r]).argmax(1) == nth]
            close = apart[(regs[apart] == regs[r]).mean(1) >= agree]
            one.append(np.full(len(close), r))
            two.append(close)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *two])


def _screened(members: DataFrame, agree: float) -> DataFrame:
    """(center, other, band, i, j, nth, block): what is left to compare exactly of each band.

    Works on blocks of a band's members, so that a large band is many pieces of
    work. Of a block with few pairs for its members, the pairs leave. Of one
    with many, the members that are in pairs leave (``other`` is null), with
    their block: rows grow with members and blocks, never with pairs.
    """
    sizes = members.groupBy("band").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    sizes = sizes.where("lo <> hi").select("band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    ij = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j"))
    )
    dealt = dealt.withColumn("ij", F.explode(ij)).select("band", "nth", "ij.i", "ij.j", "block", "id", "component", "bands", "registers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            one, two = _close_pairs(rows, agree)
            if not len(one):
                continue
            ids = rows["id"].to_numpy()
            within = np.unique(np.concatenate([one, two]))
            if len(one) <= SPARSE * len(within):
                center, other = np.minimum(ids[one], ids[two]), pa.array(np.maximum(ids[one], ids[two]))
                block = np.zeros(len(one), np.int32)
            else:
                center, other, block = ids[within], pa.nulls(len(within), pa.int64()), rows["block"].to_numpy()[within]
            same = [pa.array(np.full(len(center), rows[c][0].as_py()), rows[c].type) for c in (*_BLOCK_KEYS, "nth")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(center), other, *same, pa.array(block, pa.int32())], ["center", "other", *_BLOCK_KEYS, "nth", "block"]
            )

    told = "center long, other long, band long, i int, j int, nth int, block int"
    return dealt.repartition(*_BLOCK_KEYS).sortWithinPartitions(*_BLOCK_KEYS).mapInArrow(run, told)


def _remaining(members: DataFrame, agree: float) -> DataFrame:
    """Pairs (center, other) that leave their blocks."""
    return _screened(members, agree).where("other is not null").select("center", "other").distinct()


def _linked_inside(dense: DataFrame, texts: DataFrame, agree: float, least: float) -> DataFrame:
    """(u, v): links between members of one block, compared there: enough of them to connect what is linked.

    ``dense`` has the members with their block, component, bands and registers.
    Each member's text goes to its blocks once. A pair that links found before
    already connect is not compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            one, two = _close_pairs(rows, agree)
            ids, text, known = rows["id"].to_numpy(), rows["text"], {}
            root = list(range(len(ids)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            def shingled(x: int) -> tuple[np.ndarray, np.ndarray]:
                if x not in known:
                    known[x] = shingles(text[x].as_py().encode())
                return known[x]

            us, vs = [], []
            for a, b in zip(one.tolist(), two.tolist(), strict=True):
                if find(a) != find(b) and probability_jaccard(shingled(a), shingled(b)) >= least - 1e-12:
                    root[find(a)] = find(b)
                    us.append(ids[a])
                    vs.append(ids[b])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    full = dense.join(texts, "id").select(*_BLOCK_KEYS, "nth", "block", "id", "component", "bands", "registers", "text")
    return full.repartition(*_BLOCK_KEYS).sortWithinPartitions(*_BLOCK_KEYS).mapInArrow(run, "u long, v long")


def _candidates(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(center, other) of each band: one member against those not joined to it.

    The center is the member that agrees with most others over all its bands,
    as the origin of a group of copies does; later, the best one outside the
    component of the first.
    """
    if labels is None:
        centers = members.groupBy("band").agg(F.max(F.struct("score", "id")).alias("c"))
        pairs = members.join(centers, "band").where(F.col("id") != F.col("c.id"))
    else:
        here = _labelled(members, labels)
        span = here.groupBy("band").agg(
            F.min("component").alias("lo"),
            F.max("component").alias("hi"),
            F.max_by("component", F.struct("score", "id")).alias("lead"),
        )
        here = here.join(span.where("lo <> hi"), "band")
        outside = here.where(F.col("component") != F.col("lead"))
        centers = outside.groupBy("band").agg(F.max(F.struct("score", "id", "component")).alias("c"))
        pairs = here.join(centers, "band").where(F.col("component") != F.col("c.component"))
    return pairs.select(F.col("c.id").alias("center"), F.col("id").alias("other")).distinct()


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, members["id"] == labels["node"], "left").select(
        "band", "nth", "id", "score", F.coalesce("component", "id").alias("component")
    )


def groups(docs: DataFrame, least: float = LEAST, rounds: int = 2, agree: float | None = None) -> DataFrame:
    """One row per input row: doc_id, text_hash, group_id, kept.

    A group is the texts linked by chains of pairs whose shingles have a
    probability Jaccard similarity of ``least`` or more. group_id is its
    smallest doc_id (null before all others), and one row with it is kept.
    Rows of equal text are one class throughout. A text without words (null,
    empty, white space) is like nothing else, not even another one: its row is
    kept, with its own doc_id as group_id. Extra columns are not read.

    In each band, members are first verified against a center (``rounds``
    times against another one not joined to it yet). Members still in different
    components are then compared with each other, by their registers, and
    exactly if a share of ``agree`` or more is equal (by default that of
    :func:`least_agreement`). So a band full of copies costs one comparison
    each, and a link of texts that share a band is left out with a probability
    of 3e-8 at most.
    """
    agree = least_agreement(least) if agree is None else agree
    signed = cut(signatures(docs))
    # ids of classes are dealt out once and then stored
    classes = (
        signed.where("bands is not null")
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    classes = cut(classes)
    banded = classes.select("id", F.posexplode("bands").alias("nth", "band"))
    shared = cut(banded.join(banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "band"))
    members = shared.join(shared.groupBy("id").agg(F.sum("m").alias("score")), "id").select("band", "nth", "id", "score")
    wanted = members.select("id").distinct().join(classes.select("id", "of"), "id")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = cut(
        wanted.join(
            hashed, F.col("of.doc_id").eqNullSafe(hashed["doc_id"]) & (F.col("of.text_hash") == hashed["text_hash"])
        ).select("id", "text").dropDuplicates(["id"])
    )
    found = labels = None
    for _ in range(rounds):
        new = cut(verify(_candidates(members, labels), texts, least))
        found = new if found is None else found.union(new)
        labels = cut(components(found))
    signs = classes.select("id", "bands", "registers")
    left = cut(_screened(_labelled(members, labels).join(signs, "id"), agree))
    pairs = left.where("other is not null").select("center", "other").distinct()
    dense = left.where("other is null").drop("other").withColumnRenamed("center", "id").join(signs, "id")
    dense = dense.join(labels, dense["id"] == labels["node"], "left").withColumn("component", F.coalesce("component", "id"))
    found = found.union(cut(verify(pairs, texts, least))).union(cut(_linked_inside(dense, texts, agree, least)))
    labels = components(found)

    named = classes.join(labels, classes["id"] == labels["node"], "left").select(
        "key", "of", F.coalesce("component", "id").alias("component")
    )
    heads = named.groupBy("component").agg(F.min("of").alias("head"))
    named = named.join(heads, "component").select("key", "head")
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("key"))
    rows = signed.select("doc_id", "text_hash", "key").withColumn("nth", nth).join(named, "key", "left")
    alone = F.col("head").isNull()
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    return rows.select(
        "doc_id",
        "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"),
        (alone | (first & (F.col("nth") == 1))).alias("kept"),
    )


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents whose row is kept; columns as given."""
    told = groups(docs, least).where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n"))
    told = told.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "_n")
    nth = F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy("_hash"))
    rows = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_nth", nth)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")) & (F.col("_nth") <= F.col("_n"))
    return rows.join(told, same).select(*(F.col(f"`{c}`") for c in docs.columns))
