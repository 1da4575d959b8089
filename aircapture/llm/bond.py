"""Hard negatives by branch and bound on vertically stored vectors.

Vectors are stored as blocks of columns, one per dimension, with each column's
extremes. A query reads a block's columns in the order of its own components'
sizes, largest first. After some columns, each row has a partial score, and the
columns not read yet can add no less and no more than their extremes allow.
Rows whose bounds miss all that is still sought leave the candidates; the rest
goes on, and where no column is left its scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aircapture.llm.common import cut

SCALE = 256
#: Components beyond this are taken as this, so that four times a score of 4 096 dimensions fits in 64 bits.
LARGEST = 1 << 24
#: Rows of a block, and the rows and anchors that one piece of work takes at most, about.
BLOCK_ROWS, CELL_ROWS, CELL_ANCHORS = 4096, 65_536, 4096
#: Columns read before candidates are first looked through, and then each time.
STRIDE = 8
POSITIVES = NEGATIVES = 5
#: A negative's score is at least this part of the positive's, and at most that.
LOW = (4, 5)


def quantised(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, v): rows that take part, with each component x as floor(256 x) within :data:`LARGEST`.

    Rows with a null label, a null vector, or a null or non-finite component take no part.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    rows = vectors.select("vec_id", (F.col("label") if label is None else label).cast("int").alias("label"), "embedding")
    return rows.where(F.col("label").isNotNull() & finite).select("vec_id", "label", v.alias("v"))


_BLOCK = "dims int, no long, n int, ids array<long>, labels array<int>, columns array<binary>, least array<int>, most array<int>"
_BLOCK_ARROW = pa.schema(
    [("dims", pa.int32()), ("no", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())),
     ("columns", pa.list_(pa.binary())), ("least", pa.list_(pa.int32())), ("most", pa.list_(pa.int32()))]
)


def vertical(rows: DataFrame) -> DataFrame:
    """Numbered blocks of at most ``BLOCK_ROWS`` rows of equal dimension, a column each, as they lie in their partition.

    Which rows share a block changes the work and never the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no = TaskContext.get().partitionId() << 32
        for b in batches:
            lengths = b.column("v").value_lengths().to_numpy()
            for dims in np.unique(lengths):
                mine = b.filter(pa.array(lengths == dims))
                for at in range(0, mine.num_rows, BLOCK_ROWS):
                    part, no = mine.slice(at, BLOCK_ROWS), no + 1
                    x = part.column("v").flatten().to_numpy().reshape(part.num_rows, dims)
                    record = {
                        "dims": int(dims), "no": no, "n": part.num_rows, "ids": part.column("vec_id").to_pylist(),
                        "labels": part.column("label").to_pylist(), "columns": [c.astype("<i4").tobytes() for c in x.T],
                        "least": x.min(0).tolist(), "most": x.max(0).tolist(),
                    }
                    yield pa.RecordBatch.from_pylist([record], schema=_BLOCK_ARROW)

    return rows.select("vec_id", "label", "v").mapInArrow(run, _BLOCK)


class Block:
    """The rows of a block, a column per dimension."""

    def __init__(self, row: dict) -> None:
        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        self.distinct = len(np.unique(self.ids)) == len(self.ids)
        self.labels = np.array(row["labels"], np.int32)
        self.columns = np.empty((row["dims"], row["n"]))
        for d, c in enumerate(row["columns"]):
            self.columns[d] = np.frombuffer(c, "<i4")
        self.least, self.most = np.array(row["least"], np.int64), np.array(row["most"], np.int64)
        self.largest = int(max(np.abs(self.least).max(initial=0), np.abs(self.most).max(initial=0)))


#: Stands for a null vec_id, which comes after all others of its score.
NO_ID = 2**63 - 1


@dataclass
class Wanted:
    """The best ``count`` rows with a score from ``low`` to ``high``: more points first, then the smaller id."""

    low: int
    high: int
    count: int
    found: list[tuple[int, int]]  # (minus score, id), in order

    def floor(self) -> int:
        """The least score that can still be among the best."""
        return self.low if len(self.found) < self.count else max(self.low, -self.found[-1][0])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.floor()) & (scores <= self.high)
        scores, ids = scores[inside], ids[inside]
        if len(scores) > 4 * self.count:
            # ties at the last place stay, for their ids to decide
            last = np.partition(scores, len(scores) - self.count)[len(scores) - self.count]
            # of one id and score there may be several rows, which count once
            if len(np.unique(ids[scores >= last])) >= self.count:
                scores, ids = scores[scores >= last], ids[scores >= last]
        new = set(zip((-scores).tolist(), ids.tolist(), strict=True))
        if new:
            self.found = sorted(new.union(self.found))[: self.count]


def scan(query: np.ndarray, block: Block, among: np.ndarray, wanted: list[Wanted]) -> int:
    """Look among the rows of a block (a bitmap) for what is wanted; returns how many products that took.

    Bounds of a row after some columns are its partial score and what the other
    columns can add. A row stays a candidate while for one of the wanted, its
    bounds meet the range from the floor to the high end. The floor rises with
    the count-th largest lower bound of rows that are surely inside.
    """
    candidates = np.flatnonzero(among)
    live = [w for w in wanted if w.low <= w.high]
    if not len(candidates) or not live:
        return 0
    dims, work = len(query), 0
    exact = np.float64 if int(np.abs(query).max(initial=0)) * block.largest * max(dims, 1) < 1 << 53 else np.int64
    order = np.argsort(-np.abs(query), kind="stable")
    q = query[order]
    ends = np.stack([q * block.least[order], q * block.most[order]])
    rest_low = np.concatenate([np.cumsum(ends.min(0)[::-1])[::-1], [0]])
    rest_high = np.concatenate([np.cumsum(ends.max(0)[::-1])[::-1], [0]])
    partial = np.zeros(len(candidates), exact)
    every = len(candidates) == block.columns.shape[1]
    for at in range(0, dims, STRIDE):
        read = order[at : at + STRIDE]
        columns = block.columns[read] if every else block.columns[np.ix_(read, candidates)]
        partial += q[at : at + STRIDE].astype(exact) @ columns.astype(exact, copy=False)
        work += columns.size
        done = min(at + STRIDE, dims)
        lower, upper = partial + exact(rest_low[done]), partial + exact(rest_high[done])
        stay = np.zeros(len(candidates), bool)
        for w in live:
            floor = w.floor()
            sure = lower[(lower >= w.low) & (upper <= w.high)]
            # rows of one id may count once, so a block that repeats an id raises no floor by its bounds
            if len(sure) >= w.count and done < dims and block.distinct:
                floor = max(floor, np.partition(sure, len(sure) - w.count)[len(sure) - w.count])
            stay |= (upper >= floor) & (lower <= w.high)
        if not stay.all():
            candidates, partial, every = candidates[stay], partial[stay], False
            if not len(candidates):
                return work
    scores, ids = partial.astype(np.int64), block.ids[candidates]
    for w in live:
        w.add(scores, ids)
    return work


_GOAL = "struct<positive_id: long, low: long, high: long>"
_FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def _anchors_to_cells(anchors: DataFrame, groups: int, cells: int) -> DataFrame:
    grp = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    return anchors.select(
        F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), grp.alias("grp"),
        F.lit(0).alias("kind"), F.col("vec_id").alias("anchor"), "label", "v", "goals",
    )


def _blocks_to_cells(blocks: DataFrame, groups: int, cells: int) -> DataFrame:
    return blocks.select(
        "dims", F.pmod(F.xxhash64("no"), F.lit(cells)).cast("int").alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(1).alias("kind"),
        "n", "ids", "labels", "columns", "least", "most",
    )


def _search(anchors: DataFrame, blocks: DataFrame, groups: int, cells: int, same: bool, count: int) -> DataFrame:
    """The best ``count`` rows of each cell for each goal of each anchor, of the anchor's label or of all others.

    A piece of work is a group of anchors and a cell of blocks: its anchors come
    first, then one block at a time is scanned for all of them, and what they
    have found so far narrows the later blocks.
    """

    def ends(state: list) -> Iterator[pa.RecordBatch]:
        out = [
            (a["anchor"], goal["positive_id"], goal["high"] if not same else None, None if i == NO_ID else i, -s)
            for a, _, wanted in state for goal, w in zip(a["goals"], wanted, strict=True) for s, i in w.found
        ]
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "positive_score", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state = None, []
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                here = row["dims"], row["cell"], row["grp"]
                if here != place:
                    yield from ends(state)
                    place, state = here, []
                if row["kind"] == 0:
                    wanted = [Wanted(g["low"], g["high"], count, []) for g in row["goals"]]
                    state.append((row, np.array(row["v"], np.int64), wanted))
                elif state:
                    block = Block(row)
                    for a, query, wanted in state:
                        among = (block.labels == a["label"]) if same else (block.labels != a["label"])
                        scan(query, block, among & (block.ids != a["anchor"]), wanted)
        yield from ends(state)

    rows = _anchors_to_cells(anchors, groups, cells).unionByName(_blocks_to_cells(blocks, groups, cells), allowMissingColumns=True)
    tasks = min(groups * cells, MOST_TASKS)
    keys = ["dims", "cell", "grp"]
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, _FOUND)


#: Tasks of a search; beyond, a task takes several pieces of work one after the other.
MOST_TASKS = 100_000


def _first(found: DataFrame, goal: list[str], count: int) -> DataFrame:
    """The first ``count`` rows of each goal over all cells, with their rank."""
    order = Window.partitionBy(*goal).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor's hard negatives.

    Vectors are whole numbers (:func:`quantised`), a score is their inner
    product. An anchor's positives are the ``positives`` other rows of its label
    that score most, the smaller vec_id first among equals. For each of them,
    the ``negatives`` rows of other labels that score most within 4/5 of the
    positive's score and that score are returned; there may be fewer or none.

    Every row is looked at for every anchor, so the work is rows times anchors,
    less what the bounds save; it is dealt out in cells of blocks and groups of
    anchors of bounded size, whatever the labels. Cells send the best rows only.

    Rows with a null label, a null vector, or a null or non-finite component
    take no part; a component beyond 2^16 counts as 2^16. A row has a score with
    rows of as many components only. Rows of one vec_id are one vector: they are
    not each other's positives or negatives, such an anchor is the least of them
    by label and vector, and elsewhere those of one score count once. A null
    vec_id is no anchor and comes last among equals. Extra columns are not
    read; no rows or no anchors give no rows.
    """
    rows = quantised(vectors, label)
    blocks = cut(vertical(rows))
    size = blocks.agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).first()
    chosen = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    chosen = cut(chosen.select("vec_id", "a.label", "a.v"))
    groups = max(1, -(-chosen.count() // CELL_ANCHORS))
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = max(1, -(-(size["n"] or 0) // CELL_ROWS), min(size["blocks"], partitions))

    anything = F.struct(F.lit(None).cast("long").alias("positive_id"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))
    best = _search(chosen.withColumn("goals", F.array(anything)), blocks, groups, cells, True, positives)
    best = _first(best.select("anchor_id", "id", "score"), ["anchor_id"], positives)
    # the least whole number that is 4/5 of the score or more, without a division of floating point
    low = F.expr(f"({LOW[0]} * score) div {LOW[1]}") + ((F.col("score") > 0) & (F.col("score") * LOW[0] % LOW[1] != 0)).cast("int")
    goals = best.select("anchor_id", F.struct(F.col("id").alias("positive_id"), low.cast("long").alias("low"), F.col("score").alias("high")).alias("g"))
    goals = goals.groupBy("anchor_id").agg(F.array_sort(F.collect_list("g")).alias("goals"))
    second = chosen.join(goals, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    found = _first(_search(second, blocks, groups, cells, False, negatives), ["anchor_id", "positive_id", "positive_score"], negatives)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
