"""Merkle manifest of a dataset: few stored levels, and proofs that recompute the levels between them.

Leaves of one source, in order of doc_id, form a tree of runs of ``ARITY``; the
roots of the sources form the top tree. A stored level is a table of *groups*:
``ARITY ** LEVELS`` neighbouring nodes, which are the lowest nodes of one
aligned subtree. The levels inside a subtree are never stored. Whoever needs
them recomputes them from its group and drops them again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aircapture.llm.common import cut, shared_folder

ARITY = 3
#: Levels from one stored level to the next.
LEVELS = 4
#: Nodes of a group, at most.
GROUP = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the tree whose leaves are the roots of all others.
TOP = "top"


def entry(value: Column) -> Column:
    """A value as it goes into a leaf: ``-`` for null, else its length in UTF-8 bytes, a colon, and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    """Hex SHA-256 of the entries of a row, one after the other."""
    return F.sha2(F.concat(*(entry(f) for f in fields)), 256)


def tree_name(source: Column) -> Column:
    """A name without nulls that sorts as the source does: null first, then by bytes."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and ``levels`` levels above them; a run of one node has a parent of its own too."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(below), ARITY)])
    return out


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _steps(n: int) -> int:
    """Levels between a group and its top, where the whole tree has n nodes on the group's level."""
    return min(LEVELS, height(n))


@dataclass(frozen=True)
class Manifest:
    """A manifest in a folder: its stored levels of groups, of the sources' trees and of the top tree."""

    spark: SparkSession
    folder: str

    def groups(self, part: str, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{part}/level-{level}")

    def depth(self, part: str) -> int:
        """Stored levels of a part, told by the largest tree on its lowest level."""
        n = self.groups(part, 0).agg(F.max("n")).first()[0] or 0
        return max(1, -(-height(n) // LEVELS))

    def root(self) -> str | None:
        """The root of all; None for no rows."""
        found = self.groups(TOP, self.depth(TOP) - 1)
        rows = _climbed(found).limit(1).collect()
        return rows[0]["digest"] if rows else None


def _positions(nodes: DataFrame) -> DataFrame:
    """Add ``idx``, the place of a node in its tree by (key, digest), and ``n``, the nodes of the tree.

    Nodes are dealt to ranges of (tree, key), so that a tree of a third of all
    rows is many ranges; only the sizes of a tree's ranges go through a window
    of one tree. Equal nodes are dealt apart by their place in the input.
    """
    order = ["tree", "key", "digest", "tie"]
    ranged = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("tree", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    offsets = offsets.withColumn("n", F.sum("size").over(Window.partitionBy("tree"))).drop("size")
    inside = Window.partitionBy("tree", "part").orderBy(*order[1:])
    placed = ranged.withColumn("nth", F.row_number().over(inside) - 1).join(offsets, ["tree", "part"])
    return placed.withColumn("idx", F.col("start") + F.col("nth")).drop("tie", "part", "nth", "start")


def _grouped(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, grp, n, nodes): each aligned run of ``ARITY ** LEVELS`` nodes as one row, in order."""
    row = F.struct("idx", "digest", *carried)
    return nodes.groupBy("tree", F.floor(F.col("idx") / GROUP).alias("grp"), "n").agg(
        F.array_sort(F.collect_list(row)).alias("nodes")
    )


def _climbed(groups: DataFrame) -> DataFrame:
    """(tree, idx, digest, n): the node above each group, and how many of them the tree has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops = [
                climb(nodes, _steps(n))[-1][0]
                for nodes, n in zip(b.column("digests").to_pylist(), b.column("n").to_pylist(), strict=True)
            ]
            above = pa.array([-(-n // GROUP) for n in b.column("n").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("grp"), pa.array(tops, pa.string()), above], ["tree", "idx", "digest", "n"])

    slim = groups.select("tree", "grp", F.col("nodes.digest").alias("digests"), "n")
    return slim.mapInArrow(run, "tree string, idx long, digest string, n long")


def _store(nodes: DataFrame, folder: str, part: str, carried: list[str]) -> list[DataFrame]:
    """Write the levels of all trees, lowest first, as long as a tree has more than one node."""
    spark, stored, level = nodes.sparkSession, [], 0
    now = _grouped(_positions(nodes), carried)
    while True:
        path = f"{folder}/{part}/level-{level}"
        now.write.parquet(path)
        stored.append(spark.read.parquet(path))
        largest = stored[-1].agg(F.max("n")).first()[0] or 0
        if largest <= GROUP:
            return stored
        above = _climbed(stored[-1].where(F.col("n") > GROUP))
        now, level = _grouped(above, []), level + 1


def write(docs: DataFrame, folder: str, fields: tuple[str, ...] = FIELDS, by: str = "source", key: str = "doc_id", carried: dict[str, Column] | None = None) -> Manifest:
    """Write the manifest of a dataset to ``folder``, which must not exist, and return it.

    A leaf is the hash of a row's ``fields``. Rows of one ``by`` (null is one of
    its values, and first) form a tree, ordered by ``key`` (null first), then by
    leaf. ``carried`` are further columns kept with the leaves; columns that are
    not named are not read. Rows that are wholly equal are leaves side by side.
    Empty and null texts have different entries; a very long text is hashed in
    the task that reads it and not moved. No rows give a manifest without a root.
    Stored are every ``LEVELS``-th level, a 65th of the digests of all levels
    beyond the leaves.
    """
    carried = carried or {}
    rows = docs.select(
        tree_name(F.col(by)).alias("tree"), F.col(key).alias("key"),
        leaf([F.col(f) for f in fields]).alias("digest"), *(c.alias(name) for name, c in carried.items()),
    )
    stored = _store(rows, folder, "sources", ["key", *carried])
    heads = None
    for groups in stored:
        done = _climbed(groups.where(F.col("n") <= GROUP))
        heads = done if heads is None else heads.unionByName(done)
    tops = heads.select(F.lit(TOP).alias("tree"), F.col("tree").alias("key"), "digest")
    _store(tops, folder, TOP, ["key"])
    return Manifest(docs.sparkSession, folder)


_STEP = "struct<left: string, right: string>"
_ARROW_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def _beside(levels: list[list[str]], at: int, steps: int) -> list[dict[str, str]]:
    """The siblings of the node ``at`` on each of the lowest ``steps`` levels: what is left and right of it in its run."""
    out = []
    for nodes in levels[:steps]:
        first = at - at % ARITY
        out.append({"left": "".join(nodes[first:at]), "right": "".join(nodes[at + 1 : first + ARITY])})
        at //= ARITY
    return out


def fold(digest: str, path: list[dict[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for step in path:
        digest = hashlib.sha256(f"{step['left']}{digest}{step['right']}".encode()).hexdigest()
    return digest


def proof_digest(path: list[dict[str, str]]) -> str:
    """SHA-256 of all siblings, level by level, left to right."""
    return hashlib.sha256("".join(s["left"] + s["right"] for s in path).encode()).hexdigest()


def _with_paths(groups: DataFrame, above: DataFrame) -> DataFrame:
    """Groups with ``subroot`` and ``path`` of the node above each."""
    of = above.select(F.col("tree").alias("of_tree"), F.col("idx").alias("of_idx"), "subroot", "path")
    return groups.join(of, (F.col("tree") == F.col("of_tree")) & (F.col("grp") == F.col("of_idx"))).drop("of_tree", "of_idx")


def _descend(groups: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, idx, subroot, path) of each node of the groups, from those of the nodes ``above`` them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m, steps = len(r["digests"]), _steps(r["n"])
                levels = climb(r["digests"], steps)
                path = [_beside(levels, at, steps) + r["path"] for at in range(m)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["tree"]] * m, pa.string()), pa.array(range(r["grp"] * GROUP, r["grp"] * GROUP + m), pa.int64()),
                        pa.array([r["subroot"]] * m, pa.string()), pa.array(path, pa.list_(_ARROW_STEP)),
                    ],
                    ["tree", "idx", "subroot", "path"],
                )

    slim = groups.select("tree", "grp", "n", F.col("nodes.digest").alias("digests"))
    return _with_paths(slim, above).mapInArrow(run, f"tree string, idx long, subroot string, path array<{_STEP}>")


def _top_paths(manifest: Manifest) -> DataFrame:
    """(tree, idx, subroot, path): of the root of each source's tree, what leads from it to the root of all."""
    depth = manifest.depth(TOP)
    none = F.array().cast(f"array<{_STEP}>")
    paths = _climbed(manifest.groups(TOP, depth - 1)).select("tree", "idx", F.lit("").alias("subroot"), none.alias("path"))
    for level in reversed(range(depth)):
        paths = _descend(manifest.groups(TOP, level), paths)
    names = manifest.groups(TOP, 0).select(F.explode("nodes").alias("x")).select("x.*")
    return names.join(paths.select("idx", "path"), "idx").select(
        F.col("key").alias("tree"), F.lit(0).cast("long").alias("idx"), F.col("digest").alias("subroot"), "path"
    )


def prove(manifest: Manifest, carried: list[str] | None = None, claim: str | None = None, paths: bool = True) -> DataFrame:
    """One row per leaf: key, leaf, the ``carried`` columns, subroot, root, proof_sha256, folded_root, verified and,
    unless ``paths`` is false, path.

    ``path`` has the siblings of each level up to the root: what is left and
    what is right of the node in its run. ``folded_root`` is what ``claim`` (a
    carried column of digests; the leaf where that is null or not named) and
    the path lead to; ``verified`` tells whether that is the root.

    Stored levels are met from above. A task takes one group at a time with the
    path of the node above it, recomputes the inner levels of the subtree,
    emits the siblings of its nodes and forgets them. Groups meet the nodes
    above them by equality of (tree, place), so a tree of a third of all rows
    is dealt out like any other.
    """
    carried, root = carried or [], manifest.root()
    heads, above = _top_paths(manifest), None
    for level in reversed(range(manifest.depth("sources"))):
        groups = manifest.groups("sources", level)
        # a tree ends on the level on which one group has all of its nodes
        ending = heads.join(groups.where(F.col("n") <= GROUP).select("tree").distinct(), "tree").select(*heads.columns)
        above = ending if above is None else above.unionByName(ending)
        if level:
            above = _descend(groups, above)
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema["nodes"].dataType.elementType.fields}
    told = {"proof_sha256": "string", "folded_root": "string", "verified": "boolean"} | ({"path": f"array<{_STEP}>"} if paths else {})
    schema = {c: kinds[c] for c in ("key", *carried)} | {c: "string" for c in ("leaf", "subroot", "root")} | told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, rest = b.column("nodes"), b.column("path").to_pylist()
            for r, (n, subroot) in enumerate(zip(b.column("n").to_pylist(), b.column("subroot").to_pylist(), strict=True)):
                rows = pa.Table.from_struct_array(nodes[r].values)
                digests = rows["digest"].to_pylist()
                claims = rows[claim].to_pylist() if claim else digests
                m, steps = len(digests), _steps(n)
                levels = climb(digests, steps)
                found = [_beside(levels, at, steps) + rest[r] for at in range(m)]
                ends = [fold(c or d, p) for c, d, p in zip(claims, digests, found, strict=True)]
                columns = [
                    *(rows[c].combine_chunks() for c in ("key", *carried)),
                    pa.array(digests, pa.string()), pa.array([subroot] * m, pa.string()), pa.array([root] * m, pa.string()),
                    pa.array([proof_digest(p) for p in found], pa.string()), pa.array(ends, pa.string()),
                    pa.array([e == root for e in ends], pa.bool_()),
                ]
                if paths:
                    columns.append(pa.array(found, pa.list_(_ARROW_STEP)))
                yield pa.RecordBatch.from_arrays(columns, list(schema))

    lowest = _with_paths(groups.select("tree", "grp", "n", "nodes"), above)
    return lowest.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in schema.items()))


def tampered_leaf() -> Column:
    """The leaf of a row of documents whose text lost its newlines, where 2 divides the crc32 of the decimal doc_id; else null."""
    fields = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf(fields))


def tamper_check(docs: DataFrame) -> DataFrame:
    """Write the manifest of documents to a fresh folder below the shared one, and prove each with its text tampered with
    where :func:`tampered_leaf` says so."""
    folder = f"{shared_folder(docs.sparkSession)}/manifest-{uuid.uuid4().hex}"
    manifest = write(docs, folder, carried={"claim": tampered_leaf()})
    return prove(manifest, claim="claim", paths=False).withColumnRenamed("key", "doc_id")
