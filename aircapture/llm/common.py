"""Words, checkpoints and connected components shared by the corpus operators."""

from __future__ import annotations

import gc
import sys
import tempfile
import time
import types

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: White space between words: the space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
SEPARATOR = "[ \\t-\\r]+"


def words(text: Column) -> Column:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]`` of a text; no words for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, SEPARATOR)).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master one of its own where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def release(spark: SparkSession, wait: float = 0) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs that nothing refers to any more.

    It does so when the driver collects its garbage, which a long chain of
    checkpoints may not reach before the files fill the disks. What Python has
    just given up is told to the JVM by a thread that looks once a second:
    ``wait`` are the seconds to give it.
    """
    gc.collect()
    time.sleep(wait)
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so that lost executors cost no more than the work since then.

    What earlier steps have left on the disks is given up first.
    """
    context = df.sparkSession.sparkContext
    release(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that undirected edges (u, v) connect each node to.

    Alternates the two star contractions until the edges stay the same. A round
    is aggregations and equality joins, so a node with very many edges is
    pre-aggregated and its join partition can be split. Nodes without an edge
    are not returned; self-loops and repeated edges are allowed.
    """
    e = cut(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


# ---- words of one text as 64-bit numbers (numpy, inside tasks) ----

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(text: bytes) -> np.ndarray:
    """xxh3 of each word; ``bytes.split`` cuts at exactly the white space of :data:`SPACES`."""
    found = text.split()
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def rolling(numbers: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit number for each run of k consecutive word numbers."""
    n = len(numbers) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _MULT + numbers[i : i + n]
        out = out ^ (out >> np.uint64(29))
    return mix(out)


def kept_in_worker(name: str, path: str, make):
    """The object that ``make(path)`` gave this Python worker process first for this path; it outlives the task.

    One object a name is kept: that of the last path.
    """
    store = sys.modules.setdefault("corpus_worker_store", types.ModuleType("corpus_worker_store"))
    kept = getattr(store, name, None)
    if kept is None or kept[0] != path:
        kept = (path, make(path))
        setattr(store, name, kept)
    return kept[1]
