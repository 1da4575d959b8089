"""Mixing sources to token targets by entropy balancing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aircapture.llm.common import cut, n_words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size and target from one row (source, n, source_size) per source.

    Sources in code point order, null last, take the weights in turn and share
    the sum of all sizes. A target stops at ``max_copies`` times its source's
    size and the excess goes to the others by weight. With sources sorted by
    size over weight, those that stop come first, so the level of the others
    follows from running sums. Windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    t = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * float(max_copies))
    ranked = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    # the first source that stays below its limit sets the level of all after it
    free = F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))
    t = t.withColumn("final", F.first(free, ignorenulls=True).over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
    return t.select(
        "source", "source_size", F.coalesce(F.col("final") * F.col("w"), F.col("most")).cast("double").alias("target")
    )


def tilts(cells: DataFrame, targets: DataFrame, rounds: int = 60, near: float = 1e-9) -> DataFrame:
    """targets with ``tilt``: lambda of the rate min(max_copies, exp(lambda * size / mean size)).

    Maximises the concave dual of: least relative entropy to one copy each,
    subject to each source's token sum and to rates of at most ``MAX_COPIES``.
    The Hessian is diagonal (a document adds tokens to its own source only), so
    each source takes a Newton step of its own, kept inside the interval that
    holds its root. A round is one grouped sum over the cells (source, size, n).
    A source whose target is all its copies gets an infinite tilt, an empty one none.
    """
    t = targets.withColumns(
        {
            "tilt": F.lit(0.0),
            "lo": F.lit(float("-inf")),
            "hi": F.lit(float("inf")),
            "open": (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * (MAX_COPIES - 1e-9)),
        }
    )
    t = cut(t)
    for _ in range(rounds):
        if t.where("open").limit(1).count() == 0:
            break
        z = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.col("tilt") * z, F.lit(50.0))))
        tokens = F.col("n") * F.col("size")
        sums = (
            cells.join(t.where("open").select(F.col("source").alias("s"), "tilt"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(
                F.sum(tokens * rate).alias("got"),
                F.sum(F.when(rate < MAX_COPIES, tokens * rate * z).otherwise(0.0)).alias("slope"),
            )
            .withColumnRenamed("source", "s")
        )
        t = t.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.col("target") - F.col("got")
        t = t.withColumns(
            {
                "lo": F.when(F.col("open") & (gap >= 0), F.col("tilt")).otherwise(F.col("lo")),
                "hi": F.when(F.col("open") & (gap <= 0), F.col("tilt")).otherwise(F.col("hi")),
                "open": F.col("open") & (F.abs(gap) > near * F.col("source_size")),
                "step": F.col("tilt") + F.try_divide(gap, F.col("slope")),
                "gap": gap,
            }
        )
        # outside the bracket, or without a slope: the bracket's middle, or one further out
        middle = (
            F.when(F.col("lo") == float("-inf"), F.col("hi") * 2 - 1)
            .when(F.col("hi") == float("inf"), F.col("lo") * 2 + 1)
            .otherwise((F.col("lo") + F.col("hi")) / 2)
        )
        step = F.col("step")
        inside = (step > F.col("lo")) & (step < F.col("hi")) & (F.abs(step - F.col("tilt")) < 4)
        moved = F.when(inside, step).otherwise(middle)
        t = cut(
            t.withColumn("tilt", F.when(F.col("open"), moved).otherwise(F.col("tilt")))
            .drop("step", "gap", "got", "slope")
            .coalesce(1)
        )
    return t.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") == 0, 0.0)
        .when(F.col("target") >= F.col("source_size") * (MAX_COPIES - 1e-9), float("inf"))
        .otherwise(F.col("tilt"))
        .alias("tilt"),
    )


def _rate() -> Column:
    """Copies of a document of a cell, before rounding."""
    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))
    return F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(MAX_COPIES)), tilted))


def _rounded(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """cells with ``base`` copies for each document and ``extra`` documents that get one more.

    Goes through the sizes of a source from the largest down and carries the
    fraction of a copy on, so the rounding error stays below the largest size;
    three single changes of the best fitting size then close most of what is left.
    """
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    c = cells.withColumn("rate", _rate()).withColumn("base", F.floor("rate"))
    c = c.withColumn("upto", F.round(F.sum(F.col("n") * (F.col("rate") - F.col("base"))).over(down), 6))
    c = c.withColumn(
        "extra",
        F.floor(F.col("upto") + 0.5) - F.floor(F.coalesce(F.lag("upto").over(down), F.lit(0.0)) + 0.5),
    )
    c = c.withColumn("extra", F.least(F.greatest("extra", F.lit(0)), "n"))
    for _ in range(3):
        whole = Window.partitionBy("source")
        c = c.withColumn(
            "rest",
            F.col("target") - F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra"))).over(whole),
        )
        can = (
            F.when((F.col("rest") > 0) & (F.col("extra") < F.col("n")) & (F.col("base") < MAX_COPIES), 1)
            .when((F.col("rest") < 0) & (F.col("extra") > 0), -1)
            .otherwise(0)
        )
        left = F.when((can != 0) & (F.col("size") > 0), F.abs(F.abs("rest") - F.col("size")))
        c = c.withColumn("can", can).withColumn("left", left)
        best = F.min(F.struct(F.coalesce("left", F.lit(float("inf"))), "size")).over(whole)
        c = c.withColumn("best", best)
        hit = (F.col("left") < F.abs("rest")) & (F.col("best.size") == F.col("size"))
        c = c.withColumn("extra", F.col("extra") + F.when(hit, F.col("can")).otherwise(0))
    return c.select("source", "size", "n", "target", "source_size", "base", "extra")


#: Documents of one source and size that one task ranks at a time.
RANKED = 50_000


def mix(docs: DataFrame, weights=WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (and ``source``, ``text_hash``), one row per input row.

    A null text has size 0; null is a source of its own; extra columns are not
    read. Copies of rows that agree in doc_id, source and text are
    interchangeable. An empty table gives an empty result. Reruns agree.
    """
    rows = cut(
        docs.select(
            "doc_id", "source", F.coalesce(n_words(F.col("text")), F.lit(0)).alias("size"), F.xxhash64("text").alias("text_hash")
        )
    )
    cells = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("source").agg(
        F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size")
    )
    targets = cut(source_targets(sizes, weights).join(sizes.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s").coalesce(1))
    named = targets.select(F.col("source").alias("s"), "target", "source_size", (F.col("source_size") / F.col("docs")).alias("mean"))
    same = F.col("source").eqNullSafe(F.col("s"))
    cells = cut(cells.join(named, same).drop("s"))
    tilted = tilts(cells.select("source", "size", "n", "mean"), targets.drop("docs"))
    plan = _rounded(cells.join(tilted.select(F.col("source").alias("s"), "tilt"), same).drop("s"), targets)
    plan = cut(plan)

    # which documents of a cell: by rank of a hash, in parts that one task can rank
    p = plan.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "target", "source_size", "base", "extra")
    rows = rows.join(p, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.ceil(F.col("n") / RANKED)))
    parts = rows.groupBy("source", "size", "part").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("extra").alias("extra"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("part"))
    share = lambda k: F.floor(F.col("extra") * k / F.col("n"))
    parts = parts.withColumn("upto", upto).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("q"),
        (share(F.col("upto")) - share(F.col("upto") - F.col("m"))).alias("more"),
    )
    order = Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "text_hash")
    ranked = rows.withColumn("rank", F.row_number().over(order)).join(
        parts,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("q")),
    )
    copies = (F.col("base") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)).cast("long")
    return ranked.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
        "source",
        "text_hash",
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as given."""
    hashed = docs.withColumn("_h", F.xxhash64("text"))
    nth = lambda h: F.row_number().over(Window.partitionBy("doc_id").orderBy("source", h))
    left = hashed.withColumn("_nth", nth("_h")).drop("_h")
    right = mix(docs, weights).select(
        F.col("doc_id").alias("_id"), nth("text_hash").alias("_k"), F.col("copies").alias("_copies")
    )
    both = left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_nth") == F.col("_k")))
    repeated = both.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))
