"""Order-dependent building blocks that hold when one key owns a large share of the rows.

``heavy_hashes``   which keys are too big for one task (an exact count, partial before its shuffle)
``heavy_keys``     the same as a table, and the number of rows
``dealt``          rows by key in tasks small enough to sort in memory
``time_cuts``      instants that cut heavy keys into slices of even size
``gap_chains``     consecutive rows of a key closer than a gap form a chain
``running_total``  cumulative weight in value order, without a one-task window
``ordered_fold``   a sequential fold per key in bounded memory, epoch by epoch for heavy keys
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from aircapture.operators import folds
from aircapture.operators.folds import Fold, arrow_folder
from aircapture.session import scratch_path

# workers need not have this package installed
cloudpickle.register_pickle_by_value(folds)

HOT_MIN_ROWS = 2_000_000
EPOCH_ROWS = 20_000_000
TASK_ROWS = 150_000


def heavy_hashes(df: DataFrame, keys: list[str], min_rows: int | None = None) -> list[int]:
    """Hashes of all keys with at least ``min_rows`` rows, biggest first.

    An exact count of the key hashes over the key columns only, summed in each
    task before its exchange by hash; the driver gets one number per heavy key,
    at most the rows over ``min_rows``.  The answer steers how rows are spread
    over tasks and never what the result is.
    """
    min_rows = HOT_MIN_ROWS if min_rows is None else min_rows
    counts = df.select(F.xxhash64(*keys).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    heavy = counts.where(F.col("n") >= min_rows).collect()
    return [r["h"] for r in sorted(heavy, key=lambda r: (-r["n"], r["h"]))]


def is_heavy(keys: list[str], hashes: list[int]) -> Column:
    return F.xxhash64(*keys).isin(hashes)


def heavy_keys(df: DataFrame, keys: list[str], min_rows: int | None = None) -> tuple[DataFrame | None, int]:
    """The heavy keys of ``heavy_hashes`` as a stored table (h, n), or None if there is none; and how many rows there are.

    For limits so low that very many keys count as heavy: the driver gets two numbers only.
    """
    min_rows, seen = HOT_MIN_ROWS if min_rows is None else min_rows, Observation()
    path = scratch_path(df.sparkSession, "heavy")
    counts = df.select(F.xxhash64(*keys).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    told = counts.observe(seen, F.sum("n").alias("rows"), F.count_if(F.col("n") >= min_rows).alias("heavy"))
    told.where(F.col("n") >= min_rows).write.parquet(path)
    if not seen.get["heavy"]:
        return None, seen.get["rows"] or 0
    return df.sparkSession.read.schema("h long, n long").parquet(path), seen.get["rows"]


def heavy_rows(df: DataFrame, keys: list[str], hot: list[int] | DataFrame) -> DataFrame:
    if isinstance(hot, list):
        return df.where(is_heavy(keys, hot))
    return df.join(hot.select(F.col("h").alias("_h")), F.xxhash64(*keys) == F.col("_h"), "left_semi")


def other_rows(df: DataFrame, keys: list[str], hot: list[int] | DataFrame) -> DataFrame:
    if isinstance(hot, list):
        return df.where(~is_heavy(keys, hot))
    return df.join(hot.select(F.col("h").alias("_h")), F.xxhash64(*keys) == F.col("_h"), "left_anti")


def dealt(df: DataFrame, rows: int | None, keys: list[str]) -> DataFrame:
    """Rows by key over so many tasks that one sorts about ``TASK_ROWS`` of ``rows`` without spilling.

    Adaptive execution sizes tasks by compressed bytes, and packets are several times larger in a sort.
    """
    tasks = -(-(rows or 0) // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def _cuts(df: DataFrame, keys: list[str], time: str, heavy: DataFrame, rows: int) -> DataFrame:
    """(h, cuts) of the keys in ``heavy`` (h, n) that need cuts; see ``time_cuts``."""
    parts = heavy.withColumn("parts", F.ceil(F.col("n") / rows).cast("int")).where("parts > 1")
    # keys of like size share a sketch, so that small keys do not get one as fine as the biggest needs
    size = F.ceil(F.log2("parts")).cast("int")
    most_of = {r["size"]: r["most"] for r in parts.groupBy(size.alias("size")).agg(F.max("parts").alias("most")).collect()}
    known = df.where(F.col(time).isNotNull()).select(F.xxhash64(*keys).alias("h"), F.unix_micros(F.col(time)).alias("us"))
    found = df.sparkSession.createDataFrame([], "h long, cuts array<long>")
    for of, most in sorted(most_of.items()):
        quantiles = [i / most for i in range(1, most)]
        sketch = known.join(parts.where(size == of).select("h", "parts"), "h").groupBy("h", "parts")
        sketch = sketch.agg(F.percentile_approx("us", quantiles, 4 * max(most, 500)).alias("q"))
        at = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: (i * most / F.col("parts")).cast("int"))
        cut = F.transform(at, lambda i: F.get("q", F.greatest(i - 1, F.lit(0))))
        whole = F.array_sort(F.array_distinct(F.transform(cut, lambda c: c - F.pmod(c, F.lit(1000)))))
        found = found.unionByName(sketch.select("h", whole.alias("cuts")))
    return found


def time_cuts(df: DataFrame, keys: list[str], time: str, hot: list[int], rows: int) -> dict[int, list[int]]:
    """For each heavy key (by hash) the instants that cut it into slices of about ``rows`` rows.

    From a quantile sketch per key, as fine as its size needs, so no slice grows
    with the input; the driver gets the slices' ends.  Instants are µs at whole
    milliseconds: rows of one millisecond stay together, so an order by
    milliseconds is kept.
    """
    heavy = df.where(is_heavy(keys, hot) & F.col(time).isNotNull())
    counts = heavy.groupBy(F.xxhash64(*keys).alias("h")).agg(F.count("*").alias("n"))
    return {r["h"]: r["cuts"] for r in _cuts(heavy, keys, time, counts, rows).collect()}


def cut_table(df: DataFrame, keys: list[str], time: str, hot: DataFrame, rows: int) -> DataFrame:
    """The cuts of ``time_cuts`` as a stored table (h, cuts) of all keys in ``hot``; none passes the driver."""
    path = scratch_path(df.sparkSession, "cuts")
    cuts = _cuts(df, keys, time, hot, rows)
    hot.join(cuts, "h", "left").select("h", F.coalesce("cuts", F.array().cast("array<long>")).alias("cuts")).write.parquet(path)
    return df.sparkSession.read.schema("h long, cuts array<long>").parquet(path)


def with_slice(df: DataFrame, keys: list[str], time: str, cuts: dict[int, list[int]] | DataFrame, name: str) -> DataFrame:
    """Add the number of the key's cuts at or before the row's instant (null for a null instant)."""
    known = F.col(time).isNotNull()
    if isinstance(cuts, DataFrame):
        table = cuts.select(F.col("h").alias("_h"), F.col("cuts").alias("_cuts"))
        most = table.agg(F.max(F.size("_cuts"))).first()[0] or 0
    else:
        # from Arrow, so that it is a local relation whose size the planner knows
        rows = pa.table({"_h": pa.array(list(cuts), pa.int64()), "_cuts": pa.array(list(cuts.values()), pa.list_(pa.int64()))})
        table = df.sparkSession.createDataFrame(rows) if cuts else None
        most = max(map(len, cuts.values()), default=0)
    if not most:
        return df.withColumn(name, F.when(known, F.lit(0)))
    # binary search: jump ahead by falling powers of two while the cut there is not later
    jumps = F.lit([1 << k for k in reversed(range(most.bit_length()))])
    us = F.unix_micros(F.col(time))
    found = F.aggregate(
        jumps,
        F.lit(0),
        lambda at, jump: F.when(F.get("_cuts", at + jump - 1) <= us, at + jump).otherwise(at),
    )
    return (
        df.withColumn("_h", F.xxhash64(*keys))
        .join(table, "_h", "left")
        .withColumn(name, F.when(known, found))
        .select(*df.columns, name)
    )


# ---------------------------------------------------------------- chains


def _same_as_previous(window, same: list[str]) -> Column:
    ok = F.lit(True)
    for name in same:
        ok = ok & F.lag(name).over(window).eqNullSafe(F.col(name))
    return ok


def _chains_by_window(df: DataFrame, keys: list[str], time: str, row_id: str, gap_us: int, same: list[str]):
    """Chains of each window partition; both windows share one shuffle and one sort."""
    order = Window.partitionBy(*keys).orderBy(time, row_id)
    before = F.lag(time).over(order)
    near = F.unix_micros(F.col(time)) - F.unix_micros(before) <= gap_us
    linked = before.isNotNull() & near & _same_as_previous(order, same)
    head = F.when(~F.col("_linked"), F.struct(F.col(row_id).alias("id"), F.col(time).alias("time")))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_linked", linked).withColumn("_chain", F.last(head, ignorenulls=True).over(so_far))


def gap_chains(
    df: DataFrame,
    keys: list[str],
    time: str,
    row_id: str,
    gap_us: int,
    same: list[str] | None = None,
    hot: DataFrame | None = None,
    slice_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add ``chain_id``, ``chain_time`` (row id and time of the chain's first row).

    Rows of one key are ordered by (time, row_id); a row continues its chain when
    the row just before it is at most ``gap_us`` older and agrees on ``same``.
    Keys in ``hot`` (a table of ``heavy_keys``) are cut into time slices of about ``slice_rows`` rows that are
    chained in parallel; a small table with one row per slice then joins the
    slices together, so no task sees more than one slice of a heavy key.  A row
    without a time is a chain of its own; those of heavy keys pass the windows by.
    ``rows``, if known, sets how many tasks there are.
    """
    same = same or []
    final = [*df.columns, "chain_id", "chain_time"]

    def finish(chained: DataFrame) -> DataFrame:
        return chained.withColumns({"chain_id": F.col("_chain.id"), "chain_time": F.col("_chain.time")}).select(*final)

    if hot is None:
        return finish(_chains_by_window(dealt(df, rows, keys), keys, time, row_id, gap_us, same))

    cold = _chains_by_window(dealt(other_rows(df, keys, hot), rows, keys), keys, time, row_id, gap_us, same)
    cuts = cut_table(df, keys, time, hot, HOT_MIN_ROWS if slice_rows is None else slice_rows)
    heavy = heavy_rows(df, keys, hot)
    untimed = heavy.where(F.col(time).isNull()).withColumns({"chain_id": F.col(row_id), "chain_time": F.col(time)})
    sliced = with_slice(heavy.where(F.col(time).isNotNull()), keys, time, cuts, "_slice")
    parts = _chains_by_window(dealt(sliced, rows, [*keys, "_slice"]), [*keys, "_slice"], time, row_id, gap_us, same)

    position = F.struct(time, row_id)
    edge = F.struct(F.col(row_id).alias("id"), F.col(time).alias("time"), *same)
    edges = parts.groupBy(*keys, "_slice").agg(
        F.min_by(edge, position).alias("first"),
        F.max_by(edge, position).alias("last"),
        F.max_by("_chain", position).alias("tail"),
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    previous = F.col("_previous")
    linked = (
        previous.isNotNull()
        & previous["time"].isNotNull()
        & (F.unix_micros(F.col("first.time")) - F.unix_micros(previous["time"]) <= gap_us)
    )
    for name in same:
        linked = linked & previous[name].eqNullSafe(F.col("first")[name])
    # a slice's last chain is known on its own unless it is the one that entered from before
    own = F.when(~F.col("_enters") | (F.col("tail.id") != F.col("first.id")), F.col("tail"))
    joints = (
        edges.withColumn("_previous", F.lag("last").over(by_slice))
        .withColumn("_enters", F.coalesce(linked, F.lit(False)))
        .withColumn(
            "_entry",
            F.last(own, ignorenulls=True).over(by_slice.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .where("_enters")
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"),
                F.col("first.id").alias("_first"), "_entry")
    )
    on = parts["_slice"].eqNullSafe(joints["_s"])
    for i, k in enumerate(keys):
        on = on & parts[k].eqNullSafe(joints[f"_k{i}"])
    hot_rows = parts.join(joints, on, "left").withColumn(
        "_chain",
        F.when(F.col("_entry").isNotNull() & (F.col("_chain.id") == F.col("_first")), F.col("_entry")).otherwise(
            F.col("_chain")
        ),
    )
    return finish(cold).unionByName(finish(hot_rows)).unionByName(untimed.select(*final))


# ---------------------------------------------------------------- cumulative weights


def running_total(
    df: DataFrame, value: str, weight: Column | None = None, by: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Rows ``(by, value, weight, cumulative, total)``, one per distinct value, in value order.

    A prefix scan. Values are summed first and dealt to ranges of (facet,
    value), as many as the shuffle has partitions unless ``partitions`` says
    otherwise. Only the sum of each range goes through a window of one facet;
    values run inside their range. The ranges are stored, with their number in
    each row, so that both steps, and a task done again, see the same ones.
    """
    by, spark = by or [], df.sparkSession
    weight = F.lit(1) if weight is None else weight
    keep = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for name in by:
        keep = keep & F.col(name).isNotNull()
    sums = df.where(keep).groupBy(*by, value).agg(F.sum(weight).alias("weight"))
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sums.repartitionByRange(ranges, *by, value).withColumn("_range", F.spark_partition_id())
    path = scratch_path(spark, "ranges")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    in_order = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, "_range")
        .agg(F.sum("weight").alias("_w"))
        .withColumn("_before", F.sum("_w").over(in_order))
        .withColumn("total", F.sum("_w").over(Window.partitionBy(*by)))
        .drop("_w")
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_inside", F.sum("weight").over(inside))
        .join(offsets, [*by, "_range"])
        .withColumn("cumulative", F.col("_inside") + F.coalesce("_before", F.lit(0)))
        .select(*by, value, "weight", "cumulative", "total")
    )


def sliced_row_number(df: DataFrame, keys: list[str], time: str, tie: str, slice_us: int = 86_400_000_000) -> DataFrame:
    """Add ``rn``, the 1-based position of a row in its key, numbering time slices in parallel."""
    cut = df.withColumn("_slice", F.floor(F.unix_micros(F.col(time)) / F.lit(slice_us)).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(time, tie)
    return (
        cut.join(starts, [*keys, "_slice"])
        .withColumn("rn", F.row_number().over(inside) + F.col("_start"))
        .drop("_slice", "_start")
    )


# ---------------------------------------------------------------- sequential folds

def ordered_fold(
    df: DataFrame,
    key: str,
    order: list[str],
    inputs: list[str],
    added: T.StructType,
    fold: Fold,
    time: str,
    hot: list[int] | DataFrame | None = None,
    epoch_rows: int | None = None,
    states: DataFrame | None = None,
    keep_states: bool = False,
    n_rows: int | None = None,
) -> DataFrame:
    """Append the columns ``added`` computed by a sequential fold over each key's rows.

    ``fold(state, arrays)`` gets the rows of one key in ``order`` piece by piece,
    as numpy arrays of the columns ``inputs``, with the state it returned for the
    piece before (``None`` at first).  All other columns pass through as Arrow
    data.  ``key`` must be a string without nulls.

    Keys in ``hot`` are folded one epoch of time after another, an epoch holding
    about ``epoch_rows`` rows of a key; each key has its own epochs.  Their rows are written to the shared
    folder once, split by epoch; each epoch is a job whose result, with the closing state of every key, is a table that the next epoch
    reads.  No task sorts or holds more than an epoch of a key and a lost executor
    repeats at most its part of one epoch.  ``time`` must not be null.

    ``states`` (``key``, ``_state``) are closing states of an earlier fold, to go
    on from. With ``keep_states`` the result has a column ``_state`` and one more
    row per key, of the rows or of ``states``: the key and its closing state,
    where ``_state`` is null in all other rows. ``n_rows``, if known, sets how many
    tasks there are.
    """
    columns, names = df.columns, [f.name for f in added.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*df.schema.fields, *added.fields]])
    carry_schema = T.StructType([*schema.fields, T.StructField("_state", T.BinaryType())])
    arrow_added = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in added.fields])

    def fold_all(rows: DataFrame, carry: bool) -> DataFrame:
        first = [F.col("_state").isNull()] if carry else []
        tasks = [t] if (t := -(-(n_rows or 0) // TASK_ROWS)) > df.sparkSession.sparkContext.defaultParallelism else []
        ordered = rows.repartition(*tasks, key).sortWithinPartitions(key, *first, *order)
        worker = arrow_folder(columns, key, inputs, arrow_added, fold, carry)
        return ordered.mapInArrow(worker, carry_schema if carry else schema)

    carried = keep_states or states is not None

    def begin(rows: DataFrame, earlier: DataFrame | None) -> DataFrame:
        rows = rows.withColumn("_state", F.lit(None).cast("binary"))
        return rows if earlier is None else rows.unionByName(earlier, allowMissingColumns=True)

    def done_with(told: DataFrame) -> DataFrame:
        return told if keep_states else told.where("_state is null").drop("_state")

    if hot is None or hot == []:
        return done_with(fold_all(begin(df, states), True)) if carried else fold_all(df, False)

    spark, root = df.sparkSession, scratch_path(df.sparkSession, "fold")
    cuts = (time_cuts if isinstance(hot, list) else cut_table)(df, [key], time, hot, EPOCH_ROWS if epoch_rows is None else epoch_rows)
    (
        with_slice(heavy_rows(df, [key], hot), [key], time, cuts, "_epoch")
        .repartitionByRange("_epoch", time)
        .write.partitionBy("_epoch")
        .parquet(f"{root}/input")
    )
    written = T.StructType([*schema.fields[: len(columns)], T.StructField("_epoch", T.IntegerType())])
    heavy = spark.read.schema(written).parquet(f"{root}/input")
    epochs = sorted(r["_epoch"] for r in heavy.select("_epoch").distinct().collect())
    cold_states, paths = None, []
    if states is not None:
        cold_states, states = other_rows(states, [key], hot), heavy_rows(states, [key], hot)
    for e in epochs:
        rows = begin(heavy.where(F.col("_epoch") == e).drop("_epoch"), states)
        paths.append(f"{root}/epoch-{e}")
        fold_all(rows, True).write.parquet(paths[-1])
        states = spark.read.schema(carry_schema).parquet(paths[-1]).where("_state is not null").select(key, "_state")
    cold = other_rows(df, [key], hot)
    result = done_with(fold_all(begin(cold, cold_states), True)) if carried else fold_all(cold, False)
    if not paths:
        return result
    done = spark.read.schema(carry_schema).parquet(*paths).where("_state is null")
    if not keep_states:
        return result.unionByName(done.drop("_state"))
    # each epoch passes all states on, so the last one has those of all heavy keys
    return result.unionByName(done).unionByName(begin(df.limit(0), states).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added.fields}))
