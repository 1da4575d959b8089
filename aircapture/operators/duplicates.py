"""Duplicate receptions: flags on every packet, and messages collapsed over gateways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aircapture.functions import predicates
from aircapture.functions.frame import DUP_VERSION
from aircapture.operators.folds import anchor_fold
from aircapture.operators.skew import gap_chains, heavy_keys, ordered_fold
from aircapture.session import scratch_path

# Receptions up to an hour apart are copies; a message gathers receptions for 300 ms.
GAP_MINUTES = 60
WINDOW_MS = 300

_LORA = "txInfo.modulation.lora"
_RADIO = {
    "_sf": f"{_LORA}.spreadingFactor",
    "_bw": f"{_LORA}.bandwidth",
    "_cr": f"{_LORA}.codeRate",
    "_freq": "txInfo.frequency",
}


def flag_duplicates(
    df: DataFrame,
    gap_minutes: float = GAP_MINUTES,
    version: str = DUP_VERSION,
    strict_keys: bool = False,
    hot_min_rows: int | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Set ``dup_infos`` of every row.

    In (time, _id) order per payload a row is a duplicate when the row just
    before it has the same radio parameters and is at most ``gap_minutes`` older;
    ``copy_of`` is the first row of its chain; a row without payload is its own
    original.  With ``strict_keys`` frames of
    other radio parameters in between do not break a chain.  One shuffle.
    """
    flat = _flat(df)
    keys = ["phyPayload", "_solo", *_RADIO] if strict_keys else ["phyPayload", "_solo"]
    same = [] if strict_keys else list(_RADIO)
    hot, rows = heavy_keys(flat, keys, hot_min_rows)
    chained = gap_chains(flat, keys, "time", "_id", int(gap_minutes * 60_000_000), same, hot, slice_rows, rows)
    return chained.withColumn("dup_infos", _dup_infos(version)).drop(*_RADIO, "_solo", "chain_id", "chain_time")


def _flat(df: DataFrame) -> DataFrame:
    """Radio parameters as columns, and ``_solo``, which keeps rows without a payload apart from each other."""
    return df.withColumns(
        {**{name: F.col(path) for name, path in _RADIO.items()}, "_solo": F.when(F.col("phyPayload").isNull(), F.col("_id"))}
    )


def _dup_infos(version: str):
    return F.struct(
        F.lit(version).alias("version"),
        (F.col("chain_id") != F.col("_id")).alias("is_duplicate"),
        F.col("chain_id").alias("copy_of"),
    )


def payload_inventory(df: DataFrame, version: str = DUP_VERSION, start: str | None = None) -> DataFrame:
    """Payloads with unflagged rows: how many, and the earliest time."""
    return (
        df.where(predicates.needs_dup_flag(version, start) & F.col("phyPayload").isNotNull())
        .groupBy("phyPayload")
        .agg(F.count("*").alias("doc_count"), F.min("time").alias("time"))
    )


def candidate_window(
    df: DataFrame, version: str = DUP_VERSION, gap_minutes: float = GAP_MINUTES, start: str | None = None
) -> DataFrame:
    """Rows whose flag may change.

    Of payloads with unflagged rows, those from ``gap_minutes`` before the
    first of them; and unflagged rows without a payload or without a time,
    which are their own originals.
    """
    todo = payload_inventory(df, version, start).select("phyPayload", F.col("time").alias("_first"))
    back = F.col("_first") - F.expr(f"INTERVAL {int(gap_minutes * 60)} SECONDS")
    unflagged = predicates.needs_dup_flag(version, start)
    timed = df.join(todo, "phyPayload").where(F.col("time") >= back).select(*df.columns)
    alone = df.where(unflagged & (F.col("phyPayload").isNull() | F.col("time").isNull()))
    return timed.unionByName(alone)


def payload_batch(df: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows whose payload occurs in ``batch``."""
    return df.join(batch.select("phyPayload").distinct(), "phyPayload", "left_semi").select(*df.columns)


def flag_incremental(
    df: DataFrame,
    version: str = DUP_VERSION,
    gap_minutes: float = GAP_MINUTES,
    hot_min_rows: int | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """New ``dup_infos`` for the rows of ``candidate_window`` only; the same as flagging all rows anew.

    The first row of a payload in the window lies before every change, and so
    does the row before it: if it was a duplicate, it still is, of the original
    recorded for it. All later rows are chained anew.  Put the result back with
    ``upsert``. The window is written to the shared folder first, since three
    steps read it.
    """
    path = scratch_path(df.sparkSession, "window")
    window = candidate_window(df, version, gap_minutes)
    window.write.parquet(path)
    window = df.sparkSession.read.schema(window.schema).parquet(path)
    known = (F.col("dup_infos.version") == version) & F.col("dup_infos.is_duplicate")
    first = window.where("time is not null").groupBy("phyPayload").agg(
        F.min_by(
            F.struct("_id", F.when(known, F.col("dup_infos.copy_of")).alias("copy_of")), F.struct("time", "_id")
        ).alias("_first")
    )
    window = window.join(first, "phyPayload", "left").withColumn(
        "_earlier", F.when(F.col("_first._id") == F.col("_id"), F.col("_first.copy_of"))
    )
    flat = _flat(window.drop("_first")).withColumn("_label", F.struct(F.col("_id"), F.col("_earlier")))
    keys = ["phyPayload", "_solo"]
    hot, rows = heavy_keys(flat, keys, hot_min_rows)
    chained = gap_chains(flat, keys, "time", "_label", int(gap_minutes * 60_000_000), list(_RADIO), hot, slice_rows, rows)
    head = F.coalesce(F.col("chain_id._earlier"), F.col("chain_id._id"))
    return chained.withColumn(
        "dup_infos",
        F.struct(
            F.lit(version).alias("version"), (head != F.col("_id")).alias("is_duplicate"), head.alias("copy_of")
        ),
    ).select(*df.columns)


def dups_per_original(df: DataFrame) -> DataFrame:
    """Copies received of each original packet."""
    return (
        df.where(predicates.flagged())
        .groupBy(F.col("dup_infos.copy_of").alias("copy_of"))
        .agg(F.sum(F.col("dup_infos.is_duplicate").cast("long")).alias("nb_duplicates"))
    )


# ---------------------------------------------------------------- messages

_MESSAGE_KEYS = {
    "_freq": "rxInfo.frequency",
    "_bw": "rxInfo.dataRate.bandwidth",
    "_sf": "rxInfo.dataRate.spreadFactor",
    "_cr": "rxInfo.codeRate",
}


def assign_messages(
    df: DataFrame,
    window_ms: float = WINDOW_MS,
    hot_min_rows: int | None = None,
    slice_rows: int | None = None,
    epoch_rows: int | None = None,
) -> DataFrame:
    """Add ``message_id``: the first reception of the message a reception belongs to.

    Receptions of one payload and one set of radio parameters form a message with
    the first of them, up to ``window_ms`` after that first one.  A message never
    crosses a silence longer than the window, so receptions are first cut into
    chains at such silences; the first message of a chain needs nothing more, and
    only receptions later than that are folded in order.
    """
    window_us = int(window_ms * 1000)
    flat = df.withColumns({name: F.col(path) for name, path in _MESSAGE_KEYS.items()}).withColumn(
        "_at", F.col("rxInfo.time")
    )
    keys = ["phyPayload", *_MESSAGE_KEYS]
    hot, rows = heavy_keys(flat, keys, hot_min_rows)
    chained = gap_chains(flat, keys, "_at", "_id", window_us, [], hot, slice_rows, rows).withColumn(
        "_us", F.unix_micros("_at")
    )
    late = F.col("_us") - F.unix_micros("chain_time") > window_us
    first = chained.where(~F.coalesce(late, F.lit(False))).withColumn("message_id", F.col("chain_id"))
    rest = chained.where(late)
    hot_chains = None if hot is None else heavy_keys(rest, ["chain_id"], hot_min_rows)[0]
    folded = ordered_fold(
        rest,
        "chain_id",
        ["_at", "_id"],
        ["_us", "_id"],
        T.StructType([T.StructField("message_id", T.StringType())]),
        anchor_fold(window_us),
        "_at",
        hot_chains,
        epoch_rows,
    )
    return first.unionByName(folded).drop(*_MESSAGE_KEYS, "_at", "_us", "chain_id", "chain_time")


def _reception() -> list[Column]:
    rx = F.col("rxInfo")
    names = ("channel", "rfChain", "loRaSNR", "timestamp", "mac", "rssi", "crcStatus")
    return [rx["time"].alias("time"), F.col("_id"), *[rx[name].alias(name) for name in names]]


def collapse_receptions(df: DataFrame, **options) -> DataFrame:
    """One row per message: the header of its first reception, and all receptions as the array ``rxInfo``, earliest first.

    A message spans one window, so its receptions are those of the gateways
    within it. ``message_receptions`` has the same as a table of rows.
    """
    rx = F.col("rxInfo")
    header = F.struct(
        "phyPayload", *[rx[name].alias(name) for name in ("antenna", "dataRate", "frequency", "board", "size", "codeRate")]
    )
    return (
        assign_messages(df, **options)
        .groupBy(F.col("message_id").alias("_id"))
        .agg(
            F.min_by(header, F.struct(rx["time"], F.col("_id"))).alias("_message"),
            F.array_sort(F.collect_list(F.struct(*_reception()))).alias("rxInfo"),
        )
        .select("_id", "_message.*", "rxInfo")
    )


def message_receptions(df: DataFrame, **options) -> DataFrame:
    """One row per reception: its message, its 1-based position in it, and its fields."""
    order = Window.partitionBy("message_id").orderBy("time", "_id")
    rows = assign_messages(df, **options).select("message_id", *_reception())
    return rows.withColumn("position", F.row_number().over(order))


def reception_stats(messages: DataFrame) -> DataFrame:
    """Messages and receptions, from rows with a ``message_id``."""
    return messages.agg(
        F.count_if(F.col("message_id") == F.col("_id")).alias("messages"), F.count("*").alias("receptions")
    )
