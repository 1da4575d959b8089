"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from aircapture.functions import predicates
from aircapture.functions.frame import EXTRA_VERSION
from aircapture.operators.decode import decode_incremental
from aircapture.operators.aggregates import ZONE
from aircapture.operators.duplicates import GAP_MINUTES, WINDOW_MS, _RADIO
from aircapture.streaming import collapse, keyed
from aircapture.streaming.collapse import MESSAGE_COLUMNS, MESSAGE_SCHEMA, STATE_SCHEMA, message_updater

# workers need not have this package installed
cloudpickle.register_pickle_by_value(collapse)
cloudpickle.register_pickle_by_value(keyed)

# Fixed value: the class of the state store on disk.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def stream_decode(packets: DataFrame, version: str = EXTRA_VERSION) -> DataFrame:
    """A stream of packets with its LORA frames decoded; stateless, so a restart goes on at the checkpoint."""
    return decode_incremental(packets, version)


def stream_collapse(
    receptions: DataFrame, window_ms: float = 300, delay: str = "10 seconds", buckets: int | None = None
) -> DataFrame:
    """Receptions with the ``message_id`` they belong to.

    Input: ``_id, phyPayload, time, frequency, bandwidth, spreadFactor, codeRate``.
    A reception waits in state until the watermark has passed it, so late ones
    within ``delay`` are still put in order; later ones are dropped.

    Most message keys occur once, so state is kept per hash bucket of keys, not
    per key: the receptions of the last ``delay`` and the messages still open.
    ``buckets`` is four times the shuffle partitions unless given; it must stay
    the same over restarts of a stream.
    """
    if buckets is None:
        buckets = 4 * int(receptions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = ["phyPayload", *MESSAGE_COLUMNS]
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in parts])
    return (
        receptions.withWatermark("time", delay)
        .select(key.alias("key"), "time", "_id", F.pmod(F.xxhash64(*parts), F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .applyInPandasWithState(
            message_updater(int(window_ms * 1000)),
            MESSAGE_SCHEMA,
            STATE_SCHEMA,
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def _as_text(*names: str) -> Column:
    """Columns as one text, exact and null-safe, that ``_from_text`` reads back."""
    return F.to_json(F.struct(*(F.col(n).cast("string").alias(n) for n in names)), {"ignoreNullFields": "true"})


def _from_text(texts: Column, fields: dict[str, str]) -> Column:
    """Each of an array of texts as a struct."""
    # parsed in an inner step, so that a text is parsed once and not once a field
    read = F.transform(texts, lambda t: F.from_json(t, ", ".join(f"{n} string" for n in fields)))
    return F.transform(read, lambda r: F.struct(*(r[n].cast(t).alias(n) for n, t in fields.items())))


def _by_bucket(rows: DataFrame, updater: Callable, schema: str, buckets: int | None) -> DataFrame:
    """A stream of ``key, time, us, _id, said`` through an updater of ``keyed``, whose state is kept per bucket of keys."""
    if buckets is None:
        buckets = 16 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(updater, schema, keyed.STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def stream_messages(
    receptions: DataFrame, window_ms: float = WINDOW_MS, delay: str = "10 seconds", buckets: int | None = None
) -> DataFrame:
    """The stream twin of ``collapse_receptions``: one row per message, with header and array of receptions.

    Input as for the batch: ``_id, phyPayload, rxInfo``. State holds the
    receptions of a message until the watermark is a window past the first of
    them. A message goes out once, complete; receptions that come later than
    ``delay`` after it are dropped. One without a time is a message of its own
    at once. State is kept per hash bucket of message keys, of which there are
    16 times the shuffle partitions unless ``buckets`` is given; it must stay
    the same over restarts of a stream.
    """
    rx = F.col("rxInfo")
    flat = {
        "us": F.unix_micros(rx["time"]), "frequency": rx["frequency"], "bandwidth": rx["dataRate"]["bandwidth"],
        "spreadFactor": rx["dataRate"]["spreadFactor"], "codeRate": rx["codeRate"], "modulation": rx["dataRate"]["modulation"],
        **{n: rx[n] for n in ("channel", "rfChain", "loRaSNR", "timestamp", "mac", "rssi", "crcStatus", "antenna", "board", "size")},
    }
    fields = {**keyed.KEY, **keyed.HEADER, **keyed.RECEPTION}
    rows = receptions.select(rx["time"].alias("time"), *(flat.get(n, F.col(n)).cast(t).alias(n) for n, t in fields.items()))
    timed = rows.where("time is not null").withWatermark("time", delay)
    timed = timed.select(_as_text(*keyed.KEY).alias("key"), "time", "us", "_id", _as_text(*keyed.RECEPTION, *keyed.HEADER).alias("said"))
    told = _by_bucket(timed, keyed.message_updater(int(window_ms * 1000)), keyed.MESSAGE, buckets).select(
        F.get(_from_text(F.array("key"), keyed.KEY), F.lit(0)).alias("key"),
        F.get(_from_text(F.slice("receptions", 1, 1), keyed.HEADER), F.lit(0)).alias("head"),
        _from_text(F.col("receptions"), keyed.RECEPTION).alias("rx"),
    ).select("key.*", "head.*", "rx")
    alone = rows.where("time is null").withColumn("rx", F.array(F.struct(*keyed.RECEPTION)))
    both = told.unionByName(alone.select(*told.columns))
    names = ("_id", "channel", "rfChain", "loRaSNR", "timestamp", "mac", "rssi", "crcStatus")
    list_of = F.transform("rx", lambda r: F.struct(F.timestamp_micros(r["us"]).alias("time"), *(r[n].alias(n) for n in names)))
    rate = F.struct("bandwidth", "spreadFactor", "modulation").alias("dataRate")
    return both.select(
        F.col("rx")[0]["_id"].alias("_id"), "phyPayload", "antenna", rate, "frequency", "board", "size", "codeRate",
        list_of.alias("rxInfo"),
    )


def stream_flags(
    packets: DataFrame,
    gap_minutes: float = GAP_MINUTES,
    strict_keys: bool = False,
    delay: str = "10 seconds",
    buckets: int | None = None,
) -> DataFrame:
    """The stream twin of ``flag_duplicates``: ``_id, time, is_duplicate, copy_of`` of each packet.

    A packet goes out once the watermark has passed it. State of a payload (with
    ``strict_keys``, of a payload and its radio parameters): the packets that
    wait, and the last one that went out with the head of its chain, which is
    forgotten after a gap. Packets without a payload or a time are originals at
    once; those later than ``delay`` are dropped. State is kept per hash bucket
    of keys as in ``stream_messages``, with ``buckets`` as there.
    """
    radio = dict(zip(keyed.RADIO, _RADIO.values(), strict=True))
    rows = packets.select(
        "_id", "time", F.unix_micros("time").alias("us"), "phyPayload",
        *(F.col(path).cast(keyed.RADIO[n]).alias(n) for n, path in radio.items()),
    )
    ordered = F.col("phyPayload").isNotNull() & F.col("time").isNotNull()
    keys = ["phyPayload", *radio] if strict_keys else ["phyPayload"]
    timed = rows.where(ordered).withWatermark("time", delay)
    timed = timed.select(_as_text(*keys).alias("key"), "time", "us", "_id", _as_text(*radio).alias("said"))
    told = _by_bucket(timed, keyed.flag_updater(int(gap_minutes * 60_000_000)), keyed.FLAG, buckets)
    alone = rows.where(~ordered).select("_id", "us", F.lit(False).alias("is_duplicate"), F.col("_id").alias("copy_of"))
    return told.unionByName(alone).select("_id", F.timestamp_micros("us").alias("time"), "is_duplicate", "copy_of")


def stream_chains(packets: DataFrame, gap_minutes: float = GAP_MINUTES, delay: str = "10 seconds") -> DataFrame:
    """One row per chain of copies under strict keys: its original, how many copies, first and last time.

    A session window per payload and radio parameters, so nothing but sums is
    kept of a chain, however long; final once the watermark is a gap past it.
    Packets without a payload or a time are not counted.
    """
    radio = [F.col(path).alias(name) for name, path in _RADIO.items()]
    rows = packets.where("phyPayload is not null and time is not null").select("_id", "time", "phyPayload", *radio)
    gap = f"{int(gap_minutes * 60_000_000)} microseconds"
    return (
        rows.withWatermark("time", delay)
        .groupBy(F.session_window("time", gap), "phyPayload", *_RADIO)
        .agg(
            F.min_by("_id", F.struct("time", "_id")).alias("copy_of"), (F.count("*") - 1).alias("nb_duplicates"),
            F.min("time").alias("first_time"), F.max("time").alias("last_time"),
        )
        .select("copy_of", "nb_duplicates", "first_time", "last_time")
    )


def stream_hourly(packets: DataFrame, key: str, name: str, delay: str = "1 hour") -> DataFrame:
    """Counts of good original packets per hour and key, final once the watermark has passed the hour."""
    return (
        packets.where(predicates.all_ok_nodup() & F.col(key).isNotNull())
        .select(F.col(key).alias(name), F.col("rxInfo.time").alias("rx_time"))
        .withWatermark("rx_time", delay)
        .groupBy(F.window("rx_time", "1 hour"), name)
        .agg(F.count("*").alias("count"))
        .select(F.col("window.start").alias("hour_start"), name, "count")
    )


def stream_weekly(packets: DataFrame, key: str, name: str, zone: str = ZONE, delay: str = "2 hours") -> DataFrame:
    """The stream twin of ``weekly_by_sf``: counts of good original packets per calendar week of a zone and key.

    Weeks are windows of seven days over the zone's wall clock, from Monday on,
    so a week with a change to or from summer time has its 167 or 169 hours.
    In autumn the wall clock goes back by an hour, so ``delay`` must be longer.
    A week is final once the watermark has passed its end.
    """
    local = F.from_utc_timestamp(F.col("rxInfo.time"), zone)
    # the epoch was a Thursday
    week = F.window("local", "7 days", "7 days", "4 days")
    return (
        packets.where(predicates.all_ok_nodup() & F.col(key).isNotNull())
        .select(F.col(key).alias(name), local.alias("local"))
        .withWatermark("local", delay)
        .groupBy(week, name)
        .agg(F.count("*").alias("count"))
        .select(F.to_utc_timestamp("window.start", zone).alias("week"), name, "count")
    )


@contextmanager
def state_on_disk(spark):
    """Streams started inside keep their state in RocksDB, that of ``stream_messages`` and ``stream_flags`` out of memory."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there now into a parquet table, restartable at the checkpoint."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
