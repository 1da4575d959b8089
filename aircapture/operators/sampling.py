"""Repeatable samples, pages and row lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aircapture.functions import predicates
from aircapture.functions.text import sample_key

_DIRECT = 100


def hash_sample(df: DataFrame, n: int, row_id: str = "_id") -> DataFrame:
    """``n`` rows picked by a hash of payload and time: the same ones at every run.

    Beyond a handful a histogram of the first four hex digits (65 536 cells)
    tells which hashes can be among the first ``n``, so that only about ``n``
    rows, not ``n`` per task, go to the final sort.
    """
    keyed = df.withColumn("_key", sample_key(F.col("phyPayload"), F.unix_micros("time")))
    if n > _DIRECT:
        cell = F.substring("_key", 1, 4)
        so_far = Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = keyed.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n"))
        enough = cells.withColumn("_sum", F.sum("_n").over(so_far)).where(F.col("_sum") >= n)
        last = enough.agg(F.coalesce(F.min("_cell"), F.lit("ffff")).alias("c")).scalar()
        keyed = keyed.where(cell <= last)
    return keyed.orderBy("_key", row_id).limit(n).drop("_key")


def random_flows(flows: DataFrame, n: int) -> DataFrame:
    """``n`` different flows, picked by hash."""
    key = sample_key(F.col("devAddr"), F.unix_micros("time_1st"), F.col("flow_id"))
    return flows.orderBy(key, "devAddr", "flow_id").limit(n)


def page(df: DataFrame, keys: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The next ``size`` rows in key order after the key tuple ``after``.

    ``keys`` should end with a unique column, so no row is lost between pages.
    """
    if after is not None:
        ahead = F.lit(False)
        equal = F.lit(True)
        for name, last in zip(keys, after):
            value = F.lit(last).cast(df.schema[name].dataType)
            ahead = ahead | (equal & (F.col(name) > value))
            equal = equal & (F.col(name) == value)
        df = df.where(ahead)
    return df.orderBy(*keys).limit(size)


def _at_most(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def lookup_id(df: DataFrame, row_id: str, limit: int | None = None) -> DataFrame:
    return _at_most(df.where(F.col("_id") == row_id), limit)


def lookup_payload(df: DataFrame, payload: str, limit: int | None = None) -> DataFrame:
    return _at_most(df.where(F.col("phyPayload") == payload).orderBy("time", "_id"), limit)


def first_unflagged_payload(df: DataFrame) -> DataFrame:
    """The smallest payload that has no duplicate flag yet."""
    return df.where(F.col("dup_infos.version").isNull()).select("phyPayload").orderBy("phyPayload").limit(1)


def undecoded(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Packets without decoded fields, earliest first."""
    return _at_most(df.where(~predicates.decoded()).orderBy("time", "_id"), limit)


def device_packets(df: DataFrame, dev_addr: str) -> DataFrame:
    """Original packets of a device in (time, _id) order: address, payload, time and frame counter.

    Decoded addresses are lower case, so the plain column is compared and the
    scan can skip by it.
    """
    fhdr = "extra_infos.phyPayload.macPayload.fhdr"
    return (
        df.where(predicates.decoded() & predicates.original() & (F.col(f"{fhdr}.devAddr") == dev_addr.lower()))
        .orderBy("time", "_id")
        .select(F.col(f"{fhdr}.devAddr").alias("devAddr"), "phyPayload", "time", F.col(f"{fhdr}.fCnt").alias("fCnt"))
    )


# Fields of the link-quality sample and their report names.
LINK_FIELDS = {
    "rxInfo.rssi": "rssi",
    "rxInfo.snr": "loRaSNR",
    "rxInfo.crcStatus": "crcStatus",
    "rxInfo.channel": "channel",
    "txInfo.modulation.lora.spreadingFactor": "spreadingFactor",
}


def flatten_fields(df: DataFrame, fields: dict[str, str] = LINK_FIELDS) -> DataFrame:
    """``_id``, ``time`` and the nested fields under flat names; one-element lists become their element."""
    flat = df.select("_id", "time", *[F.col(path).alias(name) for path, name in fields.items()])
    for field in flat.schema.fields:
        if field.dataType.typeName() == "array":
            flat = flat.withColumn(field.name, F.explode_outer(field.name))
    return flat


def link_quality_sample(df: DataFrame, n: int = 40_000) -> DataFrame:
    """Sample of data packets with complete link indicators."""
    return flatten_fields(hash_sample(df.where(predicates.data_with_channel()), n))


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["rssi", "loRaSNR", "channel", "spreadingFactor"])
