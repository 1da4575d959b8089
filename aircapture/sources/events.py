"""Packet relation derived from an ``events`` table (see FIXTURES.md).

One event becomes one radio frame received ``1 + k % 3`` (or one more) times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aircapture.operators.skew import sliced_row_number


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def _little_endian(text: Column, n: int) -> Column:
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(n))])


def _digest(tag: str, event_id: Column, digits: Column | int) -> Column:
    text = F.md5(F.concat(F.lit(tag), event_id.cast("string")).cast("binary"))
    return F.upper(F.substr(text, F.lit(1), F.lit(digits) if isinstance(digits, int) else digits))


def packets_from_events(events: DataFrame) -> DataFrame:
    """Common-schema packets; the time of an event is read as UTC."""
    ev = events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    ev = sliced_row_number(ev, ["user_id"], "ts", "event_id")
    user, k, rn, eid = F.col("user_id"), F.col("k"), F.col("rn"), F.col("event_id")
    pair = F.floor(user / 2)
    flag = lambda n: (k % n == 0).cast("int")
    ev = ev.select(
        "event_id",
        "ts",
        "user_id",
        "k",
        F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "error", 4).otherwise(2).alias("mt"),
        ((pair * 28554695) % 4294967296).alias("dev"),
        ((user % 2 * 20000 + pair * 13 + rn + F.floor(rn / 7) * 2) % 65536).alias("fcnt"),
        (flag(2) * 128 + flag(5) * 32 + flag(10) * 16 + k % 3).alias("fctrl"),
        (k % 3 + flag(25)).alias("last_copy"),
    )
    mt = F.col("mt")
    bad = F.concat(_hex(mt * 32, 2), _digest("b", eid, 14))
    join = F.concat(F.lit("00"), F.upper(F.substring(F.concat(_digest("j", eid, 32), _digest("J", eid, 32)), 1, 44)))
    data = F.concat(
        _hex(mt * 32, 2),
        _little_endian(_hex(F.col("dev"), 8), 4),
        _hex(F.col("fctrl"), 2),
        _little_endian(_hex(F.col("fcnt"), 4), 2),
        F.repeat(F.lit("0A"), k % 3),
        _hex(k % 4 + 1, 2),
        _digest("p", eid, (k % 8 + 4) * 2),
        _digest("m", eid, 8),
    )
    frame = F.when(k == 99, bad).when(mt == 0, join).otherwise(data)
    j = F.col("j")
    shift_ms = F.when(j > k % 3, 7_200_000).otherwise(j * 120).cast("long")
    time = F.timestamp_micros(F.unix_micros("ts") + shift_ms * 1000)
    return (
        ev.withColumn("phyPayload", F.base64(F.unhex(frame)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("last_copy"))))
        .withColumn("time", time)
        .select(
            F.concat_ws("-", eid, j).alias("_id"),
            "time",
            "phyPayload",
            F.lit(4).alias("src_version"),
            F.struct(
                F.concat(F.lit("gw"), ((user + j) % 5).cast("string")).alias("gatewayId"),
                F.col("time").alias("time"),
                (-40 - k % 60 - j * 5).cast("int").alias("rssi"),
                (k % 20 - 10 - j).cast("double").alias("snr"),
                (k % 8).cast("int").alias("channel"),
                F.when(k == 97, "BAD_CRC").otherwise("CRC_OK").alias("crcStatus"),
            ).alias("rxInfo"),
            F.struct(
                (868100000 + k.cast("long") % 3 * 200000).alias("frequency"),
                F.struct(
                    F.when(k == 98, "FSK").otherwise("LORA").alias("type"),
                    F.struct(
                        F.lit(125000).cast("long").alias("bandwidth"),
                        (user % 6 + 7).cast("int").alias("spreadingFactor"),
                        F.lit("C_4_5").alias("codeRate"),
                    ).alias("lora"),
                ).alias("modulation"),
            ).alias("txInfo"),
        )
    )


def read_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
