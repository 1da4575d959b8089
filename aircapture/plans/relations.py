"""Relations the registered queries share, all derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aircapture.operators.decode import decode_incremental
from aircapture.operators.duplicates import flag_duplicates
from aircapture.operators.flows import infer_flow_packets, summarise_flows
from aircapture.session import scratch_path, use_utc
from aircapture.sources.events import read_packets

LORA = "txInfo.modulation.lora"


_STORED: dict[tuple[str, str, str], str] = {}
Build = Callable[[SparkSession, str], DataFrame]


class Stored:
    """A relation written once per application to the shared folder and read from there afterwards.

    Analyses read what the preprocessing has written, as in a real deployment:
    a scan with column pruning and pushed filters, not the whole chain again.
    """

    def __init__(self, name: str, build: Build):
        self.name, self.build = name, build

    def path(self, spark: SparkSession, sf_dir: str) -> str:
        key = (spark.sparkContext.applicationId, self.name, sf_dir.rstrip("/"))
        if key not in _STORED:
            path = scratch_path(use_utc(spark), self.name)
            self.build(spark, sf_dir).write.option("compression", "zstd").parquet(path)
            _STORED[key] = path
        return _STORED[key]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return use_utc(spark).read.parquet(self.path(spark, sf_dir))

    def stream(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The stored files as a stream."""
        path = self.path(spark, sf_dir)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _flagged_and_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    # decoding is a projection, so it comes after the shuffle of the flags
    return decode_incremental(flag_duplicates(packets(spark, sf_dir)))


#: common-schema packets
packets = Stored("packets", read_packets)
#: packets with duplicate flags and, for LORA, decoded frames
enriched = Stored("enriched", _flagged_and_decoded)
#: packets of the inferred flows
flow_packets = Stored("flow_packets", lambda spark, sf_dir: infer_flow_packets(enriched(spark, sf_dir)))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise_flows(flow_packets(spark, sf_dir))


def gateway_rx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw reception log shape of the same packets."""
    return as_gateway_rx(packets(spark, sf_dir))


def as_gateway_rx(df: DataFrame) -> DataFrame:
    """Common packets in the shape of the raw reception log."""
    rx, tx = F.col("rxInfo"), F.col("txInfo")
    return df.select(
        "_id",
        "phyPayload",
        F.struct(
            rx["gatewayId"].alias("mac"),
            rx["time"].alias("time"),
            F.unix_micros(rx["time"]).alias("timestamp"),
            rx["rssi"].alias("rssi"),
            rx["snr"].alias("loRaSNR"),
            rx["crcStatus"].alias("crcStatus"),
            rx["channel"].alias("channel"),
            F.lit(None).cast("int").alias("rfChain"),
            F.lit(0).alias("antenna"),
            F.lit(0).alias("board"),
            F.lit(None).cast("int").alias("size"),
            tx["frequency"].alias("frequency"),
            tx["modulation"]["lora"]["codeRate"].alias("codeRate"),
            F.struct(
                tx["modulation"]["lora"]["bandwidth"].alias("bandwidth"),
                tx["modulation"]["lora"]["spreadingFactor"].alias("spreadFactor"),
                tx["modulation"]["type"].alias("modulation"),
            ).alias("dataRate"),
        ).alias("rxInfo"),
    )


def as_v3(df: DataFrame) -> DataFrame:
    """Common packets in the third-generation shape."""
    rx, lora = F.col("rxInfo"), F.col(LORA)
    return df.select(
        "_id",
        F.col("time").alias("mqtt_time"),
        "phyPayload",
        F.struct(
            rx["gatewayId"].alias("gatewayID"),
            rx["time"].alias("time"),
            rx["rssi"].alias("rssi"),
            rx["snr"].alias("loRaSNR"),
            rx["channel"].alias("channel"),
            rx["crcStatus"].alias("crcStatus"),
            F.concat(F.lit("up-"), F.col("_id")).alias("uplinkID"),
        ).alias("rxInfo"),
        F.struct(
            F.col("txInfo.frequency").alias("frequency"),
            F.col("txInfo.modulation.type").alias("modulation"),
            F.struct(
                lora["bandwidth"].alias("bandwidth"),
                lora["spreadingFactor"].alias("spreadingFactor"),
                F.translate(F.substring(lora["codeRate"], 3, 3), "_", "/").alias("codeRate"),
            ).alias("loRaModulationInfo"),
        ).alias("txInfo"),
    )


def as_v4(df: DataFrame) -> DataFrame:
    """Common packets in the fourth-generation shape, receptions as a list."""
    return df.select("_id", "time", "phyPayload", F.array("rxInfo").alias("rxInfo"), "txInfo")


def as_v4_lists(df: DataFrame) -> DataFrame:
    """Common packets in the fourth-generation shape, all receptions of an event (``_id`` is event-copy) in one list.

    Frame and time are those of the first copy.
    """
    event, copy = F.substring_index("_id", "-", 1), F.substring_index("_id", "-", -1).cast("int")
    listed = F.sort_array(F.collect_list(F.struct(copy.alias("copy"), "time", "phyPayload", "rxInfo", "txInfo")))
    rows = df.groupBy(event.alias("_id")).agg(listed.alias("all"))
    first = F.col("all")[0]
    return rows.select(
        "_id", first["time"].alias("time"), first["phyPayload"].alias("phyPayload"), F.col("all.rxInfo").alias("rxInfo"),
        first["txInfo"].alias("txInfo"),
    )


def _reshaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet's frame with its message type replaced by one of all eight and cut to one of 40 lengths.

    The data has three message types and few broken frames; this covers the rest.
    """
    code = F.conv(F.substring(F.md5(F.col("_id").cast("binary")), 1, 7), 16, 10).cast("int")
    h = F.hex(F.unbase64("phyPayload"))
    header = F.lpad(F.hex((code % 8) * 32 + code % 4), 2, "0")
    size = F.when(code % 3 == 0, F.lit(1 << 10)).otherwise(F.floor(code / 8) % 40)
    cut = F.substr(F.concat(header, F.substr(h, F.lit(3))), F.lit(1), (size * 2).cast("int"))
    return packets(spark, sf_dir).select("_id", F.base64(F.unhex(cut)).alias("phyPayload"))


#: frames of all message types and lengths
reshaped_frames = Stored("reshaped", _reshaped)
