"""Flow inference: packets sharing a device address are split into the flows of single devices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aircapture import schema
from aircapture.functions import predicates
from aircapture.operators.folds import flow_fold
from aircapture.operators.skew import dealt, heavy_hashes, heavy_keys, ordered_fold

# Limits of the counter step and of the silence inside one flow.
MAX_FCNT_STEP = 10_000
MAX_SILENCE_MS = 604_800_000

_ADDED = T.StructType(
    [
        T.StructField("flow_id", T.LongType()),
        T.StructField("_since_us", T.LongType()),
        T.StructField("interpkt_time_ms", T.DoubleType()),
        T.StructField("fCnt_diff", T.LongType()),
    ]
)


def device_list(df: DataFrame) -> DataFrame:
    """Devices with data packets and their number of packets, in address order."""
    return (
        df.where(predicates.data() & F.col(predicates.DEVADDR).isNotNull())
        .groupBy(F.col(predicates.DEVADDR).alias("devAddr"))
        .agg(F.count("*").alias("doc_count"))
        .orderBy("devAddr")
    )


def pending_devices(devices: DataFrame, flows: DataFrame) -> DataFrame:
    """Devices that have no flow in the summary yet."""
    return devices.join(flows.select("devAddr").distinct(), "devAddr", "left_anti")


def heavy_devices(df: DataFrame, min_rows: int | None = None) -> list[int]:
    """Hashes of busy device addresses, from decoded packets that need no duplicate flags yet."""
    return heavy_hashes(df.select(F.col(predicates.DEVADDR).alias("devAddr")), ["devAddr"], min_rows)


def flow_input(df: DataFrame) -> DataFrame:
    """Columns of flagged data packets that flow inference needs."""
    return df.where(predicates.data_for_device()).select(
        F.col(predicates.DEVADDR).alias("devAddr"),
        F.col("extra_infos.phyPayload.macPayload.fhdr.fCnt").cast("long").alias("fCnt"),
        F.col(predicates.SF).alias("SF"),
        "time",
        "phyPayload",
        "_id",
        F.col("dup_infos.is_duplicate").alias("is_duplicate"),
        F.col("dup_infos.copy_of").alias("copy_of"),
    )


def assign_flows(
    packets: DataFrame,
    max_fcnt: int = MAX_FCNT_STEP,
    max_gap_ms: int = MAX_SILENCE_MS,
    hot_min_rows: int | None = None,
    epoch_rows: int | None = None,
    hot: list[int] | DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Split the non-duplicate packets of ``flow_input`` into flows.

    Per device, in time order (milliseconds, then ``_id``), a packet joins the
    oldest flow whose counter it continues by less than ``max_fcnt``, whose pace
    it keeps within a factor of two, and which was silent for less than
    ``max_gap_ms``; otherwise it opens a flow.  Which flow fits depends on all
    earlier choices, so this is a fold, one key per device, in bounded memory;
    devices with at least ``hot_min_rows`` packets are folded epoch by epoch.
    Packets without a time are in no flow; ``untimed_packets`` returns them.
    Pass ``hot`` (see ``heavy_devices``) where the packets come from a long plan,
    and ``rows``, how many they are about, so that tasks are small enough.
    """
    originals = _originals(packets)
    if hot is None:
        hot, rows = heavy_keys(originals, ["devAddr"], hot_min_rows)
    return _told(
        ordered_fold(
            originals, "devAddr", ["_ms", "_id"], ["_us", "fCnt"], _ADDED, flow_fold(max_fcnt, max_gap_ms),
            "time", hot, epoch_rows, n_rows=rows,
        )
    )


def _originals(packets: DataFrame) -> DataFrame:
    """The packets that make flows, with the instants they are ordered by."""
    return packets.where(~F.col("is_duplicate") & F.col("time").isNotNull()).select(
        "devAddr", "fCnt", "SF", "time", "phyPayload", "_id", F.unix_micros("time").alias("_us")
    ).withColumn("_ms", F.unix_millis("time"))


def _told(folded: DataFrame) -> DataFrame:
    return folded.withColumn("time_1st", F.timestamp_micros("_since_us")).select(
        "devAddr", "flow_id", "time_1st", "interpkt_time_ms", "fCnt_diff", "fCnt", "SF", "time", "phyPayload", "_id"
    )


def untimed_packets(packets: DataFrame) -> DataFrame:
    """Original packets that no flow can take because they have no time."""
    return packets.where(~F.col("is_duplicate") & F.col("time").isNull())


def attach_duplicates(flow_packets: DataFrame, packets: DataFrame, rows: int | None = None) -> DataFrame:
    """Add ``nb_duplicates``: the flagged copies of each packet, counted before the join; ``rows`` as in ``assign_flows``."""
    copies = packets.where("is_duplicate").groupBy(F.col("copy_of").alias("_id")).agg(F.count("*").alias("_n"))
    return (
        dealt(flow_packets, rows, ["_id"]).join(dealt(copies, rows, ["_id"]), "_id", "left")
        .withColumn("nb_duplicates", F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def unmatched_duplicates(flow_packets: DataFrame, packets: DataFrame) -> DataFrame:
    """Flagged copies whose original is in no flow."""
    originals = flow_packets.select(F.col("_id").alias("copy_of"))
    return packets.where("is_duplicate").join(originals, "copy_of", "left_anti")


def infer_flow_packets(df: DataFrame, **options) -> DataFrame:
    """Flagged, decoded packets to flow packets (all columns of ``schema.FLOW_PACKET``)."""
    packets = flow_input(df)
    if options.get("hot") is None:
        hot, rows = heavy_keys(_originals(packets), ["devAddr"], options.get("hot_min_rows"))
        options |= {"hot": [] if hot is None else hot, "rows": rows}
    told = attach_duplicates(assign_flows(packets, **options), packets, options.get("rows"))
    return told.select(*schema.FLOW_PACKET_COLUMNS)


def summarise_flows(flow_packets: DataFrame) -> DataFrame:
    """One row per flow.

    The 16-bit counter grows at every packet of a flow, so a flow has at most
    65 536 rows and exact medians fit in a task.
    """
    at = F.struct(F.unix_millis("time"), F.col("fCnt"))
    return (
        flow_packets.groupBy("devAddr", "flow_id")
        .agg(
            F.min_by("fCnt", at).alias("fCnt_1st"),
            F.max_by("fCnt", at).alias("fCnt_last"),
            F.min_by("time", at).alias("time_1st"),
            F.max_by("time", at).alias("time_last"),
            F.avg("fCnt_diff").alias("mean_fCnt_diff"),
            F.median("fCnt_diff").alias("median_fCnt_diff"),
            F.max("fCnt_diff").alias("max_fCnt_diff"),
            F.sum("nb_duplicates").alias("nb_duplicates"),
            F.median("interpkt_time_ms").alias("median_interpkt_time_ms"),
            F.max("interpkt_time_ms").alias("max_interpkt_time_ms"),
            F.min("interpkt_time_ms").alias("min_interpkt_time_ms"),
            F.count("*").alias("nb_pkts"),
        )
        .select(*schema.FLOW_COLUMNS)
    )


def flow_lookup(flow_packets: DataFrame, dev_addr: str, time_1st=None) -> DataFrame:
    """Packets of all flows of a device, or of the one that began at ``time_1st``."""
    found = flow_packets.where(F.col("devAddr") == dev_addr)
    if time_1st is not None:
        found = found.where(F.col("time_1st") == F.lit(time_1st).cast("timestamp"))
    return found.orderBy("flow_id", "time")


def flow_series(flows: DataFrame, flow_packets: DataFrame) -> DataFrame:
    """Packets of the given flows."""
    return flow_packets.join(flows.select("devAddr", "flow_id"), ["devAddr", "flow_id"])
