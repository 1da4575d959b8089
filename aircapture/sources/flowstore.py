"""Parquet tables of flows and of their packets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aircapture import schema
from aircapture.operators.skew import TASK_ROWS


def write_flows(flows: DataFrame, path: str, mode: str = "overwrite") -> None:
    flows.select(*schema.FLOW_COLUMNS).write.mode(mode).parquet(path)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """The flow summary, or an empty one when there is none yet."""
    try:
        return spark.read.schema(schema.FLOW).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema.FLOW)


def address_block(dev_addr: Column) -> Column:
    """Upper seven bits of a device address: 128 blocks."""
    return F.shiftright(F.conv(dev_addr, 16, 10).cast("long"), 25).cast("int")


def write_flow_packets(flow_packets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One table for all flows, in address blocks, sorted by device within each file.

    The range exchange splits a busy block or device over several files, and
    tasks are small enough to sort in memory; so packets are counted first,
    which reads no more than the footers where they are stored.
    """
    tasks = -(-flow_packets.count() // TASK_ROWS)
    number = [tasks] if tasks > flow_packets.sparkSession.sparkContext.defaultParallelism else []
    (
        flow_packets.select(*schema.FLOW_PACKET_COLUMNS)
        .withColumn("addr_block", address_block(F.col("devAddr")))
        .repartitionByRange(*number, "addr_block", "devAddr", "time")
        .sortWithinPartitions("addr_block", "devAddr", "flow_id", "time")
        .write.mode(mode)
        .partitionBy("addr_block")
        .parquet(path)
    )


def read_flow_packets(spark: SparkSession, path: str, dev_addr: str | None = None, time_1st=None) -> DataFrame:
    """Packets of all flows, of one device, or of the flow of a device that began at ``time_1st``."""
    rows = spark.read.schema(f"{schema.FLOW_PACKET}, addr_block int").parquet(path)
    if dev_addr is not None:
        # the block as a number, so that only its folder is listed and read
        rows = rows.where((F.col("addr_block") == (int(dev_addr, 16) >> 25)) & (F.col("devAddr") == dev_addr))
    if time_1st is not None:
        rows = rows.where(F.col("time_1st") == F.lit(time_1st).cast("timestamp"))
    return rows.drop("addr_block")
