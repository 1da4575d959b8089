"""Joins of packets and flows with small or equal-keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The text for an address outside all ranges, and two names too long for reports.
UNKNOWN_OPERATOR = "UNKOWN"
SHORT_NAMES = {
    "Shenzhen Tencent Computer Systems Company Limited": "Shenzhen Tencent",
    "NTT (Nippon Telephone and Telegraph)": "NTT",
}
_BLOCK_BITS = 25


def with_operator(df: DataFrame, operators: DataFrame, dev_addr: str = "devAddr") -> DataFrame:
    """Add ``operator``: the name whose address range holds the device address.

    Ranges are spread over blocks of 2^25 addresses, so the range join has an
    equality to hash on; whether the table is broadcast is left to its size.
    Where ranges overlap, the last row of the table wins: they are made
    disjoint first, so a packet never matches twice. That is done in one
    partition, without exchanges: the table has a row per prefix of a network,
    a few thousand at most, in the order of its one file.
    """
    address = F.conv(F.col(dev_addr), 16, 10).cast("long")
    ranges = _disjoint(operators.coalesce(1)).select(F.col("name").alias("operator"), "lo", "hi", "_block")
    keyed = df.withColumn("_addr", address).withColumn("_in", F.shiftright("_addr", _BLOCK_BITS))
    inside = (F.col("_in") == F.col("_block")) & F.col("_addr").between(F.col("lo"), F.col("hi"))
    return (
        keyed.join(ranges, inside, "left")
        .withColumn("operator", F.coalesce("operator", F.lit(UNKNOWN_OPERATOR)))
        .drop("_addr", "_in", "_block", "lo", "hi")
    )


def _disjoint(operators: DataFrame) -> DataFrame:
    """(name, lo, hi, _block): per block, the stretches between range ends, with the last range that covers each."""
    size = 1 << _BLOCK_BITS
    blocks = F.explode(F.sequence(F.shiftright("lo", _BLOCK_BITS), F.shiftright("hi", _BLOCK_BITS)))
    numbered = operators.select("name", "lo", "hi", F.monotonically_increasing_id().alias("_row"), blocks.alias("_block"))
    clipped = numbered.select(
        "name", "_row", "_block",
        F.greatest("lo", F.col("_block") * size).alias("_lo"),
        F.least("hi", F.col("_block") * size + size - 1).alias("_hi"),
    )
    ends = clipped.select("_block", F.explode(F.array("_lo", F.col("_hi") + 1)).alias("lo")).distinct()
    order = Window.partitionBy("_block").orderBy("lo")
    stretches = ends.withColumn("hi", F.lead("lo").over(order) - 1).where("hi is not null")
    covering = stretches.join(clipped, "_block").where(F.col("lo").between(F.col("_lo"), F.col("_hi")))
    return covering.groupBy("_block", "lo", "hi").agg(F.max_by("name", "_row").alias("name"))


def shorten_names(df: DataFrame, column: str = "operator") -> DataFrame:
    return df.replace(SHORT_NAMES, subset=[column])


def duplicate_to_original(df: DataFrame) -> DataFrame:
    """Pairs of a duplicate and the packet it copies: ids and times of both."""
    copies = df.where("dup_infos.is_duplicate").select(
        F.col("_id").alias("duplicate_id"), F.col("time").alias("duplicate_time"), F.col("dup_infos.copy_of").alias("_id")
    )
    originals = df.where("not dup_infos.is_duplicate").select("_id", F.col("time").alias("original_time"))
    return originals.join(copies, "_id").withColumnRenamed("_id", "original_id")
