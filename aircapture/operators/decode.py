"""Frame enrichment: ``phyPayload`` to ``extra_infos``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aircapture.functions import frame, predicates


def _decoded(df: DataFrame, wanted: Column, version: str, payload: str, exact_hash: bool) -> DataFrame:
    """Add ``_extra``, whose fields are null where ``wanted`` is false."""
    worked = frame.with_header(df.withColumn("_hex", F.when(wanted, frame.payload_hex(F.col(payload)))), "_hex")
    fields = F.struct(
        F.when(wanted, F.lit(version)).alias("version"),
        F.when(F.col("_n") > 0, frame.content_hash(F.col(payload), exact_hash)).alias("random"),
        frame.phy_payload(F.col("_hex")).alias("phyPayload"),
    )
    return worked.withColumn("_extra", fields).drop("_hex", *frame.HEADER_COLUMNS)


def decode_frames(
    df: DataFrame, version: str = frame.EXTRA_VERSION, payload: str = "phyPayload", exact_hash: bool = False
) -> DataFrame:
    """Set ``extra_infos`` of every row. Without a payload its fields are null (see ``bad_frames``)."""
    decoded = _decoded(df.drop("extra_infos"), F.col(payload).isNotNull(), version, payload, exact_hash)
    return decoded.withColumnRenamed("_extra", "extra_infos")


def decode_incremental(
    df: DataFrame, version: str = frame.EXTRA_VERSION, payload: str = "phyPayload", exact_hash: bool = False
) -> DataFrame:
    """Decode only the LORA rows whose ``extra_infos`` is missing or of another version.

    A projection: rows already decoded pass through, so a restart costs one scan
    and no join.
    """
    present = F.col(payload).isNotNull()
    if "extra_infos" not in df.columns:
        decoded = _decoded(df, predicates.is_lora() & present, version, payload, exact_hash)
        return decoded.withColumnRenamed("_extra", "extra_infos")
    marked = df.withColumn("_todo", F.coalesce(predicates.needs_decode(version) & present, F.lit(False)))
    decoded = _decoded(marked, F.col("_todo"), version, payload, exact_hash)
    renewed = F.when(F.col("_todo"), F.col("_extra")).otherwise(F.col("extra_infos"))
    return decoded.withColumn("extra_infos", renewed).drop("_extra", "_todo")


def bad_frames(df: DataFrame, payload: str = "phyPayload") -> DataFrame:
    """Audit table of frames that cannot be decoded: payload, reason, count."""
    text = F.col(payload)
    return (
        df.select(text.alias("phyPayload"), frame.payload_hex(text).alias("_hex"))
        .withColumn("reason", frame.bad_reason(F.col("_hex"), F.col("phyPayload")))
        .where("reason is not null")
        .groupBy("phyPayload", "reason")
        .agg(F.count("*").alias("count"))
    )
