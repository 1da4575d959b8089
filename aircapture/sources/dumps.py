"""JSON dumps: one ``{"_id": ..., "_source": {...}}`` document per line, gzip or plain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aircapture import schema


def _dump_schema(source: str) -> str:
    return f"_id string, _source struct<{source}>, _corrupt string"


def _as_fields(columns: str, drop: tuple[str, ...] = ("_id",)) -> str:
    """Top-level DDL columns as the fields of a struct type, without some of them."""
    fields, depth, current = [], 0, ""
    for c in columns:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            fields.append(current.strip())
            current = ""
        else:
            current += c
    fields.append(current.strip())
    pairs = [f.split(" ", 1) for f in fields]
    return ",".join(f"{name}:{kind}" for name, kind in pairs if name not in drop)


#: source schemas by generation; a v4 reception is kept as VARIANT since it may be a list or an object
SOURCES = {
    "common": _as_fields(schema.PACKET),
    "v3": _as_fields(schema.PACKET_V3),
    "v4": _as_fields(schema.PACKET_V4, ("_id", "rxInfo")) + ",rxInfo:variant",
    "gateway_rx": _as_fields(schema.GATEWAY_RX),
}


def read_packet_dump(spark: SparkSession, path: str, generation: str = "common") -> DataFrame:
    """Documents of a dump as rows. A line that is no document keeps its text in ``_corrupt``."""
    lines = (
        spark.read.schema(_dump_schema(SOURCES[generation]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return lines.select("_id", "_source.*", "_corrupt")


# Fixed value: dump times keep their microseconds.
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _documents(df: DataFrame, *extra: str) -> DataFrame:
    source = F.struct(*[c for c in df.columns if c != "_id"]).alias("_source")
    return df.select("_id", source, *[F.col(c) for c in extra])


def write_packet_dump(df: DataFrame, path: str) -> None:
    """One document per row, gzipped."""
    _documents(df).write.option("compression", "gzip").option("timestampFormat", _TIME).json(path)


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.year("time"), "month": F.month("time")})


def export_monthly(df: DataFrame, path: str, start_year: int | None = None, end_year: int | None = None) -> None:
    """Gzipped dumps in one folder per year and month, on request of some years only.

    Rows without a time go to the folder of a null year and month.

    Rows are spread by time range, so a task writes into few months and a big
    month is written by many tasks.
    """
    if start_year is not None:
        df = df.where(F.year("time") >= start_year)
    if end_year is not None:
        df = df.where(F.year("time") <= end_year)
    rows = _documents(df, "time")
    (
        rows.repartitionByRange("time")
        .transform(with_month)
        .drop("time")
        .write.partitionBy("year", "month")
        .option("compression", "gzip")
        .option("timestampFormat", _TIME)
        .json(path)
    )
