"""Schema normalisation and table upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, VariantType

from aircapture import schema
from aircapture.functions import predicates
from aircapture.functions.text import java_string_hash


def _fields(df: DataFrame, column: str) -> list[str]:
    return df.schema[column].dataType.fieldNames()


def _renamed(df: DataFrame, column: str, names: dict[str, str]) -> Column:
    """The struct ``column`` with some fields renamed; fields that are missing stay missing."""
    parts = [F.col(f"{column}.{f}").alias(names.get(f, f)) for f in _fields(df, column)]
    return F.when(F.col(column).isNotNull(), F.struct(*parts))


def normalise_v3(df: DataFrame) -> DataFrame:
    """Third-generation packets in the common schema."""
    tx = "txInfo"
    info = F.col(f"{tx}.loRaModulationInfo")
    rate = F.when(info["codeRate"].isNotNull(), F.concat(F.lit("C_"), F.replace(info["codeRate"], F.lit("/"), F.lit("_"))))
    lora = F.when(info.isNotNull(), info.withField("codeRate", rate))
    kept = [F.col(f"{tx}.{f}").alias(f) for f in _fields(df, tx) if f not in ("modulation", "loRaModulationInfo")]
    modulation = F.struct(F.col(f"{tx}.modulation").alias("type"), lora.alias("lora"))
    rx = {"loRaSNR": "snr", "gatewayID": "gatewayId", "uplinkID": "uplinkIdText"}
    return df.withColumnRenamed("mqtt_time", "time").withColumns(
        {
            "src_version": F.lit(3),
            "txInfo": F.struct(*kept, modulation.alias("modulation")),
            "rxInfo": _renamed(df, "rxInfo", rx),
        }
    )


def _receptions(df: DataFrame) -> Column:
    """The receptions of fourth-generation packets as a list; null or empty if there is none."""
    kind = df.schema["rxInfo"].dataType
    rx = F.col("rxInfo")
    if isinstance(kind, VariantType):
        one = F.try_variant_get(rx, "$", schema.RX)
        listed = F.schema_of_variant(rx).startswith("ARRAY")
        return F.when(listed, F.try_variant_get(rx, "$", f"array<{schema.RX}>")).when(one.isNotNull(), F.array(one))
    if isinstance(kind, ArrayType):
        return rx
    return F.when(rx.isNotNull(), F.array(rx))


def normalise_v4(df: DataFrame, explode: bool = False) -> DataFrame:
    """Fourth-generation packets in the common schema.

    Of a list of receptions the first is kept, as the reference does;
    :func:`dropped_receptions` counts the others. With ``explode`` each is a
    row: the first under the packet's ``_id``, those at position k > 0 of the
    list under ``_id#k``. A packet without receptions stays one row.
    """
    kind = df.schema["rxInfo"].dataType
    rx = F.col("rxInfo")
    if explode:
        columns = [F.col(f"`{c}`") for c in df.columns if c not in ("_id", "rxInfo")]
        df = df.select("_id", *columns, F.posexplode_outer(_receptions(df)).alias("_position", "rxInfo"))
        nth = F.concat_ws("#", "_id", F.col("_position").cast("string"))
        df = df.withColumn("_id", F.when(F.col("_position") > 0, nth).otherwise(F.col("_id"))).drop("_position")
    elif isinstance(kind, VariantType):
        rx = F.coalesce(F.try_variant_get(rx, "$[0]", schema.RX), F.try_variant_get(rx, "$", schema.RX))
    elif isinstance(kind, ArrayType):
        rx = F.get(rx, F.lit(0))
    return df.withColumns(
        {
            "src_version": F.lit(4),
            "rxInfo": rx,
            "txInfo": F.col("txInfo").withField("modulation.type", F.lit("LORA")),
        }
    )


def dropped_receptions(df: DataFrame) -> DataFrame:
    """One row: ``packets`` of the fourth generation, their ``receptions``, and those ``dropped`` without ``explode``."""
    n = F.coalesce(F.size(_receptions(df)), F.lit(0))
    n = F.when(n > 0, n).otherwise(0)
    return df.agg(
        F.count("*").alias("packets"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("receptions"),
        F.coalesce(F.sum(F.greatest(n - 1, F.lit(0))), F.lit(0)).cast("long").alias("dropped"),
    )


def unify(*frames: DataFrame) -> DataFrame:
    """One table of all generations; fields a generation lacks are null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def anonymise(df: DataFrame, salt: str | None = None) -> DataFrame:
    """Without payload and gateway location, and with a hash for the gateway's identity.

    The default hash is a plain 31-polynomial, which a list of gateway names
    reverses at once; give a ``salt`` for a keyed digest.
    """
    gateway = F.col("rxInfo.gatewayId")
    if salt is None:
        h = java_string_hash(gateway)
        hashed = F.when(h == -(1 << 31), h).otherwise(F.abs(h))
    else:
        hashed = F.sha2(F.concat(F.lit(salt), gateway), 256)
    drop = [f for f in ("gatewayId", "location") if f in _fields(df, "rxInfo")]
    rx = F.col("rxInfo").withField("gatewayId_hash", hashed).dropFields(*drop)
    return df.withColumn("rxInfo", rx).drop("phyPayload")


def subset_period(df: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    return df.where(predicates.time_between(lo, hi))


def delete_period(df: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    """All rows but those of the period; rows without a time stay."""
    return df.where(~F.coalesce(predicates.time_between(lo, hi), F.lit(False)))


def delete_period_from_table(spark: SparkSession, path: str, lo: str, hi: str) -> None:
    """Delete a period from a parquet table partitioned by ``year``, ``month``.

    What stays of the months that lose rows is written aside first, in a folder
    that readers of the table skip; then each month's folder is swapped for the
    new one, or taken out if nothing stays. A failure before the swap leaves the
    table as it was. One during the swap is made good by :func:`finish_delete`,
    which the next delete calls by itself: no row that stays is ever in one
    place only that is about to be removed.
    """
    finish_delete(spark, path)
    table = spark.read.parquet(path)
    inside = F.coalesce(predicates.time_between(lo, hi), F.lit(False))
    gone = table.groupBy("year", "month").agg(F.count_if(inside).alias("gone")).where("gone > 0")
    months = [(m["year"], m["month"]) for m in gone.collect()]  # one small row per touched month
    if not months:
        return
    touched = F.lit(False)
    for year, month in months:
        touched = touched | (F.col("year").eqNullSafe(F.lit(year)) & F.col("month").eqNullSafe(F.lit(month)))
    aside = f"{path}/_delete-{uuid.uuid4().hex}"
    kept = table.where(touched & ~inside).repartitionByRange("year", "month", "time")
    kept.write.partitionBy("year", "month").parquet(f"{aside}/new")
    files, hadoop = _files(spark, path)
    for year, month in months:  # a folder to swap in also for months that nothing stays of
        files.mkdirs(hadoop(f"{aside}/new/{_month_folder(year, month)}"))
    files.create(hadoop(f"{aside}/_ready")).close()
    finish_delete(spark, path)


def finish_delete(spark: SparkSession, path: str) -> int:
    """Finish the swaps of a delete that was interrupted, and clear away one that never got so far; returns the months swapped."""
    files, hadoop = _files(spark, path)
    swapped = 0
    for found in files.globStatus(hadoop(f"{path}/_delete-*")):
        aside = found.getPath().toString()
        if files.exists(hadoop(f"{aside}/_ready")):
            for month in files.globStatus(hadoop(f"{aside}/new/year=*/month=*")):
                new = month.getPath()
                name = f"{new.getParent().getName()}/{new.getName()}"
                current, old = hadoop(f"{path}/{name}"), hadoop(f"{aside}/old/{name}")
                files.mkdirs(old.getParent())
                # the current folder is the old one as long as that has not been moved
                if files.exists(current) and not files.exists(old):
                    files.rename(current, old)
                if files.listStatus(new):
                    files.mkdirs(current.getParent())
                    files.rename(new, current)
                else:
                    files.delete(new, True)
                swapped += 1
        files.delete(found.getPath(), True)
    return swapped


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _month_folder(year: int | None, month: int | None) -> str:
    return "/".join(f"{n}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for n, v in (("year", year), ("month", month)))


def upsert(base: DataFrame, updates: DataFrame, key: str = "_id", order: str | None = None) -> DataFrame:
    """``base`` with whole rows replaced or added by ``updates``.

    With ``order`` several updates of a key are allowed and the last one wins.
    """
    if order is not None:
        columns = [c for c in updates.columns if c != key]
        newest = F.max_by(F.struct(*columns), order).alias("_row")
        updates = updates.groupBy(key).agg(newest).select(key, "_row.*")
    kept = base.join(updates.select(key), key, "left_anti")
    return kept.unionByName(updates.select(*base.columns))
