"""Counts and histograms. All are partial aggregations before their only shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aircapture.functions import predicates
from aircapture.functions.frame import EXTRA_VERSION, payload_size
from aircapture.functions.text import SHORT_DAYS, day_name, week_start
from aircapture.operators.flows import device_list
from aircapture.operators.joins import shorten_names, with_operator

# Fixed value: zone of the weekly histograms.
ZONE = "Europe/Paris"


def nested_counts(
    df: DataFrame,
    key1: str | Column,
    key2: str | Column,
    size1: int | None = None,
    size2: int | None = None,
    metrics: dict[str, Column] | None = None,
    names: tuple[str, str] = ("key1", "key2"),
) -> DataFrame:
    """Counts per (key1, key2); on request only the biggest ``size1`` keys and ``size2`` sub-keys of each.

    Bigger count first, then smaller key; rows without either key are left out
    (a key1 still ranks by all its rows).
    """
    k1, k2 = names
    as_column = lambda key: F.col(key) if isinstance(key, str) else key
    keyed = df.withColumns({k1: as_column(key1), k2: as_column(key2)}).where(F.col(k1).isNotNull())
    extra = [expr.alias(name) for name, expr in (metrics or {}).items()]
    counts = keyed.groupBy(k1, k2).agg(F.count("*").alias("count"), *extra)
    kept = counts
    if size2 is not None:
        # rows without key2 rank last, so that both uses of the counts can share one exchange
        order = Window.partitionBy(k1).orderBy(F.col(k2).isNull(), F.desc("count"), k2)
        kept = kept.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= size2).drop("_rank")
    kept = kept.where(F.col(k2).isNotNull())
    if size1 is not None:
        totals = counts.groupBy(k1).agg(F.sum("count").alias("_total"))
        kept = kept.join(totals.orderBy(F.desc("_total"), k1).limit(size1).select(k1), k1, "left_semi")
    return kept


def _weekly(df: DataFrame, key: Column, name: str) -> DataFrame:
    return (
        df.where(predicates.all_ok_nodup() & key.isNotNull() & F.col("rxInfo.time").isNotNull())
        .groupBy(key.alias(name), week_start(F.col("rxInfo.time"), ZONE).alias("week"))
        .agg(F.count("*").alias("count"))
    )


def weekly_by_sf(df: DataFrame) -> DataFrame:
    return _weekly(df, F.col(predicates.SF), "SF")


def weekly_by_modulation(df: DataFrame) -> DataFrame:
    return _weekly(df, F.col("txInfo.modulation.type"), "modulation")


def per_weekday_per_day(df: DataFrame) -> DataFrame:
    """Packets per calendar day with the name of its weekday, Monday first."""
    by_day = (
        df.where(predicates.all_ok_nodup())
        .groupBy(F.to_date("time").alias("day"))
        .agg(F.count("*").alias("count"))
    )
    index = F.weekday("day")
    return by_day.orderBy(index, "day").select(day_name(index, SHORT_DAYS).alias("day_of_week"), "day", "count")


def per_hour_per_day(df: DataFrame) -> DataFrame:
    return (
        df.where(predicates.all_ok_nodup())
        .groupBy(F.hour("time").alias("hour"), F.to_date("time").alias("day"))
        .agg(F.count("*").alias("count"))
    )


def _of_period(df: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    return df.where(predicates.crc_ok() & predicates.time_between(lo, hi))


def per_weekday(df: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    counts = _of_period(df, lo, hi).groupBy(F.weekday("time").alias("_day")).agg(F.count("*").alias("count"))
    return counts.select(day_name(F.col("_day")).alias("day_of_week"), "count")


def per_hour(df: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    return _of_period(df, lo, hi).groupBy(F.hour("time").alias("hour")).agg(F.count("*").alias("count"))


def am_pm(df: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    half = F.when(F.hour("time") < 12, "AM").otherwise("PM")
    return _of_period(df, lo, hi).groupBy(half.alias("half")).agg(F.count("*").alias("count"))


def day_night(df: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Night is up to and including hour 7, and from hour 19."""
    hour = F.hour("time")
    period = F.when((hour <= 7) | (hour >= 19), "night").otherwise("day")
    return _of_period(df, lo, hi).groupBy(period.alias("period")).agg(F.count("*").alias("count"))


def per_mtype(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col(predicates.DEVADDR).isNotNull())
        .groupBy(F.col(predicates.MTYPE).alias("mType"))
        .agg(F.count("*").alias("count"))
    )


def traffic_cube(df: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Eight of the traffic charts at once: chart, key, at, count.

    ``weekly_by_modulation``, ``per_weekday_per_day``, ``per_hour_per_day`` (of
    good original packets; ``at`` is the week or day), ``per_weekday``,
    ``per_hour``, ``am_pm``, ``day_night`` (of packets with a good checksum from
    ``lo`` to ``hi``) and ``per_mtype`` (of packets with a device address). The
    charts are grouping sets of one scan with one exchange. Each set counts the
    rows of its own condition.
    """
    hour = F.hour("time")
    good = predicates.all_ok_nodup()
    rows = df.select(
        F.when(good & F.col("rxInfo.time").isNotNull(), F.col("txInfo.modulation.type")).alias("modulation"),
        week_start(F.col("rxInfo.time"), ZONE).alias("week"),
        F.to_date("time").alias("day"),
        F.weekday("time").alias("weekday"),
        hour.alias("hour"),
        F.when(hour < 12, "AM").when(hour.isNotNull(), "PM").alias("half"),
        F.when((hour <= 7) | (hour >= 19), "night").when(hour.isNotNull(), "day").alias("period"),
        F.when(F.col(predicates.DEVADDR).isNotNull(), F.struct(F.col(predicates.MTYPE).alias("mType"))).alias("mtype"),
        good.alias("good"),
        (predicates.crc_ok() & predicates.time_between(lo, hi)).alias("ok"),
    )
    sets = {
        "weekly_by_modulation": ["modulation", "week"], "per_weekday_per_day": ["weekday", "day"], "per_hour_per_day": ["hour", "day"],
        "per_weekday": ["weekday"], "per_hour": ["hour"], "am_pm": ["half"], "day_night": ["period"], "per_mtype": ["mtype"],
    }
    columns = ["modulation", "week", "day", "weekday", "hour", "half", "period", "mtype"]
    # a bit per column, the last one lowest, set where the column is not in the set
    ids = {chart: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in mine) for chart, mine in sets.items()}
    counts = rows.groupingSets(list(sets.values()), *columns).agg(
        F.grouping_id().alias("set"), F.count_if("good").alias("good"), F.count_if("ok").alias("ok"), F.count("mtype").alias("addressed")
    )
    chart = F.lit(None).cast("string")
    for name, number in ids.items():
        chart = F.when(F.col("set") == number, name).otherwise(chart)
    name_of = day_name(F.col("weekday"), SHORT_DAYS)
    key = F.coalesce("modulation", name_of, F.col("hour").cast("string"), "half", "period", F.col("mtype.mType").cast("string"))
    of_good = F.col("chart").isin("weekly_by_modulation", "per_weekday_per_day", "per_hour_per_day")
    count = F.when(of_good, F.col("good")).when(F.col("chart") == "per_mtype", F.col("addressed")).otherwise(F.col("ok"))
    told = counts.withColumn("chart", chart).select("chart", key.alias("key"), F.coalesce("week", F.col("day").cast("timestamp")).alias("at"), count.alias("count"))
    unkeyed = (F.col("chart") == "weekly_by_modulation") & F.col("key").isNull()
    return told.where((F.col("count") > 0) & ~unkeyed)


def gateway_first_seen(df: DataFrame) -> DataFrame:
    """Earliest decoded packet of each gateway, newest gateway first."""
    return (
        df.where(predicates.decoded() & F.col("rxInfo.gatewayId").isNotNull())
        .groupBy(F.col("rxInfo.gatewayId").alias("gatewayId"))
        .agg(F.min("time").alias("min_time"))
        .orderBy(F.desc("min_time"), "gatewayId")
    )


def per_device_gateway(df: DataFrame, max_devices: int | None = None, max_gateways: int | None = None) -> DataFrame:
    return nested_counts(
        df.where(predicates.has_extra_nodup()), predicates.DEVADDR, "rxInfo.gatewayId", max_devices, max_gateways,
        names=("devAddr", "gatewayId"),
    )


def per_deveui_gateway(df: DataFrame, max_devices: int | None = None, max_gateways: int | None = None) -> DataFrame:
    return nested_counts(
        df.where(predicates.has_extra_nodup()), predicates.DEVEUI, "rxInfo.gatewayId", max_devices, max_gateways,
        names=("devEUI", "gatewayId"),
    )


def class_ack_matrix(df: DataFrame) -> DataFrame:
    """The 2 x 2 counts of class B and acknowledgement bits, with shares of the whole and of the class."""
    fctrl = "extra_infos.phyPayload.macPayload.fhdr.fCtrl"
    counts = (
        df.where(predicates.has_extra_nodup() & F.col(f"{fctrl}.classB").isNotNull())
        .groupBy(F.col(f"{fctrl}.classB").alias("classB"), F.col(f"{fctrl}.ack").alias("ack"))
        .agg(F.count("*").alias("count"))
    )
    # at most four rows from here on
    whole, row = Window.partitionBy(F.lit(0)), Window.partitionBy("classB")
    return counts.select(
        "classB",
        "ack",
        "count",
        (F.col("count") / F.sum("count").over(whole)).alias("share"),
        (F.col("count") / F.sum("count").over(row)).alias("share_of_class"),
    )


def operator_traffic(df: DataFrame, operators: DataFrame) -> DataFrame:
    """Data packets per network operator, busiest first."""
    return (
        shorten_names(with_operator(device_list(df), operators))
        .groupBy("operator")
        .agg(F.sum("doc_count").alias("doc_count"))
        .orderBy(F.desc("doc_count"), "operator")
    )


def dups_by_hour(flow_packets: DataFrame, max_dups: int | None = None) -> DataFrame:
    """Packets by number of duplicates (on request only below ``max_dups``) and hour of day, missing cells zero."""
    hours = range(24)
    rows = flow_packets if max_dups is None else flow_packets.where(F.col("nb_duplicates") < max_dups)
    return (
        rows.groupBy("nb_duplicates")
        .agg(*[F.count_if(F.hour("time") == h).alias(f"h{h:02d}") for h in hours])
    )


def progress(df: DataFrame, since: str, version: str = EXTRA_VERSION) -> DataFrame:
    """State of the preprocessing per modulation, in one pass."""
    return df.groupBy(F.col("txInfo.modulation.type").alias("modulation")).agg(
        F.count("*").alias("docs"),
        F.count_if(F.col("dup_infos").isNull()).alias("without_dup_infos"),
        F.count_if(~predicates.decoded()).alias("without_extra_infos"),
        F.count_if(predicates.decoded()).alias("with_extra_infos"),
        F.count_if(F.col("extra_infos.version") == version).alias("with_extra_version"),
        F.count_if(F.col("time") >= F.lit(since).cast("timestamp")).alias("since_date"),
    )


def packet_sizes(df: DataFrame) -> DataFrame:
    """Frame size in bytes of every decoded original packet."""
    return df.where(predicates.has_extra_nodup()).select("_id", payload_size(F.col("phyPayload")).alias("size"))
