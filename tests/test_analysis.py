"""Predicates, aggregates, statistics, samples."""

import math

import pytest
from pyspark.sql import functions as F

from aircapture.functions import predicates as P
from aircapture.operators import aggregates as A
from aircapture.operators import sampling as K
from aircapture.operators import statistics as X
from aircapture.plans import relations as R


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return R.enriched(spark, sf_dir)


def test_missing_fields(spark, rows):
    bare = rows.limit(5).withColumns(
        {"extra_infos": F.lit(None).cast(rows.schema["extra_infos"].dataType), "dup_infos": F.lit(None).cast(rows.schema["dup_infos"].dataType)}
    ).withColumn("txInfo", F.col("txInfo").withField("modulation.type", F.lit("LoRa")))
    count = lambda c: bare.where(c).count()
    assert count(P.needs_decode()) == count(P.not_data()) == count(P.needs_dup_flag()) == 5
    assert count(P.data()) == count(P.has_extra_nodup()) == count(P.original()) == count(P.data_for_device()) == 0
    assert count(P.all_ok()) <= 5 and count(P.is_lora()) == 5


def test_filters_reach_the_scan(spark, rows):
    plan = rows.where(P.data_for_device("03676b8e")).select("_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "mType" in plan.split("PushedFilters")[1]
    schema = plan.split("ReadSchema")[1]
    assert "gatewayId" not in schema and "frequency" not in schema and "mic" not in schema


def test_time_between(spark):
    df = spark.sql("select explode(array('2024-01-04 23:59:59.9', '2024-01-05 00:00:00', '2024-01-09 23:59:59.999999', '2024-01-10')) s")
    df = df.select(F.col("s").cast("timestamp").alias("time"))
    assert df.where(P.time_between("2024-01-05", "2024-01-09")).count() == 2
    assert df.where(P.time_between("2024-01-05", "2024-01-10 00:00:00")).count() == 3
    assert df.where(P.time_between()).count() == 4


def test_tokens(spark):
    df = spark.createDataFrame([("A Quick-brown fox",), ("slow",), (None,)], "t string")
    assert df.where(P.match_any_token("t", "BROWN cow")).count() == 1


def test_nested_counts_limits(spark):
    data = [("a", x) for x in "pppqqr"] + [("b", None)] * 9 + [("b", "p")] + [("c", "q")] * 5 + [(None, "p")]
    df = spark.createDataFrame(data, "k string, m string")
    got = {(r["key1"], r["key2"]): r["count"] for r in A.nested_counts(df, "k", "m", 2, 2).collect()}
    assert got == {("b", "p"): 1, ("a", "p"): 3, ("a", "q"): 2}
    assert A.nested_counts(df, "k", "m", None, None).count() == 5


def test_day_night_border(spark):
    df = spark.sql("select explode(sequence(timestamp'2024-01-01', timestamp'2024-01-01 23:00:00', interval 1 hour)) time")
    df = df.withColumn("rxInfo", F.struct(F.lit("CRC_OK").alias("crcStatus")))
    assert {r["period"]: r["count"] for r in A.day_night(df).collect()} == {"night": 13, "day": 11}
    assert {r["half"]: r["count"] for r in A.am_pm(df).collect()} == {"AM": 12, "PM": 12}


def test_weekdays_come_in_order(spark, rows):
    names = [r["day_of_week"] for r in A.per_weekday_per_day(rows).collect()]
    assert names == sorted(names, key=["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"].index)


def test_progress_adds_up(spark, rows):
    for r in A.progress(rows, "2024-01-10").collect():
        assert r["docs"] == r["with_extra_infos"] + r["without_extra_infos"]


@pytest.mark.parametrize("r, n, p", [(0.5, 10, 0.14111), (0.1, 50, 0.489586), (0.9, 5, 0.037386), (0.0, 20, 1.0), (-0.3, 100, 0.002422)])
def test_p_value(spark, r, n, p):
    got = spark.range(1).select(X.correlation_p_value(F.lit(r), F.lit(n)).alias("p")).first()["p"]
    assert math.isclose(got, p, abs_tol=2e-4)


def test_pearson(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (4.0, 4.0), (None, 1.0)], "x double, y double")
    one = X.pearson(df, "x", "y").first()
    assert math.isclose(one["r"], 0.98198050606) and one["n"] == 3


def test_histogram_ends(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)] + [(None,)], "v double")
    assert {r["bin"]: r["count"] for r in X.histogram(df, "v", 5).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    assert {r["bin"]: r["count"] for r in X.histogram(df.where("v = 3"), "v", 5).collect()} == {0: 1}


def test_weighted_ecdf_reaches_one(spark, sf_dir):
    told = R.flow_packets(spark, sf_dir)
    out = X.prr_by_sf(R.flows(spark, sf_dir).where(P.flow_quality(5)), told)
    last = out.groupBy("SF").agg(F.max("ecdf").alias("e")).collect()
    assert last and all(r["e"] == 1.0 for r in last)


def test_sample_is_repeatable_and_whole(spark, packets):
    a = [r["_id"] for r in K.hash_sample(packets, 300).collect()]
    b = [r["_id"] for r in K.hash_sample(packets.repartition(7), 300).collect()]
    assert a == b and len(set(a)) == 300
    assert K.hash_sample(packets, 50_000).count() == packets.count()  # by way of the histogram


def test_sample_by_histogram_equals_direct(spark, packets, monkeypatch):
    direct = [r["_id"] for r in K.hash_sample(packets, 700).collect()]
    monkeypatch.setattr(K, "_DIRECT", 10)
    assert [r["_id"] for r in K.hash_sample(packets, 700).collect()] == direct


def test_pages_lose_no_ties(spark):
    df = spark.createDataFrame([(i // 7, f"r{i:03d}") for i in range(100)], "t long, _id string")
    seen, after = [], None
    while page := K.page(df, ["t", "_id"], 11, after).collect():
        seen += [r["_id"] for r in page]
        after = tuple(page[-1])
    assert seen == [f"r{i:03d}" for i in range(100)]


def test_flatten_lists(spark, packets):
    listed = packets.withColumn("rxInfo", F.col("rxInfo").withField("rssi", F.array("rxInfo.rssi")))
    assert K.flatten_fields(listed).exceptAll(K.flatten_fields(packets)).count() == 0


def test_dense_values_are_spread_over_many_stretches(spark):
    from aircapture.operators.skew import running_total

    n = 100_000
    rows = spark.range(n).select((1000 + F.col("id") / (1000 * n)).alias("v"), (F.col("id") % 3 + 1).alias("w"))
    out = running_total(rows, "v", F.col("w"))
    got = out.orderBy("v").select("cumulative", "total").collect()
    want = 0
    for i, r in enumerate(got):
        want += i % 3 + 1
        assert r["cumulative"] == want
    assert len(got) == n and {r["total"] for r in got} == {want}
    ends = [int(got[-1]["total"] * k / 8) for k in range(1, 8)]
    assert len({next(i for i, r in enumerate(got) if r["cumulative"] >= e) // (n // 8) for e in ends}) == 7
