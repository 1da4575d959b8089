"""Sources, sinks, schema generations and table upkeep."""

import gzip
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from aircapture import schema
from aircapture.operators import flows as W
from aircapture.operators import joins as J
from aircapture.operators import maintenance as M
from aircapture.plans import relations as R
from aircapture.sources import dumps, flowstore
from aircapture.sources.operators import PACKAGED, packaged_operators, read_operators


def write_lines(path, docs):
    path.mkdir()
    with gzip.open(path / "part.json.gz", "wt") as f:
        for d in docs:
            f.write((d if isinstance(d, str) else json.dumps(d)) + "\n")
    return str(path)


V3 = {
    "_id": "a",
    "_source": {
        "mqtt_time": "2020-10-05T19:08:35.262Z", "phyPayload": "AAAA",
        "rxInfo": {"gatewayID": "g1", "loRaSNR": 7.5, "uplinkID": "u-1", "rssi": -90, "channel": 2, "crcStatus": "CRC_OK"},
        "txInfo": {"frequency": 868100000, "modulation": "LORA",
                   "loRaModulationInfo": {"bandwidth": 125, "spreadingFactor": 9, "codeRate": "4/5"}},
    },
}
V3_FSK = {"_id": "b", "_source": {"mqtt_time": "2020-10-05T19:08:36Z", "phyPayload": "BBBB", "rxInfo": {"gatewayID": "g1"},
                                  "txInfo": {"frequency": 868800000, "modulation": "FSK", "fskModulationInfo": {"datarate": 50000}}}}


def v4(rid, rx):
    return {"_id": rid, "_source": {
        "time": "2024-01-05T19:08:35.251262Z", "phyPayload": "AAAA", "rxInfo": rx,
        "txInfo": {"frequency": 868100000, "modulation": {"lora": {"bandwidth": 125000, "spreadingFactor": 9, "codeRate": "C_4_5"}}}}}


def test_both_generations_become_one_table(spark, tmp_path):
    old = dumps.read_packet_dump(spark, write_lines(tmp_path / "v3", [V3, V3_FSK, "no json"]), "v3").cache()
    assert old.where("_corrupt is not null").count() == 1
    rx = {"gatewayId": "g2", "snr": 3.25, "rssi": -80, "uplinkId": 77, "time": "2024-01-05T19:08:35.2Z"}
    new = dumps.read_packet_dump(spark, write_lines(tmp_path / "v4", [v4("c", rx), v4("d", [rx, {"gatewayId": "g9"}])]), "v4")
    both = M.unify(
        M.normalise_v3(old.where("_corrupt is null").drop("_corrupt")), M.normalise_v4(new.drop("_corrupt"))
    )
    lora = R.LORA
    got = {r["_id"]: tuple(r)[1:] for r in both.select(
        "_id", "src_version", F.date_format("time", "HH:mm:ss.SSSSSS"), "rxInfo.gatewayId", "rxInfo.snr", "rxInfo.uplinkIdText",
        "rxInfo.uplinkId", "txInfo.modulation.type", f"{lora}.codeRate", f"{lora}.spreadingFactor").collect()}
    assert got == {
        "a": (3, "19:08:35.262000", "g1", 7.5, "u-1", None, "LORA", "C_4_5", 9),
        "b": (3, "19:08:36.000000", "g1", None, None, None, "FSK", None, None),
        "c": (4, "19:08:35.251262", "g2", 3.25, None, 77, "LORA", "C_4_5", 9),
        "d": (4, "19:08:35.251262", "g2", 3.25, None, 77, "LORA", "C_4_5", 9),
    }


def test_each_reception_of_a_list_is_a_row(spark, tmp_path):
    one, two = {"gatewayId": "g2", "rssi": -80}, {"gatewayId": "g9", "rssi": -90}
    lines = [v4("c", one), v4("d", [one, two, two]), v4("e", []), v4("f", None)]
    rows = dumps.read_packet_dump(spark, write_lines(tmp_path / "v4", lines), "v4").drop("_corrupt")
    lists = rows.where("_id = 'd'").withColumn("rxInfo", F.expr(f"try_variant_get(rxInfo, '$', 'array<{schema.RX}>')"))
    want = [("d", "g2"), ("d#1", "g9"), ("d#2", "g9")]
    for df, others in ((rows, [("c", "g2"), ("e", None), ("f", None)]), (lists, [])):
        got = M.normalise_v4(df, explode=True).select("_id", "rxInfo.gatewayId", "src_version").collect()
        assert sorted((r[0], r[1]) for r in got) == sorted(want + others) and {r[2] for r in got} == {4}
    assert tuple(M.dropped_receptions(rows).first()) == (4, 4, 2) and tuple(M.dropped_receptions(lists).first()) == (1, 3, 2)
    assert M.normalise_v4(rows, explode=True).schema["rxInfo"].dataType == M.normalise_v4(rows).schema["rxInfo"].dataType


def test_monthly_export_reads_back(spark, packets, tmp_path):
    path = str(tmp_path / "out")
    dumps.export_monthly(packets, path)
    back = dumps.read_packet_dump(spark, path + "/year=2024/month=1").drop("_corrupt")
    cols = ["_id", "time", "phyPayload", "rxInfo.gatewayId", "rxInfo.snr", R.LORA + ".spreadingFactor"]
    january = packets.where("month(time) = 1")
    assert back.select(cols).exceptAll(january.select(cols)).count() == 0 and back.count() == january.count()


def test_monthly_export_keeps_every_year_and_rows_without_a_time(spark, packets, tmp_path):
    times = ["2019-03-01 00:00:00", "2026-07-01 00:00:00", None]
    rows = packets.limit(3).withColumn("n", F.row_number().over(Window.orderBy("_id")))
    rows = rows.withColumn("time", F.get(F.array(*map(F.lit, times)), F.col("n") - 1).cast("timestamp")).drop("n")
    path = str(tmp_path / "out")
    dumps.export_monthly(rows, path)
    back = spark.read.schema("_id string, year int, month int").json(path)
    assert {(r["year"], r["month"]) for r in back.collect()} == {(2019, 3), (2026, 7), (None, None)}
    dumps.export_monthly(rows, str(tmp_path / "some"), 2020, 2030)
    assert spark.read.schema("_id string").json(str(tmp_path / "some")).count() == 1


def test_the_last_of_overlapping_ranges_wins(spark):
    ops = packaged_operators(spark)
    rows = [("n", "p", "r", "A", None, 0, 100), ("n", "p", "r", "B", None, 50, 70), ("n", "p", "r", "C", None, 60, 1 << 26)]
    some = spark.createDataFrame([(f"{a:08x}",) for a in (0, 50, 59, 60, 70, 71, 1 << 26)], "devAddr string")
    got = [r["operator"] for r in J.with_operator(some, spark.createDataFrame(rows, ops.schema).coalesce(1)).orderBy("devAddr").collect()]
    assert got == ["A", "B", "B", "C", "C", "C", "C"]


def test_anonymise(spark, packets):
    plain, salted = M.anonymise(packets), M.anonymise(packets, salt="s")
    assert "phyPayload" not in plain.columns
    assert "gatewayId" not in plain.schema["rxInfo"].dataType.fieldNames()
    h = {r[0] for r in plain.select("rxInfo.gatewayId_hash").distinct().collect()}
    assert h == {((ord("g") * 31 + ord("w")) * 31 + ord(str(i))) for i in range(5)}
    assert salted.select(F.length("rxInfo.gatewayId_hash")).distinct().first()[0] == 64


def test_periods(spark, packets):
    a, b = M.subset_period(packets, "2024-01-05", "2024-01-09"), M.delete_period(packets, "2024-01-05", "2024-01-09")
    assert a.count() + b.count() == packets.count()
    assert a.agg(F.max("time")).first()[0].isoformat() < "2024-01-10"
    assert a.where("date(time) = '2024-01-09'").count() > 0
    nowhen = packets.limit(3).withColumn("time", F.lit(None).cast("timestamp"))
    assert M.delete_period(nowhen, "2024-01-05", "2024-01-09").count() == 3


def test_delete_from_partitioned_table(spark, packets, tmp_path):
    path = str(tmp_path / "t")
    months = packets.withColumn("time", F.expr("time + make_ym_interval(0, int(abs(hash(_id)) % 3))")).transform(dumps.with_month)
    months.write.partitionBy("year", "month").parquet(path)
    before = {r["month"]: r["count"] for r in spark.read.parquet(path).groupBy("month").count().collect()}
    gone = months.where("time >= '2024-02-01' and time < '2024-03-11'").count()
    M.delete_period_from_table(spark, path, "2024-02-01", "2024-03-10")
    spark.catalog.refreshByPath(path)
    after = {r["month"]: r["count"] for r in spark.read.parquet(path).groupBy("month").count().collect()}
    assert 2 not in after and after[1] == before[1] and after[3] < before[3]
    assert sum(before.values()) - sum(after.values()) == gone


def test_interrupted_delete_is_finished(spark, packets, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    months = packets.withColumn("time", F.expr("time + make_ym_interval(0, int(abs(hash(_id)) % 3))")).transform(dumps.with_month)
    months.write.partitionBy("year", "month").parquet(path)
    rows = lambda: sorted(r[0] for r in spark.read.parquet(path).select("_id").collect())
    before = rows()
    want = sorted(r[0] for r in M.delete_period(months, "2024-01-20", "2024-03-10").select("_id").collect())
    real, calls = M.finish_delete, []

    def dies(spark, path):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("lost")
        return real(spark, path)

    monkeypatch.setattr(M, "finish_delete", dies)
    with pytest.raises(OSError):
        M.delete_period_from_table(spark, path, "2024-01-20", "2024-03-10")
    assert rows() == before  # written aside, not swapped
    aside = next(tmp_path.glob("t/_delete-*"))
    # one month was already moved out when the swap died
    (aside / "old" / "year=2024").mkdir(parents=True)
    (tmp_path / "t" / "year=2024" / "month=1").rename(aside / "old" / "year=2024" / "month=1")
    assert real(spark, path) == 3
    spark.catalog.refreshByPath(path)
    assert rows() == want and not list(tmp_path.glob("t/_delete-*"))
    # one that died while writing aside is cleared away
    (tmp_path / "t" / "_delete-x" / "new").mkdir(parents=True)
    M.delete_period_from_table(spark, path, "1999-01-01", "1999-02-01")
    assert rows() == want and not list(tmp_path.glob("t/_delete-*"))


def test_upsert(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "_id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 5, 2), ("c", 4, 1)], "_id string, v int, n int")
    got = {r["_id"]: r["v"] for r in M.upsert(base, new, order="n").collect()}
    assert got == {"a": 1, "b": 5, "c": 4}


def test_flow_tables(spark, sf_dir, tmp_path):
    told = R.flow_packets(spark, sf_dir)
    flows = W.summarise_flows(told)
    assert flowstore.read_flows(spark, str(tmp_path / "none")).count() == 0
    flowstore.write_flows(flows, str(tmp_path / "flows"))
    assert flowstore.read_flows(spark, str(tmp_path / "flows")).exceptAll(flows).count() == 0
    path = str(tmp_path / "series")
    flowstore.write_flow_packets(told, path)
    one = flows.orderBy(F.desc("nb_pkts"), "devAddr").first()
    device = flowstore.read_flow_packets(spark, path, one["devAddr"])
    assert device.count() == told.where(F.col("devAddr") == one["devAddr"]).count()
    plan = device._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(devAddr" in plan and "addr_block" in plan.split("PartitionFilters")[1]
    single = flowstore.read_flow_packets(spark, path, one["devAddr"], one["time_1st"])
    assert single.count() >= one["nb_pkts"] and W.flow_lookup(told, one["devAddr"], one["time_1st"]).count() == single.count()


def test_operator_table_and_range_join(spark, tmp_path):
    ops = packaged_operators(spark)
    assert ops.count() == 151 and ops.where("area is null").count() == 18
    same = read_operators(spark, "file://" + PACKAGED)
    assert ops.exceptAll(same).count() == 0 and same.count() == 151
    addresses = ["1ddec524", "03975dd1", "70000000", "e00a0000", "fc00e3ff", "fc00e400", "ffffffff", "E0980000"]
    df = spark.createDataFrame([(a,) for a in addresses], "devAddr string")
    joined = J.with_operator(df, ops)
    got = {r["devAddr"]: r["operator"] for r in joined.collect()}
    assert got == {
        "1ddec524": "SagemCom", "03975dd1": "Private/experimental nodes", "70000000": "UNKOWN", "e00a0000": "Blink",
        "fc00e3ff": "First Snow Co., Ltd", "fc00e400": "UNKOWN", "ffffffff": "UNKOWN", "E0980000": "UNKOWN",
    }
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    wide = spark.createDataFrame([("n", "p", "r", "wide", None, 0, (5 << 25) + 3)], ops.schema)
    some = spark.createDataFrame([("00000000",), ("0a000003",), ("0a000004",)], "devAddr string")
    assert {r["devAddr"]: r["operator"] for r in J.with_operator(some, wide).collect()} == {
        "00000000": "wide", "0a000003": "wide", "0a000004": "UNKOWN",
    }
    short = J.shorten_names(spark.createDataFrame([("NTT (Nippon Telephone and Telegraph)",), ("KPN",)], "operator string"))
    assert {r[0] for r in short.collect()} == {"NTT", "KPN"}


@pytest.mark.parametrize("name", ["PACKET", "PACKET_V3", "PACKET_V4", "GATEWAY_RX", "FLOW", "FLOW_PACKET"])
def test_schemas_parse(spark, name):
    assert len(spark.createDataFrame([], getattr(schema, name)).columns) >= 2
