"""Duplicates, messages and flows against plain-Python models, with and without heavy keys."""

import random

import model
import pytest
from pyspark.sql import functions as F

from aircapture.operators import duplicates as D
from aircapture.operators import flows as W
from aircapture.operators.decode import decode_frames
from aircapture.operators.skew import heavy_hashes, running_total, time_cuts, with_slice
from aircapture.plans import relations as R

T0 = 1_704_067_200_000_000
PACKET = (
    "_id string, us long, phyPayload string, freq long, sf int"
)


def as_packets(spark, rows):
    """rows: (id, us after the start, payload, freq, sf)."""
    df = spark.createDataFrame([(i, T0 + us, p, f, s) for i, us, p, f, s in rows], PACKET)
    return df.select(
        "_id", F.timestamp_micros("us").alias("time"), "phyPayload",
        F.struct(F.lit("gw").alias("gatewayId"), F.timestamp_micros("us").alias("time")).alias("rxInfo"),
        F.struct(
            F.col("freq").alias("frequency"),
            F.struct(
                F.lit("LORA").alias("type"),
                F.struct(
                    F.lit(125000).cast("long").alias("bandwidth"), F.col("sf").alias("spreadingFactor"), F.lit("C_4_5").alias("codeRate")
                ).alias("lora"),
            ).alias("modulation"),
        ).alias("txInfo"),
    )


def as_receptions(spark, rows):
    return as_packets(spark, rows).select(
        "_id", "phyPayload",
        F.struct(
            F.lit("gw").alias("mac"), F.col("time"), F.unix_micros("time").alias("timestamp"), F.lit(-60).alias("rssi"),
            F.lit(5.0).alias("loRaSNR"), F.lit("CRC_OK").alias("crcStatus"), F.lit(1).alias("channel"),
            F.lit(None).cast("int").alias("rfChain"), F.lit(0).alias("antenna"), F.lit(0).alias("board"),
            F.lit(None).cast("int").alias("size"), F.col("txInfo.frequency").alias("frequency"), F.lit("4/5").alias("codeRate"),
            F.struct(
                F.lit(125000).cast("long").alias("bandwidth"),
                F.col("txInfo.modulation.lora.spreadingFactor").alias("spreadFactor"), F.lit("LORA").alias("modulation"),
            ).alias("dataRate"),
        ).alias("rxInfo"),
    )


def crowd(seed, n, hot_share=0.5, span_s=20_000, step_us=1):
    """Random receptions of which one payload holds ``hot_share``."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        payload = "hot" if rnd.random() < hot_share else f"p{rnd.randrange(n // 4)}"
        us = rnd.randrange(span_s * 1_000_000 // step_us) * step_us
        rows.append((f"r{i:05d}", us, payload, rnd.choice((868100000, 868300000)), rnd.choice((7, 7, 7, 9))))
    return rows


def told_flags(df):
    return {r["_id"]: r["c"] for r in df.select("_id", F.col("dup_infos.copy_of").alias("c")).collect()}


@pytest.mark.parametrize("hot_min_rows, slice_rows", [(None, None), (100, None), (100, 40), (2, 3)])
def test_flags_match_model(spark, hot_min_rows, slice_rows):
    rows = crowd(1, 1200, span_s=400_000)
    want = model.flags([(p, us, i, (f, s)) for i, us, p, f, s in rows])
    got = told_flags(D.flag_duplicates(as_packets(spark, rows), hot_min_rows=hot_min_rows, slice_rows=slice_rows))
    assert got == want and len(set(want.values())) < len(want)


def test_flags_do_not_depend_on_row_order(spark):
    rows = crowd(2, 300)
    a = told_flags(D.flag_duplicates(as_packets(spark, rows)))
    b = told_flags(D.flag_duplicates(as_packets(spark, rows[::-1]).repartition(5)))
    assert a == b


@pytest.mark.parametrize("hot_min_rows", [None, 2])
def test_rows_without_payload_or_radio(spark, hot_min_rows):
    rows = [("a", 0, None, 1, 7), ("b", 1, None, 1, 7), ("c", 2, "p", None, None), ("d", 3, "p", None, None), ("e", 4, "p", 1, 7)]
    got = told_flags(D.flag_duplicates(as_packets(spark, rows), hot_min_rows=hot_min_rows))
    assert got == {"a": "a", "b": "b", "c": "c", "d": "c", "e": "e"}


def test_interleaved_radios_break_chains_unless_strict(spark):
    rows = [("a", 0, "p", 1, 7), ("b", 1000, "p", 2, 7), ("c", 2000, "p", 1, 7), ("d", 3000, "p", 2, 7)]
    df = as_packets(spark, rows)
    assert told_flags(D.flag_duplicates(df)) == {"a": "a", "b": "b", "c": "c", "d": "d"}
    assert told_flags(D.flag_duplicates(df, strict_keys=True)) == {"a": "a", "b": "b", "c": "a", "d": "b"}


def test_gap_is_inclusive_and_chained(spark):
    hour = 3_600_000_000
    rows = [("a", 0, "p", 1, 7), ("b", hour, "p", 1, 7), ("c", 2 * hour, "p", 1, 7), ("d", 3 * hour + 1, "p", 1, 7)]
    assert told_flags(D.flag_duplicates(as_packets(spark, rows))) == {"a": "a", "b": "a", "c": "a", "d": "d"}


@pytest.mark.parametrize("hot_min_rows", [None, 50])
def test_incremental_flags_equal_full(spark, tmp_path, hot_min_rows):
    rows = crowd(3, 600, span_s=100_000)
    df = as_packets(spark, rows)
    want = told_flags(D.flag_duplicates(df))
    cut = F.lit("2024-01-01 14:00:00").cast("timestamp")
    from aircapture.operators.maintenance import unify, upsert

    path = str(tmp_path / "base")
    unify(D.flag_duplicates(df.where(F.col("time") < cut)), df.where(F.col("time") >= cut)).write.parquet(path)
    base = spark.read.parquet(path)
    fresh = D.flag_incremental(base, hot_min_rows=hot_min_rows, slice_rows=20)
    assert fresh.count() < len(rows)
    assert told_flags(upsert(base, fresh)) == want


@pytest.mark.parametrize("hot_min_rows, slice_rows", [(None, None), (20, 7), (20, 100)])
@pytest.mark.parametrize("step_us", [1, 100_000])
def test_messages_match_model(spark, hot_min_rows, slice_rows, step_us):
    # dense enough that sessions run on much longer than one message
    rows = crowd(4, 1000, span_s=100, step_us=step_us)
    want = model.messages([((p, f, s), us, i) for i, us, p, f, s in rows])
    told = D.assign_messages(
        as_receptions(spark, rows), hot_min_rows=hot_min_rows, slice_rows=slice_rows, epoch_rows=100
    )
    assert {r["_id"]: r["message_id"] for r in told.select("_id", "message_id").collect()} == want


def test_message_window_is_anchored_not_chained(spark):
    rows = [("a", 0, "p", 1, 7), ("b", 250_000, "p", 1, 7), ("c", 500_000, "p", 1, 7), ("d", 300_000, "q", 1, 7)]
    df = as_receptions(spark, rows)
    got = {r["_id"]: [x["_id"] for x in r["rxInfo"]] for r in D.collapse_receptions(df).collect()}
    assert got == {"a": ["a", "b"], "c": ["c"], "d": ["d"]}
    assert told_flags(D.flag_duplicates(as_packets(spark, rows))) == {"a": "a", "b": "a", "c": "a", "d": "d"}
    stats = D.reception_stats(D.assign_messages(df)).first()
    assert tuple(stats) == (3, 4)


def test_a_message_is_one_row_with_the_header_of_its_first_reception(spark):
    rows = [(f"r{i:03d}", i * 1000, "p", 1, 7) for i in range(50)]
    df = as_receptions(spark, rows).withColumn(
        "rxInfo", F.col("rxInfo").withField("antenna", F.substring("_id", 2, 3).cast("int"))
    )
    (got,) = D.collapse_receptions(df).collect()
    assert got["_id"] == "r000" and got["antenna"] == 0
    assert [x["_id"] for x in got["rxInfo"]] == [r[0] for r in rows]
    told = D.message_receptions(df).orderBy("position").collect()
    assert [(r["message_id"], r["position"], r["_id"]) for r in told] == [("r000", i + 1, r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_incremental_flags_equal_a_full_run(spark, seed):
    """Late, interleaved, payload-less and time-less rows, arriving in any order."""
    rnd = random.Random(seed)
    rows = [
        (f"r{i:03d}", rnd.randrange(40) * 10_000_000, rnd.choice("pq"), 1, rnd.choice((7, 8))) for i in range(120)
    ]
    full = as_packets(spark, rows).withColumns(
        {
            "phyPayload": F.when(F.col("_id") != "r005", F.col("phyPayload")),
            "time": F.when(F.col("_id") != "r009", F.col("time")),
        }
    )
    want = told_flags(D.flag_duplicates(full, gap_minutes=1))
    new = [r[0] for r in rows if rnd.random() < 0.3] + ["r005", "r009"]
    stored = D.flag_duplicates(full.where(~F.col("_id").isin(new)), gap_minutes=1)
    none = F.lit(None).cast(stored.schema["dup_infos"].dataType)
    merged = stored.unionByName(full.where(F.col("_id").isin(new)).withColumn("dup_infos", none).select(*stored.columns))
    changed = told_flags(D.flag_incremental(merged, gap_minutes=1))
    assert {**told_flags(stored), **changed} == want


def flow_rows(seed, n, devices=4, span_days=40):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        dev = "00000000" if rnd.random() < 0.4 else f"0000000{rnd.randrange(1, devices)}"
        base = rnd.choice((0, 30_000))
        day = rnd.randrange(span_days * 24)
        us = day * 3_600_000_000 + rnd.randrange(3_000) * 1_000_000 + rnd.randrange(3) * 400
        rows.append((dev, us, f"r{i:05d}", (base + day * 3 + rnd.randrange(6)) % 65536))
    return rows


@pytest.mark.parametrize("hot_min_rows, epoch_rows", [(None, None), (100, 60), (1, 100)])
def test_flows_match_model(spark, hot_min_rows, epoch_rows):
    rows = flow_rows(5, 700)
    want = model.flows([(d, T0 + us, i, f) for d, us, i, f in rows])
    df = spark.createDataFrame([(d, T0 + us, i, f) for d, us, i, f in rows], "devAddr string, us long, _id string, fCnt long")
    df = df.select(
        "devAddr", "_id", "fCnt", F.timestamp_micros("us").alias("time"), F.lit(7).alias("SF"), F.lit("x").alias("phyPayload"),
        F.lit(False).alias("is_duplicate"), F.col("_id").alias("copy_of"),
    )
    told = W.assign_flows(df, hot_min_rows=hot_min_rows, epoch_rows=epoch_rows)
    got = {r["_id"]: (r["flow_id"], r["interpkt_time_ms"], r["fCnt_diff"]) for r in told.collect()}
    assert got == want
    assert max(f for f, _, _ in want.values()) > 3


def test_packets_of_one_millisecond_never_match(spark):
    df = spark.createDataFrame(
        [("d", T0 + us, i, f) for us, i, f in ((0, "a", 1), (300, "b", 2), (5_000_000, "c", 3))],
        "devAddr string, us long, _id string, fCnt long",
    ).select(
        "devAddr", "_id", "fCnt", F.timestamp_micros("us").alias("time"), F.lit(7).alias("SF"), F.lit("x").alias("phyPayload"),
        F.lit(False).alias("is_duplicate"), F.col("_id").alias("copy_of"),
    )
    got = {r["_id"]: r["flow_id"] for r in W.assign_flows(df).collect()}
    assert got == {"a": 0, "b": 1, "c": 0}


def test_golden_counts(spark, packets):
    """Independent counts for all modulations (see FIXTURES.md)."""
    df = decode_frames(D.flag_duplicates(packets))
    path_flows = W.infer_flow_packets(df).cache()
    flows = W.summarise_flows(path_flows).cache()
    dups = W.flow_input(df).where("is_duplicate")
    assert packets.count() == 2052
    assert df.where("dup_infos.is_duplicate").count() == 1011
    assert D.assign_messages(R.gateway_rx(spark, "/root/testdata/sf0.001")).where("_id = message_id").count() == 1041
    assert path_flows.select("devAddr").distinct().count() == 8
    assert flows.count() == 41
    assert path_flows.count() == 624 == flows.agg(F.sum("nb_pkts")).first()[0]
    assert path_flows.agg(F.sum("nb_duplicates")).first()[0] == 607
    assert W.unmatched_duplicates(path_flows, W.flow_input(df)).count() == 0 == dups.count() - 607
    assert flows.where("nb_pkts >= 5").count() == 17 and flows.where("nb_pkts >= 50").count() == 2
    assert flows.agg(F.max("nb_pkts")).first()[0] == 50


def test_summary_counts_the_first_packet(spark, packets):
    flows = W.summarise_flows(W.infer_flow_packets(decode_frames(D.flag_duplicates(packets))))
    assert flows.where("min_interpkt_time_ms <> 0").count() == 0


def test_slices_are_even_and_in_order(spark):
    rnd = random.Random(9)
    rows = [("a", int(rnd.expovariate(1e-7))) for _ in range(4000)] + [("b", 5)] * 300
    df = spark.createDataFrame([(k, us) for k, us in rows], "k string, us long").withColumn("t", F.timestamp_micros("us"))
    cuts = time_cuts(df, ["k"], "t", heavy_hashes(df, ["k"], 200), 400)
    ((_, mine),) = cuts.items()  # the smaller key needs no cut
    assert mine == sorted(set(mine)) and 8 <= len(mine) <= 10
    got = with_slice(df, ["k"], "t", cuts, "s").collect()
    assert all(r["s"] == (sum(c <= r["us"] for c in mine) if r["k"] == "a" else 0) for r in got)
    sizes = [sum(r["k"] == "a" and r["s"] == i for r in got) for i in range(len(mine) + 1)]
    assert max(sizes) < 500 and sum(sizes) == 4000
    empty = df.limit(1).withColumn("t", F.lit(None).cast("timestamp"))
    assert with_slice(empty, ["k"], "t", cuts, "s").first()["s"] is None


def test_heavy_keys_pass_the_driver_by(spark, monkeypatch):
    rows = [(f"r{i}-{j}", i * 10_000_000 + j * 200_000, f"p{i}", 1, 7) for i in range(400) for j in range(4)]
    frame = type(spark.range(1))
    told, collect = [], frame.collect

    def counted(df):
        told.append(collect(df))
        return told[-1]

    monkeypatch.setattr(frame, "collect", counted)
    flags = D.flag_duplicates(as_packets(spark, rows), hot_min_rows=3, slice_rows=2)
    messages = D.assign_messages(as_receptions(spark, rows), hot_min_rows=3, slice_rows=2)
    assert 0 < sum(map(len, told)) < 40
    monkeypatch.undo()
    assert told_flags(flags) == model.flags([(p, us, i, (f, s)) for i, us, p, f, s in rows])
    want = model.messages([((p, f, s), us, i) for i, us, p, f, s in rows])
    assert {r["_id"]: r["message_id"] for r in messages.select("_id", "message_id").collect()} == want


def test_tasks_grow_with_the_rows(spark, monkeypatch, tmp_path):
    from aircapture.operators import skew
    from aircapture.sources import flowstore

    rows = crowd(12, 1200, span_s=400_000)
    want = told_flags(D.flag_duplicates(as_packets(spark, rows)))
    plain = W.infer_flow_packets(decode_frames(D.flag_duplicates(R.packets(spark, "/root/testdata/sf0.001"))))
    expected = sorted(map(repr, plain.collect()))
    for module in (skew, flowstore):
        monkeypatch.setattr(module, "TASK_ROWS", 50)
    flags = D.flag_duplicates(as_packets(spark, rows))
    assert flags.rdd.getNumPartitions() == 24 and told_flags(flags) == want
    flows = W.infer_flow_packets(decode_frames(D.flag_duplicates(R.packets(spark, "/root/testdata/sf0.001"))))
    assert flows.rdd.getNumPartitions() > 8 and sorted(map(repr, flows.collect())) == expected
    flowstore.write_flow_packets(flows, str(tmp_path / "flows"))
    assert len(list((tmp_path / "flows").rglob("*.parquet"))) > 8


def test_heavy_keys_are_found(spark):
    df = spark.createDataFrame([("a",)] * 500 + [(f"k{i}",) for i in range(800)] + [(None,)] * 300, "k string")
    found = heavy_hashes(df, ["k"], 200)
    want = df.where("k = 'a' or k is null").select(F.xxhash64("k").alias("h")).distinct().collect()
    assert set(found) == {r["h"] for r in want}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_total_matches_model(spark, by):
    rnd = random.Random(6)
    rows = [(rnd.choice("xy"), rnd.choice((rnd.gauss(0, 3), rnd.randrange(-5, 5) * 1.0, rnd.expovariate(1e-6))), rnd.randrange(4)) for _ in range(800)]
    rows += [("x", None, 3), (None, 1.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = running_total(df, "v", F.col("w"), by).collect()
    for g in ("x", "y") if by else (None,):
        want = model.ecdf([(v, w) for h, v, w in rows if v is not None and (h == g or not by)])
        mine = sorted((r["v"], r["weight"], r["cumulative"], r["total"]) for r in got if not by or r["g"] == g)
        assert mine == want
