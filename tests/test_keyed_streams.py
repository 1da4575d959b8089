"""Streams with keyed state: merged messages, duplicate flags, chains and calendar weeks, over restarts and late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_order_dependent import T0, crowd

from aircapture import schema
from aircapture.operators import aggregates, duplicates
from aircapture.streaming import jobs

RX = "_id string, us long, phyPayload string, frequency long, sf int"


def gateway_rows(spark, rows):
    """(id, us after T0, payload, frequency, sf) as raw receptions."""
    df = spark.createDataFrame([(i, None if us is None else T0 + us, p, f, s) for i, us, p, f, s in rows], RX)
    fields = {
        "mac": F.concat(F.lit("gw"), F.col("_id")), "time": F.timestamp_micros("us"), "timestamp": F.col("us"),
        "rssi": F.length("_id"), "antenna": F.length("_id"), "frequency": F.col("frequency"), "codeRate": F.lit("4/5"),
        "dataRate": F.struct(F.lit(125000).cast("long").alias("bandwidth"), F.col("sf").alias("spreadFactor"), F.lit("LORA").alias("modulation")),
    }
    kind = spark.createDataFrame([], schema.GATEWAY_RX).schema["rxInfo"].dataType
    rx = F.struct(*(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
    return df.select("_id", "phyPayload", rx.alias("rxInfo"))


def packet_rows(spark, rows):
    df = spark.createDataFrame([(i, None if us is None else T0 + us, p, f, s) for i, us, p, f, s in rows], RX)
    lora = F.struct(F.lit(125000).cast("long").alias("bandwidth"), F.col("sf").alias("spreadingFactor"), F.lit("C_4_5").alias("codeRate"))
    tx = F.struct("frequency", F.struct(F.lit("LORA").alias("type"), lora.alias("lora")).alias("modulation"))
    return df.select("_id", F.timestamp_micros("us").alias("time"), "phyPayload", tx.alias("txInfo"))


CLOCK = ("clock", 10**13, "clock", 1, 7)


def deliveries(rows, by=3):
    """In time order but for a few rows, each followed by a run of the stream to its end."""
    ordered = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1])
    size = -(-len(ordered) // by)
    cuts = [ordered[i : i + size] for i in range(0, len(ordered), size)]
    cuts[0][-3:], cuts[1][:3] = cuts[1][:3], cuts[0][-3:]
    cuts[0] += [r for r in rows if r[1] is None]
    return [*cuts, [CLOCK]]


def run_over(spark, tmp_path, make, stream_of, parts):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in parts:
        make(spark, part).coalesce(1).write.mode("append").parquet(source)
        with jobs.state_on_disk(spark):
            jobs.run_available(stream_of(spark.readStream.schema(make(spark, []).schema).parquet(source)), out, check)
    return spark.read.parquet(out)


def test_merged_messages_equal_the_batch_over_restarts(spark, tmp_path):
    rows = crowd(8, 400, span_s=40) + [("null time", None, "p", 1, 7), ("null payload", 5, None, 1, 7)]
    want = duplicates.collapse_receptions(gateway_rows(spark, rows))
    got = run_over(spark, tmp_path, gateway_rows, jobs.stream_messages, deliveries(rows))
    got = got.where("_id <> 'clock'").select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.where(F.size("rxInfo") > 2).count() > 10


def test_a_message_waits_for_the_rest_of_its_window(spark, tmp_path):
    ms = 1000
    # the run ends in mid-window: the second part has receptions of a message whose first one waits in state
    first = [("a", 0, "p", 1, 7), ("b", 200 * ms, "p", 1, 7), ("x", 50 * ms, "q", 1, 7)]
    second = [("c", 300 * ms, "p", 1, 7), ("d", 301 * ms, "p", 1, 7), ("e", 100 * ms, "p", 1, 7)]
    got = run_over(spark, tmp_path, gateway_rows, jobs.stream_messages, [first, second, [CLOCK]])
    told = {r["_id"]: [x["_id"] for x in r["rxInfo"]] for r in got.where("_id <> 'clock'").collect()}
    assert told == {"a": ["a", "e", "b", "c"], "d": ["d"], "x": ["x"]}


@pytest.mark.parametrize("strict", [False, True])
def test_flags_equal_the_batch_over_restarts(spark, tmp_path, strict):
    rows = crowd(5, 400, span_s=4 * 3600) + [("null time", None, "p", 1, 7), ("null payload", 5, None, 1, 7)]
    want = duplicates.flag_duplicates(packet_rows(spark, rows), gap_minutes=10, strict_keys=strict)
    want = {r["_id"]: (r["dup_infos"]["is_duplicate"], r["dup_infos"]["copy_of"]) for r in want.collect()}
    of = lambda s: jobs.stream_flags(s, 10, strict, delay="10 minutes")
    got = run_over(spark, tmp_path, packet_rows, of, deliveries(rows, 4)).where("_id <> 'clock'").collect()
    assert {r["_id"]: (r["is_duplicate"], r["copy_of"]) for r in got} == want and len(got) == len(rows)
    assert sum(d for d, _ in want.values()) > 20


@pytest.mark.parametrize("strict", [None, False, True])
def test_state_is_kept_by_bucket_and_not_by_key(spark, tmp_path, strict):
    # 300 payloads, with text that must come back as it was
    rows = [(f"r{i}", i * 1000, f'p "{i}" \\ |-', 1, 7) for i in range(300)] + [("a|", 5, "-", None, None), (None, 7, "", 1, 7), CLOCK]
    make = gateway_rows if strict is None else packet_rows
    make(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(make(spark, []).schema).parquet(str(tmp_path / "in"))
    stream = jobs.stream_messages(source, buckets=4) if strict is None else jobs.stream_flags(source, strict_keys=strict, buckets=4)
    with jobs.state_on_disk(spark):
        query = jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    kept = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 1 <= max(kept) <= 4
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    if strict is None:
        assert {(r["_id"], r["phyPayload"], r["rxInfo"][0]["mac"]) for r in got} == {(i, p, i and f"gw{i}") for i, _, p, _, _ in rows[:-1]}
    else:
        assert {(r["_id"], r["copy_of"], r["is_duplicate"]) for r in got if r["_id"]} == {(r[0], r[0], False) for r in rows[:-1] if r[0]}
        assert len(got) == 302


def test_chains_equal_strict_flags(spark, tmp_path):
    rows = crowd(6, 400, span_s=4 * 3600)
    flags = duplicates.flag_duplicates(packet_rows(spark, rows), gap_minutes=10, strict_keys=True)
    want = {r["copy_of"]: r["nb_duplicates"] for r in duplicates.dups_per_original(flags).collect()}
    got = run_over(spark, tmp_path, packet_rows, lambda s: jobs.stream_chains(s, 10, "10 minutes"), deliveries(rows))
    assert {r["copy_of"]: r["nb_duplicates"] for r in got.where("copy_of <> 'clock'").collect()} == want


def test_weeks_follow_the_zone_over_both_changes_of_the_clock(spark, tmp_path):
    hours = [dt.datetime(2024, 3, 20) + dt.timedelta(hours=h) for h in range(24 * 20)]
    hours += [dt.datetime(2024, 10, 20) + dt.timedelta(hours=h, minutes=30) for h in range(24 * 14)]
    hours += [dt.datetime(2024, 12, 30)]  # moves the watermark past all weeks before

    def packets(spark, times):
        df = spark.createDataFrame([(t, 7 + k % 2) for k, t in enumerate(times)], "t timestamp_ntz, sf int").select(F.col("t").cast("timestamp").alias("t"), "sf")
        return df.select(
            F.col("t").alias("time"), F.struct(F.col("t").alias("time"), F.lit("CRC_OK").alias("crcStatus")).alias("rxInfo"),
            F.struct(F.struct(F.lit("LORA").alias("type"), F.struct(F.col("sf").alias("spreadingFactor")).alias("lora")).alias("modulation")).alias("txInfo"),
            F.struct(F.lit(False).alias("is_duplicate")).alias("dup_infos"),
        )

    stream = lambda s: jobs.stream_weekly(s, "txInfo.modulation.lora.spreadingFactor", "SF")
    got = run_over(spark, tmp_path, packets, stream, [hours[:300], hours[300:500], hours[500:]])
    want = aggregates.weekly_by_sf(packets(spark, hours)).where("week < timestamp '2024-12-01'")
    assert sorted(map(repr, got.select("SF", "week", "count").collect())) == sorted(map(repr, want.select("SF", "week", "count").collect()))
    assert got.where("week = timestamp '2024-03-24 23:00:00'").agg(F.sum("count")).collect()[0][0] == 167
