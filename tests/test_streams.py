"""Streams give what the batch operators give, over restarts and late rows."""

import model
from pyspark.sql import functions as F
from test_order_dependent import T0, crowd

from aircapture.operators.decode import decode_incremental
from aircapture.streaming import jobs

RX = "_id string, us long, phyPayload string, frequency long, spreadFactor int"


def receptions(spark, rows):
    df = spark.createDataFrame([(i, T0 + us, p, f, s) for i, us, p, f, s in rows], RX)
    return df.select(
        "_id", "phyPayload", F.timestamp_micros("us").alias("time"), "frequency",
        F.lit(125000).cast("long").alias("bandwidth"), "spreadFactor", F.lit("4/5").alias("codeRate"),
    )


def test_collapse_over_several_batches(spark, tmp_path):
    rows = crowd(8, 500, span_s=60)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    want = model.messages([((p, f, s), us, i) for i, us, p, f, s in rows])
    ordered = sorted(rows, key=lambda r: r[1])
    # three deliveries that overlap by less than the delay, each followed by a run to its end
    cuts = [ordered[:200], ordered[200:350], ordered[350:]]
    cuts[0][-5:], cuts[1][:5] = cuts[1][:5], cuts[0][-5:]
    clock = [("clock", 10_000_000_000, "clock", 1, 7)]
    for part in (*cuts, clock):
        receptions(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_collapse(
            spark.readStream.schema(receptions(spark, []).schema).parquet(source), delay="10 seconds", buckets=8
        )
        jobs.run_available(stream, out, check)
    got = {r["_id"]: r["message_id"] for r in spark.read.parquet(out).collect()}
    assert got == want


def test_decode_restarts_where_it_stopped(spark, packets, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for lo, hi in (("2024-01-01", "2024-01-15"), ("2024-01-15", "2024-03-01")):
        packets.where((F.col("time") >= lo) & (F.col("time") < hi)).write.mode("append").parquet(source)
        jobs.run_available(jobs.stream_decode(spark.readStream.schema(packets.schema).parquet(source)), out, check)
    batch = decode_incremental(packets).where("extra_infos.version is not null")
    cols = ["_id", "extra_infos"]
    got = spark.read.parquet(out).where("extra_infos.version is not null").select(cols)
    assert got.exceptAll(batch.select(cols)).count() == 0 and got.count() == batch.count()
