"""Flows inferred run by run are the flows of one run."""

import model
import pytest
from pyspark.sql import functions as F
from test_order_dependent import T0, flow_rows

from aircapture.operators import flows as W
from aircapture.operators.flowruns import FlowRuns

IN = "devAddr string, us long, _id string, fCnt long, is_duplicate boolean, copy_of string"


def flow_input(spark, rows):
    df = spark.createDataFrame([(d, None if us is None else T0 + us, i, f, c is not None, c or i) for d, us, i, f, c in rows], IN)
    return df.select("devAddr", "_id", "fCnt", F.timestamp_micros("us").alias("time"), F.lit(7).alias("SF"), F.lit("x").alias("phyPayload"), "is_duplicate", "copy_of")


def parts_of(rows, n):
    """Rows cut at n - 1 instants, so that packets of one millisecond are delivered together."""
    times = sorted({r[1] // 1000 for r in rows})
    ends = [times[len(times) * k // n] for k in range(1, n)]
    cuts = [[] for _ in range(n)]
    for r in rows:
        cuts[sum(r[1] // 1000 >= e for e in ends)].append(r)
    return cuts


@pytest.mark.parametrize("hot_min_rows, epoch_rows", [(None, None), (50, 40)])
def test_runs_equal_one_run(spark, tmp_path, hot_min_rows, epoch_rows):
    plain = flow_rows(5, 700)
    want = model.flows([(d, T0 + us, i, f) for d, us, i, f in plain])
    rows = [(*r, None) for r in plain]
    # duplicates of each fifth packet, half of them delivered in the last run only
    copies = [(d, us + 1, f"{i}-copy", f, i) for k, (d, us, i, f) in enumerate(plain) if k % 5 == 0]
    parts = parts_of(rows, 3)
    for k, part in enumerate(parts):
        part += [c for n, c in enumerate(copies) if (n % 2 and k == 2) or (n % 2 == 0 and any(r[2] == c[4] for r in part))]
    runs = FlowRuns(spark, str(tmp_path / "flows"))
    for part in parts:
        runs.add(flow_input(spark, part), hot_min_rows=hot_min_rows, epoch_rows=epoch_rows)
    got = runs.flow_packets().collect()
    assert {r["_id"]: (r["flow_id"], r["interpkt_time_ms"], r["fCnt_diff"]) for r in got} == want
    assert {r["_id"] for r in got if r["nb_duplicates"] == 1} == {c[4] for c in copies}
    one = FlowRuns(spark, str(tmp_path / "one"))
    one.add(flow_input(spark, rows + copies))
    assert sorted(map(repr, runs.flows().collect())) == sorted(map(repr, one.flows().collect()))
    assert sorted(map(repr, one.flow_packets().collect())) == sorted(map(repr, runs.flow_packets().collect()))
    told = [tuple(r) for r in runs.commits().orderBy("run").select("run", "late").collect()]
    assert told == [(1, 0), (2, 0), (3, 0)] and runs.last_run() == 3


def test_late_packets_are_kept_apart_and_counted(spark, tmp_path):
    runs = FlowRuns(spark, str(tmp_path / "flows"))
    s = 1_000_000
    runs.add(flow_input(spark, [("d", 10 * s, "b", 2, None), ("e", 10 * s, "x", 1, None)]))
    # of d: one packet before its last one, one in the same millisecond with a smaller id, one with a larger id, one later
    late = [("d", 5 * s, "a", 1, None), ("d", 10 * s + 7, "ab", 3, None)]
    runs.add(flow_input(spark, late + [("d", 10 * s, "c", 3, None), ("d", 20 * s, "d", 3, None), ("f", 1 * s, "y", 9, None), ("d", None, "z", 9, None)]))
    assert {r["_id"] for r in runs.late_packets().collect()} == {"a", "ab"}
    assert [tuple(r) for r in runs.commits().orderBy("run").collect()] == [(1, 2, 0, 0), (2, 3, 2, 0)]
    got = {r["_id"]: r["flow_id"] for r in runs.flow_packets().collect()}
    assert got == {"b": 0, "c": 1, "d": 0, "x": 0, "y": 0}
    # a device that sends nothing keeps its state: e goes on two runs later
    runs.add(flow_input(spark, [("e", 12 * s, "x2", 2, None), ("e", 13 * s, "copy", 2, "x2")]))
    assert {(r["devAddr"], r["flow_id"], r["nb_pkts"], r["nb_duplicates"]) for r in runs.changed_flows().collect()} == {("e", 0, 2, 1)}


def test_an_interrupted_run_is_done_again(spark, tmp_path):
    rows = [(*r, None) for r in flow_rows(6, 300)]
    first, second = parts_of(rows, 2)
    runs = FlowRuns(spark, str(tmp_path / "flows"))
    runs.add(flow_input(spark, first))
    # what a run that died before its commit may have left
    for name in ("folded", "packets", "states", "copies", "late"):
        spark.range(5).write.parquet(f"{tmp_path}/flows/{name}/run=2")
    assert runs.last_run() == 1 and runs.flow_packets().count() == len(first)
    runs.add(flow_input(spark, second))
    want = W.assign_flows(flow_input(spark, rows)).select("_id", "flow_id")
    assert sorted(runs.flow_packets().select("_id", "flow_id").collect()) == sorted(want.collect())
    # an empty delivery is a run too
    assert runs.add(flow_input(spark, [])) == 3 and runs.flow_packets().count() == len(rows)
