"""p-values, pair matrices, the traffic cube, resampled intervals and merged sketches against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aircapture.operators import aggregates as A
from aircapture.operators import sampling as K
from aircapture.operators import statistics as X
from aircapture.plans import relations as R


def plain_p(r, n, steps=200_000):
    """Two-sided tail of Student's distribution by Simpson's rule over u = t / (1 + t), far enough to be small itself."""
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def density(u):
        x = t + u / (1 - u)
        return norm * math.exp(-(df + 1) / 2 * math.log1p(x * x / df)) / (1 - u) ** 2

    h = (1 - 1e-9) / steps
    inner = sum((4 if i % 2 else 2) * density(i * h) for i in range(1, steps))
    return 2 * h / 3 * (density(0) + inner + density(1 - 1e-9))


@pytest.mark.parametrize("n", [3, 4, 5, 12, 160, 5000, 200_000])
def test_p_value_equals_an_integral(spark, n):
    ts = [0.01, 0.5, 1.2, 2.0, 4.0, 8.0]
    rs = [t / math.sqrt(n - 2 + t * t) for t in ts]
    df = spark.createDataFrame([(r * s, n) for r in rs for s in (1, -1)], "r double, n long").select("r", X.correlation_p_value(F.col("r"), F.col("n")).alias("p"))
    got = {r["r"]: r["p"] for r in df.collect()}
    for r in rs:
        assert got[r] == got[-r] == pytest.approx(plain_p(r, n, 20_000), rel=2e-6)


def test_p_value_at_the_ends(spark):
    df = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.0, 9), (0.9999999, 10**9), (1e-9, 10**12)], "r double, n long")
    got = [r["p"] for r in df.select(X.correlation_p_value(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got[:3] == [0.0, 0.0, 1.0] and got[3] == 0.0 and 0.99 < got[4] <= 1
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 5.0)], "x double, y double")
    assert X.pearson(two, "x", "y").first()["p"] is None
    assert X.pearson(two.limit(0), "x", "y").first()["p"] is None


def test_pair_matrix_equals_a_plain_count(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, rng.gauss(0, 1)]), rng.randrange(5), 7, rng.expovariate(1.0)) for _ in range(500)]
    names, bins = ["a", "b", "c", "d"], 6
    df = spark.createDataFrame(rows, "a double, b int, c int, d double")
    ends = [(min(r[i] for r in rows if r[i] is not None), max(r[i] for r in rows if r[i] is not None)) for i in range(4)]
    at = lambda i, v: 0 if ends[i][0] == ends[i][1] else min(math.floor((v - ends[i][0]) * bins / (ends[i][1] - ends[i][0])), bins - 1)
    want = Counter()
    for r in rows:
        for i in range(4):
            if r[i] is None:
                continue
            want[names[i], names[i], at(i, r[i]), None] += 1
            for j in range(i):
                if r[j] is not None:
                    want[names[i], names[j], at(i, r[i]), at(j, r[j])] += 1
    got = {(r["x"], r["y"], r["x_bin"], r["y_bin"]): r["count"] for r in X.pair_matrix(df, names, bins).collect()}
    assert got == want
    assert X.pair_matrix(df.limit(0), names).collect() == []
    nothing = spark.createDataFrame([(None, 1)], "a double, b int")
    assert [tuple(r) for r in X.pair_matrix(nothing, ["a", "b"]).collect()] == [("b", "b", 0, None, 1)]


def test_pair_matrix_contains_histogram_and_grid(spark, packets):
    flat = K.flatten_fields(packets)
    cells = X.pair_matrix(flat, ["rssi", "loRaSNR"], 8).cache()
    one = {r["bin"]: r["count"] for r in X.histogram(flat, "rssi", 8).collect()}
    assert {r["x_bin"]: r["count"] for r in cells.where("x = 'rssi' and y = 'rssi'").collect()} == one
    two = {(r["x_bin"], r["y_bin"]): r["count"] for r in X.density_grid(flat, "loRaSNR", "rssi", 8).collect()}
    assert {(r["x_bin"], r["y_bin"]): r["count"] for r in cells.where("x = 'loRaSNR' and y = 'rssi'").collect()} == two


def test_cube_equals_its_charts_in_one_scan_and_exchange(spark, sf_dir):
    rows, lo, hi = R.enriched(spark, sf_dir), "2024-01-05", "2024-01-20"
    cube = A.traffic_cube(rows, lo, hi)
    got = {}
    for r in cube.collect():
        got.setdefault(r["chart"], {})[r["key"], r["at"]] = r["count"]
    charts = {
        "weekly_by_modulation": (A.weekly_by_modulation(rows), "modulation", "week"), "per_weekday_per_day": (A.per_weekday_per_day(rows), "day_of_week", "day"),
        "per_hour_per_day": (A.per_hour_per_day(rows), "hour", "day"), "per_weekday": (A.per_weekday(rows, lo, hi), "day_of_week", None),
        "per_hour": (A.per_hour(rows, lo, hi), "hour", None), "am_pm": (A.am_pm(rows, lo, hi), "half", None),
        "day_night": (A.day_night(rows, lo, hi), "period", None), "per_mtype": (A.per_mtype(rows), "mType", None),
    }
    for name, (chart, key, at) in charts.items():
        time = F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")
        want = {(r["key"], r["at"]): r["count"] for r in chart.select(F.col(key).cast("string").alias("key"), time.alias("at"), "count").collect()}
        assert got.pop(name) == want, name
    assert not got
    plan = A.traffic_cube(rows, lo, hi)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1


def test_bootstrap_is_repeatable_and_covers_the_mean(spark):
    rng = random.Random(1)
    rows = [(h, f"2024-01-{d:02d}", rng.randrange(100 * h, 100 * h + 50)) for h in (1, 2) for d in range(1, 29)] + [(3, "2024-01-01", 5)]
    df = spark.createDataFrame(rows, "hour int, day string, count long")
    one = sorted(map(tuple, X.bootstrap_ci(df, "hour", "day").collect()))
    assert one == sorted(map(tuple, X.bootstrap_ci(df.repartition(7, "day"), "hour", "day").collect()))
    for hour, mean, low, high, n in one[:2]:
        mine = [r[2] for r in rows if r[0] == hour]
        assert mean == pytest.approx(sum(mine) / 28) and n == 28
        normal = 1.96 * (sum((x - mean) ** 2 for x in mine) / 27 / 28) ** 0.5
        assert normal / 2 < mean - low < normal * 2 and normal / 2 < high - mean < normal * 2
    assert one[2] == (3, 5.0, 5.0, 5.0, 1)


def test_merged_sketches_are_near_the_exact_distribution(spark):
    n = 200_000
    df = spark.range(n).select(
        (F.col("id") * 7919 % n).alias("v"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 100).alias("time")
    )
    months = X.monthly_sketches(df.union(df.limit(1).withColumn("v", F.lit(None).cast("long"))), "v").cache()
    assert months.count() == 8 and months.agg(F.sum("n")).first()[0] == n
    at = [0.01, 0.1, 0.5, 0.9, 0.99]
    found = {r["q"]: r["value"] for r in X.merged_quantiles(months, at).collect()}
    assert all(abs(found[q] - q * n) < 0.01 * n for q in at)
    # of some months only, from the same table
    part = X.merged_quantiles(months.where("month <= 2"), [0.5]).first()["value"]
    assert abs(part - 0.5 * n) < 0.02 * n
    assert X.merged_quantiles(months.limit(0), [0.5]).collect() == []
