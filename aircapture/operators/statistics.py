"""Distributions and correlations of flows and packets."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aircapture.functions.predicates import flow_quality
from aircapture.operators.flows import flow_series
from aircapture.operators.skew import running_total

# Fixed value: two-sided 95 % quantile of the normal distribution.
_Z95 = 1.959963984540054


def ecdf(df: DataFrame, value: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Empirical distribution: one row per distinct value with its (weighted) share at or below it."""
    w = None if weight is None else F.col(weight)
    return running_total(df, value, w, by).withColumn("ecdf", F.col("cumulative") / F.col("total"))


def _span() -> Column:
    return F.col("fCnt_last") - F.col("fCnt_1st")


def prr_span(flows: DataFrame) -> DataFrame:
    """Add ``prr``: packets over counter span, null for flows of one packet."""
    return flows.withColumn("prr", F.when(_span() != 0, F.col("nb_pkts") / _span()))


def mean_interpkt(flows: DataFrame) -> DataFrame:
    """Add ``mean_interpkt_time_ms``: duration over counter span."""
    lasted = (F.unix_micros("time_last") - F.unix_micros("time_1st")) / 1000
    return flows.withColumn("mean_interpkt_time_ms", F.when(_span() != 0, lasted / _span()))


def flow_reception(flow_packets: DataFrame) -> DataFrame:
    """Per flow: reception rate, usual spreading factor, mean duplicates and number of packets."""
    return (
        flow_packets.groupBy("devAddr", "flow_id")
        .agg(
            F.avg("fCnt_diff").alias("_step"),
            F.bround(F.avg("SF")).cast("int").alias("SF"),
            F.avg("nb_duplicates").alias("nb_duplicates"),
            F.count("*").alias("nb_pkts"),
        )
        .withColumn("prr", F.when(F.col("_step") != 0, 1 / F.col("_step")))
        .select("devAddr", "flow_id", "prr", "SF", "nb_duplicates", "nb_pkts")
    )


def prr_by_sf(flows: DataFrame, flow_packets: DataFrame) -> DataFrame:
    """Distribution of the reception rate per spreading factor, weighted by packets."""
    rates = flow_reception(flow_series(flows, flow_packets))
    return ecdf(rates, "prr", "nb_pkts", ["SF"])


def prr_vs_dups(flows: DataFrame, flow_packets: DataFrame) -> DataFrame:
    return flow_reception(flow_series(flows, flow_packets)).select(
        "devAddr", "flow_id", "prr", "nb_duplicates", "nb_pkts"
    )


def _ceil_seconds(ms: Column) -> Column:
    return F.ceil(ms / 1000)


def interpkt_ecdf(flows: DataFrame) -> DataFrame:
    """Distributions of the mean and the median packet interval, in whole seconds."""
    timed = mean_interpkt(flows)
    both = timed.select(
        F.explode(
            F.array(
                F.struct(F.lit("mean").alias("kind"), _ceil_seconds(F.col("mean_interpkt_time_ms")).alias("seconds")),
                F.struct(
                    F.lit("median").alias("kind"), _ceil_seconds(F.col("median_interpkt_time_ms")).alias("seconds")
                ),
            )
        ).alias("x")
    ).select("x.*")
    return ecdf(both, "seconds", by=["kind"])


def duration_ecdf(flows: DataFrame) -> DataFrame:
    """Distribution of the duration of flows, in seconds rounded up to hours."""
    lasted = (F.unix_micros("time_last") - F.unix_micros("time_1st")) / 1_000_000
    return ecdf(flows.select((F.ceil(lasted / 3600) * 3600).alias("seconds")), "seconds")


def flow_interpkt_ecdf(chosen: DataFrame, flow_packets: DataFrame) -> DataFrame:
    """Distribution of the packet intervals (in seconds) of each chosen flow."""
    series = flow_series(chosen, flow_packets).withColumn("seconds", F.col("interpkt_time_ms") / 1000)
    return ecdf(series, "seconds", by=["devAddr", "flow_id"])


def dups_ecdf(flows: DataFrame, flow_packets: DataFrame, min_pkts: int = 5) -> DataFrame:
    """Distribution of the number of duplicates over the packets of good flows."""
    kept = flows.where(flow_quality(min_pkts))
    return ecdf(flow_series(kept, flow_packets), "nb_duplicates")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation ``r`` of two columns, the number of pairs ``n``, the ``t`` statistic, and the two-sided ``p`` value
    under independence (null for fewer than three pairs)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    r, n = F.col("r"), F.col("n")
    return (
        df.where(both)
        .agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
        .withColumn("t", F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r))))
        .withColumn("p", F.when((n > 2) & r.isNotNull(), correlation_p_value(r, n)))
    )


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n > 2 pairs: the incomplete beta function of 1 - r^2 at ((n - 2) / 2, 1 / 2).

    Below the distribution's middle by its continued fraction, which is exact
    where p is small; above it as one minus the series of the other tail, whose
    terms are all positive.
    """
    a, b = (n - 2) / 2, 0.5
    y = F.least(r * r, F.lit(1.0))
    # x^a (1 - x)^b / B(a, b) with x = 1 - y
    front = F.exp(a * F.log1p(-y) + F.log(y) / 2 + _log_gamma_step(a)) / F.lit(math.sqrt(math.pi))
    # convergents from the tail: 1 / (1 + d1 / (1 + d2 / ...))
    x = 1 - y

    def convergent(value: Column, i: Column) -> Column:
        m = F.floor(i / 2)
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return 1 + F.when(i % 2 == 1, odd).otherwise(even) / value

    below = front / a / F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), convergent)

    def term(acc: Column, k: Column) -> Column:
        nxt = acc["term"] * (a + b + k) / (b + 1 + k) * y
        return F.struct(nxt.alias("term"), (acc["sum"] + nxt).alias("sum"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    above = 1 - front / b * F.aggregate(F.sequence(F.lit(0), F.lit(_TERMS)), one, term)["sum"]
    p = F.when(x < (a + 1) / (a + b + 2), below).otherwise(F.greatest(above, F.lit(0.0)))
    return F.when(y >= 1, 0.0).when(y == 0, 1.0).otherwise(p)


#: Convergents and terms that are taken; both settle long before.
_TERMS = 400


def _log_gamma_step(a: Column) -> Column:
    """log(Gamma(a + 1/2) / Gamma(a)) for a > 0, by its series at a + 10, where that is exact to 13 digits."""
    z = a + 10
    far = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, 3)) - 1 / (640 * F.pow(z, 5)) + 17 / (14336 * F.pow(z, 7))
    for k in range(10):
        far = far + F.log((a + k) / (a + (k + 0.5)))
    return far


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns, all in one aggregation."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(x, y).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)]
    return one.select(F.inline(F.array(*cells)))


def _binned(df: DataFrame, column: str, bins: int) -> Column:
    """Index 0 .. bins-1 of equal steps between the extremes, the largest value in the last one."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    lo, hi = ends.select(F.col("lo").cast("double")).scalar(), ends.select(F.col("hi").cast("double")).scalar()
    at = F.floor((F.col(column) - lo) * bins / (hi - lo))
    return F.when(hi == lo, 0).otherwise(F.least(at, F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts of a column in ``bins`` equal steps between its extremes."""
    known = df.where(F.col(column).isNotNull())
    return known.groupBy(_binned(known, column, bins).alias("bin")).agg(F.count("*").alias("count"))


def density_grid(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Counts of a pair of columns on a grid of equal steps."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(_binned(known, x, bins).alias("x_bin"), _binned(known, y, bins).alias("y_bin")).agg(
        F.count("*").alias("count")
    )


def pair_matrix(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """All histograms and pair grids of the columns: x, y, x_bin, y_bin, count of each cell that is not empty.

    Where x = y, the histogram of a column (y_bin is null); else y comes before
    x in ``columns``, the lower half of the matrix. Steps are equal between the
    extremes of a column. One scan gives the extremes; a second one sends each
    row's cells, at most one per histogram and pair, to one aggregation that
    sums them in the tasks first.
    """
    ends = df.agg(*(f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))))
    ends = ends.select(F.struct("*")).scalar()

    def bin_of(i: int, c: str) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        at = F.floor((F.col(c) - lo) * bins / (hi - lo))
        return F.when(F.col(c).isNotNull(), F.when(hi == lo, 0).otherwise(F.least(at, F.lit(bins - 1)))).cast("int")

    binned = df.select(*(bin_of(i, c).alias(f"b{i}") for i, c in enumerate(columns)))
    none = F.lit(None).cast("int")
    cells = [F.when(F.col(f"b{i}").isNotNull(), _cell(c, c, F.col(f"b{i}"), none)) for i, c in enumerate(columns)]
    for j, i in combinations(range(len(columns)), 2):
        known = F.col(f"b{i}").isNotNull() & F.col(f"b{j}").isNotNull()
        cells.append(F.when(known, _cell(columns[i], columns[j], F.col(f"b{i}"), F.col(f"b{j}"))))
    exploded = binned.select(F.inline(F.array_compact(F.array(*cells))))
    return exploded.groupBy("x", "y", "x_bin", "y_bin").agg(F.count("*").alias("count"))


def _cell(x: str, y: str, x_bin: Column, y_bin: Column) -> Column:
    return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), x_bin.alias("x_bin"), y_bin.alias("y_bin"))


def mean_ci(counts: DataFrame, key: str, value: str = "count") -> DataFrame:
    """Mean of daily counts per key with its 95 % normal interval."""
    half = _Z95 * F.col("sd") / F.sqrt("n")
    return (
        counts.groupBy(key)
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))
        .select(key, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), "n")
    )


#: Of 2^32 equally likely numbers, how many are below the one that first gives 1, 2, ... as a Poisson(1) weight.
_POISSON = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(9)]


def bootstrap_ci(counts: DataFrame, key: str, unit: str, value: str = "count", replicas: int = 200) -> DataFrame:
    """Mean of daily counts per key with its 95 % interval by resampling.

    A Poisson bootstrap: in each replica a row counts as often as a Poisson(1)
    number, drawn from the hash of key, ``unit`` (its day) and replica, so a
    rerun, on any partitioning, gives the same. All replicas are one aggregation,
    partial before its exchange. Ends are the exact 2.5 and 97.5 % points of the
    replicas' means, interpolated.
    """
    name = F.concat_ws("|", F.col(key).cast("string"), F.col(unit).cast("string"), F.col("replica").cast("string"))
    drawn = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")
    weight = sum(((drawn >= end).cast("int") for end in _POISSON), F.lit(0))
    rows = counts.select(key, unit, value, F.explode(F.sequence(F.lit(1), F.lit(replicas))).alias("replica")).withColumn("w", weight)
    means = rows.groupBy(key, "replica").agg(F.sum(F.col("w") * F.col(value)).alias("s"), F.sum("w").alias("n"))
    means = means.where(F.col("n") > 0).groupBy(key).agg(
        F.percentile(F.col("s") / F.col("n"), F.array(F.lit(0.025), F.lit(0.975))).alias("ends")
    )
    plain = counts.groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return plain.join(means, key).select(key, "mean", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"), "n")


# ---------------------------------------------------------------- distributions that can be merged


def monthly_sketches(df: DataFrame, value: str, time: str = "time", k: int = 400) -> DataFrame:
    """year, month, n, sketch: a KLL sketch of a whole-number column for each month.

    A table of these answers for any run of months without the rows
    (:func:`merged_quantiles`). Nulls are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.year(time).alias("year"), F.month(time).alias("month"), F.col(value).cast("long").alias("v"))
    return rows.groupBy("year", "month").agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint("v", k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, at: list[float]) -> DataFrame:
    """q, value: the value at each share of all rows of the given months, by merging their sketches.

    The rank of a value differs from its share by less than 0.01 with a
    probability of 99 % at k = 400, however many sketches are merged.
    """
    whole = sketches.agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n"))
    # a merged sketch of nothing has no quantiles to ask for
    found = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q)))) for q in at]
    told = [F.struct(F.lit(float(q)).alias("q"), value.alias("value")) for q, value in zip(at, found, strict=True)]
    return whole.select(F.inline(F.array(*told))).where("value is not null")
