"""The operator prefix table."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aircapture import schema

PACKAGED = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "operators.tsv")


def read_operators(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Tab-separated prefix table, with or without a header line, with the bounds of each range as numbers."""
    bounds = F.split("range", r"\s+-\s+")
    rows = spark.read.schema(schema.OPERATORS).csv(path, sep="\t", header=header, comment="#", enforceSchema=True)
    return _with_bounds(rows, bounds)


def packaged_operators(spark: SparkSession) -> DataFrame:
    """The table shipped with the package (151 rows), as a local relation: executors need no file, and its
    size is known to the planner."""
    with open(PACKAGED, encoding="utf-8") as f:
        lines = [line.rstrip("\n").split("\t") for line in f if not line.startswith("#")][1:]
    columns = [part.split()[0] for part in schema.OPERATORS.split(", ")]
    cells = zip(*[(line + [None])[:5] for line in lines])
    rows = spark.createDataFrame(pa.table({name: pa.array(values, pa.string()) for name, values in zip(columns, cells)}))
    return _with_bounds(rows, F.split("range", r"\s+-\s+"))


def _with_bounds(rows: DataFrame, bounds) -> DataFrame:
    return rows.select(
        "netid",
        F.trim("prefix").alias("prefix"),
        "range",
        "name",
        "area",
        F.conv(F.trim(bounds[0]), 16, 10).cast("long").alias("lo"),
        F.conv(F.trim(bounds[1]), 16, 10).cast("long").alias("hi"),
    )
