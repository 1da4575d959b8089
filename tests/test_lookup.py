"""Indexed look-ups give what scans give, and read few files."""

import pytest
from pyspark.sql import functions as F

from aircapture.functions import predicates as P
from aircapture.functions.text import tokens
from aircapture.sources.lookup import Lookup, write_lookup

WORDS = ["Alpha", "beta", "GAMMA", "delta", "common"]


@pytest.fixture(scope="module")
def table(spark):
    # a third of all rows share a key and a word
    text = F.concat_ws(" ", F.lit("Common!"), *(F.when(F.col("id") % (7 * (k + 1)) == k, F.lit(w)) for k, w in enumerate(WORDS[:4])))
    rows = spark.range(6000).select(
        F.concat(F.lit("r"), F.col("id")).alias("_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        F.when(F.col("id") % 11 != 0, text).alias("text"), "id",
    )
    odd = spark.createDataFrame([(None, "hot", "Alpha", -1), ("null key", None, None, -2), ("twice", "k", "beta beta", -3), ("twice", "k", "x", -4)], "_id string, k string, text string, id long")
    return rows.unionByName(odd)


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookup") / "t")
    return write_lookup(table, path, "_id", {"k": F.array("k"), "word": tokens(F.col("text"))}, 32)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_look_ups_equal_scans(spark, table, index):
    index = Lookup(spark, index.path)
    assert index.by_id("r77").collect() == table.where("_id = 'r77'").collect()
    assert ids(index.by_id("twice")) == [-4, -3] and index.by_id("nobody").collect() == []
    for key in ("hot", "k7", "nobody"):
        assert ids(index.by_key("k", key)) == ids(table.where(F.col("k") == key))
    assert ids(index.by_key("k", "k7", "k8", "k7")) == ids(table.where("k in ('k7', 'k8')"))
    for text in ("alpha", "ALPHA beta, none", "common", "nothing at all", ""):
        assert ids(index.by_any_token("word", text)) == ids(table.where(P.match_any_token("text", text))), text
    assert index.rows().count() == table.count()


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())]


def test_few_files_are_read(spark, index):
    rows, keys = (len(spark.read.parquet(f"{index.path}/{n}").inputFiles()) for n in ("rows", "keys"))
    assert rows >= 32 and keys >= 36
    (one,) = files_read(index.by_id("r77"))
    assert 1 <= one <= 3
    (two,) = files_read(index.postings("k", "k7"))
    assert 1 <= two <= 3
    (hot,) = files_read(index.postings("k", "hot"))
    assert hot <= 8 < keys
