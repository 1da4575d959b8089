"""Point look-ups without a full scan: rows in buckets by id, and posting lists by key."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aircapture.functions.text import tokens


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _bloom(name: str) -> dict[str, str]:
    return {f"parquet.bloom.filter.enabled#{name}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def write_lookup(df: DataFrame, path: str, row_id: str, keys: dict[str, Column], buckets: int = 64) -> Lookup:
    """Write the look-up table of a DataFrame to ``path``, which must not exist.

    ``rows`` has the rows, numbered, in ``buckets`` folders by a hash of the id,
    sorted by it. ``keys`` has, for each name in ``keys`` (columns of arrays of
    strings), one posting (key, number and bucket of the row) per different key
    of a row, in folders by name and hash of the key, sorted. Both have Bloom
    filters on what is looked up, so that a file without it is not read beyond
    its footer. Postings of a key that very many rows have are dealt to several
    files. A row with a null id is found by its keys only.
    """
    spark = df.sparkSession
    rows = df.withColumns({"_row": F.monotonically_increasing_id(), "_bucket": _bucket(F.col(row_id), buckets)})
    (
        rows.repartitionByRange("_bucket", row_id).sortWithinPartitions("_bucket", row_id)
        .write.options(**_bloom(row_id)).partitionBy("_bucket").parquet(f"{path}/rows")
    )
    # from what is written, so that the numbers are those of the table
    found = F.array(*(F.struct(F.lit(n).alias("name"), F.array_distinct(F.array_compact(c)).alias("found")) for n, c in keys.items()))
    postings = spark.read.parquet(f"{path}/rows").select(F.col("_row").alias("row"), F.col("_bucket").alias("row_bucket"), F.explode(found).alias("n"))
    postings = postings.select("row", "row_bucket", F.col("n.name").alias("name"), F.explode("n.found").alias("key"))
    postings = postings.withColumn("key_bucket", _bucket(F.col("key"), buckets))
    order = ["name", "key_bucket", "key", "row_bucket", "row"]
    (
        postings.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.options(**_bloom("key")).partitionBy("name", "key_bucket").parquet(f"{path}/keys")
    )
    about = {"row_id": row_id, "buckets": buckets}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
    return Lookup(spark, path)


@dataclass(frozen=True)
class Lookup:
    """A written look-up table."""

    spark: SparkSession
    path: str

    def _about(self) -> tuple[str, int]:
        about = json.loads(self.spark.read.text(f"{self.path}/about").first()[0])
        return about["row_id"], about["buckets"]

    def rows(self) -> DataFrame:
        """The rows with their number and bucket (``_row``, ``_bucket``)."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def by_id(self, value) -> DataFrame:
        """Rows of an id: one folder is listed, and of its files those whose Bloom filter may have it are read."""
        row_id, buckets = self._about()
        wanted = F.lit(value).cast(self.rows().schema[row_id].dataType)
        return self.rows().where((F.col("_bucket") == _bucket(wanted, buckets)) & (F.col(row_id) == wanted)).drop("_bucket", "_row")

    def postings(self, name: str, *values: str) -> DataFrame:
        """(key, row, row_bucket) of each key asked for, from the folders of their hashes only."""
        _, buckets = self._about()
        found = self.spark.read.parquet(f"{self.path}/keys").where(F.col("name") == name)
        hit = F.lit(False)
        for v in values:
            hit = hit | ((F.col("key_bucket") == _bucket(F.lit(v), buckets)) & (F.col("key") == v))
        return found.where(hit).select("key", "row", "row_bucket")

    def by_key(self, name: str, *values: str) -> DataFrame:
        """Rows that have at least one of the keys: their postings, joined back by bucket and number.

        Few postings are sent to the rows by the planner, which then reads the
        buckets they name; many, as of a very common key, meet them in a join.
        """
        wanted = self.postings(name, *values).select(F.col("row").alias("_row"), F.col("row_bucket").alias("_bucket"))
        return self.rows().join(wanted, ["_bucket", "_row"], "left_semi").drop("_bucket", "_row")

    def by_any_token(self, name: str, text: str) -> DataFrame:
        """Rows of which the named token list has at least one word of ``text``, ignoring case."""
        words = self.spark.range(1).select(F.array_distinct(tokens(F.lit(text))).alias("w")).first()["w"]
        return self.by_key(name, *[w for w in words if w])
