"""Flow inference run by run: each run goes on from the closing states that the run before has left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from aircapture import schema
from aircapture.operators.flows import MAX_FCNT_STEP, MAX_SILENCE_MS, _ADDED, _originals, _told, summarise_flows
from aircapture.operators.folds import flow_fold
from aircapture.operators.skew import dealt, heavy_keys, ordered_fold

_COMMIT = "run int, packets long, late long, copies long"
_STATE = "devAddr string, _state binary, last struct<ms: bigint, _id: string>"


@dataclass(frozen=True)
class FlowRuns:
    """Flows in a folder that grows by runs.

    ``packets`` are the packets of flows, ``copies`` the duplicates of each
    original, ``late`` what came too late, and ``states`` the open flows of each
    device and the position of its last packet; each in a folder of its run.
    ``commits`` has a row for each complete run. What an interrupted run has
    left is not read and is written over by the next one.
    """

    spark: SparkSession
    folder: str

    def commits(self) -> DataFrame:
        """run, packets, late, copies of each complete run."""
        try:
            return self.spark.read.schema(_COMMIT).parquet(f"{self.folder}/commits")
        except AnalysisException:  # before the first run
            return self.spark.createDataFrame([], _COMMIT)

    def last_run(self) -> int:
        return self.commits().agg(F.max("run")).first()[0] or 0

    def _runs(self, name: str) -> DataFrame:
        """A table over all complete runs, with the column ``run``."""
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*(f"{self.folder}/{name}/run={r}" for r in range(1, self.last_run() + 1)))
        return rows.withColumn("run", F.col("run").cast("int"))

    def add(
        self, packets: DataFrame, max_fcnt: int = MAX_FCNT_STEP, max_gap_ms: int = MAX_SILENCE_MS,
        hot_min_rows: int | None = None, epoch_rows: int | None = None,
    ) -> int:
        """Continue the flows with the packets of a ``flow_input``; returns the number of the run.

        Packets of a device must be later, by (milliseconds, ``_id``), than all
        its packets of earlier runs: a flow's choices are never undone. Others
        are kept apart (``late``) and counted. Their duplicates, and duplicates
        of packets of earlier runs, are counted for their original all the same.
        """
        before, run = self.last_run(), self.last_run() + 1
        originals, states, last = _originals(packets), None, None
        if before:
            stored = self.spark.read.schema(_STATE).parquet(f"{self.folder}/states/run={before}")
            states, last = stored.select("devAddr", "_state"), stored.select("devAddr", "last")
            placed = originals.join(last, "devAddr", "left")
            late = F.coalesce(F.struct(F.col("_ms").alias("ms"), "_id") <= F.col("last"), F.lit(False))
            self._write(placed.where(late).drop("last", "_us", "_ms"), "late", run)
            originals = placed.where(~late).drop("last")
        else:
            self._write(originals.limit(0).drop("_us", "_ms"), "late", run)
        hot, rows = heavy_keys(originals, ["devAddr"], hot_min_rows)
        folded = ordered_fold(
            originals, "devAddr", ["_ms", "_id"], ["_us", "fCnt"], _ADDED, flow_fold(max_fcnt, max_gap_ms),
            "time", hot, epoch_rows, states, keep_states=True, n_rows=rows,
        )
        # rows and closing states come out of one fold, so they are stored together and parted afterwards
        folded = self._write(folded, "folded", run)
        placed = folded.where("_state is null")
        told = self._write(_told(placed), "packets", run)
        ends = placed.groupBy("devAddr").agg(F.max(F.struct(F.col("_ms").alias("ms"), "_id")).alias("last"))
        if last is not None:
            ends = ends.unionByName(last).groupBy("devAddr").agg(F.max("last").alias("last"))
        self._write(folded.where("_state is not null").select("devAddr", "_state").join(ends, "devAddr"), "states", run)
        copies = packets.where("is_duplicate").groupBy(F.col("copy_of").alias("_id")).agg(F.count("*").alias("nb_duplicates"))
        copies = self._write(copies, "copies", run)
        late_rows = self.spark.read.parquet(f"{self.folder}/late/run={run}")
        commit = [(run, told.count(), late_rows.count(), copies.agg(F.sum("nb_duplicates")).first()[0] or 0)]
        self.spark.createDataFrame(commit, _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return run

    def _write(self, df: DataFrame, name: str, run: int) -> DataFrame:
        path = f"{self.folder}/{name}/run={run}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def flow_packets(self) -> DataFrame:
        """Packets of the flows of all runs (all columns of ``schema.FLOW_PACKET``)."""
        copies = self._runs("copies").groupBy("_id").agg(F.sum("nb_duplicates").alias("_n"))
        rows = self.commits().agg(F.sum("packets")).first()[0]
        told = dealt(self._runs("packets"), rows, ["_id"]).join(dealt(copies, rows, ["_id"]), "_id", "left")
        return told.withColumn("nb_duplicates", F.coalesce("_n", F.lit(0).cast("long"))).select(*schema.FLOW_PACKET_COLUMNS)

    def late_packets(self) -> DataFrame:
        """Packets that came after later ones of their device had been folded, with their run."""
        return self._runs("late")

    def flows(self) -> DataFrame:
        """One row per flow over all runs."""
        return summarise_flows(self.flow_packets())

    def changed_flows(self, run: int | None = None) -> DataFrame:
        """Summaries, over all runs, of the flows that a run (the last one) has added packets to.

        Flows that only gained duplicates of earlier packets are among them.
        """
        run = self.last_run() if run is None else run
        told = self._runs("packets")
        grown = told.where(F.col("run") == run).select("devAddr", "flow_id")
        copied = told.join(self._runs("copies").where(F.col("run") == run).select("_id"), "_id", "left_semi").select("devAddr", "flow_id")
        return summarise_flows(self.flow_packets().join(grown.union(copied).distinct(), ["devAddr", "flow_id"], "left_semi"))
