"""The status of every task, kept up to date while results arrive."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources import folder_bytes, folders, remove_folder

SEVERE = ["ERROR", "BLOCK", "UNCERTAINTY", "WARNING"]
#: Bits of `said`: an agent is in its task's plan, it has a result, and which severe statuses its results have.
PLANNED, SEEN = 1, 2
BITS = {s: 4 << k for k, s in enumerate(SEVERE)}
STATE = "task_id string, agent string, said int"
#: So many deltas in a row are merged into one, and so many merged ones again.
MERGED = 16


def live_status(results: DataFrame) -> DataFrame:
    """(task_id, agent, said) of a batch's results with both ids, as bits."""
    said = F.lit(SEEN)
    for s, bit in BITS.items():
        said = said.bitwiseOR(F.when(F.col("status") == s, bit).otherwise(0))
    return results.where("task_id is not null and agent is not null").groupBy("task_id", "agent").agg(F.bit_or(said).alias("said"))


def _status_of(rows: DataFrame) -> DataFrame:
    """(task_id, status) of rows (task_id, agent, said), one for each planned agent."""
    tasks = rows.groupBy("task_id").agg(F.bit_or("said").alias("some"), F.bit_and("said").alias("all"))
    has = lambda bits, bit: F.col(bits).bitwiseAND(bit) > 0
    status = F.when(~has("all", SEEN), "UNCERTAINTY").otherwise("ACCEPTED")
    for s in reversed(SEVERE):
        status = F.when(has("some", BITS[s]), s).otherwise(status)
    return tasks.select("task_id", status.alias("status"))


class StatusTable:
    """What the planned agents of each task have said after every micro-batch, as snapshots and deltas in a shared folder.

    `base/v=…` holds all planned agents as they were after a version, `delta/v=…` only what one batch says, so that a batch
    reads and writes no more than itself; batch n makes version n + 1, and version 0 is the plan without results. Statuses
    are summed up when they are read. MERGED deltas in a row are written once more as `merged/v=<last>-<before the first>`,
    as many of these too, and so on. Once there are `every` deltas and all behind a base are as large as it, they are folded
    into a new base. So a row is written as often as the logarithm of the number of batches says, and a reader finds less
    than MERGED deltas of each width. One older base and what is behind it stay for readers that have begun, and so do the
    parts of the last merged delta; the rest is deleted. A version is there when Spark's committer has marked it whole. A
    batch that runs again finds its version and changes nothing; one that had failed half-way is written anew. All is in
    buckets by task_id, so `changes` reads only those that its batch touches.

    Results of agents that a task's plan does not have do not count. Results without task_id are no task's.
    """

    def __init__(self, spark: SparkSession, folder: str, planned: DataFrame | None = None, buckets: int = 16, every: int = 8) -> None:
        self.spark, self.folder, self.buckets, self.every = spark, folder, buckets, every
        if planned is not None and not self._versions("base"):
            # a check without an agent is waited for by nobody
            said = F.when(F.col("agent").isNull(), PLANNED | SEEN).otherwise(PLANNED)
            self._write(planned.where("task_id is not null").select("task_id", "agent", said.alias("said")), self._path("base", 0))

    def _versions(self, kind: str) -> list[int]:
        return sorted(int(found[1]) for name in folders(self.spark, f"{self.folder}/{kind}", whole=True) if (found := re.fullmatch(r"v=(\d+)", name)))

    def _path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/v={version:08d}"

    def _deltas(self) -> list[tuple[int, int, str]]:
        """(before, last, path) of all deltas: of the versions after `before` up to `last`."""
        merged = [m for name in folders(self.spark, f"{self.folder}/merged", whole=True) if (m := re.fullmatch(r"v=(\d+)-(\d+)", name))]
        return [(v - 1, v, self._path("delta", v)) for v in self._versions("delta")] + [(int(m[2]), int(m[1]), f"{self.folder}/merged/{m[0]}") for m in merged]

    def _upto(self, version: int | None = None) -> tuple[int, list[tuple[int, int, str]]]:
        """The newest base up to a version, and the deltas behind it, each as wide as there is."""
        bases, deltas = self._versions("base"), self._deltas()
        newest = max([*bases, *(last for _, last, _ in deltas)], default=0)
        version = newest if version is None else min(version, newest)
        bases = [v for v in bases if v <= version]
        at, found = bases[-1] if bases else -1, []
        while bases and (next_ := min((d for d in deltas if d[0] >= at and d[1] <= version), key=lambda d: (d[0], -d[1]), default=None)):
            found.append(next_)
            at = next_[1]
        if at != version:
            raise ValueError(f"no version {version} in {self.folder}")
        return bases[-1], found

    def _write(self, rows: DataFrame, path: str, planned: bool = False) -> None:
        """Writes a row for each agent of a task, or for each planned one, of rows (task_id, agent, said); a bucket is written by as many tasks as there are for it."""
        places = self.buckets * max(int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets, 1)
        rows = rows.withColumn("place", F.pmod(F.xxhash64("task_id"), F.lit(places)).cast("int")).repartitionById(places, "place")
        rows = rows.groupBy("place", "task_id", "agent").agg(F.bit_or("said").alias("said"))
        rows = rows.where(F.col("said").bitwiseAND(PLANNED) > 0) if planned else rows
        rows.select("task_id", "agent", "said", F.pmod("place", F.lit(self.buckets)).alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _read(self, paths: list[str], spark: SparkSession) -> DataFrame:
        out = None
        for path in paths:
            rows = spark.read.schema(f"{STATE}, bucket int").parquet(path)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _rows(self, version: int | None, spark: SparkSession) -> DataFrame:
        """Rows of the newest base up to a version and of the deltas behind it."""
        base, deltas = self._upto(version)
        return self._read([self._path("base", base), *(path for _, _, path in deltas)], spark)

    @staticmethod
    def _planned(rows: DataFrame) -> DataFrame:
        """A row for each planned agent of a task, from rows of a base and deltas."""
        # tasks come together once, for their agents and for the tasks
        rows = rows.repartition("task_id").groupBy("task_id", "agent").agg(F.bit_or("said").alias("said"))
        return rows.where(F.col("said").bitwiseAND(PLANNED) > 0)

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Takes in a micro-batch of results (task_id, agent, status), for foreachBatch."""
        version, spark = number + 1, batch.sparkSession
        if version <= max(self._versions("base")) or any(before < version <= last for before, last, _ in self._deltas()):
            return
        self._write(live_status(batch), self._path("delta", version))
        base, deltas = self._upto()
        if len(deltas) >= self.every and sum(folder_bytes(self.spark, path) for _, _, path in deltas) >= folder_bytes(self.spark, self._path("base", base)):
            self._fold(version, spark)
        else:
            self._merge(deltas, spark)

    def _fold(self, version: int, spark: SparkSession) -> None:
        self._write(self._rows(version, spark), self._path("base", version), planned=True)
        *older, last, _ = self._versions("base")
        for path in [*(self._path("base", v) for v in older), *(path for _, to, path in self._deltas() if to <= last)]:
            remove_folder(self.spark, path)

    def _merge(self, deltas: list[tuple[int, int, str]], spark: SparkSession) -> None:
        before = [d for d in self._deltas() if d[1] - d[0] > 1]
        while len(own := deltas[-MERGED:]) == MERGED and len({last - first for first, last, _ in own}) == 1:
            whole = (own[0][0], own[-1][1], f"{self.folder}/merged/v={own[-1][1]:08d}-{own[0][0]:08d}")
            self._write(self._read([path for _, _, path in own], spark), whole[2])
            deltas = [*deltas[:-MERGED], whole]
            for first, last, path in self._deltas():
                if any(a <= first and last <= b and path != of for a, b, of in before):
                    remove_folder(self.spark, path)

    def status(self, version: int | None = None) -> DataFrame:
        """(task_id, status) of every planned task after a version that is still there, or the newest: what final_status gives for the results so far."""
        return _status_of(self._planned(self._rows(version, self.spark)))

    def changes(self, version: int) -> DataFrame:
        """(task_id, status) of the planned tasks for whose agents the batch of a version has results."""
        touched = self.spark.read.schema(f"{STATE}, bucket int").parquet(self._path("delta", version))
        rows = self._planned(self._rows(version, self.spark).join(touched.select("bucket", "task_id").distinct(), ["bucket", "task_id"], "left_semi"))
        own = touched.select("task_id", "agent").withColumn("_own", F.lit(True))
        own = rows.join(own, ["task_id", "agent"], "left_semi").select("task_id").distinct()
        return _status_of(rows).join(own, "task_id", "left_semi")


def stream_status(results: DataFrame, table: StatusTable, checkpoint: str) -> None:
    """Runs a stream of results (task_id, agent, status) over all that is there, a version of the table for each micro-batch."""
    results.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").foreachBatch(table.upsert).start().awaitTermination()
