"""Project tables as a dashboard shows them: scans, latest rows, counts, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge.functions import status_class


def project_scan(table: DataFrame, columns: list[str], project_id: object = None, order: str | None = None, limit: int | None = None) -> DataFrame:
    """The columns of one project's rows, or of all if project_id is null, "" or 0; newest first, nulls before."""
    out = table.where(F.col("project_id") == F.lit(project_id)) if project_id else table
    if order:
        out = out.orderBy(F.desc_nulls_first(order))
    return (out.limit(limit) if limit is not None else out).select(*columns)


class ProjectStore:
    """A table (project_id, …) stored so that one project is read from few files.

    Rows are in folders by a bucket of their project, and within a bucket in order of project and, newest first, of a
    time: a scan of a project names its bucket, so other folders are not opened, and in its files row groups of other
    projects are left out. Rows are dealt out by ranges, so a project of any size is written by many tasks. Null projects
    are in a bucket of their own kind. `buckets` is part of the layout: read with the number that was written.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, project: Column) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(project), F.lit(self.buckets)).cast("int"), F.lit(-1))

    def write(self, table: DataFrame, order: str) -> None:
        by = [F.col("project_bucket"), F.asc_nulls_first("project_id"), F.desc_nulls_first(order)]
        rows = table.withColumn("project_bucket", self._bucket(F.col("project_id")))
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("project_bucket").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def scan(self, columns: list[str], project_id: object, order: str | None = None, limit: int | None = None) -> DataFrame:
        """project_scan of one project."""
        table = self.table()
        wanted = F.lit(project_id).cast(table.schema["project_id"].dataType)
        own = table.where(F.col("project_bucket") == self._bucket(wanted)) if project_id else table
        return project_scan(own.drop("project_bucket"), columns, project_id, order, limit)


def top_k(df: DataFrame, order: str, n: int, tie: str) -> DataFrame:
    """The n rows with the largest `order`, nulls first; equal ones by `tie`."""
    return df.orderBy(F.desc_nulls_first(order), tie).limit(n)


def latest_n(df: DataFrame, key: str, ts: str, n: int, tie: str = "id") -> DataFrame:
    """The newest n rows of each key, with rn from 1; nulls count as newest, equal ones go by `tie`."""
    at = Window.partitionBy(key).orderBy(F.desc_nulls_first(ts), tie)
    return df.withColumn("rn", F.row_number().over(at)).where(F.col("rn") <= n)


def preview(latest: DataFrame, n: int = S.PREVIEW) -> DataFrame:
    """The first n of each list of latest_n."""
    return latest.where(F.col("rn") <= n)


def project_counts(tables: dict[str, DataFrame], cap: int | None = S.COUNT_CAP) -> DataFrame:
    """One row per project: rows of each table, at most cap each (None: all), 0 where there are none."""
    counted = None
    for name, table in tables.items():
        n = table.groupBy("project_id").agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        counted = n if counted is None else counted.unionByName(n)
    if cap is not None:
        counted = counted.withColumn("n", F.least("n", F.lit(cap)))
    return counted.groupBy("project_id").pivot("table", list(tables)).agg(F.sum("n")).fillna(0)


def pipeline_counters(jobs: DataFrame, runs: DataFrame, last_n: int = S.LATEST["jobs"], last_runs: int = S.LATEST["runs"], full_history: bool = False) -> DataFrame:
    """Per project, over its latest jobs: running, queued and failed (FAILED or BLOCKED), and the number of latest runs."""
    own = jobs if full_history else latest_n(jobs, "project_id", "updated_at", last_n)
    some = runs if full_history else latest_n(runs, "project_id", "created_at", last_runs)
    count = own.groupBy("project_id").agg(
        F.count_if(F.col("status") == "RUNNING").alias("running"), F.count_if(F.col("status") == "QUEUED").alias("queued"), F.count_if(F.col("status").rlike("FAILED|BLOCKED")).alias("failed")
    )
    return count.join(some.groupBy("project_id").agg(F.count("*").alias("runs")), "project_id", "full").fillna(0)


def queue_overview(sources: dict[str, tuple[DataFrame, str, int]]) -> DataFrame:
    """(project_id, list, rn, id, status): the latest rows of each source (rows, time column, limit) as one table."""
    out = None
    for name, (rows, ts, n) in sources.items():
        part = latest_n(rows, "project_id", ts, n).select("project_id", F.lit(name).alias("list"), "rn", "id", "status")
        out = part if out is None else out.unionByName(part)
    return out


def status_distribution(rows: DataFrame, kind: Column | str = "kind") -> DataFrame:
    """Rows per project, kind and class of status."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return rows.groupBy("project_id", kind.alias("kind"), status_class(F.col("status")).alias("status_class")).agg(F.count("*").alias("n"))


def assignment_doc_suggest(documents: DataFrame) -> DataFrame:
    """(project_id, suggested): place, from 1, of the newest document that looks like the assignment, else 1."""
    at = Window.partitionBy("project_id").orderBy(F.desc_nulls_first("created_at"), "id")
    said = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("document_type", F.lit("")))
    rows = documents.withColumn("rn", F.row_number().over(at))
    return rows.groupBy("project_id").agg(F.coalesce(F.min(F.when(said.rlike("(?iu)ТЗ|техническ|assignment"), F.col("rn"))), F.lit(1)).alias("suggested"))


def launch_eligibility(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, n_documents, eligibility): a separate assignment needs two documents; none, no launch."""
    n = documents.groupBy("project_id").agg(F.count("*").alias("n_documents"))
    out = projects.select("project_id").join(n, "project_id", "left").fillna(0, ["n_documents"])
    return out.withColumn("eligibility", F.when(F.col("n_documents") == 0, "refused").when(F.col("n_documents") == 1, "single_document").otherwise("separate_assignment"))


def recover_stale(jobs: DataFrame, as_of: str, minutes: int = S.LEASE_MINUTES) -> DataFrame:
    """Running jobs whose lease is older: next_status QUEUED, or FAILED once max_attempts are used; attempts unchanged."""
    stale = jobs.where((F.col("status") == "RUNNING") & (F.col("locked_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))))
    return stale.withColumn("next_status", F.when(F.col("attempts") >= F.col("max_attempts"), "FAILED").otherwise("QUEUED"))
