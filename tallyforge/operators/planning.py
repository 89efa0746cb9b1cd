"""From tasks to planned checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge.functions import is_blank, normalize_key


def registry(spark: SparkSession) -> DataFrame:
    """The five known checks."""
    return spark.createDataFrame(S.CHECKS, S.REGISTRY)


def validate_tasks(tasks: DataFrame, materials: DataFrame) -> DataFrame:
    """tasks with has_materials and reject_reason: the first rule that fails, null for a valid task."""
    there = materials.select("task_id").distinct().withColumn("_there", F.lit(True))
    out = tasks.join(there, "task_id", "left").withColumn("has_materials", F.coalesce("_there", F.lit(False))).drop("_there")
    no_checks = F.coalesce(F.size("requested_checks"), F.lit(0)) <= 0
    failing = (is_blank(F.col("task_id")), is_blank(F.col("tz")), ~F.col("has_materials"), no_checks)
    reason = F.lit(None).cast("string")
    for fails, said in reversed(list(zip(failing, S.TASK_REASONS))):
        reason = F.when(fails, said).otherwise(reason)
    return out.withColumn("reject_reason", reason)


def valid_tasks(tasks: DataFrame, materials: DataFrame) -> DataFrame:
    return validate_tasks(tasks, materials).where("reject_reason is null").drop("reject_reason", "has_materials")


def requested(tasks: DataFrame) -> DataFrame:
    """One row per requested check: task_id, tz, pos, original, key."""
    rows = tasks.select("task_id", "tz", F.posexplode("requested_checks").alias("pos", "original"))
    return rows.withColumn("key", normalize_key(F.col("original")))


def check_lookup(tasks: DataFrame) -> DataFrame:
    """requested() with agent, skill and purpose; null where the check is unknown."""
    known = registry(tasks.sparkSession).withColumnRenamed("check", "key")
    return requested(tasks).join(F.broadcast(known), "key", "left")  # five rows


def unknown_checks(tasks: DataFrame) -> DataFrame:
    """(task_id, reason): the first unknown check of each task that has one; the whole task is rejected."""
    bad = check_lookup(tasks).where("agent is null").groupBy("task_id").agg(F.min_by("original", "pos").alias("original"))
    return bad.select("task_id", F.concat(F.lit(S.UNKNOWN_CHECK), "original").alias("reason"))


def dedupe_checks(tasks: DataFrame) -> DataFrame:
    """First occurrence of each key of a task, in order: task_id, plan_pos (from 0), key."""
    first = requested(tasks).groupBy("task_id", "key").agg(F.min("pos").alias("pos"))
    at = Window.partitionBy("task_id").orderBy("pos")
    return first.select("task_id", (F.row_number().over(at) - 1).alias("plan_pos"), "key")


def plan_checks(tasks: DataFrame, materials: DataFrame) -> DataFrame:
    """Planned checks of all valid tasks whose checks are all known; the final audit comes last if not asked for.

    Checks are deduplicated inside each task's own array, so planning shuffles only for the materials.
    """
    valid = valid_tasks(tasks, materials)
    known = F.array(*[F.lit(c[0]) for c in S.CHECKS])
    keys = F.array_distinct(F.transform("requested_checks", normalize_key))
    all_known = F.forall(keys, lambda k: F.coalesce(F.array_contains(known, k), F.lit(False)))
    final = F.when(F.array_contains(keys, S.FINAL_CHECK), keys).otherwise(F.concat(keys, F.array(F.lit(S.FINAL_CHECK))))
    rows = valid.where(all_known).select("task_id", "tz", F.posexplode(final).alias("plan_pos", "check"))
    return rows.join(F.broadcast(registry(tasks.sparkSession)), "check").select("task_id", "plan_pos", "agent", "skill", "purpose", "tz")


def append_final_audit(planned: DataFrame, tasks: DataFrame) -> DataFrame:
    """planned, and a final audit after the last check of each planned task that has none; it carries tz."""
    _, agent, skill, purpose = next(c for c in S.CHECKS if c[0] == S.FINAL_CHECK)
    last = planned.groupBy("task_id").agg((F.max("plan_pos") + 1).alias("plan_pos"), F.bool_or(F.col("agent") == agent).alias("has"))
    more = last.where("not has").join(tasks.select("task_id", "tz"), "task_id")
    return planned.unionByName(more.select("task_id", "plan_pos", F.lit(agent).alias("agent"), F.lit(skill).alias("skill"), F.lit(purpose).alias("purpose"), "tz"))
