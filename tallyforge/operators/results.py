"""From planned checks and their results to one status per task. Missing work is uncertainty, never success."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge.functions import blocks_progress, is_blank, result_json
from tallyforge.sources import folders, rename_folder

RESULT = ["task_id", "agent", "status", "findings", "evidence_ids", "message"]


def reject_unplanned(results: DataFrame, planned: DataFrame, run: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rejected results have a reason, the agent's before the task's.

    `run` names the column of the task that collected the result: its plan must have the agent, and the result's own
    task_id must be the same.
    """
    agents = planned.select(F.col("task_id").alias("_run"), F.col("agent").alias("_agent")).distinct().withColumn("_planned", F.lit(True))
    seen = results.join(agents, (F.col(run) == F.col("_run")) & (F.col("agent") == F.col("_agent")), "left")
    unplanned = F.concat(F.lit(S.UNPLANNED_AGENT), F.coalesce("agent", F.lit("")))
    reason = F.when(F.col("_planned").isNull(), unplanned).when(~F.col("task_id").eqNullSafe(F.col(run)), S.OTHER_TASK)
    seen = seen.withColumn("reason", reason).drop("_run", "_agent", "_planned")
    return seen.where("reason is null").drop("reason"), seen.where("reason is not null")


def reject_wrong_owner(dispatched: DataFrame) -> DataFrame:
    """Rows (task_id, agent, result_task_id, result_agent) with reason; null where the owner is right."""
    wrong = ~(F.col("task_id").eqNullSafe(F.col("result_task_id")) & F.col("agent").eqNullSafe(F.col("result_agent")))
    return dispatched.withColumn("reason", F.when(wrong, S.WRONG_OWNER))


def fill_missing(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Results of planned agents, with a synthetic UNCERTAINTY row for each planned agent that has none."""
    got = results.select("task_id", "agent", *[c for c in RESULT[2:] if c in results.columns])
    out = planned.select("task_id", "plan_pos", "agent").join(got.withColumn("_there", F.lit(True)), ["task_id", "agent"], "left")
    said = F.concat(F.lit(S.NO_HANDLER), "agent", F.lit("."))
    missing = F.col("_there").isNull()
    return out.withColumns({"status": F.when(missing, "UNCERTAINTY").otherwise(F.col("status")), "message": F.when(missing, said).otherwise(F.col("message")), "synthetic": missing}).drop("_there")


def missing_agents(planned: DataFrame, results: DataFrame) -> DataFrame:
    """(task_id, n_missing, missing): planned agents without a result, sorted."""
    left = planned.select("task_id", "agent").distinct().join(results.select("task_id", "agent").distinct(), ["task_id", "agent"], "left_anti")
    return left.groupBy("task_id").agg(F.count("*").alias("n_missing"), F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("missing"))


def any_status(*wanted: str) -> Column:
    return F.coalesce(F.bool_or(F.col("status").isin(*wanted)), F.lit(False))


def final_status(planned: DataFrame, results: DataFrame, materials: DataFrame | None = None) -> DataFrame:
    """(task_id, status) of every planned task.

    Blank assignment or no material: BLOCK. Else ERROR, BLOCK, UNCERTAINTY, WARNING in this order if any result
    has it; UNCERTAINTY if a planned agent has no result; else ACCEPTED. Results of unplanned agents do not
    count. Without `materials` the plan's own check of them stands. Both sides are first summed to a row per task,
    at most a few agents and statuses each, and meet on task_id, by which plan_checks has dealt its rows already.
    """
    expected = planned.groupBy("task_id").agg(F.collect_set("agent").alias("expected"), F.max("tz").alias("tz"))
    got = results.groupBy("task_id").agg(F.collect_set(F.struct("agent", "status")).alias("got"))
    rows = expected.join(got, "task_id", "left")
    own = F.filter(F.coalesce("got", F.array().cast(got.schema["got"].dataType)), lambda r: F.array_contains("expected", r["agent"]))
    rows = rows.withColumns({"_statuses": F.transform(own, lambda r: r["status"]), "_missing": F.size(F.array_except("expected", F.transform(own, lambda r: r["agent"]))) > 0})
    blocked = is_blank(F.col("tz"))
    if materials is not None:
        rows = rows.join(materials.select("task_id").distinct().withColumn("_there", F.lit(True)), "task_id", "left")
        blocked = blocked | F.col("_there").isNull()
    status = F.when(blocked, "BLOCK")
    for s in ("ERROR", "BLOCK", "UNCERTAINTY", "WARNING"):
        status = status.when(F.array_contains("_statuses", s), s)
    return rows.select("task_id", status.when(F.col("_missing"), "UNCERTAINTY").otherwise("ACCEPTED").alias("status"))


def task_status(tasks: DataFrame, planned: DataFrame, results: DataFrame, materials: DataFrame) -> DataFrame:
    """(task_id, status) of every task, planned or not.

    Blank assignment or no material: BLOCK. A task that planning rejects for another reason has no check that could
    accept it: UNCERTAINTY. Else what final_status says.
    """
    there = materials.select("task_id").distinct().withColumn("_there", F.lit(True))
    rows = tasks.select("task_id", "tz").join(there, "task_id", "left").join(final_status(planned, results), "task_id", "left")
    blocked = is_blank(F.col("tz")) | F.col("_there").isNull()
    return rows.select("task_id", F.when(blocked, "BLOCK").otherwise(F.coalesce("status", F.lit("UNCERTAINTY"))).alias("status"))


def run_summary(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Per task, in result order, duplicates kept: completed_agents, blocking_agents and results as arrays."""
    expected = planned.groupBy("task_id").agg(F.collect_set("agent").alias("expected"))
    rows = results.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", *RESULT))).alias("r"))
    own = F.filter(F.coalesce("r", F.array().cast(rows.schema["r"].dataType)), lambda x: F.array_contains("expected", x["agent"]))
    out = expected.join(rows, "task_id", "left").withColumn("r", own)
    return out.select(
        "task_id",
        F.transform("r", lambda x: x["agent"]).alias("completed_agents"),
        F.transform(F.filter("r", lambda x: blocks_progress(x["status"])), lambda x: x["agent"]).alias("blocking_agents"),
        F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in RESULT])).alias("results"),
    )


def summary_json(summary: DataFrame, status: DataFrame) -> DataFrame:
    """(task_id, status, summary): the whole summary as JSON with null messages kept."""
    return summary.join(status, "task_id").select("task_id", "status", result_json("task_id", "status", "completed_agents", "blocking_agents", "results").alias("summary"))


def prior_bounds(results: DataFrame) -> DataFrame:
    """results (task_id, pos, ok) with n_prior: how many of its task's first results, by pos, a result gets to see.

    A failed result does not refresh the context: what it sees and adds appears once a later result succeeds.
    """
    task = Window.partitionBy("task_id").orderBy("pos")
    rows = results.withColumn("_rn", F.row_number().over(task))
    last_ok = F.max(F.when(F.col("ok"), F.col("_rn"))).over(task.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("n_prior", F.coalesce(last_ok, F.lit(0))).drop("_rn")


def context_refs(results: DataFrame) -> DataFrame:
    """results (task_id, pos, ok, json) with the context that each gets to see, by reference: n_prior, n_bytes and chain.

    The context is the first n_prior of its task's lines (context_lines), by pos, which are n_bytes of UTF-8 as a text.
    chain names its content: the same lines in the same order have the same chain in every task, other ones another; it
    is null without lines. See prior_bounds for what a result sees. No text is made here, so the rows grow with the
    results, however many a task has.
    """
    task = Window.partitionBy("task_id").orderBy("pos")
    upto = task.rowsBetween(Window.unboundedPreceding, 0)
    # of a line, only these two go to its task, unless the caller wants it there
    rows = results.withColumns({"_size": F.octet_length("json") + 1, "_line": F.when(F.col("json").isNotNull(), F.xxhash64("json"))})
    rows = rows.withColumn("_rn", F.row_number().over(task))
    size = F.coalesce(F.sum("_size").over(upto) - 1, F.lit(0)).cast("long")
    so_far = F.struct(F.col("_rn").alias("n"), size.alias("bytes"), F.bit_xor(F.xxhash64("_rn", "_line")).over(upto).alias("chain"))
    rows = rows.withColumn("_so_far", so_far)
    last_ok = F.max(F.when(F.col("ok"), F.col("_so_far"))).over(task.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_seen", last_ok)
    refs = {"n_prior": F.coalesce("_seen.n", F.lit(0)), "n_bytes": F.coalesce("_seen.bytes", F.lit(0)), "chain": F.lower(F.lpad(F.hex("_seen.chain"), 16, "0"))}
    return rows.withColumns(refs).drop("_size", "_line", "_rn", "_so_far", "_seen")


def context_lines(results: DataFrame) -> DataFrame:
    """(task_id, pos, json): each result's line once, which contexts of any number point to."""
    return results.select("task_id", "pos", "json")


def render_contexts(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """refs (task_id, n_prior, …) with context: the text of the first n_prior lines of their task, or NONE.

    For whoever writes texts out, in which a line is there as often as it is seen. A task's lines come together once.
    """
    of_task = lines.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", "json"))).alias("_lines"))
    seen = F.transform(F.slice("_lines", F.lit(1), F.col("n_prior")), lambda x: x["json"])
    context = F.when(F.coalesce("n_prior", F.lit(0)) == 0, "NONE").otherwise(F.array_join(seen, "\n"))
    return refs.join(of_task, "task_id", "left").withColumn("context", context).drop("_lines")


def prior_results(results: DataFrame) -> DataFrame:
    """results (task_id, pos, ok, json) with context as a text: JSON lines of earlier results, or NONE."""
    return render_contexts(prior_bounds(results), context_lines(results)).drop("n_prior")


def write_summaries(summaries: DataFrame, path: str, run_id: str) -> bool:
    """Writes a run's summaries once, as Parquet below path/run=<run_id>, a folder per status; False if the run is there already.

    They are staged in a hidden folder and get their place by one rename when whole, so readers see all of a run or
    nothing, and a run that failed anywhere may be written again: what it had staged is removed. One writer of a run
    at a time; different runs do not wait for each other.
    """
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"a run id has letters, digits, _, . and - only: {run_id!r}")
    spark = summaries.sparkSession
    place, staged = f"{path}/run={run_id}", f"{path}/_staged/{run_id}"
    if f"run={run_id}" in folders(spark, path):
        return False
    summaries.write.mode("overwrite").partitionBy("status").parquet(staged)
    return rename_folder(spark, staged, place)


def read_summaries(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """What write_summaries has written of a run."""
    return spark.read.schema("task_id string, summary string, status string").parquet(f"{path}/run={run_id}")
