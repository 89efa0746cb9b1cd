"""The registered streaming queries: a table replayed as a stream, its results as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import streaming
from tallyforge.operators import contract, planning
from tallyforge.plans import queries as q
from tallyforge.plans.derived import Tables, with_
from tallyforge.sources import route_messages, shared_path
from tallyforge.streaming.status import StatusTable, stream_status


def _replayed(t: Tables, rows: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """rows written once and read back as a stream, so many files at a time."""
    path = shared_path(t.spark, name)
    rows.write.parquet(path)
    reader = t.spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _run(t: Tables, stream: DataFrame, name: str, mode: str = "append", **how) -> DataFrame:
    return streaming.run_available(stream, shared_path(t.spark, name), mode, **how)


def _and_a_day_later(rows: DataFrame) -> DataFrame:
    """rows and one without ids a day after them, so that the stream's time passes all of them."""
    later = [(F.max(c) + F.expr("interval 1 day")).alias(c) if c == "ts" else F.max(F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns]
    return rows.unionByName(rows.agg(*later))


@q.query("src4_message_source", with_("messages") + " select thread_id, seq, method, md5(text) as text_md5 from messages where seq % 11 <> 7 union all select thread_id, seq, 'malformed', md5('') from messages where seq % 11 = 7")
def src4(t: Tables) -> DataFrame:
    """Lines as a stream, parsed once and routed to messages and quarantine."""
    item = F.struct(F.lit("agentMessage").alias("type"), F.col("text"))
    line = F.to_json(F.struct("method", F.struct(F.col("thread_id").alias("threadId"), F.col("turn_id").alias("turnId"), item.alias("item")).alias("params")))
    lines = t.messages.select("thread_id", "seq", F.when(F.col("seq") % 11 == 7, F.concat(F.lit("{broken"), line)).otherwise(line).alias("value"))
    good, bad = route_messages(_replayed(t, lines.withColumnRenamed("thread_id", "file"), "lines", files=3), shared_path(t.spark, "routed"))
    read = good.select("thread_id", "seq", "method", F.md5("item_text").alias("text_md5"))
    return read.unionByName(bad.select(F.col("file").alias("thread_id"), "seq", F.lit("malformed").alias("method"), F.md5(F.lit("")).alias("text_md5")))


@q.query("st1_stream_turns", with_("messages") + q._TURNS + " select thread_id, turn_id, md5(text) as text_md5, turn_status, false as timed_out from turns")
def st1_stream(t: Tables) -> DataFrame:
    out = streaming.stream_turns(_replayed(t, q._sent(t), "messages"), seconds=1_000_000, fill=True)
    return _run(t, out, "turns").select("thread_id", "turn_id", F.md5("text").alias("text_md5"), "turn_status", "timed_out")


#: Turns of every third thread never complete, and those that take over 900 seconds (three messages) do so too late.
@q.query(
    "st2_stream_timeout",
    with_("messages") + """, e as (select *, min(seq) over (partition by thread_id) as s0 from messages where not (method = 'turn/completed' and thread_id::bigint % 3 = 0)),
 d as (select *, method like '%delta' as delta, min(seq) filter (where method = 'item/completed' and text <> '' or method like '%delta') over (partition by thread_id) as first from e where (seq - s0) * 400 <= 900),
 k as (select thread_id, coalesce(string_agg(text, '' order by seq) filter (where delta or (method = 'item/completed' and text <> '' and seq = first)), '') as text, not bool_or(method = 'turn/completed') as timed_out,
  max(turn_status) filter (where method = 'turn/completed') as s from d group by 1)
 select thread_id, md5(text) as text_md5, timed_out, case when timed_out or s = 'failed' then 'ERROR' when s = 'interrupted' then 'BLOCK' else 'UNCERTAINTY' end as status,
 case when timed_out then 'Turn did not complete in time.' when s = 'failed' then 'model error' when s = 'interrupted' then 'Turn was interrupted.' else 'Output is not JSON.' end as message from k""",
)
def st2_stream(t: Tables) -> DataFrame:
    sent = q._messages(t).where(~((F.col("method") == "turn/completed") & (F.col("thread_id").cast("long") % 3 == 0)))
    out = _run(t, streaming.stream_turns(_replayed(t, _and_a_day_later(sent), "messages")), "turns", "update").drop("batch")
    ended = contract.turn_outcome(out.withColumns({"task_id": F.col("thread_id"), "agent": F.lit("report-audit-agent"), "_text": F.col("text")}))
    return ended.select("thread_id", F.md5("_text").alias("text_md5"), "timed_out", "status", "message")


#: The stream's own time ends a minute before its last lease; a later job is still running then.
@q.query(
    "st4_stream_leases",
    with_("jobs") + " select id, case when attempts >= max_attempts then 'FAILED' else 'QUEUED' end as next_status from jobs where status = 'RUNNING' and locked_at + interval 10 minute <= (select max(locked_at) from jobs) - interval 1 minute",
)
def st4_stream(t: Tables) -> DataFrame:
    jobs = t.jobs.select("id", "status", "attempts", "max_attempts", F.col("locked_at").cast("timestamp").alias("locked_at"))
    return _run(t, streaming.stream_stale_leases(_replayed(t, jobs, "jobs")), "leases", "update").select("id", "next_status")


@q.query("st5_stream_cooldown", q.ORACLE["st5_cooldown"])
def st5_stream(t: Tables) -> DataFrame:
    actions = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    out = streaming.stream_cooldown(_replayed(t, actions, "actions"), "user_id", "ts", 7200)
    return _run(t, out, "cooldown", "update").select(F.col("id").alias("event_id"), "accepted", "remaining")


@q.query("st6_live_status", q.WITH_RESULTS + q.A1_SQL)
def st6(t: Tables) -> DataFrame:
    """Results in several micro-batches, each of which brings the table up to date."""
    table = StatusTable(t.spark, shared_path(t.spark, "status"), planning.plan_checks(t.tasks, t.materials), buckets=4, every=3)
    stream = _replayed(t, t.results.select("task_id", "agent", "status"), "results", files=3)
    stream_status(stream, table, shared_path(t.spark, "checkpoints"))
    return table.status()


@q.query("j10_stream_pairs", "select q.event_id // 2 as id, a.event_id is not null as answered from events q left join events a on a.event_id = q.event_id + 1 and a.ts between q.ts and q.ts + interval 900 second where q.event_id % 2 = 0 and (a.event_id is not null)")
def j10_stream(t: Tables) -> DataFrame:
    asked, answered = q._rpc(t)
    out = streaming.stream_pairs(_replayed(t, asked, "asked"), _replayed(t, answered, "answered"))
    return _run(t, out, "pairs", "update").where("response_ts is not null").select("id", F.lit(True).alias("answered"))


@q.query("j10_stream_outcomes", q.ORACLE["j10_request_response_pairing"])
def j10_stream_outcomes(t: Tables) -> DataFrame:
    """A row per request as it comes out: nothing is summed behind the stream."""
    asked, answered = (_and_a_day_later(rows) for rows in q._rpc(t))
    out = _run(t, streaming.stream_pairs(_replayed(t, asked, "asked"), _replayed(t, answered, "answered")), "outcomes", "update")
    return out.where("id is not null").select("id", "outcome")
