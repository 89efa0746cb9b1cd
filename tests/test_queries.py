"""Every registered audit query against its SQL."""

import datetime

import pytest
from compare import plain

from tallyforge import plans, streaming
from tallyforge.operators import dashboard


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(plans.ORACLE[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got[columns].astype(object).values) == plain(want[columns].astype(object).values)


def test_stream_leases_equal_batch(spark, sf):
    streamed = plans.QUERIES["st4_stream_leases"](spark, sf).collect()
    jobs = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id as id", "if(event_type = 'click', 'RUNNING', 'x') as status", "ts as locked_at", "event_id % 5 as attempts", "3 as max_attempts")
    end = jobs.selectExpr("cast(max(locked_at) - interval 1 minute as string)").first()[0]
    batch = {r.id: r.next_status for r in dashboard.recover_stale(jobs, end).collect()}
    assert streamed and {r.id: r.next_status for r in streamed} == batch


def test_stream_leases_out_of_order(spark, tmp_path):
    """An older state that comes late changes nothing, a finished job is not stale, a renewed one not before its time."""
    schema = "id long, status string, attempts long, max_attempts long, locked_at timestamp"
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    batches = [
        [(1, "RUNNING", 0, 3, at(5)), (2, "RUNNING", 3, 3, at(5)), (3, "RUNNING", 0, 3, at(5)), (4, "RUNNING", 0, 3, at(5))],
        [(1, "RUNNING", 0, 3, at(9)), (3, "COMPLETED", 0, 3, at(7)), (4, "RUNNING", 1, 3, at(12))],
        [(1, "RUNNING", 2, 3, at(8)), (3, "RUNNING", 0, 3, at(6))],
        [(9, "COMPLETED", 0, 3, at(21))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = streaming.run_available(streaming.stream_stale_leases(stream), str(tmp_path / "out"), "update")
    assert sorted((r.id, r.next_status) for r in out.collect()) == [(1, "QUEUED"), (2, "FAILED")]


def test_stream_turns_time_out_once_and_end(spark, tmp_path):
    from tallyforge import schemas as S

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    delta = lambda seq, s, turn, text: ("c", seq, at(s), "item/agentMessage/delta", "th", turn, text, None, None, None, None)
    batches = [[delta(0, 0, "slow", "a"), delta(1, 10, "done", "b"), ("c", 2, at(20), "turn/completed", "th", "done", None, None, None, "completed", None)], [delta(3, 1100, "other", "x")], [delta(4, 1150, "slow", "late")], [delta(5, 5000, "other", "y")], [delta(6, 9000, "last", "z")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, S.MESSAGES).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(S.MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = streaming.run_available(streaming.stream_turns(stream), str(tmp_path / "out"), "update")
    got = sorted((r.turn_id, r.text, r.timed_out) for r in out.collect())
    assert got.count(("slow", "a", True)) == 1 and ("done", "b", False) in got and all(r[1] != "late" for r in got)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
