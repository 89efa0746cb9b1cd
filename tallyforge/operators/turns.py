"""Agent message logs as turns, requests and accepted actions, in batch."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge import schemas as S
from tallyforge.sources import ranged, written

TURN = ["thread_id", "turn_id"]


def fill_ids(messages: DataFrame) -> DataFrame:
    """Null thread and turn ids become those of the connection's last message that had them.

    Messages are dealt out by ranges of (connection, seq), so a connection may have any number of them. Ids are carried
    forward within each range; of the ranges, a row each, follows what a range's first connection had before, and that is
    given to those of its rows that are still without. A connection without ids keeps nulls; a null connection is one.
    """
    name = messages.columns
    rows = written(ranged(messages, ["connection", "seq"]).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    so_far = Window.partitionBy("_part", "connection").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in TURN})
    ends = filled.groupBy("_part").agg(F.min_by(F.struct("connection"), "_row").alias("head"), F.max_by(F.struct("connection", *TURN), "_row").alias("tail"))
    # one row for each range; a range's last connection begins in it unless it is also the last one of the range before
    in_order = Window.orderBy("_part")
    before = F.lag("tail.connection").over(in_order)
    same = lambda a, b: a.eqNullSafe(b) & F.lag("_part").over(in_order).isNotNull()
    begun = ~(same(F.col("tail.connection"), before) & F.col("head.connection").eqNullSafe(F.col("tail.connection")))
    ends = ends.withColumns({"_begun": begun.cast("int"), "_goes_on": same(F.col("head.connection"), before)}).withColumn("_run", F.sum("_begun").over(in_order))
    carried = Window.partitionBy("_run").orderBy("_part")
    ends = ends.withColumns({f"_{c}": F.last(f"tail.{c}", ignorenulls=True).over(carried) for c in TURN})
    ends = ends.select("_part", F.col("head.connection").alias("_head"), *[F.when(F.col("_goes_on"), F.lag(f"_{c}").over(in_order)).alias(f"_{c}") for c in TURN])
    met = filled.join(F.broadcast(ends), "_part", "left")  # as many rows as there were tasks
    given = {c: F.coalesce(c, F.when(F.col("connection").eqNullSafe(F.col("_head")), F.col(f"_{c}"))) for c in TURN}
    return met.withColumns(given).select(*name)


def cutoff_at_completion(messages: DataFrame) -> DataFrame:
    """Without what follows the first turn/completed of a turn."""
    end = F.min(F.when(F.col("method") == "turn/completed", F.col("seq"))).over(Window.partitionBy(*TURN))
    return messages.withColumn("_end", end).where("_end is null or seq <= _end").drop("_end")


def _assembled(rows: DataFrame) -> DataFrame:
    """Turns of messages none of which come after the end."""
    is_delta = (F.col("method") == "item/agentMessage/delta") & F.col("delta").isNotNull()
    is_item = (F.col("method") == "item/completed") & (F.col("item_type") == "agentMessage") & (F.col("item_text") != "")
    part = F.when(is_delta, F.col("delta")).when(is_item, F.col("item_text"))
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("seq", is_delta.alias("delta"), part.alias("part")))))
    end = F.col("method") == "turn/completed"
    turns = rows.groupBy(*TURN).agg(
        parts.alias("p"), F.bool_or(end).alias("completed"), F.max(F.when(end, F.col("turn_status"))).alias("turn_status"), F.max(F.when(end, F.col("turn_error"))).alias("turn_error"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    used = F.filter("p", lambda x, i: x["delta"] | (i == 0))
    return turns.withColumn("text", F.array_join(F.transform(used, lambda x: x["part"]), "")).select(*TURN, "text", "completed", "turn_status", "turn_error", "first_ts", "last_ts")


def reassemble_turns(messages: DataFrame) -> DataFrame:
    """(thread_id, turn_id, text, completed, turn_status, turn_error, first_ts, last_ts), one row per turn.

    The text is all deltas in order, an empty one too. A completed agent message counts only if it is not empty
    and nothing came before it. Messages after the turn's end are ignored. Messages without ids belong to the turn
    that their connection was in.
    """
    return _assembled(cutoff_at_completion(fill_ids(messages) if "connection" in messages.columns else messages))


def ended_turns(messages: DataFrame, as_of: str | None = None, seconds: int = S.TURN_TIMEOUT_S) -> DataFrame:
    """(thread_id, turn_id, text, turn_status, turn_error, timed_out) of the turns that are over, as a stream gives them.

    A turn is over with its first turn/completed or, timed out, with the first message that comes more than `seconds`
    after its first one, whichever has the smaller seq; what follows is ignored for good, and so is the late message. A turn
    without either is over, timed out, if its time is up at as_of. Messages bear their own ids here.
    """
    turn = Window.partitionBy(*TURN)
    late = F.unix_millis("ts") > F.unix_millis(F.min("ts").over(turn)) + seconds * 1000
    end = F.min(F.when(F.col("_late") | (F.col("method") == "turn/completed"), F.col("seq"))).over(turn)
    rows = messages.withColumn("_late", late).withColumn("_end", end)
    over = rows.where("seq = _end").groupBy(*[F.col(c).alias(f"_{c}") for c in TURN]).agg(F.bool_or("_late").alias("_late"))
    done = _assembled(rows.where("not _late and (_end is null or seq <= _end)"))
    up = F.lit(False) if as_of is None else F.unix_millis(F.lit(as_of).cast("timestamp")) > F.unix_millis("first_ts") + seconds * 1000
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TURN]
    met = done.join(over, same[0] & same[1], "left").withColumn("timed_out", F.coalesce("_late", F.when(up, True)))
    return met.where("timed_out is not null").select(*TURN, "text", "turn_status", "turn_error", "timed_out")


def flag_timeouts(turns: DataFrame, as_of: str, seconds: int = S.TURN_TIMEOUT_S) -> DataFrame:
    """turns with timed_out: not completed within the time, as seen at as_of."""
    late = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("first_ts") > seconds
    return turns.withColumn("timed_out", ~F.col("completed") & late)


def pair_requests(requests: DataFrame, responses: DataFrame, seconds: int = S.TURN_TIMEOUT_S) -> DataFrame:
    """requests (id, ts) with outcome: ok, failed (the response has an error) or timed_out; result {} if missing.

    Only the first response in time counts.
    """
    met = responses.select("id", F.col("ts").alias("response_ts"), "error", "result")
    joined = requests.join(met, "id", "left").withColumn("_in_time", F.col("response_ts").between(F.col("ts"), F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))))
    best = joined.groupBy("id", "ts").agg(F.min(F.when(F.col("_in_time"), F.struct("response_ts", "error", "result"))).alias("r"))
    outcome = F.when(F.col("r").isNull(), "timed_out").when(F.col("r.error").isNotNull(), "failed").otherwise("ok")
    return best.select("id", "ts", outcome.alias("outcome"), F.when(F.col("r").isNotNull(), F.coalesce("r.result", F.lit("{}"))).alias("result"))


def cooldown(actions: DataFrame, key: str, ts: str, seconds: int = S.COOLDOWN_S) -> DataFrame:
    """actions (key, ts, id) with accepted and remaining (whole seconds, rounded up, 0 if accepted).

    An action is accepted if that much time has gone since the last accepted one of its key; equal times go by id.
    Actions are dealt out by ranges of (key, ts, id), so one key's may fill all tasks. In a range, keys that begin there
    are judged at once. What the range's first key comes to depends on its last acceptance before: that is said as a
    step function (last acceptance before to last acceptance in the range), which has at most as many steps as there
    are actions in one cooldown. The functions are applied one after the other, a value for each range, and the ranges'
    first keys are judged with it. A null key is one. No rows in, no rows out.
    """
    wait = seconds * 1_000_000
    rows = ranged(actions.select(key, ts, "id", F.unix_micros(F.col(ts)).alias("_at")), [key, "_at", "id"])
    schema = T.StructType([*rows.schema]).add("accepted", "boolean").add("remaining", "long").add("_part", "integer").add("_row", "long").add("_head", "boolean")
    schema = schema.add("_upto", T.ArrayType(T.LongType())).add("_exit", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, head, now, last = TaskContext.get().partitionId(), 0, [], None, None

        def out(batch: pa.RecordBatch, judged: tuple | None, steps: tuple | None = None) -> pa.RecordBatch:
            nonlocal row
            n = batch.num_rows
            accepted, remaining = judged or (pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()))
            lists = [pa.array([s.tolist()] + [None] * (n - 1), pa.list_(pa.int64())) for s in steps] if steps else [pa.nulls(n, pa.list_(pa.int64()))] * 2
            place = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(np.full(n, judged is None))]
            row += n
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(remaining, pa.int64()), *place, *lists], schema.names)

        def of_head() -> Iterator[pa.RecordBatch]:
            steps = exits(np.concatenate([b.column("_at").to_numpy() for b in head]), wait)
            for k, batch in enumerate(head):
                yield out(batch, None, None if k else steps)
            head.clear()

        first, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(key).to_pylist()
            if not begun:
                first, begun, in_head = own[0], True, True
            cut = 0
            if in_head:
                cut = next((k for k, x in enumerate(own) if x != first), len(own))
                if cut:
                    head.append(batch.slice(0, cut))
                if cut == len(own):
                    continue
                in_head = False
                yield from of_head()
            rest = batch.slice(cut)
            keys = own[cut:]
            *judged, now, last = judge(keys, rest.column("_at").to_pylist(), wait, now, last)
            yield out(rest, tuple(judged))
        if head:
            yield from of_head()

    first_pass = written(rows.mapInArrow(run, schema))
    # one row for each range: its first key and that key's steps, its last key, and when that was last accepted if it begins here
    ends = first_pass.groupBy("_part").agg(
        F.min_by(key, "_row").alias("head"), F.max_by(key, "_row").alias("tail"), F.max_by("_at", F.when(F.col("accepted"), F.col("_row"))).alias("exit"),
        F.min_by("_upto", F.when(F.col("_upto").isNotNull(), F.col("_row"))).alias("upto"), F.min_by("_exit", F.when(F.col("_upto").isNotNull(), F.col("_row"))).alias("exits"),
    )

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, begun, entry = None, False, None
        for batch in batches:
            found = []
            for k, (part, head, tail, exit_) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_part", "head", "tail", "exit")))):
                entry = carried[1] if begun and carried[0] == head else None
                found.append((part, entry))
                if exit_ is None:
                    upto, exits_ = (batch.column(c)[k].values.to_numpy() for c in ("upto", "exits"))
                    at = 0 if entry is None else int(np.searchsorted(upto, entry + wait))
                    exit_ = int(exits_[at]) if at < len(upto) else entry
                carried, begun = (tail, exit_), True
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int64())], ["_part", "_entry"])

    entries = ends.coalesce(1).sortWithinPartitions("_part").mapInArrow(compose, "_part int, _entry long")
    heads = first_pass.where("_head").join(F.broadcast(entries), "_part").select(key, ts, "id", "_at", "_part", "_entry")
    heads = heads.repartition("_part").sortWithinPartitions("_part", "_at", "id")  # a range again, none larger than before
    judged = heads.drop("_part", "_entry", "_at").schema.add("accepted", "boolean").add("remaining", "long")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            parts, at, entry = (batch.column(c).to_pylist() for c in ("_part", "_at", "_entry"))
            accepted, remaining = [], []
            for lo, hi in pairwise([k for k in range(len(parts)) if not k or parts[k] != parts[k - 1]] + [len(parts)]):
                if parts[lo] != now:
                    now, last = parts[lo], entry[lo]
                a, r, _, last = judge([now] * (hi - lo), at[lo:hi], wait, now, last)
                accepted += a
                remaining += r
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, ts, "id")), pa.array(accepted, pa.bool_()), pa.array(remaining, pa.int64())], judged.names)

    return first_pass.where("not _head").select(*judged.names).unionByName(heads.mapInArrow(settle, judged))


def judge(keys: list, at: list[int], wait: int, now: object, last: int | None) -> tuple[list[bool], list[int], object, int | None]:
    """(accepted, remaining, last key, its last acceptance) of actions in order; now and last are those of the actions before."""
    accepted, remaining = [], []
    for own, t in zip(keys, at):
        if own != now:
            now, last = own, None
        left = 0 if last is None else wait - (t - last)
        accepted.append(left <= 0)
        remaining.append(max(0, -(-left // 1_000_000)))
        if left <= 0:
            last = t
    return accepted, remaining, now, last


def exits(at: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, exit): if the first acceptance in these actions is one up to this time (and after the step before), this is the last one.

    What is accepted next after an action follows from it alone, so each leads to a last one: found by doubling. An
    entry can put the first acceptance off to the first action a cooldown after the first one, but no further.
    """
    n = len(at)
    onward = np.searchsorted(at, at + wait)
    onward = np.where(onward < n, np.maximum(onward, np.minimum(np.arange(n) + 1, n - 1)), np.arange(n))
    while True:
        further = onward[onward]
        if (further == onward).all():
            break
        onward = further
    most = min(int(np.searchsorted(at, at[0] + wait)), n - 1) + 1
    upto, last = at[:most], at[onward[:most]]
    ends = np.append(last[1:] != last[:-1], True)
    return upto[ends], last[ends]
