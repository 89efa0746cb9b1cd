"""Scans over ranges of hot keys, stream processors under any cut of their input, tables kept by micro-batches, and stores."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge import sources, streaming
from tallyforge.operators import contract, dashboard, planning, results, turns
from tallyforge.streaming.status import StatusTable, stream_status

SPARK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
DELTA, ITEM, END = "item/agentMessage/delta", "item/completed", "turn/completed"

# Ranges


@pytest.fixture(scope="module")
def ranges(spark):
    """Small tables lie in several ranges too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@SPARK
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 40]), st.sampled_from([0.1, 0.6, 0.99]))
def test_ids_are_carried_over_ranges(spark, ranges, seed, n_connections, lacking):
    rng = random.Random(seed)
    some = lambda x: None if rng.random() < lacking else x
    connections = [None, *(f"c{k}" for k in range(n_connections))]
    rows = [(rng.choice(connections), seq, some(f"th{rng.randrange(5)}"), some(f"tu{rng.randrange(50)}"), "x") for seq in range(400)]
    got = {r.seq: (r.connection, r.thread_id, r.turn_id, r.other) for r in turns.fill_ids(spark.createDataFrame(rows, "connection string, seq long, thread_id string, turn_id string, other string").repartition(4)).collect()}
    want, last = {}, {}
    for c, seq, a, b, x in rows:
        before = last.get(c, (None, None))
        last[c] = (before[0] if a is None else a, before[1] if b is None else b)
        want[seq] = (c, *last[c], x)
    assert got == want


def greedy(rows, wait):
    """(accepted, remaining) by id of rows (key, micros, id)."""
    last, out = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        left = wait - (at - last[key]) if key in last else 0
        out[i] = (left <= 0, max(0, -(-left // 1_000_000)))
        if left <= 0:
            last[key] = at
    return out


@SPARK
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 30]), st.sampled_from([0, 1, 7, 60, 5000]))
def test_cooldown_over_ranges(spark, ranges, seed, n_keys, seconds):
    rng = random.Random(seed)
    keys = [None, *range(n_keys)] if n_keys > 1 else [2**60 + 1]
    rows = [(rng.choice(keys), rng.choice([rng.randrange(10**9), rng.randrange(500) * 1_000_000]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "user long, at long, id long").select("user", F.timestamp_micros("at").alias("ts"), "id").repartition(4)
    got = {r.id: (r.accepted, r.remaining) for r in turns.cooldown(df, "user", "ts", seconds).collect()}
    assert got == greedy(rows, seconds * 1_000_000)


def test_one_key_fills_all_tasks(spark, ranges):
    df = spark.range(4000).select(F.lit("k").alias("k"), F.timestamp_seconds("id").alias("ts"), "id")
    assert sources.ranged(df, ["k", "ts", "id"]).select(F.spark_partition_id()).distinct().count() == 7
    assert turns.cooldown(df, "k", "ts", 60).where("accepted").count() == 67
    assert turns.cooldown(df.limit(0), "k", "ts").count() == turns.fill_ids(spark.createDataFrame([], S.MESSAGES)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.integers(1, 30), st.integers(-40, 60))
def test_steps_say_what_a_walk_finds(times, wait, entry):
    at = np.array(sorted(times))
    entry = min(entry, int(at[0]))
    upto, last = turns.exits(at, wait)
    k = int(np.searchsorted(upto, entry + wait))
    now = entry
    for t in at.tolist():
        if t - now >= wait:
            now = t
    assert (int(last[k]) if k < len(upto) else entry) == now


# Processors, driven as Spark drives them: rows of a key, then the timers that the watermark has passed


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held if not isinstance(self.held, list) else iter(self.held)

    def update(self, x):
        self.held = x

    put = update

    def appendList(self, rows):
        self.held = [*(self.held or []), *rows]

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.timers, self.states = set(), []

    def getValueState(self, *_):
        self.states.append(Value())
        return self.states[-1]

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Now:
    def __init__(self, at):
        self.at = at

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.at


class Driven:
    """One processor for each key; run() takes a micro-batch and gives its rows, late ones left out."""

    def __init__(self, make, key, millis):
        self.make, self.key, self.millis, self.own, self.mark = make, key, millis, {}, 0

    def run(self, batch):
        out, seen = [], self.mark
        for key in sorted({self.key(r) for r in batch}, key=repr):
            rows = [r for r in batch if self.key(r) == key and self.millis(r) >= seen]
            if not rows:
                continue
            if key not in self.own:
                handle = Handle()
                self.own[key] = (self.make(), handle)
                self.own[key][0].init(handle)
            out += self._rows(self.own[key][0].handleInputRows(key, iter([pd.DataFrame(rows)]), Now(seen)))
        if batch:
            self.mark = max(self.mark, max(map(self.millis, batch)) - 60_000)
        for key, (processor, handle) in self.own.items():
            for timer in sorted(t for t in handle.timers if t <= self.mark):
                if timer in handle.timers:
                    out += self._rows(processor.handleExpiredTimer(key, Now(self.mark), Now(timer)))
                    handle.timers.discard(timer)
        return out

    @staticmethod
    def _rows(frames):
        return [r for f in frames or () for r in f.to_dict("records")]

    def held(self):
        return sum(s.held is not None for _, h in self.own.values() for s in h.states)


def cuts(rows, rng):
    """Rows in order, cut at random."""
    at = 0
    while at < len(rows):
        to = at + rng.choice([1, 1, 2, 5, 40])
        yield rows[at:to]
        at = to


def message(seq, s, turn, method=DELTA, text=None, status=None):
    return {"seq": seq, streaming.MILLIS: s * 1000, "thread_id": "th", "turn_id": turn, "method": method, "delta": text if method == DELTA else None, "item_type": "agentMessage" if method == ITEM else None, "item_text": text if method == ITEM else None, "turn_status": status, "turn_error": None}


def turn_processors(horizon=100_000):
    return Driven(lambda: streaming.TurnProcessor(900, horizon), lambda r: (r["thread_id"], r["turn_id"]), lambda r: r[streaming.MILLIS])


@pytest.mark.parametrize("rows", [
    [message(0, 0, "a", text="x"), message(1, 10, "a", END, status="completed"), message(2, 1000, "a", text="y"), message(3, 1100, "a", text="z"), message(4, 2500, "a", END, status="completed")],
    [message(0, 0, "a", text="x"), message(1, 950, "a", text="y"), message(2, 1100, "a", text="z"), message(3, 1200, "a", END, status="completed"), message(4, 4000, "a", text="w")],
])
def test_stragglers_never_make_a_turn_again(rows):
    for sizes in ([1] * len(rows), [2] * 3, [len(rows)], [1, 4], [4, 1]):
        driven, got, at = turn_processors(), [], 0
        for n in sizes:
            got += driven.run(rows[at : at + n])
            at += n
        got += driven.run([message(99, 50_000, "b")])
        assert [(r["text"], r["timed_out"]) for r in got if r["turn_id"] == "a"] == [("x", rows[1]["method"] != END)]
        driven.run([message(100, 500_000, "b"), message(101, 500_001, "c", END)])
        driven.run([message(102, 900_000, "d")])
        assert not driven.own["th", "a"][1].timers and all(s.held is None for s in driven.own["th", "a"][1].states)


def plain_turns(rows, end):
    out = {}
    for turn in {r["turn_id"] for r in rows}:
        own = sorted((r for r in rows if r["turn_id"] == turn), key=lambda r: r["seq"])
        deadline, parts = own[0][streaming.MILLIS] + 900_000, []
        for r in own:
            if r[streaming.MILLIS] > deadline:
                out[turn] = (parts, True)
                break
            if r["method"] == END:
                out[turn] = (parts, False)
                break
            if r["delta"] is not None or (r["method"] == ITEM and r["item_text"] and not parts):
                parts.append(r["delta"] if r["delta"] is not None else r["item_text"])
        else:
            if deadline < end:
                out[turn] = (parts, True)
    return {k: ("".join(p), late) for k, (p, late) in out.items()}


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9))
def test_turns_are_the_same_under_any_cuts(seed):
    rng = random.Random(seed)
    rows, s = [], 0
    for seq in range(rng.choice([5, 30, 80])):
        s += rng.choice([0, 1, 30, 400])
        rows.append(message(seq, s, f"t{rng.randrange(4)}", rng.choice([DELTA, DELTA, ITEM, END]), f"{seq}.", rng.choice(["completed", "failed"])))
    driven, got = turn_processors(10**6), []
    for batch in [*cuts(rows, rng), [message(10**6, s + 5000, "last")], [message(10**6 + 1, s + 10_000, "last")]]:
        got += driven.run(batch)
    found = [(r["turn_id"], (r["text"], r["timed_out"])) for r in got if r["turn_id"] != "last"]
    assert len(found) == len(dict(found)) and dict(found) == plain_turns(rows, (s + 4900) * 1000)


def test_stream_turns_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    start, rows, s = datetime.datetime(2024, 1, 1), [], 0
    for seq in range(120):
        s += rng.choice([0, 5, 200])
        method = rng.choice([DELTA, DELTA, DELTA, ITEM, END])
        rows.append(("c", seq, start + datetime.timedelta(seconds=s), method, "th", f"t{rng.randrange(8)}", f"{seq}." if method == DELTA else None, "agentMessage" if method == ITEM else None, f"{seq};" if method == ITEM else None, "completed" if method == END else None, None))
    later = [("c", 1000 + k, start + datetime.timedelta(seconds=s + 5000 * k), DELTA, "th", "last", "x", None, None, None, None) for k in (1, 2)]
    for k, batch in enumerate([rows[:17], rows[17:18], rows[18:90], rows[90:], later[:1], later[1:]]):
        spark.createDataFrame(batch, S.MESSAGES).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(S.MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")  # processors get times in the session's zone
        streamed = streaming.run_available(streaming.stream_turns(stream), str(tmp_path / "out"), "update").where("turn_id <> 'last'").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert spark.conf.get(streaming.STORE) != streaming.ROCKS  # the session's own setting is back
    batch = turns.ended_turns(spark.createDataFrame(rows, S.MESSAGES), as_of=str(start + datetime.timedelta(seconds=s + 4900))).collect()
    columns = ["turn_id", "text", "turn_status", "turn_error", "timed_out"]
    assert streamed and sorted(tuple(r[c] for c in columns) for r in streamed) == sorted(tuple(r[c] for c in columns) for r in batch)


def ask(i, s):
    return {"id": i, "at": s * 1_000_000, "asks": True, "error": None, "result": None}


def say(i, s, error=None, result=None):
    return {"id": i, "at": s * 1_000_000, "asks": False, "error": error, "result": result}


def pair_processors():
    return Driven(lambda: streaming.PairProcessor(900), lambda r: (r["id"],), lambda r: r["at"] // 1000)


def test_first_response_wins_and_frees_the_request():
    driven = pair_processors()
    got = driven.run([ask(1, 0), ask(2, 0), ask(3, 0)])
    assert got == []
    got = driven.run([say(1, 10, "e"), say(1, 5, None, "r"), say(2, 1000)])
    assert [(r["id"], r["outcome"], r["result"], r["said"]) for r in got if r["id"] == 1] == [(1, "ok", "r", 5_000_000)]
    got += driven.run([say(1, 20), say(3, 990), say(4, 950)])
    got += driven.run([say(1, 1200), ask(9, 5000)])
    assert sorted((r["id"], r["outcome"]) for r in got) == [(1, "ok"), (2, "timed_out"), (3, "timed_out")]
    driven.run([ask(10, 50_000)])
    driven.run([ask(11, 90_000)])
    assert driven.held() == 1  # of all that came, only the request of the last batch is open


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9))
def test_pairs_equal_the_batch_form_under_any_cuts(seed):
    rng = random.Random(seed)
    asked = {i: rng.randrange(3000) for i in range(12)}
    answers = {i: [t for t in (asked[i] + rng.randrange(-100, 1800) for _ in range(rng.choice([0, 1, 1, 3]))) if t >= 0] for i in asked}
    rows = sorted([*(ask(i, s) for i, s in asked.items()), *(say(i, s, rng.choice([None, "e"])) for i, own in answers.items() for s in own)], key=lambda r: (r["at"], rng.random()))
    driven, got = pair_processors(), []
    for batch in [*cuts(rows, rng), [ask(99, 10_000)], [ask(98, 20_000)]]:
        got += driven.run(batch)
    found = {r["id"]: (r["outcome"], None if r["said"] is pd.NA or pd.isna(r["said"]) else r["said"]) for r in got if r["id"] < 90}
    assert len(found) == sum(r["id"] < 90 for r in got) == len(asked)
    for i, s in asked.items():
        own = [t for t in answers[i] if s <= t <= s + 900]
        assert (found[i][0] == "timed_out") == (not own) and found[i][1] == (min(own) * 1_000_000 if own else None)


# Status table


def test_status_table_equals_final_status_after_every_batch(spark, tmp_path):
    rng = random.Random(11)
    agents = [c[1] for c in S.CHECKS]
    tasks = [str(i) for i in range(30)]
    planned = spark.createDataFrame([(t, k, a, "s", "p", "tz") for t in tasks for k, a in enumerate(agents[: 1 + int(t) % 4])], S.PLANNED)
    table = StatusTable(spark, str(tmp_path / "t"), planned, buckets=3, every=2)
    assert {r.status for r in table.status().collect()} == {"UNCERTAINTY"}
    so_far, seen = [], []
    result = lambda: (rng.choice([*tasks, "gone", None]), 0, rng.choice([*agents, "stranger"]), rng.choice([*["ACCEPTED"] * 8, *S.STATUSES]), [], [], None)
    for n in range(7):
        batch = [result() for _ in range(25)] if n != 3 else []
        so_far += batch
        frame = spark.createDataFrame(batch, S.RESULTS)
        table.upsert(frame, n)
        want = {r.task_id: r.status for r in results.final_status(planned, spark.createDataFrame(so_far, S.RESULTS)).collect()}
        got = {r.task_id: r.status for r in table.status().collect()}
        assert got == want
        touched = {r.task_id: r.status for r in table.changes(n + 1).collect()} if n + 1 in table._versions("delta") else {}
        assert touched.items() <= want.items()
        table.upsert(frame, n)  # a batch that runs again
        table.upsert(spark.createDataFrame([("1", 0, agents[0], "ERROR", [], [], None)], S.RESULTS), 0)
        assert {r.task_id: r.status for r in table.status().collect()} == got
        seen.append(got)
        assert len(table._versions("base")) <= 2 and len(table._versions("delta")) <= 4
    assert {r.task_id: r.status for r in table.status(6).collect()} == seen[5]
    with pytest.raises(ValueError):
        table.status(0)
    # a delta that failed half-way is no version, and is written anew
    (tmp_path / "t" / "delta" / "v=00000008" / "bucket=0").mkdir(parents=True)
    (tmp_path / "t" / "delta" / "v=00000008" / "bucket=0" / "part-x.parquet").write_bytes(b"broken")
    assert {r.task_id: r.status for r in table.status().collect()} == seen[6]
    table.upsert(frame, 7)
    assert {r.task_id: r.status for r in StatusTable(spark, str(tmp_path / "t"), buckets=3).status().collect()} == seen[6]


def test_status_batches_write_what_they_say(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tallyforge.streaming.status.MERGED", 3)
    planned = spark.range(20_000).select(F.col("id").cast("string").alias("task_id"), F.lit(0).alias("plan_pos"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("agent"), *[F.lit("x").alias(c) for c in ("skill", "purpose", "tz")])
    table = StatusTable(spark, str(tmp_path / "t"), planned, buckets=2, every=2)
    schema = "task_id string, agent string, status string"
    batches = [[(str(n % 4), "ab"[n % 2 - n // 4], "PASS"), ("7", "z", "ERROR"), (str(n), None, "BLOCK")] for n in range(7)] + [[("3", "a", "WARNING")] * 5]
    for n, batch in enumerate(batches):
        table.upsert(spark.createDataFrame(batch, schema), n)
        assert spark.read.parquet(table._path("delta", n + 1)).count() <= 2
        # parts of a merged delta stay until the next one is made
        assert len(table._deltas()) <= 8 and len(table._upto()[1]) <= 4
    assert table._versions("base") == [0]
    seen = {}
    for batch in batches:
        for task, agent, status in batch:
            seen.setdefault(task, {}).setdefault(agent, set()).add(status)
    own = lambda t: {k: v for k, v in seen.get(t, {}).items() if k in ("a", "b")}
    want = {str(t): "WARNING" if t == 3 else "ACCEPTED" if len(own(str(t))) == 2 else "UNCERTAINTY" for t in range(10)}
    assert {r.task_id: r.status for r in table.status().where("length(task_id) = 1").collect()} == want and "ACCEPTED" in want.values()
    assert [tuple(r) for r in table.changes(8).collect()] == [("3", "WARNING")]
    table.upsert(spark.createDataFrame([("0", "a", "ERROR")], schema), 1)  # a part of a merged delta is there
    assert table._upto()[1][-1][1] == 8
    with pytest.raises(ValueError):
        table.status(1)


def test_status_stream_goes_on_where_it_was(spark, tmp_path):
    planned = spark.createDataFrame([("t", 0, "a", "s", "p", "tz"), ("t", 1, "b", "s", "p", "tz")], S.PLANNED)
    table = StatusTable(spark, str(tmp_path / "t"), planned)
    schema = "task_id string, agent string, status string"
    for agent, status, want in (("a", "ACCEPTED", "UNCERTAINTY"), ("b", "PASS", "ACCEPTED"), ("b", "BLOCK", "BLOCK")):
        spark.createDataFrame([("t", agent, status)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream_status(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "c"))
        assert table.status().first().status == want


# Contexts by reference


def test_contexts_grow_with_the_results(spark, tmp_path):
    n = 100_000
    rows = spark.range(n).select(F.lit("t").alias("task_id"), F.col("id").cast("int").alias("pos"), (F.col("id") % 7 != 3).alias("ok"), F.format_string('{"line": %d}', "id").alias("json"))
    refs = results.context_refs(rows)
    refs.drop("json").write.parquet(str(tmp_path / "refs"))
    results.context_lines(rows).write.parquet(str(tmp_path / "lines"))
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert size < 60 * n
    back = spark.read.parquet(str(tmp_path / "refs"))
    assert back.count() == n
    few = back.where("pos in (0, 3, 4, 5, 11, 20)")
    texts = {r.pos: (r.context, r.n_bytes) for r in results.render_contexts(few, results.context_lines(rows)).collect()}
    for pos, seen in ((0, 0), (3, 3), (4, 3), (5, 5), (11, 10), (20, 20)):
        text = "\n".join('{"line": %d}' % k for k in range(seen))
        assert texts[pos] == (text or "NONE", len(text))


def test_equal_contexts_have_one_chain(spark):
    lines = [("t", 0, True, "ä"), ("t", 1, True, None), ("t", 2, False, "b"), ("t", 3, True, "c"), ("u", 5, True, "ä"), ("u", 7, True, "x"), ("v", 0, True, "x"), ("v", 1, True, "ä"), ("v", 2, True, "y")]
    got = {(r.task_id, r.pos): r for r in results.context_refs(spark.createDataFrame(lines, "task_id string, pos int, ok boolean, json string")).collect()}
    assert got["t", 0].chain is None and got["t", 1].chain == got["u", 7].chain != got["v", 1].chain
    assert [got["t", k].n_prior for k in range(4)] == [0, 1, 2, 2] and [got["t", k].n_bytes for k in range(4)] == [0, 2, 2, 2]
    assert got["v", 2].chain not in {got["t", 2].chain, None}


def test_prompts_are_made_from_references(spark):
    planned = spark.createDataFrame([("t", 0, "a", "known", "p", "tz"), ("t", 1, "b", "known", "p", "tz"), ("u", 0, "c", "gone", "p", "tz")], S.PLANNED)
    materials = spark.createDataFrame([("t", 0, "m", "k", "n", None)], S.MATERIALS)
    rows = spark.createDataFrame([("t", 0, True, "one"), ("t", 1, True, "two")], "task_id string, pos int, ok boolean, json string")
    prompts = contract.assemble_prompts(planned, materials, results.context_refs(rows).withColumnRenamed("pos", "plan_pos"))
    skills = spark.createDataFrame([("known", "Do it.")], "skill string, text string")
    got = {(r.task_id, r.plan_pos): r.prompt for r in contract.render_prompts(prompts, results.context_lines(rows), skills).collect()}
    assert set(got) == {("t", 0), ("t", 1)}
    assert "Earlier results:\nNONE\nInstructions:\nDo it.\n" in got["t", 0] and "Earlier results:\none\nInstructions:" in got["t", 1]


# Sinks, sources and stores


def test_summaries_are_written_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    frame = lambda *rows: spark.createDataFrame(rows, "task_id string, status string, summary string")
    first = frame(("1", "BLOCK", "x"), ("2", "ACCEPTED", "y"))
    with monkeypatch.context() as m:  # the writer dies behind its staged rows
        m.setattr(results, "rename_folder", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            results.write_summaries(first, path, "r1")
    assert "run=r1" not in sources.folders(spark, path)
    assert results.write_summaries(first, path, "r1") and not results.write_summaries(frame(("9", "BLOCK", "z")), path, "r1")
    assert results.write_summaries(frame(("3", "BLOCK", "w")), path, "r2")
    assert sorted(tuple(r) for r in results.read_summaries(spark, path, "r1").collect()) == [("1", "x", "BLOCK"), ("2", "y", "ACCEPTED")]
    assert spark.read.parquet(path).count() == 3
    assert sources.folders(spark, f"{path}/_staged") == []
    with pytest.raises(ValueError):
        results.write_summaries(first, path, "../x")


def test_a_folder_gets_a_name_that_is_free(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(name)
    assert sources.rename_folder(spark, str(tmp_path / "a"), str(tmp_path / "new" / "c"))
    assert not sources.rename_folder(spark, str(tmp_path / "b"), str(tmp_path / "new" / "c"))
    assert (tmp_path / "new" / "c" / "x").read_text() == "a" and (tmp_path / "b" / "x").read_text() == "b" and sources.folders(spark, str(tmp_path / "new")) == ["c"]
    with pytest.raises(Exception, match="FileNotFound"):
        sources.rename_folder(spark, str(tmp_path / "gone"), str(tmp_path / "d"))


def test_messages_are_routed_once(spark, tmp_path):
    lines = ['{"method":"item/completed","params":{"threadId":"a","turnId":"b","item":{"type":"agentMessage","text":"x"}}}', "{broken", "", None, '{"params":{}}', '{"method":"turn/completed","params":{"turn":{"status":"failed","error":{"message":"m"}}}}']
    for k in range(3):
        spark.createDataFrame([(100 * k + i, x) for i, x in enumerate(lines)], "seq long, value string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = lambda: spark.readStream.schema("seq long, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    good, bad = sources.route_messages(stream(), str(tmp_path / "out"))
    assert sorted((r.seq % 100, r.method, r.item_text, r.turn_error) for r in good.collect()) == sorted([(0, "item/completed", "x", None), (5, "turn/completed", None, "m")] * 3)
    assert sorted(r.seq % 100 for r in bad.collect()) == sorted([1, 2, 3, 4] * 3)
    assert bad.columns == ["seq", "value"] and {r.value for r in bad.collect()} == {"{broken", "", None, '{"params":{}}'}
    before = good.count(), bad.count()
    # the last batch was written, but the stream's log does not know: it runs again
    for log in (tmp_path / "out" / "checkpoint" / "commits").glob("*2*"):
        log.unlink()
    for log in (tmp_path / "out" / "checkpoint" / "commits").glob(".*2*"):
        log.unlink()
    good, bad = sources.route_messages(stream(), str(tmp_path / "out"))
    assert (good.count(), bad.count()) == before
    plain = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
    assert [x.columns for x in sources.parse_messages(plain)] == [good.columns, bad.columns]


def test_a_project_is_read_from_its_own_files(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 40).alias("project_id"), F.col("id").alias("task_id"), F.timestamp_seconds("id").alias("created_at"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows = rows.unionByName(spark.range(10_000).select(F.lit(7).cast("long").alias("project_id"), F.col("id").alias("task_id"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("x").alias("text")))
    rows = rows.unionByName(rows.limit(5).withColumn("project_id", F.lit(None).cast("long")))
    store = dashboard.ProjectStore(spark, str(tmp_path / "p"), buckets=16)
    store.write(rows, "created_at")
    scan = store.scan(["task_id", "created_at"], 9, "created_at")
    got = [(r.task_id, r.created_at) for r in scan.collect()]
    assert got == [(r.task_id, r.created_at) for r in dashboard.project_scan(rows, ["task_id", "created_at"], 9, "created_at").collect()] and len(got) == 500
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_bucket" in plan and "EqualTo(project_id,9)" in plan
    of_scan, of_all = ({f.rsplit("/", 2)[-2] for f in x.inputFiles()} for x in (scan, store.table()))
    assert len(of_all) > 10
    metric = lambda df, name: _scan_metric(df, name)
    assert metric(scan, "numFiles") * 4 < metric(store.table(), "numFiles") and metric(scan, "filesSize") * 4 < metric(store.table(), "filesSize")
    assert store.scan(["task_id"], None).count() == rows.count()


def _scan_metric(df, name):
    """A metric of the plan's only scan, once it has run."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while "Scan" not in node.nodeName():
        node = node.finalPhysicalPlan() if node.nodeName().startswith("AdaptiveSparkPlan") else node.plan() if "QueryStage" in node.nodeName() else node.children().head()
    return node.metrics().apply(name).value()


def test_rejected_tasks_are_not_in_the_plan(spark):
    tasks = spark.createDataFrame([("t", " ", ["report"])], "task_id string, tz string, requested_checks array<string>")
    assert planning.plan_checks(tasks, spark.createDataFrame([("t", 0, "m", "k", "n", None)], S.MATERIALS)).count() == 0


# Many keys in one state


def one_bucket(driven):
    driven.key = lambda r: (0,)
    return driven


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**9))
def test_pairs_of_a_bucket_are_those_of_its_ids(seed):
    rng = random.Random(seed)
    rows = sorted((rng.choice([ask, say])(f"={rng.randrange(8)}", rng.randrange(4000)) for _ in range(60)), key=lambda r: r["at"])
    batches = [*cuts(rows, rng), [ask("=last", 10_000)], [ask("=last", 20_000)]]
    each, together = pair_processors(), one_bucket(pair_processors())
    found = [sorted((r["id"], r["at"], r["outcome"], str(r["said"])) for batch in batches for r in driven.run(batch)) for driven in (each, together)]
    assert found[0] == found[1] and found[0]
    assert all(len(handle.timers) <= 1 for _, handle in together.own.values())


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**9))
def test_leases_of_a_bucket_are_those_of_its_jobs(seed):
    rng = random.Random(seed)
    job = lambda: {"id": f"={rng.randrange(8)}", streaming.MILLIS: rng.randrange(4000) * 1000, "next_status": rng.choice([None, "FAILED", "QUEUED"])}
    last = [{"id": "=last", streaming.MILLIS: at * 1_000_000, "next_status": None} for at in (10, 20)]
    batches = [*cuts(sorted((job() for _ in range(60)), key=lambda r: r[streaming.MILLIS]), rng), last[:1], last[1:]]
    each, together = (Driven(lambda: streaming.LeaseProcessor(10), key, lambda r: r[streaming.MILLIS]) for key in (lambda r: (r["id"],), lambda r: (0,)))
    found = [[sorted(map(repr, driven.run(batch))) for batch in batches] for driven in (each, together)]
    assert found[0] == found[1]
    assert all(len(handle.timers) <= 1 for _, handle in together.own.values()) and together.held() == 1


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**9))
def test_turns_of_a_bucket_are_those_of_its_turns(seed):
    rng = random.Random(seed)
    rows, s = [], 0
    for seq in range(60):
        s += rng.choice([0, 1, 30, 400])
        rows.append(message(seq, s, f"t{rng.randrange(4)}", rng.choice([DELTA, DELTA, ITEM, END]), f"{seq}."))
    batches = [*cuts(rows, rng), [message(10**6, s + 5000, "last")], [message(10**6 + 1, s + 500_000, "last")]]
    each, together = turn_processors(), one_bucket(turn_processors())
    found = [sorted(repr(r) for batch in batches for r in driven.run(batch)) for driven in (each, together)]
    assert found[0] == found[1] and found[0]
    assert all(len(handle.timers) <= 1 for _, handle in together.own.values())


def test_tasks_are_sorted_once_for_their_contexts(spark, sf):
    from tallyforge import plans

    plan = plans.QUERIES["w2_context_refs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2  # the results of an order, and those of a task
    of_task = [line for line in plan.splitlines() if "Exchange hashpartitioning(task_id" in line]
    assert len(of_task) == 1 and "concat_ws" not in plan.split(of_task[0])[0]


def test_a_filter_on_reason_parses_nothing_again(spark):
    raw = spark.range(3).select(F.col("id").cast("string").alias("task_id"), F.lit("a").alias("agent"), F.lit('{"status":1}').alias("raw_text"))
    parsed = contract.parse_result_contract(raw).where("reason is not null").select("task_id", "message", "findings")
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert filters and not any("variant_get" in line or "parse_json" in line for line in filters)
    assert parsed.count() == 3


def test_prompts_are_not_shuffled_again(spark, sf):
    from tallyforge import plans

    plan = plans.QUERIES["c4_prompt_assembly"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("hashpartitioning(skill" in line or "hashpartitioning(task_id" in line and "plan_pos" in line for line in exchanges)
