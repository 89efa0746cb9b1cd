"""Single tasks, results and texts with known outcomes."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge import sources
from tallyforge.functions import format_ts, html_escape, safe_skill_name, status_class
from tallyforge.operators import contract, guard, handlers, planning, results, trace, turns


def task(spark, checks=("report", "normative", "calculation"), tz="Inspect it", task_id="t1"):
    return spark.createDataFrame([(task_id, 1, tz, list(checks), None)], S.TASKS)


def material(spark, task_id="t1"):
    return spark.createDataFrame([(task_id, 0, "m1", "report", "report.docx", None)], S.MATERIALS)


def result(spark, *rows):
    return spark.createDataFrame([("t1", i, agent, status, [], [], None) for i, (agent, status) in enumerate(rows)], S.RESULTS)


def planned(spark, **kw):
    return planning.plan_checks(task(spark, **kw), material(spark))


def test_plan_order_and_tz(spark):
    rows = planned(spark).orderBy("plan_pos").collect()
    assert [r.skill for r in rows] == ["report-review", "normative-check", "calculation-review", "final-audit"]
    assert {r.tz for r in rows} == {"Inspect it"}


def test_no_handlers_is_uncertainty(spark):
    p = planned(spark)
    got = handlers.apply_handlers(p, {})
    assert {r.status for r in got.collect()} == {"UNCERTAINTY"}
    assert results.final_status(p, got, material(spark)).first().status == "UNCERTAINTY"


def test_handlers_accept(spark):
    got = handlers.apply_handlers(planned(spark), {c[1]: lambda row: {"status": "ACCEPTED"} for c in S.CHECKS})
    assert got.count() == 4 and {r.status for r in got.collect()} == {"ACCEPTED"}


def test_wrong_owner(spark):
    got = handlers.apply_handlers(planned(spark), {c[1]: lambda row: {"status": "ACCEPTED", "agent": "other-agent"} for c in S.CHECKS})
    assert results.reject_wrong_owner(got).where("reason is not null").count() == 4


AGENTS = ["report-audit-agent", "normative-agent", "calculation-agent", "final-audit-agent"]
RANK = ["ERROR", "BLOCK", "UNCERTAINTY", "WARNING"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(S.STATUSES), min_size=0, max_size=4), st.randoms())
def test_status_is_order_free_and_severest_wins(spark, statuses, random):
    rows = list(zip(AGENTS, statuses))
    random.shuffle(rows)
    p = planned(spark)
    got = results.final_status(p, result(spark, *rows) if rows else result(spark, ("x", "PASS")).where("false")).first().status
    worst = next((s for s in RANK if s in statuses), None)
    assert got == (worst or ("ACCEPTED" if len(statuses) == 4 else "UNCERTAINTY"))


def test_blank_assignment_blocks(spark):
    p = planned(spark)
    accepted = result(spark, *[(a, "ACCEPTED") for a in AGENTS])
    assert results.final_status(p.withColumn("tz", F.lit(" \u2003")), accepted).first().status == "BLOCK"
    assert results.final_status(p, accepted, material(spark, "other")).first().status == "BLOCK"
    assert results.final_status(p, accepted, material(spark)).first().status == "ACCEPTED"
    reasons = [planning.validate_tasks(t, m).first().reject_reason for t, m in ((task(spark, tz=" "), material(spark)), (task(spark), material(spark, "other")), (task(spark, checks=()), material(spark)), (task(spark, task_id=" "), material(spark, " ")))]
    assert reasons == ["ТЗ is required", "At least one material is required", "At least one requested check is required", "task_id is required"]


def test_unknown_check_rejects_the_task(spark):
    t = task(spark, checks=("report", "CAD "))
    assert planning.unknown_checks(t).first().reason == "Unknown requested check: CAD "
    assert planning.plan_checks(t, material(spark)).count() == 0


def test_summary(spark):
    p = planned(spark, checks=("report",))
    s = results.run_summary(p, result(spark, ("report-audit-agent", "ACCEPTED"), ("final-audit-agent", "ACCEPTED"), ("stranger", "BLOCK"))).first()
    assert s.completed_agents == ["report-audit-agent", "final-audit-agent"] and s.blocking_agents == []


CONTRACT = [
    ('{"status":"ACCEPTED","findings":[],"evidence_ids":["e1"],"message":"ok"}', None),
    (' {"status":"PASS","findings":[{}],"evidence_ids":[],"message":null,"extra":1} ', None),
    ("not json", S.NOT_JSON),
    (None, S.NOT_JSON),
    ("", S.NOT_JSON),
    ("null", S.NOT_OBJECT),
    ('{"status":"PASS","findings":[],"evidence_ids":[],"message":null} x', S.NOT_JSON),
    ('{"status":"PASS","findings":[],"evidence_ids":[],"message":null},"#END#"', S.NOT_JSON),
    ('{"status":"DONE","findings":[],"evidence_ids":[],"message":null}', S.BAD_STATUS),
    ('{"status":5,"findings":[],"evidence_ids":[],"message":null}', S.BAD_STATUS),
    ('{"status":"PASS","findings":"bad","evidence_ids":[],"message":null}', S.BAD_FINDINGS),
    ('{"status":"PASS","findings":[null],"evidence_ids":[],"message":null}', S.BAD_FINDINGS),
    ('{"status":"PASS","findings":[],"evidence_ids":["a",null],"message":null}', S.BAD_EVIDENCE),
    ('{"status":"PASS","findings":[],"evidence_ids":[],"message":{}}', S.BAD_MESSAGE),
    ('{"status":"PASS","findings":[]}', "Result is missing fields: ['evidence_ids', 'message']."),
    ('{"status":"DONE","status":"PASS","findings":[],"evidence_ids":[],"message":null}', None),
    ('{"status":"PASS","status":"DONE","findings":[],"evidence_ids":[],"message":null}', S.BAD_STATUS),
    ('{"status":"PASS","findings":[{"a":1,"ТЗ":[{"b":1,"b":2}],"a":"x"}],"evidence_ids":["é","{"],"message":null}', None),
    ('{"status":"PASS","findings":[{"a":1,"a":2}],"evidence_ids":[],"message":null} x', S.NOT_JSON),
    ('{"status":"PASS","status":"PASS","findings":[{"a":NaN}],"evidence_ids":[],"message":null}', S.NOT_JSON),
]


def test_repeated_keys_need_no_setting(spark):
    before = spark.sql("set -v").collect(), spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    text = next(t for t, _ in CONTRACT if t and "ТЗ" in t)
    got = contract.parse_result_contract(spark.createDataFrame([("1", "a", text, None, None)], S.RAW_OUTPUTS)).first()
    assert got.findings == ['{"a":"x","ТЗ":[{"b":2}]}'] and got.evidence_ids == ["é", "{"]
    assert (spark.sql("set -v").collect(), spark.conf.get("spark.sql.variant.allowDuplicateKeys")) == before


def test_contract(spark):
    raw = spark.createDataFrame([(str(i), "a", text, "th", "") for i, (text, _) in enumerate(CONTRACT)], S.RAW_OUTPUTS)
    got = {r.task_id: r for r in contract.parse_result_contract(raw).collect()}
    assert len(got) == len(CONTRACT)
    for i, (_, reason) in enumerate(CONTRACT):
        r = got[str(i)]
        assert r.reason == reason, CONTRACT[i]
        assert reason is None or (r.status == "UNCERTAINTY" and r.message == reason and r.evidence_ids == [] and "thread_id" in r.findings[0] and "turn_id" not in r.findings[0])


def messages(spark, *rows):
    full = [("c", i, None, m, "th", "tu", d, it, tx, ts, te) for i, (m, d, it, tx, ts, te) in enumerate(rows)]
    return spark.createDataFrame(full, S.MESSAGES)


def test_turn_text(spark):
    delta, item, end = "item/agentMessage/delta", "item/completed", "turn/completed"
    cases = [
        ([(item, None, "agentMessage", "whole", None, None), (end, None, None, None, "completed", None)], "whole"),
        ([(item, None, "commandExecution", "x", None, None), (end, None, None, None, None, None)], ""),
        ([(delta, "", None, None, None, None), (item, None, "agentMessage", "late", None, None), (end, None, None, None, None, None)], ""),
        ([(delta, "a", None, None, None, None), (delta, "b", None, None, None, None), (end, None, None, None, None, None), (delta, "c", None, None, None, None)], "ab"),
    ]
    for rows, text in cases:
        assert turns.reassemble_turns(messages(spark, *rows)).first().text == text


def test_null_ids_follow_the_connection(spark):
    rows = spark.createDataFrame([("c", 0, "th", "tu"), ("c", 1, None, None)], "connection string, seq long, thread_id string, turn_id string")
    assert turns.fill_ids(rows).orderBy("seq").collect()[1].turn_id == "tu"


def test_cooldown_is_from_the_last_accepted(spark):
    rows = spark.createDataFrame([("k", 1_700_000_000 + s, i) for i, s in enumerate((0, 30, 59, 61, 119, 121))], "k string, s long, id long").select("k", F.timestamp_seconds("s").alias("ts"), "id")
    got = {r.id: (r.accepted, r.remaining) for r in turns.cooldown(rows, "k", "ts").collect()}
    assert got == {0: (True, 0), 1: (False, 30), 2: (False, 1), 3: (True, 0), 4: (False, 2), 5: (True, 0)}


def test_paths(spark):
    paths = [".env", ".env.example", ".env.local", "a/.pem", "k.PEM", "x/id_rsa.pub", "Token.JSON", "ok.md"]
    rows = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    assert sorted({r.path for r in guard.path_violations(rows).collect()}) == [".env", ".env.local", "Token.JSON", "k.PEM", "x/id_rsa.pub"]


def test_files_and_skills(spark, tmp_path):
    for name in ("demo", "a..b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text("text")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe")
    assert [tuple(r) for r in sources.skill_corpus(spark, str(tmp_path)).collect()] == [("demo", "text")]
    wanted = spark.createDataFrame([("demo",), ("../secret",), ("none",)], "skill string")
    corpus = sources.skill_corpus(spark, str(tmp_path))
    found, rejected = sources.load_skills(wanted, corpus)
    assert [r.skill for r in found.collect()] == ["demo"]
    assert {r.skill: r.reason for r in rejected.collect()} == {"../secret": "Invalid skill name: ../secret", "none": "Skill not found: none"}
    found, rejected = sources.load_skills(wanted, corpus, optional=True)
    assert {r.skill: r.text for r in found.collect()} == {"demo": "text", "none": None} and rejected.count() == 1
    read = {r.path.rsplit("/", 1)[-1]: r.content for r in guard.read_files(spark, str(tmp_path)).collect()}
    assert read["bad.bin"] is None and read["SKILL.md"] == "text"


def test_summaries_are_written_by_status(spark, tmp_path):
    p = planned(spark)
    status = results.final_status(p, result(spark, ("report-audit-agent", "BLOCK")))
    results.write_summaries(results.summary_json(results.run_summary(p, result(spark, ("report-audit-agent", "BLOCK"))), status), str(tmp_path / "out"), "run")
    back = results.read_summaries(spark, str(tmp_path / "out"), "run").first()
    assert back.status == "BLOCK" and '"message":null' in back.summary


@pytest.mark.parametrize(("status", "said"), [("INACTIVE", "ok"), ("ACCEPTED", "warn"), (None, "warn"), ("FAILED", "bad"), ("passed", "ok")])
def test_status_class(spark, status, said):
    assert spark.range(1).select(status_class(F.lit(status).cast("string"))).first()[0] == said


def test_scalars(spark):
    row = spark.range(1).select(html_escape(F.lit("<a href='x'>&\"")), html_escape(F.lit(None)), format_ts(F.lit(None).cast("timestamp")), safe_skill_name(F.lit("a/b")), safe_skill_name(F.lit("")), safe_skill_name(F.lit("ok"))).first()
    assert tuple(row) == ("&lt;a href=&#039;x&#039;&gt;&amp;&quot;", "", "—", False, False, True)


def test_trace_and_norms(spark):
    claims = spark.createDataFrame([(1, "t", "ACTUAL", ["e"]), (2, "t", "ACTUAL", ["gone"]), (3, "t", "UNKNOWN", []), (4, "t", None, None)], "claim_id long, task_id string, data_class string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("e",)], "evidence_id string")
    assert {r.claim_id: r.traceable for r in trace.evidence_traceability(claims, evidence).collect()} == {1: True, 2: False, 3: True, 4: False}
    clauses = spark.createDataFrame([("n", 1, 10), ("n", 2, 20)], "norm string, edition int, valid_from int")
    cites = spark.createDataFrame([(1, "n", 5), (2, "n", 10), (3, "n", 25), (4, "m", 9)], "citation_id long, norm string, cited_on int")
    got = {r.citation_id: (r.edition, r.status) for r in trace.normative_asof(cites, clauses).collect()}
    assert got == {1: (None, "UNCERTAINTY"), 2: (1, "HISTORICAL"), 3: (2, "CURRENT"), 4: (None, "UNCERTAINTY")}


def test_rejected_tasks_have_a_status(spark):
    tasks = spark.createDataFrame([("t", "tz", ["report"]), ("u", " ", ["report"]), ("v", "tz", ["report"]), ("w", "tz", ["nonsense"]), ("x", "tz", None)], "task_id string, tz string, requested_checks array<string>")
    materials = spark.createDataFrame([(i, 0, "m", "k", "n", None) for i in "tuwx"], S.MATERIALS)
    planned = planning.plan_checks(tasks, materials)
    accepted = spark.createDataFrame([("t", 0, a, "ACCEPTED", [], [], None) for a in ("report-audit-agent", "final-audit-agent")], S.RESULTS)
    got = {r.task_id: r.status for r in results.task_status(tasks, planned, accepted, materials).collect()}
    assert got == {"t": "ACCEPTED", "u": "BLOCK", "v": "BLOCK", "w": "UNCERTAINTY", "x": "UNCERTAINTY"}


def test_missing_skills_are_rejected_with_a_reason(spark):
    plan = spark.createDataFrame([("t", 0, "a", "known"), ("t", 1, "b", "gone")], "task_id string, plan_pos int, agent string, skill string")
    found, rejected = contract.attach_skill(plan, spark.createDataFrame([("known", "text")], "skill string, text string"))
    assert [(r.plan_pos, r.skill_text) for r in found.collect()] == [(0, "text")]
    assert [(r.plan_pos, r.reason) for r in rejected.collect()] == [(1, "Skill not found: gone")]
    assert contract.attach_skill(plan, spark.createDataFrame([], "skill string, text string"), optional=True)[0].count() == 2


def test_messages_without_ids_belong_to_the_open_turn(spark):
    rows = [("c", 0, None, "item/agentMessage/delta", "th", "tu", "a", None, None, None, None), ("c", 1, None, "item/agentMessage/delta", None, None, "b", None, None, None, None), ("c", 2, None, "turn/completed", None, None, None, None, None, "completed", None)]
    assert [(r.thread_id, r.turn_id, r.text, r.completed) for r in turns.reassemble_turns(spark.createDataFrame(rows, S.MESSAGES)).collect()] == [("th", "tu", "ab", True)]
