"""The registered audit queries. Each says in SQL of its own what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import functions as fn
from tallyforge import schemas as S
from tallyforge import sources
from tallyforge.operators import contract, dashboard, guard, handlers, planning, results, trace, turns
from tallyforge.plans.derived import Tables, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = "2024-01-15 00:00:00"


def query(name: str, sql: str | None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_REGISTRY = ", ".join("('" + "', '".join(c) + "')" for c in S.CHECKS)
PLANNED = (
    with_("tasks", "materials")
    + f""", registry(key, agent, skill, purpose) as (values {_REGISTRY}),
chk as (select task_id, tz, unnest(string_split(checks, '|')) as original, generate_subscripts(string_split(checks, '|'), 1) as pos from tasks),
norm as (select *, lower(trim(original)) as key from chk),
valid as (select task_id, tz from tasks t where trim(tz) <> '' and checks is not null and task_id in (select task_id from materials)
  and task_id not in (select task_id from norm where key not in (select key from registry))),
want as (select v.task_id, v.tz, n.key, min(n.pos) as pos from valid v join norm n using (task_id) group by all
  union all select task_id, tz, 'final_audit', 1000 from valid where task_id not in (select task_id from norm where key = 'final_audit')),
planned as (select w.task_id, (row_number() over (partition by w.task_id order by w.pos) - 1)::int as plan_pos, r.agent, r.skill, r.purpose, w.tz from want w join registry r using (key))"""
)
WITH_RESULTS = PLANNED + ", " + with_("results").removeprefix("with ")


# Planning and roll-up


@query(
    "prj1_validate_task",
    with_("tasks", "materials")
    + """ select task_id, case when trim(task_id) = '' then 'task_id is required' when trim(tz) = '' then 'ТЗ is required'
 when task_id not in (select task_id from materials) then 'At least one material is required' when checks is null then 'At least one requested check is required' end as reject_reason from tasks""",
)
def prj1(t: Tables) -> DataFrame:
    return planning.validate_tasks(t.tasks, t.materials).select("task_id", "reject_reason")


@query("prj2_result_flags", with_("results") + " select task_id, pos, status in ('ERROR', 'BLOCK') as blocks, finding is not null as has_findings from results")
def prj2(t: Tables) -> DataFrame:
    return t.results.select("task_id", F.col("pos").cast("long").alias("pos"), fn.blocks_progress(F.col("status")).alias("blocks"), fn.has_findings(F.col("findings")).alias("has_findings"))


@query("f1_normalize_key", with_("tasks") + " select task_id, lower(trim(unnest(string_split(checks, '|')))) as key from tasks where checks is not null")
def f1(t: Tables) -> DataFrame:
    return planning.requested(t.tasks).select("task_id", "key")


@query("j1_check_registry_lookup", PLANNED + " select n.task_id, n.pos - 1 as pos, n.original, r.agent, r.skill from norm n left join registry r using (key)")
def j1(t: Tables) -> DataFrame:
    return planning.check_lookup(t.tasks).select("task_id", F.col("pos").cast("long").alias("pos"), "original", "agent", "skill")


@query("j1_unknown_checks", PLANNED + " select task_id, 'Unknown requested check: ' || arg_min(original, pos) as reason from norm where key not in (select key from registry) group by task_id")
def j1_unknown(t: Tables) -> DataFrame:
    return planning.unknown_checks(t.tasks)


@query("w1_dedupe_checks", PLANNED + ", f as (select task_id, key, min(pos) as pos from norm group by all) select task_id, row_number() over (partition by task_id order by pos) - 1 as plan_pos, key from f")
def w1(t: Tables) -> DataFrame:
    return planning.dedupe_checks(t.tasks).withColumn("plan_pos", F.col("plan_pos").cast("long"))


@query("plan_checks", PLANNED + " select * from planned")
def plan(t: Tables) -> DataFrame:
    return planning.plan_checks(t.tasks, t.materials)


@query("set1_append_final_audit", PLANNED + " select task_id, plan_pos, agent from planned")
def set1(t: Tables) -> DataFrame:
    planned = planning.plan_checks(t.tasks, t.materials)
    asked = planning.requested(t.tasks).where(F.col("key") == S.FINAL_CHECK).select("task_id").distinct()
    final = next(c[1] for c in S.CHECKS if c[0] == S.FINAL_CHECK)
    without = planned.join(asked.withColumn("_asked", F.lit(True)), "task_id", "left").where((F.col("agent") != final) | F.col("_asked")).drop("_asked")
    only_final = planned.join(without.select("task_id").distinct(), "task_id", "left_anti")
    return planning.append_final_audit(without, t.tasks).unionByName(only_final).select("task_id", "plan_pos", "agent")


@query("j2_unplanned_results", WITH_RESULTS + " select task_id, pos, 'Result from unplanned agent: ' || agent as reason from results r where not exists (select 1 from planned p where p.task_id = r.task_id and p.agent = r.agent)")
def j2(t: Tables) -> DataFrame:
    _, bad = results.reject_unplanned(t.results, planning.plan_checks(t.tasks, t.materials))
    return bad.select("task_id", F.col("pos").cast("long").alias("pos"), "reason")


@query(
    "j2_task_mismatch",
    WITH_RESULTS + """, c as (select *, case when pos % 3 = 0 then (task_id::bigint + 1)::varchar else task_id end as run from results),
 s as (select c.*, exists (select 1 from planned p where p.task_id = c.run and p.agent = c.agent) as there from c)
 select task_id, pos, run, case when not there then 'Result from unplanned agent: ' || agent when run <> task_id then 'Result task_id does not match core task' else 'kept' end as outcome from s""",
)
def j2_mismatch(t: Tables) -> DataFrame:
    """Every third result is collected by the task with the next number."""
    run = F.when(F.col("pos") % 3 == 0, (F.col("task_id").cast("long") + 1).cast("string")).otherwise(F.col("task_id"))
    kept, bad = results.reject_unplanned(t.results.withColumn("run", run), planning.plan_checks(t.tasks, t.materials), "run")
    rows = kept.withColumn("reason", F.lit("kept")).unionByName(bad)
    return rows.select("task_id", F.col("pos").cast("long").alias("pos"), "run", F.col("reason").alias("outcome"))


@query(
    "j3_wrong_owner",
    with_("results") + " select task_id, pos, case when pos % 5 = 0 or pos % 7 = 0 then 'Runtime handler returned a result for the wrong task or agent' end as reason from results",
)
def j3(t: Tables) -> DataFrame:
    sent = t.results.withColumns({"result_task_id": F.when(F.col("pos") % 5 == 0, "other").otherwise(F.col("task_id")), "result_agent": F.when(F.col("pos") % 7 != 0, F.col("agent"))})
    return results.reject_wrong_owner(sent).select("task_id", F.col("pos").cast("long").alias("pos"), "reason")


@query(
    "j4_missing_handler_fill",
    WITH_RESULTS + """ select p.task_id, p.plan_pos, p.agent, coalesce(r.status, 'UNCERTAINTY') as status,
 case when r.task_id is null then 'No runtime handler registered for ' || p.agent || '.' else r.message end as message from planned p left join results r on r.task_id = p.task_id and r.agent = p.agent""",
)
def j4(t: Tables) -> DataFrame:
    return results.fill_missing(planning.plan_checks(t.tasks, t.materials), t.results).select("task_id", "plan_pos", "agent", "status", "message")


A1_SQL = """ select p.task_id, case when bool_or(r.status = 'ERROR') then 'ERROR' when bool_or(r.status = 'BLOCK') then 'BLOCK' when bool_or(r.status = 'UNCERTAINTY') then 'UNCERTAINTY'
 when bool_or(r.status = 'WARNING') then 'WARNING' when bool_or(r.task_id is null) then 'UNCERTAINTY' else 'ACCEPTED' end as status
 from planned p left join results r on r.task_id = p.task_id and r.agent = p.agent group by p.task_id"""


@query(
    "a1_final_status",
    WITH_RESULTS + f""", s as ({A1_SQL}) select t.task_id, case when trim(t.tz) = '' or t.task_id not in (select task_id from materials) then 'BLOCK' else coalesce(s.status, 'UNCERTAINTY') end as status
 from tasks t left join s using (task_id)""",
)
def a1(t: Tables) -> DataFrame:
    return results.task_status(t.tasks, planning.plan_checks(t.tasks, t.materials), t.results, t.materials)


@query(
    "a2_run_summary",
    WITH_RESULTS + """, k as (select r.* from results r join planned p on p.task_id = r.task_id and p.agent = r.agent)
 select t.task_id, coalesce(string_agg(k.agent, ',' order by k.pos), '') as completed, coalesce(string_agg(k.agent, ',' order by k.pos) filter (where k.status in ('ERROR', 'BLOCK')), '') as blocking, count(k.pos) as n_results
 from (select distinct task_id from planned) t left join k using (task_id) group by t.task_id""",
)
def a2(t: Tables) -> DataFrame:
    out = results.run_summary(planning.plan_checks(t.tasks, t.materials), t.results)
    return out.select("task_id", F.array_join("completed_agents", ",").alias("completed"), F.array_join("blocking_agents", ",").alias("blocking"), F.size("results").cast("long").alias("n_results"))


@query(
    "a6_completeness",
    WITH_RESULTS + " select p.task_id, count(*) as n_missing, string_agg(p.agent, ',' order by p.agent) as missing from planned p where not exists (select 1 from results r where r.task_id = p.task_id and r.agent = p.agent) group by p.task_id",
)
def a6(t: Tables) -> DataFrame:
    return results.missing_agents(planning.plan_checks(t.tasks, t.materials), t.results)


@query(
    "snk1_summary_json",
    WITH_RESULTS + f""", s as ({A1_SQL}), k as (select r.* from results r join planned p on p.task_id = r.task_id and p.agent = r.agent)
 select s.task_id, s.status, '{{"task_id":"' || s.task_id || '","status":"' || s.status || '","completed_agents":[' || coalesce(string_agg('"' || k.agent || '"', ',' order by k.pos), '')
 || '],"blocking_agents":[' || coalesce(string_agg('"' || k.agent || '"', ',' order by k.pos) filter (where k.status in ('ERROR', 'BLOCK')), '') || '],"results":['
 || coalesce(string_agg('{{"task_id":"' || k.task_id || '","agent":"' || k.agent || '","status":"' || k.status || '","findings":[' || coalesce('"' || k.finding || '"', '') || '],"evidence_ids":["' || k.evidence_id || '"],"message":' || coalesce('"' || k.message || '"', 'null') || '}}', ',' order by k.pos), '') || ']}}' as summary
 from s left join k using (task_id) group by s.task_id, s.status""",
)
def snk1(t: Tables) -> DataFrame:
    """Summaries written and read back."""
    planned = planning.plan_checks(t.tasks, t.materials)
    summaries = results.summary_json(results.run_summary(planned, t.results), results.final_status(planned, t.results))
    path = sources.shared_path(t.spark, "summaries")
    results.write_summaries(summaries, path, "first")
    return results.read_summaries(t.spark, path, "first")


@query(
    "f7_to_json_unescaped",
    with_("results") + """ select task_id, pos, '{"task_id":"' || task_id || '","agent":"' || agent || '","status":"' || status || '","findings":[' || coalesce('"' || finding || '"', '') || '],"evidence_ids":["' || evidence_id || '"],"message":'
 || coalesce('"ТЗ ' || message || '"', 'null') || '}' as json from results""",
)
def f7(t: Tables) -> DataFrame:
    rows = t.results.withColumn("message", F.concat(F.lit("ТЗ "), "message"))
    return rows.select("task_id", F.col("pos").cast("long").alias("pos"), fn.result_json(*results.RESULT).alias("json"))


@query("set2_set_difference", WITH_RESULTS + " select distinct task_id, agent from planned except select task_id, agent from results")
def set2(t: Tables) -> DataFrame:
    return planning.plan_checks(t.tasks, t.materials).select("task_id", "agent").subtract(t.results.select("task_id", "agent"))


# Result contract

C1_SQL = """, j as (select task_id, pos, agent, raw_text, case when json_valid(raw_text) then raw_text::json end as v from raw_outputs),
 c as (select task_id, pos, agent, raw_text, case when v is null then 'Output is not JSON.' when json_type(v) <> 'OBJECT' then 'Result must be a JSON object.'
  when len(list_filter(['evidence_ids', 'findings', 'message', 'status'], lambda k: not list_contains(json_keys(v), k))) > 0 then
    'Result is missing fields: [''' || array_to_string(list_filter(['evidence_ids', 'findings', 'message', 'status'], lambda k: not list_contains(json_keys(v), k)), ''', ''') || '''].'
  when json_type(v, '$.status') <> 'VARCHAR' or v->>'$.status' not in ('PASS', 'ACCEPTED', 'ACCEPTED_ALTERNATIVE', 'WARNING', 'UNCERTAINTY', 'ERROR', 'BLOCK') then 'Result has an invalid status.'
  when json_type(v, '$.findings') <> 'ARRAY' or len(list_filter((v->'$.findings')::json[], lambda x: coalesce(json_type(x), 'NULL') <> 'OBJECT')) > 0 then 'findings must be a JSON array of objects.'
  when json_type(v, '$.evidence_ids') <> 'ARRAY' or len(list_filter((v->'$.evidence_ids')::json[], lambda x: coalesce(json_type(x), 'NULL') <> 'VARCHAR')) > 0 then 'evidence_ids must be a JSON array of strings.'
  when json_type(v, '$.message') not in ('VARCHAR', 'NULL') then 'message must be a string or null.' end as reason, v from j)"""


@query(
    "c1_parse_result_contract",
    with_("raw_outputs") + C1_SQL + """ select task_id, pos, coalesce(reason, '') as reason, case when reason is null then v->>'$.status' else 'UNCERTAINTY' end as status,
 case when reason is null then array_to_string((v->'$.evidence_ids')::varchar[], ',') else '' end as evidence, case when reason is null then json_array_length(v, '$.findings')::bigint else 1 end as n_findings from c""",
)
def c1(t: Tables) -> DataFrame:
    out = contract.parse_result_contract(t.raw_outputs)
    return out.select("task_id", "pos", F.coalesce("reason", F.lit("")).alias("reason"), "status", F.array_join("evidence_ids", ",").alias("evidence"), F.size("findings").cast("long").alias("n_findings"))


@query("c2_uncertainty_envelope", with_("raw_outputs") + C1_SQL + " select task_id, pos, reason as message, reason as parser_reason, raw_text from c where reason is not null")
def c2(t: Tables) -> DataFrame:
    out = contract.parse_result_contract(t.raw_outputs).where("reason is not null")
    return out.select("task_id", "pos", "message", F.get_json_object(F.col("findings")[0], "$.parser_reason").alias("parser_reason"), F.get_json_object(F.col("findings")[0], "$.raw_text").alias("raw_text"))


@query("c3_contract_quality", with_("raw_outputs") + C1_SQL + " select agent, coalesce(reason, 'accepted') as reason, count(*) as n from c group by all")
def c3(t: Tables) -> DataFrame:
    return contract.contract_quality(contract.parse_result_contract(t.raw_outputs))



# Prompts


def _skills(t: Tables) -> DataFrame:
    """A whole text for each skill: of all documents whose doc_id leaves the skill's number, that of the smallest doc_id."""
    names = F.array(*[F.lit(c[2]) for c in S.CHECKS])
    return t.documents.groupBy((F.col("doc_id") % len(S.CHECKS)).alias("k")).agg(F.min_by("text", "doc_id").alias("text")).select(F.element_at(names, (F.col("k") + 1).cast("int")).alias("skill"), "text")


_SKILLS = f", skills as (select arg_min(text, doc_id) as skill_text, ['{"', '".join(c[2] for c in S.CHECKS)}'][doc_id % {len(S.CHECKS)} + 1] as skill from documents group by all)"
_DIGEST = ", digest as (select task_id, string_agg('- ' || id || ': ' || name || ' [' || kind || '] URI=' || coalesce(uri, 'n/a'), chr(10) order by pos) as digest from materials group by task_id)"


@query("a5_materials_digest", with_("materials") + _DIGEST + " select * from digest")
def a5(t: Tables) -> DataFrame:
    return contract.materials_digest(t.materials)


@query("src3_skill_corpus", "select source as skill, md5(arg_min(text, doc_id) || chr(10)) as text_md5 from documents where source is not null group by source")
def src3(t: Tables) -> DataFrame:
    """A folder for each source of documents, with the whole text of its first one."""
    path = sources.shared_path(t.spark, "skills")
    texts = t.documents.where("source is not null").groupBy(F.col("source").alias("skill")).agg(F.min_by("text", "doc_id").alias("text"))
    texts.repartition("skill").write.partitionBy("skill").text(path)
    return sources.skill_corpus(t.spark, path, "part-*").select("skill", F.md5("text").alias("text_md5"))


@query("j5_skill_join", PLANNED + _SKILLS + " select p.task_id, p.plan_pos, s.skill, md5(s.skill_text) as text_md5 from planned p left join skills s using (skill)")
def j5(t: Tables) -> DataFrame:
    found, missing = contract.attach_skill(planning.plan_checks(t.tasks, t.materials), _skills(t))
    rows = found.unionByName(missing.drop("reason"), allowMissingColumns=True)
    return rows.select("task_id", "plan_pos", "skill", F.md5("skill_text").alias("text_md5"))


_CONTEXT = """, ok as (select task_id, pos, status <> 'ERROR' as ok, task_id || ':' || pos || ':' || status as json from results),
 lastok as (select *, max(case when ok then pos end) over (partition by task_id order by pos rows between unbounded preceding and 1 preceding) as lo from ok),
 context as (select a.task_id, a.pos, coalesce(string_agg(b.json, chr(10) order by b.pos), 'NONE') as context from lastok a left join ok b on b.task_id = a.task_id and b.pos <= a.lo group by all)"""


def _earlier(t: Tables) -> DataFrame:
    return t.results.select("task_id", "pos", (F.col("status") != "ERROR").alias("ok"), F.concat_ws(":", "task_id", "pos", "status").alias("json"))


@query("w2_prior_results", with_("results") + _CONTEXT + " select task_id, pos, context from context")
def w2(t: Tables) -> DataFrame:
    return results.prior_results(_earlier(t)).select("task_id", F.col("pos").cast("long").alias("pos"), "context")


@query(
    "w2_context_refs",
    with_("results") + _CONTEXT + """ select task_id, pos, case when context = 'NONE' then 0 else len(string_split(context, chr(10))) end::bigint as n_prior, case when context = 'NONE' then 0 else strlen(context) end::bigint as n_bytes,
 dense_rank() over (partition by task_id order by case when context = 'NONE' then 0 else strlen(context) end) as nth_chain from context""",
)
def w2_refs(t: Tables) -> DataFrame:
    """The same contexts without their texts; a task's chains are numbered as they grow."""
    refs = results.context_refs(_earlier(t))
    task = Window.partitionBy("task_id").orderBy("pos")  # as the contexts are made, so tasks are sorted once
    refs = refs.withColumn("_new", (~F.col("chain").eqNullSafe(F.lag("chain").over(task))).cast("int"))
    nth = 1 + F.sum("_new").over(task.rowsBetween(Window.unboundedPreceding, 0))
    return refs.select("task_id", F.col("pos").cast("long").alias("pos"), F.col("n_prior").cast("long").alias("n_prior"), "n_bytes", nth.cast("long").alias("nth_chain"))


@query(
    "c4_prompt_assembly",
    WITH_RESULTS + _SKILLS + _DIGEST + _CONTEXT + f""" select p.task_id, p.plan_pos, sha256(concat_ws(chr(10), 'Agent: ' || p.agent, 'Skill: ' || p.skill, 'Purpose: ' || p.purpose, 'Task: ' || p.task_id, 'Assignment: ' || p.tz,
 'Materials:', coalesce(d.digest, '- NONE'), 'Earlier results:', coalesce(c.context, 'NONE'), 'Instructions:', s.skill_text, '{contract.RULES}')) as prompt_sha
 from planned p left join skills s using (skill) left join digest d using (task_id) left join context c on c.task_id = p.task_id and c.pos = p.plan_pos + 1""",
)
def c4(t: Tables) -> DataFrame:
    earlier = _earlier(t)
    refs = results.prior_bounds(earlier).select("task_id", (F.col("pos") - 1).cast("int").alias("plan_pos"), "n_prior")
    prompts = contract.assemble_prompts(planning.plan_checks(t.tasks, t.materials), t.materials, refs)
    out = contract.render_prompts(prompts, results.context_lines(earlier), _skills(t))
    return out.select("task_id", "plan_pos", fn.sha256_hex(F.col("prompt")).alias("prompt_sha"))


# Dashboard


@query("src1_project_scan", with_("tasks") + " select task_id, created_at::varchar as created_at from tasks where project_id = 7 order by tasks.created_at desc nulls first limit 1000000")
def src1(t: Tables) -> DataFrame:
    """Tasks stored by project, and one project's read from its own files."""
    store = dashboard.ProjectStore(t.spark, sources.shared_path(t.spark, "projects"))
    store.write(t.tasks, "created_at")
    return store.scan(["task_id", "created_at"], 7, "created_at").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("src2_project_list", with_("projects") + " select id, name, updated_at from projects order by updated_at desc nulls first")
def src2(t: Tables) -> DataFrame:
    return t.projects.select("id", "name", "updated_at").orderBy(F.desc_nulls_first("updated_at"))


def _latest_sql(n: int) -> str:
    return with_("jobs") + f", w as (select *, row_number() over (partition by project_id order by updated_at desc nulls first, id) as rn from jobs) select project_id, id, status, rn from w where rn <= {n}"


@query("w3_latest_n_per_project", _latest_sql(50))
def w3(t: Tables) -> DataFrame:
    return dashboard.latest_n(t.jobs, "project_id", "updated_at", 50).select("project_id", "id", "status", F.col("rn").cast("long").alias("rn"))


@query("sl1_global_top_k", with_("jobs") + " select id, status from jobs order by updated_at desc nulls first, id limit 100")
def sl1(t: Tables) -> DataFrame:
    return dashboard.top_k(t.jobs, "updated_at", 100, "id").select("id", "status")


@query("sl2_preview_slice", _latest_sql(8))
def sl2(t: Tables) -> DataFrame:
    latest = dashboard.latest_n(t.jobs, "project_id", "updated_at", 50)
    return dashboard.preview(latest).select("project_id", "id", "status", F.col("rn").cast("long").alias("rn"))


@query("sl3_sorted_difference", WITH_RESULTS + " select p.task_id, string_agg(p.agent, ',' order by p.agent) as missing from planned p anti join results r on r.task_id = p.task_id and r.agent = p.agent group by p.task_id order by 1")
def sl3(t: Tables) -> DataFrame:
    want = planning.plan_checks(t.tasks, t.materials).groupBy("task_id").agg(F.collect_set("agent").alias("want"))
    got = t.results.groupBy("task_id").agg(F.collect_set("agent").alias("got"))
    left = F.array_sort(F.array_except("want", F.coalesce("got", F.array().cast("array<string>"))))
    return want.join(got, "task_id", "left").select("task_id", F.array_join(left, ",").alias("missing")).where("missing <> ''").orderBy("task_id")


@query(
    "a3_project_counts",
    with_("tasks", "named_documents", "jobs") + """, n as (select project_id, 'tasks' as t, least(count(*), 1000) as n from tasks group by 1 union all select project_id, 'documents', least(count(*), 1000) from named_documents group by 1
 union all select project_id, 'jobs', least(count(*), 1000) from jobs group by 1)
 select project_id, coalesce(sum(n) filter (where t = 'tasks'), 0)::bigint as tasks, coalesce(sum(n) filter (where t = 'documents'), 0)::bigint as documents, coalesce(sum(n) filter (where t = 'jobs'), 0)::bigint as jobs from n group by 1""",
)
def a3(t: Tables) -> DataFrame:
    return dashboard.project_counts({"tasks": t.tasks, "documents": t.named_documents, "jobs": t.jobs})


@query(
    "a4_pipeline_counters",
    with_("jobs", "tasks") + """, w as (select *, row_number() over (partition by project_id order by updated_at desc nulls first, id) as rn from jobs),
 j as (select project_id, count(*) filter (where status = 'RUNNING') as running, count(*) filter (where status = 'QUEUED') as queued, count(*) filter (where status in ('FAILED', 'BLOCKED')) as failed from w where rn <= 50 group by 1),
 r as (select project_id, least(count(*), 20) as runs from tasks group by 1)
 select coalesce(j.project_id, r.project_id) as project_id, coalesce(running, 0) as running, coalesce(queued, 0) as queued, coalesce(failed, 0) as failed, coalesce(runs, 0) as runs from j full join r on j.project_id = r.project_id""",
)
def a4(t: Tables) -> DataFrame:
    return dashboard.pipeline_counters(t.jobs, t.tasks.withColumn("id", F.col("task_id")))


@query("a9_status_distribution", with_("jobs") + " select project_id, 'jobs' as kind, case when status in ('RUNNING', 'COMPLETED') then 'ok' when status in ('FAILED', 'BLOCKED') then 'bad' else 'warn' end as status_class, count(*) as n from jobs group by all")
def a9(t: Tables) -> DataFrame:
    return dashboard.status_distribution(t.jobs, F.lit("jobs"))


@query(
    "a10_queue_overview",
    with_("jobs", "tasks") + """, w as (select *, row_number() over (partition by project_id order by updated_at desc nulls first, id) as rn from jobs),
 r as (select *, row_number() over (partition by project_id order by created_at desc nulls first, task_id) as rn from tasks)
 select project_id, 'jobs' as list, rn, id::varchar as id, status from w where rn <= 50 union all select project_id, 'runs', rn, task_id, 'NEW' from r where rn <= 20""",
)
def a10(t: Tables) -> DataFrame:
    jobs, runs = t.jobs.withColumn("id", F.col("id").cast("string")), t.tasks.select("project_id", F.col("task_id").alias("id"), F.lit("NEW").alias("status"), "created_at")
    # ids are compared as they are stored: numbers for jobs
    latest = dashboard.latest_n(t.jobs, "project_id", "updated_at", S.LATEST["jobs"]).select("project_id", F.lit("jobs").alias("list"), "rn", F.col("id").cast("string").alias("id"), "status")
    out = dashboard.queue_overview({"runs": (runs, "created_at", S.LATEST["runs"])}).unionByName(latest)
    return out.withColumn("rn", F.col("rn").cast("long"))


@query("prj3_status_class", with_("jobs") + " select id, case when status in ('RUNNING', 'COMPLETED') then 'ok' when status in ('FAILED', 'BLOCKED') then 'bad' else 'warn' end as status_class from jobs")
def prj3(t: Tables) -> DataFrame:
    return t.jobs.select("id", fn.status_class(F.col("status")).alias("status_class"))


@query(
    "prj4_assignment_doc_suggest",
    with_("named_documents") + """, w as (select *, row_number() over (partition by project_id order by created_at desc nulls first, id) as rn from named_documents)
 select project_id, coalesce(min(rn) filter (where regexp_matches(name || ' ' || coalesce(document_type, ''), 'ТЗ|техническ|assignment', 'i')), 1)::bigint as suggested from w group by 1""",
)
def prj4(t: Tables) -> DataFrame:
    return dashboard.assignment_doc_suggest(t.named_documents).withColumn("suggested", F.col("suggested").cast("long"))


@query(
    "prj6_launch_eligibility",
    with_("projects", "named_documents") + """, n as (select project_id, count(*) as n from named_documents group by 1)
 select p.id as project_id, coalesce(n, 0) as n_documents, case when coalesce(n, 0) = 0 then 'refused' when n = 1 then 'single_document' else 'separate_assignment' end as eligibility from projects p left join n on n.project_id = p.id""",
)
def prj6(t: Tables) -> DataFrame:
    return dashboard.launch_eligibility(t.named_documents, t.projects.select(F.col("id").alias("project_id")))


@query("f2_html_escape", "select page_id, md5(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')) as escaped from pages")
def f2(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(fn.html_escape(F.col("html"))).alias("escaped"))


@query("f3_format_ts", "select event_id, strftime(ts, '%d.%m.%Y, %H:%M:%S') as shown from events")
def f3(t: Tables) -> DataFrame:
    return t.events.select("event_id", fn.format_ts(F.col("ts")).alias("shown"))


@query("f8_null_defaults", with_("results") + " select task_id, pos, coalesce(message, 'UNKNOWN') as message from results")
def f8(t: Tables) -> DataFrame:
    return t.results.select("task_id", F.col("pos").cast("long").alias("pos"), fn.null_default(F.col("message"), "UNKNOWN").alias("message"))


@query("f9_sha256_hex", "select doc_id, sha256(text) as digest from documents")
def f9(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.sha256_hex(F.col("text")).alias("digest"))


@query(
    "st4_stale_lease_recovery",
    with_("jobs") + f" select id, case when attempts >= max_attempts then 'FAILED' else 'QUEUED' end as next_status from jobs where status = 'RUNNING' and locked_at < timestamp '{AS_OF}' - interval 10 minute",
)
def st4(t: Tables) -> DataFrame:
    return dashboard.recover_stale(t.jobs, AS_OF).select("id", "next_status")


# Turns


def _messages(t: Tables) -> DataFrame:
    end = F.col("method") == "turn/completed"
    return t.messages.select(
        F.col("thread_id").alias("connection"), "seq", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("thread_id").cast("long") * 60 + F.col("seq") * 400).alias("ts"), "method", "thread_id", "turn_id",
        F.when(F.col("method").endswith("delta"), F.col("text")).alias("delta"), F.when(F.col("method") == "item/completed", F.lit("agentMessage")).alias("item_type"), F.when(F.col("method") == "item/completed", F.col("text")).alias("item_text"),
        F.when(end, F.col("turn_status")).alias("turn_status"), F.when(end & (F.col("turn_status") == "failed"), F.lit("model error")).alias("turn_error"),
    )


_TURNS = """, d as (select thread_id, turn_id, seq, text, method, turn_status, method like '%delta' as delta, min(seq) filter (where method = 'item/completed' and text <> '' or method like '%delta') over (partition by thread_id) as first from messages),
 turns as (select thread_id, turn_id, coalesce(string_agg(text, '' order by seq) filter (where delta or (method = 'item/completed' and text <> '' and seq = first)), '') as text,
  max(turn_status) filter (where method = 'turn/completed') as turn_status, bool_or(method = 'turn/completed') as completed, max(seq) - min(seq) as span from d group by all)"""


def _sent(t: Tables) -> DataFrame:
    """_messages, of which some after a connection's first one lack their ids."""
    lacking = F.row_number().over(Window.partitionBy("connection").orderBy("seq")) % 3 == 2
    sent = _messages(t).withColumn("_lacking", lacking)
    return sent.withColumns({c: F.when(~F.col("_lacking"), F.col(c)) for c in turns.TURN}).drop("_lacking")


@query("st1_turn_reassembly", with_("messages") + _TURNS + " select thread_id, turn_id, md5(text) as text_md5, completed, turn_status from turns")
def st1(t: Tables) -> DataFrame:
    return turns.reassemble_turns(_sent(t)).select("thread_id", "turn_id", F.md5("text").alias("text_md5"), "completed", "turn_status")


@query("w4_turn_cutoff", with_("messages") + " select thread_id, seq from messages")
def w4(t: Tables) -> DataFrame:
    late = _messages(t).where(F.col("method") == "turn/completed").withColumns({"seq": F.col("seq") + 1, "method": F.lit("item/completed")})
    return turns.cutoff_at_completion(_messages(t).unionByName(late)).select("thread_id", "seq")


@query("st2_turn_timeout", with_("messages") + " select thread_id, 3000 - (thread_id::bigint * 60 + min(seq) * 400) > 900 as timed_out from messages where method <> 'turn/completed' group by 1")
def st2(t: Tables) -> DataFrame:
    open_turns = turns.reassemble_turns(_messages(t).where(F.col("method") != "turn/completed"))
    return turns.flag_timeouts(open_turns, "2023-11-14 23:03:20").select("thread_id", "timed_out")


@query(
    "st3_turn_outcome",
    with_("messages") + _TURNS + """ select thread_id, case turn_status when 'failed' then 'ERROR' when 'interrupted' then 'BLOCK' else 'UNCERTAINTY' end as status,
 case turn_status when 'failed' then 'model error' when 'interrupted' then 'Turn was interrupted.' else 'Output is not JSON.' end as message from turns""",
)
def st3(t: Tables) -> DataFrame:
    done = turns.reassemble_turns(_messages(t)).withColumns({"task_id": F.col("thread_id"), "agent": F.lit("report-audit-agent")})
    return contract.turn_outcome(done).select("thread_id", "status", "message")


_RPC = """, q as (select event_id // 2 as id, ts from events where event_id % 2 = 0), a as (select event_id // 2 as id, ts, case when event_type = 'error' then 'e' end as error, props as result from events where event_id % 2 = 1),
 m as (select q.id, q.ts, count(a.id) as n, arg_min(coalesce(a.error, ''), a.ts) as error from q left join a on a.id = q.id and a.ts between q.ts and q.ts + interval 900 second group by all)"""


@query("j10_request_response_pairing", "with z as (select 1)" + _RPC + " select id, case when n = 0 then 'timed_out' when error <> '' then 'failed' else 'ok' end as outcome from m")
def j10(t: Tables) -> DataFrame:
    asked, answered = _rpc(t)
    return turns.pair_requests(asked, answered).select("id", "outcome")


def _rpc(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.events.select(F.expr("event_id div 2").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 2).alias("odd"), F.when(F.col("event_type") == "error", "e").alias("error"), F.col("props").alias("result"))
    return rows.where("odd = 0").select("id", "ts"), rows.where("odd = 1").select("id", "ts", "error", "result")


@query(
    "st5_cooldown",
    """with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events),
 w as (select user_id, event_id, ts, rn, ts as last, true as accepted, 0::bigint as remaining from e where rn = 1
  union all select e.user_id, e.event_id, e.ts, e.rn, case when e.ts - w.last >= interval 7200 second then e.ts else w.last end, e.ts - w.last >= interval 7200 second,
   case when e.ts - w.last >= interval 7200 second then 0 else ceil(7200 - epoch(e.ts - w.last))::bigint end from w join e on e.user_id = w.user_id and e.rn = w.rn + 1)
 select event_id, accepted, remaining from w""",
)
def st5(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    return turns.cooldown(rows, "user_id", "ts", 7200).select(F.col("id").alias("event_id"), "accepted", "remaining")


# File policy

_PATHS = """, p as (select repo, file as path, lower(file) as low, lower(regexp_extract(file, '[^/]*$')) as name from manifest),
 v as (select repo, path, 'tracked secret-like file' as violation from p where name = '.env' union all select repo, path, 'tracked environment file' from p where name like '.env.%' and name <> '.env.example'
 union all select repo, path, 'tracked credential-like path' from p where low like '%client_secret%' or low like '%credentials.json%' or low like '%token.json%' or low like '%refresh_token%' or low like '%service-account%'
 union all select repo, path, 'tracked private credential/key file' from p where name in ('.npmrc', '.pypirc', '.netrc') or regexp_matches(name, '^.+\\.(pem|key|p12|pfx)$') or name like 'id_rsa%' or name like 'id_ed25519%')"""
_MERGE = ", m as (select repo, file as path, doc_id from manifest where file not like '%.PNG' and contains(content, '<<<<<<< ') and contains(content, '=======') and contains(content, '>>>>>>> '))"
_NEED = ["README.md", "SECURITY.md", "d/report.md"]


def _manifest(t: Tables) -> DataFrame:
    return t.manifest.withColumnRenamed("file", "path")


def _required(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("r", p) for p in _NEED], "repo string, path string")


@query("src5_file_manifest", with_("manifest") + " select file as path, doc_id, length(content)::bigint as n_chars from manifest where trim(file) <> ''")
def src5(t: Tables) -> DataFrame:
    return _manifest(t).where(F.trim("path") != "").select("path", "doc_id", F.length("content").cast("long").alias("n_chars"))


@query("prj7_guard_path_rules", with_("manifest") + _PATHS + " select path, violation from v")
def prj7(t: Tables) -> DataFrame:
    return guard.path_violations(_manifest(t)).select("path", "violation")


@query("prj8_guard_content_rule", with_("manifest") + _MERGE + " select path, count(*) as n from m group by 1")
def prj8(t: Tables) -> DataFrame:
    return guard.content_violations(_manifest(t)).groupBy("path").agg(F.count("*").alias("n"))


@query("prj9_guard_owner_present", with_("manifest") + " select file as path, count(*) as n from manifest where file = 'd/report.md' and not contains(content, 'the') group by 1 union all select 'OWNERS', 1")
def prj9(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("r", "d/report.md", "the"), ("r", "OWNERS", "@owner")], "repo string, path string, token string")
    return guard.missing_owner(_manifest(t), rules).groupBy("path").agg(F.count("*").alias("n"))


@query("j9_required_files", with_("manifest") + " select * from (values ('README.md'), ('SECURITY.md'), ('d/report.md')) v(path) where path not in (select file from manifest) order by 1")
def j9(t: Tables) -> DataFrame:
    return guard.missing_required(_manifest(t), _required(t)).select("path")


@query("a7_guard_verdict", with_("manifest") + _PATHS + _MERGE + " select 'r' as repo, 'BLOCK' as verdict, (select count(*) from v) + (select count(*) from m) + 1 as n_violations, (select count(*) from manifest) as n_files")
def a7(t: Tables) -> DataFrame:
    files = _manifest(t)
    bad = guard.path_violations(files).unionByName(guard.content_violations(files)).unionByName(guard.missing_required(files, _required(t)))
    return guard.guard_verdict(bad, files)


@query("snk2_checksum_manifest", with_("manifest") + " select file as path, sha256(content) || '  ' || regexp_extract(file, '[^/]*$') as line from manifest")
def snk2(t: Tables) -> DataFrame:
    return guard.checksum_manifest(_manifest(t))


@query("f5_path_parts", with_("manifest") + " select doc_id, regexp_extract(file, '[^/]*$') as name, lower(regexp_extract(regexp_extract(file, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) as suffix from manifest")
def f5(t: Tables) -> DataFrame:
    name = fn.file_name(F.col("path"))
    return _manifest(t).select("doc_id", name.alias("name"), F.lower(fn.file_suffix(name)).alias("suffix"))


@query("f6_tokens", "select doc_id, contains(text, 'the') and contains(text, 'and') as all_tokens, contains(text, '|') or contains(text, '#') as any_token from documents")
def f6(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.all_tokens(F.col("text"), ["the", "and"]).alias("all_tokens"), fn.any_token(F.col("text"), ["|", "#"]).alias("any_token"))


@query("f4_safe_skill_name", with_("manifest") + " select doc_id, length(file) > 0 and not contains(file, '/') and not contains(file, chr(92)) and not contains(file, '..') as safe from manifest")
def f4(t: Tables) -> DataFrame:
    return _manifest(t).select("doc_id", fn.safe_skill_name(F.col("path")).alias("safe"))


# Traceability

_SOFT = "('ASSUMED', 'INTERPRETED', 'UNKNOWN')"


@query("prj10_fact_class_check", with_("claims") + f" select claim_id, data_class <> 'GUESSED' as valid_class, case when data_class = 'GUESSED' then 'invalid' when data_class in {_SOFT} then 'soft' else 'fact' end as fact from claims")
def prj10(t: Tables) -> DataFrame:
    return trace.fact_class_check(t.claims).select("claim_id", "valid_class", "fact")


def _evidence(t: Tables) -> DataFrame:
    rows = t.labels.select(F.col("doc_id").alias("evidence_id"), F.when(F.col("toxic") == 1, "MEMORY").otherwise("FILE").alias("origin"))
    return trace.admissible(rows)


_TRACE = f", trace as (select claim_id, task_id, (claim_id in (select doc_id from labels where toxic = 0)) or data_class in {_SOFT} as traceable from claims)"


@query("prj11_admissible_evidence", "select doc_id as evidence_id from labels where toxic = 0")
def prj11(t: Tables) -> DataFrame:
    return _evidence(t).select("evidence_id")


@query("j6_evidence_traceability", with_("claims") + _TRACE + " select claim_id, task_id, traceable from trace")
def j6(t: Tables) -> DataFrame:
    return trace.evidence_traceability(t.claims, _evidence(t))


_COVER = """, cover as (select i.task_id, i.item_id, count(l.doc_id) as n_findings from (select distinct task_id, (claim_id % 7)::bigint as item_id from claims) i
 left join claims c on c.task_id = i.task_id and c.claim_id % 7 = i.item_id left join labels l on l.doc_id = c.claim_id group by all)"""


def _coverage(t: Tables) -> DataFrame:
    items = t.claims.select("task_id", (F.col("claim_id") % 7).alias("item_id")).distinct()
    findings = t.labels.select(F.col("doc_id").alias("claim_id")).join(t.claims, "claim_id").select("task_id", (F.col("claim_id") % 7).alias("item_id"))
    return trace.assignment_coverage(items, findings)


@query("j7_assignment_coverage", with_("claims") + _COVER + " select task_id, item_id, n_findings, n_findings > 0 as covered from cover")
def j7(t: Tables) -> DataFrame:
    return _coverage(t)


@query(
    "j8_normative_asof",
    with_("citations", "clauses") + """, e as (select c.citation_id, c.norm, c.cited_day, max(k.edition) as edition from citations c left join clauses k on k.norm = c.norm and k.valid_day <= c.cited_day group by all)
 select e.citation_id, e.norm, e.edition::int as edition, case when e.edition is null then 'UNCERTAINTY' when e.edition = (select max(edition) from clauses k where k.norm = e.norm) then 'CURRENT' else 'HISTORICAL' end as status from e""",
)
def j8(t: Tables) -> DataFrame:
    cited = t.citations.withColumnRenamed("cited_day", "cited_on").distinct()
    return trace.normative_asof(cited, t.clauses.withColumnRenamed("valid_day", "valid_from")).select("citation_id", "norm", F.col("edition").cast("int").alias("edition"), "status")


@query(
    "j11_contradiction_pairs",
    with_("results") + """, f as (select task_id, agent as element, pos, status from results)
 select x.task_id, x.element, least(x.pos, y.pos) as a, greatest(x.pos, y.pos) as b from f x join f y on x.task_id = y.task_id and x.element = y.element and x.status in ('PASS', 'ACCEPTED', 'ACCEPTED_ALTERNATIVE') and y.status in ('ERROR', 'BLOCK')""",
)
def j11(t: Tables) -> DataFrame:
    return trace.contradiction_pairs(_findings(t))


_SIDES = """, f as (select task_id, agent as element, pos, status in ('PASS', 'ACCEPTED', 'ACCEPTED_ALTERNATIVE') as accepts from results where status in ('PASS', 'ACCEPTED', 'ACCEPTED_ALTERNATIVE', 'ERROR', 'BLOCK')),
 e as (select task_id, element, count(*) filter (where accepts) as n_accepting, count(*) filter (where not accepts) as n_blocking, min(pos) filter (where accepts) as accepting, min(pos) filter (where not accepts) as blocking from f group by all)"""


def _findings(t: Tables) -> DataFrame:
    return t.results.select("task_id", F.col("agent").alias("element"), F.col("pos").cast("long").alias("finding_id"), "status")


@query("j11_contradictions", with_("results") + _SIDES + " select * from e where n_accepting > 0 and n_blocking > 0")
def j11_elements(t: Tables) -> DataFrame:
    return trace.contradictions(_findings(t))


@query("j11_contested_findings", with_("results") + _SIDES + " select f.task_id, f.element, f.pos as finding_id, f.accepts, case when accepts then n_blocking else n_accepting end as n_against from f join e on e.task_id = f.task_id and e.element = f.element where n_accepting > 0 and n_blocking > 0")
def j11_findings(t: Tables) -> DataFrame:
    return trace.contested_findings(_findings(t))


@query(
    "a8_final_audit_gate",
    with_("claims") + _TRACE + _COVER + """, s as (select task_id, case when bool_or(claim_id % 31 = 0) then 'BLOCK' else 'ACCEPTED' end as status, count(*) filter (where claim_id % 29 = 0) as n from claims group by 1)
 select s.task_id, failed = '' as releasable, failed from (select s.task_id, concat_ws(',', case when s.status = 'BLOCK' then 'blocking' end, case when s.n > 0 then 'undisclosed' end,
  case when not (select bool_and(traceable) from trace t where t.task_id = s.task_id) then 'untraceable' end, case when not (select bool_and(n_findings > 0) from cover c where c.task_id = s.task_id) then 'uncovered' end) as failed from s) s""",
)
def a8(t: Tables) -> DataFrame:
    status = t.claims.groupBy("task_id").agg(F.when(F.bool_or(F.col("claim_id") % 31 == 0), "BLOCK").otherwise("ACCEPTED").alias("status"))
    undisclosed = t.claims.groupBy("task_id").agg(F.count_if(F.col("claim_id") % 29 == 0).alias("n"))
    return trace.final_audit_gate(status, undisclosed, trace.evidence_traceability(t.claims, _evidence(t)), _coverage(t))


# Handlers


def _accept(row: dict) -> dict:
    return {"status": "ACCEPTED", "evidence_ids": ["e1"], "message": row["task_id"]}


def _fragile(row: dict) -> dict:
    if int(row["task_id"]) % 3 == 0:
        raise ValueError("broken input")
    return _accept(row)


@query(
    "u1_handler_apply",
    PLANNED + " select task_id, agent, case when agent = 'cad-agent' or agent like 'norm%' then 'UNCERTAINTY' else 'ACCEPTED' end as status, case when agent like 'norm%' then 'No runtime handler registered for normative-agent.' else task_id end as message from planned",
)
def u1(t: Tables) -> DataFrame:
    known = {c[1]: _accept for c in S.CHECKS if c[0] != "normative"}
    return handlers.apply_handlers(planning.plan_checks(t.tasks, t.materials), known).select("task_id", "agent", "status", "message")


@query(
    "u2_fault_isolating_apply",
    PLANNED + " select task_id, agent, case when task_id::bigint % 3 = 0 then 'ERROR' else 'ACCEPTED' end as status, case when task_id::bigint % 3 = 0 then 'Runtime error: broken input' else task_id end as message from planned",
)
def u2(t: Tables) -> DataFrame:
    return handlers.apply_handlers(planning.plan_checks(t.tasks, t.materials), {c[1]: _fragile for c in S.CHECKS}, on_error="row").select("task_id", "agent", "status", "message")
