"""The strict JSON contract of specialist outputs. Whatever breaks it becomes UNCERTAINTY, never a lost row."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge.operators.results import render_contexts
from tallyforge.sources import load_skills

_MARK = "#END#"


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _once(text: str) -> str | None:
    """The same JSON with each key once, the last one's value; null if no key is there twice or it is no JSON."""
    repeated = False

    def last(pairs: list[tuple]) -> dict:
        nonlocal repeated
        out = dict(pairs)
        repeated |= len(out) < len(pairs)
        return out

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        value = json.loads(text, object_pairs_hook=last, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None
    return json.dumps(value, ensure_ascii=False) if repeated else None


def keys_once(texts: pd.Series) -> pd.Series:
    return texts.map(_once, na_action="ignore").astype(object)


def _parsed(text: Column) -> Column:
    """The array of a JSON value and the end mark, null if text is not a JSON value alone."""
    return _as(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]'))), "array<variant>")


def parse_result_contract(raw: DataFrame) -> DataFrame:
    """raw (task_id, agent, raw_text, …) with reason, status, findings, evidence_ids and message.

    reason is null for an accepted row; rejected rows have status UNCERTAINTY, the reason as message, no
    evidence, and one finding that holds the reason, the text and the ids of thread and turn, if there are
    any. Text after the JSON value is an error: the value is parsed inside an array with an end mark.
    Of repeated keys, at any depth, the last counts; extra keys are ignored; findings are JSON texts. Spark's parser
    refuses repeated keys, so a text that it can't read and that might be an object is looked at again, in Python,
    whether that is why; of all other rows Python gets a null.
    """
    text = F.col("raw_text")
    rows = raw.withColumn("_first", _parsed(text))
    again = F.pandas_udf(keys_once, "string")(F.when(F.col("_first").isNull() & text.contains("{"), text))
    rows = rows.withColumn("_again", again).withColumn("_all", F.coalesce("_first", _parsed(F.col("_again")))).drop("_first", "_again")
    alone = F.coalesce((F.size("_all") == 2) & (_as(F.get("_all", F.lit(1)), "string") == _MARK), F.lit(False))
    rows = rows.withColumns({"_alone": alone, "_v": F.when(alone, _as(F.get("_all", F.lit(0)), "map<string,variant>"))})
    field = lambda key: F.try_element_at("_v", F.lit(key))
    rows = rows.withColumns({"_findings": _as(field("findings"), "array<variant>"), "_evidence": _as(field("evidence_ids"), "array<variant>"), "_status": field("status"), "_message": field("message")})
    lacking = F.array_except(F.array(*map(F.lit, S.RESULT_KEYS)), F.map_keys("_v"))
    status = F.when(_kind(F.col("_status")) == "STRING", _as(F.col("_status"), "string"))
    every = lambda items, is_one: F.coalesce(F.forall(items, is_one), F.lit(False))
    reason = (
        F.when(~F.col("_alone"), S.NOT_JSON)
        .when(F.col("_v").isNull(), S.NOT_OBJECT)
        .when(F.size(lacking) > 0, F.concat(F.lit("Result is missing fields: ['"), F.array_join(F.array_sort(lacking), "', '"), F.lit("'].")))
        .when(~F.coalesce(status.isin(*S.STATUSES), F.lit(False)), S.BAD_STATUS)
        .when(~every("_findings", lambda v: _as(v, "map<string,variant>").isNotNull()), S.BAD_FINDINGS)
        .when(~every("_evidence", lambda v: _kind(v) == "STRING"), S.BAD_EVIDENCE)
        .when(~_kind(F.col("_message")).isin("STRING", "VOID"), S.BAD_MESSAGE)
    )
    # a filter on reason stays above an explode; below, it would parse the value anew wherever its conditions name a field
    rows = rows.withColumn("_ok_status", status).select("*", F.explode(F.array(reason)).alias("reason"))
    ids = [F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("thread_id", "turn_id") if c in raw.columns]
    envelope = F.to_json(F.struct(F.col("reason").alias("parser_reason"), text, *ids))
    out = {
        "status": F.when(F.col("reason").isNull(), F.col("_ok_status")).otherwise("UNCERTAINTY"),
        "findings": F.when(F.col("reason").isNull(), F.transform("_findings", lambda f: F.to_json(f))).otherwise(F.array(envelope)),
        "evidence_ids": F.when(F.col("reason").isNull(), F.transform("_evidence", lambda e: _as(e, "string"))).otherwise(F.array().cast("array<string>")),
        "message": F.when(F.col("reason").isNull(), F.when(_kind(F.col("_message")) == "STRING", _as(F.col("_message"), "string"))).otherwise(F.col("reason")),
    }
    return rows.withColumns(out).drop("_all", "_alone", "_v", "_findings", "_evidence", "_status", "_message", "_ok_status")


def contract_quality(parsed: DataFrame) -> DataFrame:
    """Rows per agent and reason; accepted rows have reason accepted."""
    return parsed.groupBy("agent", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def turn_outcome(turns: DataFrame) -> DataFrame:
    """Finished turns (thread_id, turn_id, task_id, agent, text, turn_status, turn_error) as results.

    A turn without thread or turn id is an ERROR, so is a failed one, with its error's message, and one that is
    timed_out, where turns have that column; an interrupted one is BLOCK; a status that is null counts as completed,
    and its text goes through the contract.
    """
    parsed = parse_result_contract(turns.withColumnRenamed("text", "raw_text"))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    special = (
        F.when(blank("thread_id"), F.struct(F.lit("ERROR").alias("s"), F.lit(S.NO_THREAD).alias("m")))
        .when(blank("turn_id"), F.struct(F.lit("ERROR").alias("s"), F.lit(S.NO_TURN).alias("m")))
        .when(F.coalesce("timed_out", F.lit(False)) if "timed_out" in turns.columns else F.lit(False), F.struct(F.lit("ERROR").alias("s"), F.lit(S.LATE_TURN).alias("m")))
        .when(F.col("turn_status") == "failed", F.struct(F.lit("ERROR").alias("s"), F.coalesce("turn_error", F.lit(S.FAILED_TURN)).alias("m")))
        .when(F.col("turn_status") == "interrupted", F.struct(F.lit("BLOCK").alias("s"), F.lit(S.INTERRUPTED_TURN).alias("m")))
    )
    rows = parsed.withColumn("_special", special)
    return rows.withColumns({"status": F.coalesce("_special.s", "status"), "message": F.when(F.col("_special").isNull(), F.col("message")).otherwise(F.col("_special.m"))}).drop("_special")


def materials_digest(materials: DataFrame) -> DataFrame:
    """(task_id, digest): a line per material in order; sum up before joining, so that rows don't multiply."""
    uri = F.coalesce(F.when(F.col("uri") != "", F.col("uri")), F.lit("n/a"))
    line = F.concat(F.lit("- "), F.coalesce("id", F.lit("")), F.lit(": "), F.coalesce("name", F.lit("")), F.lit(" ["), F.coalesce("kind", F.lit("")), F.lit("] URI="), uri)
    lines = materials.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return lines.select("task_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("digest"))


def attach_skill(planned: DataFrame, skills: DataFrame, optional: bool = False) -> tuple[DataFrame, DataFrame]:
    """(attached, rejected): planned with skill_text, and planned rows whose skill is missing, with a reason; none if optional."""
    found, rejected = load_skills(planned, skills, optional)
    return found.withColumnRenamed("text", "skill_text"), rejected


RULES = (
    "Do only this check and link findings to evidence. Answer with one JSON object that has status, findings, evidence_ids and message. "
    "Never invent data, calculations, clauses or evidence; answer UNCERTAINTY or BLOCK when evidence is short."
)


def assemble_prompts(planned: DataFrame, materials: DataFrame, refs: DataFrame) -> DataFrame:
    """(task_id, plan_pos, agent, skill, head, n_prior): prompts whose large parts are pointed to.

    head is what stands before the earlier results, of which the prompt has its task's first n_prior, as refs
    (task_id, plan_pos, n_prior) say, or none; the skill goes by its name. render_prompts makes the texts.
    """
    # a row of refs for each task, so all of it meets on task_id and no text is shuffled again
    of_task = refs.groupBy("task_id").agg(F.collect_list(F.struct("plan_pos", "n_prior")).alias("_refs"))
    rows = planned.join(of_task, "task_id", "left").join(materials_digest(materials), "task_id", "left")
    rows = rows.withColumn("n_prior", F.get(F.filter("_refs", lambda r: r["plan_pos"] == F.col("plan_pos")), F.lit(0))["n_prior"])
    field = lambda name, c: F.concat(F.lit(name), F.coalesce(c, F.lit("")))
    head = F.concat_ws(
        "\n",
        field("Agent: ", F.col("agent")),
        field("Skill: ", F.col("skill")),
        field("Purpose: ", F.col("purpose")),
        field("Task: ", F.col("task_id")),
        field("Assignment: ", F.col("tz")),
        F.lit("Materials:"),
        F.coalesce("digest", F.lit("- NONE")),
        F.lit("Earlier results:"),
    )
    return rows.select("task_id", "plan_pos", "agent", "skill", head.alias("head"), F.coalesce("n_prior", F.lit(0)).alias("n_prior"))


def render_prompts(prompts: DataFrame, lines: DataFrame, skills: DataFrame) -> DataFrame:
    """(task_id, plan_pos, agent, prompt) for batch inference, from assemble_prompts, context_lines and the skills' texts.

    A prompt whose skill is missing has no text; attach_skill says which these are. The skills, some files that all
    prompts share, are broadcast, and come last, so that neither they nor the prompts' other texts are shuffled by skill.
    """
    rows = attach_skill(render_contexts(prompts, lines), F.broadcast(skills))[0]
    text = F.concat_ws("\n", "head", "context", F.lit("Instructions:"), "skill_text", F.lit(RULES))
    return rows.select("task_id", "plan_pos", "agent", text.alias("prompt"))
