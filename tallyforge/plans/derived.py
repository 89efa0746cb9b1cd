"""Audit tables derived from the given ones, in SQL that Spark and DuckDB read alike.

{name} stands for a given table. Lists are strings parted by | until an engine splits them.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_AGENT = "case l_linenumber when 1 then 'inspection-agent' when 3 then 'normative-agent' when 4 then 'calculation-agent' when 5 then 'final-audit-agent' when 6 then 'cad-agent' else 'report-audit-agent' end"
_STATUS = "case l_partkey % 20 when 0 then 'ERROR' when 1 then 'BLOCK' when 2 then 'UNCERTAINTY' when 3 then 'UNCERTAINTY' when 4 then 'WARNING' when 5 then 'WARNING' when 6 then 'ACCEPTED_ALTERNATIVE' when 7 then 'PASS' else 'ACCEPTED' end"
_LINE_ORDER = "over (partition by l_orderkey order by l_linenumber, l_partkey, l_shipdate, l_extendedprice)"
_EVENT_STATUS = "case event_type when 'click' then 'RUNNING' when 'view' then 'QUEUED' when 'error' then 'FAILED' when 'signup' then 'BLOCKED' else 'COMPLETED' end"

SQL = {
    "tasks": """select cast(o_orderkey as string) as task_id, o_custkey % 50 as project_id,
        case when o_orderkey % 37 = 0 then ' ' else concat('Assignment ', cast(o_orderkey as string)) end as tz,
        case o_orderkey % 8 when 0 then ' Report |report|normative' when 1 then 'inspection' when 2 then 'final_audit' when 3 then 'calculation|final_audit'
          when 4 then 'report' when 5 then 'NORMATIVE' when 6 then 'cad|report' end as checks,
        o_orderdate as created_at from {orders}""",
    "materials": f"""select cast(l_orderkey as string) as task_id, row_number() {_LINE_ORDER} as pos, cast(l_partkey as string) as id, p_type as kind, p_name as name,
        case when l_linenumber % 3 = 0 then null else concat('file:///m/', cast(l_partkey as string)) end as uri
        from {{lineitem}} join {{part}} on l_partkey = p_partkey""",
    "results": f"""select cast(l_orderkey as string) as task_id, row_number() {_LINE_ORDER} as pos, {_AGENT} as agent, {_STATUS} as status,
        case when l_suppkey % 4 = 0 then null else concat('f', cast(l_suppkey as string)) end as finding, concat('e', cast(l_partkey as string)) as evidence_id,
        case when l_suppkey % 3 = 0 then null else concat('note ', cast(l_linenumber as string)) end as message from {{lineitem}}""",
    "raw_outputs": f"""select cast(l_orderkey as string) as task_id, l_linenumber as pos, {_AGENT} as agent, case l_suppkey % 11
        when 0 then 'not json' when 1 then '[1,2]' when 2 then concat('{{"status":"', {_STATUS}, '","findings":[]}}')
        when 3 then '{{"status":"DONE","findings":[],"evidence_ids":[],"message":null}}'
        when 4 then '{{"status":"PASS","findings":"bad","evidence_ids":[],"message":null}}'
        when 5 then '{{"status":"PASS","findings":[],"evidence_ids":[1],"message":null}}'
        when 6 then '{{"status":"PASS","findings":[],"evidence_ids":[],"message":5}}'
        when 7 then '{{"status":"PASS","findings":[],"evidence_ids":[],"message":null}} x'
        when 8 then '{{"status":"PASS","findings":[{{"a":1}},null],"evidence_ids":[],"message":null}}'
        else concat('{{"status":"', {_STATUS}, '","findings":[{{"code":', cast(l_partkey as string), '}}],"evidence_ids":["e', cast(l_partkey as string), '"],"message":"m"}}') end as raw_text
        from {{lineitem}}""",
    "messages": """select cast(conv_id as string) as thread_id, concat('t', cast(conv_id as string)) as turn_id, turn as seq, role, text,
        case when turn = max(turn) over (partition by conv_id) then 'turn/completed' when role = 'assistant' then 'item/agentMessage/delta' else 'item/completed' end as method,
        case conv_id % 5 when 0 then 'failed' when 1 then 'interrupted' else 'completed' end as turn_status from {conversations}""",
    "projects": """select c_custkey % 50 as id, max(c_acctbal) as updated_at, concat('Project ', cast(c_custkey % 50 as string)) as name from {customer} group by c_custkey % 50""",
    "jobs": f"""select event_id as id, user_id as project_id, {_EVENT_STATUS} as status, ts as updated_at, ts as locked_at, ts as created_at, event_id % 5 as attempts, 3 as max_attempts from {{events}}""",
    "claims": """select doc_id as claim_id, cast(doc_id % 97 as string) as task_id, doc_id as evidence_id,
        case doc_id % 9 when 0 then 'PROJECT' when 1 then 'ACTUAL' when 2 then 'MEASURED' when 3 then 'TESTED' when 4 then 'CALCULATED' when 5 then 'ASSUMED' when 6 then 'INTERPRETED' when 7 then 'UNKNOWN' else 'GUESSED' end as data_class from {documents}""",
    "clauses": """select p_brand as norm, p_size as edition, p_size * 60 as valid_day from {part} group by p_brand, p_size""",
    "citations": """select l_orderkey * 10 + l_linenumber as citation_id, p_brand as norm, datediff(cast(l_shipdate as date), date '1992-01-01') as cited_day
        from {lineitem} join {part} on l_partkey = p_partkey""",
    "manifest": """select 'r' as repo, case doc_id % 12 when 0 then '.env' when 1 then '.env.example' when 2 then '.env.local' when 3 then 'id_rsa' when 4 then 'key.PEM' when 5 then '.pem'
        when 6 then 'token.json' when 7 then 'README.md' when 8 then 'a/.npmrc' when 9 then 'b/notes.txt' when 10 then 'c/scan.PNG' else 'd/report.md' end as file, doc_id,
        case when doc_id % 50 = 0 then concat('<<<<<<< a', text, '=======', '>>>>>>> b') else text end as content from {documents}""",
    "named_documents": """select doc_id as id, doc_id % 40 as project_id, concat(source, ' ', cast(doc_id as string)) as name, case when doc_id % 7 = 0 then 'assignment' end as document_type, doc_id as created_at from {documents}""",
}
#: DuckDB counts days between dates by another order of arguments.
_DUCK = {"datediff(cast(l_shipdate as date), date '1992-01-01')": "datediff('day', date '1992-01-01', cast(l_shipdate as date))"}


class Tables:
    """Given and derived tables of a folder, by name, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._own: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._own:
            self._own[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in GIVEN else self._derived(name)
        return self._own[name]

    def _derived(self, name: str) -> DataFrame:
        text = SQL[name]
        for g in GIVEN:
            if "{" + g + "}" in text:
                getattr(self, g).createOrReplaceTempView(f"given_{g}")
                text = text.replace("{" + g + "}", f"given_{g}")
        out = self.spark.sql(text)
        if name == "tasks":
            out = out.select("task_id", "project_id", "tz", F.split("checks", r"\|").alias("requested_checks"), "created_at")
        if name == "results":
            evidence, finding = F.array("evidence_id").alias("evidence_ids"), F.array_compact(F.array("finding")).alias("findings")
            out = out.select("task_id", "pos", "agent", "status", finding, evidence, "message")
        if name == "claims":
            out = out.withColumn("evidence_ids", F.array("evidence_id"))
        return out


@functools.cache
def duck(name: str) -> str:
    text = SQL[name]
    for g in GIVEN:
        text = text.replace("{" + g + "}", g)
    for spark, other in _DUCK.items():
        text = text.replace(spark, other)
    return text


def with_(*names: str) -> str:
    """WITH clause of the derived tables for DuckDB."""
    return "with " + ", ".join(f"{n} as ({duck(n)})" for n in names)
