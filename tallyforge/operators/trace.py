"""Evidence, coverage and norms: what a claim rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge import schemas as S

ACCEPTING = ["PASS", "ACCEPTED", "ACCEPTED_ALTERNATIVE"]


def fact_class_check(claims: DataFrame) -> DataFrame:
    """claims with valid_class, and fact: fact, soft (assumed, interpreted, unknown) or invalid; null is invalid."""
    valid = F.coalesce(F.col("data_class").isin(*S.DATA_CLASSES), F.lit(False))
    return claims.withColumns({"valid_class": valid, "fact": F.when(~valid, "invalid").when(F.col("data_class").isin(*S.SOFT_CLASSES), "soft").otherwise("fact")})


def admissible(evidence: DataFrame) -> DataFrame:
    """Without what was only remembered: that is no evidence."""
    return evidence.where("origin is distinct from 'MEMORY'")


def evidence_traceability(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, task_id, traceable): a claim has evidence that exists, or a class that says it has none."""
    ids = claims.select("claim_id", "task_id", "data_class", F.explode_outer("evidence_ids").alias("evidence_id"))
    there = evidence.select("evidence_id").distinct().withColumn("_there", F.lit(True))
    found = ids.join(there, "evidence_id", "left").groupBy("claim_id", "task_id", "data_class").agg(F.coalesce(F.bool_or("_there"), F.lit(False)).alias("has"))
    soft = F.coalesce(F.col("data_class").isin(*S.SOFT_CLASSES), F.lit(False))
    return found.select("claim_id", "task_id", (F.col("has") | soft).alias("traceable"))


def assignment_coverage(items: DataFrame, findings: DataFrame) -> DataFrame:
    """(task_id, item_id, n_findings, covered) of each assignment item."""
    n = findings.groupBy("task_id", "item_id").agg(F.count("*").alias("n_findings"))
    out = items.join(n, ["task_id", "item_id"], "left").fillna(0, ["n_findings"])
    return out.select("task_id", "item_id", "n_findings", (F.col("n_findings") > 0).alias("covered"))


def normative_asof(citations: DataFrame, clauses: DataFrame) -> DataFrame:
    """citations (citation_id, norm, cited_on) with the edition in force that day, and whether it is the current one.

    No edition in force: status UNCERTAINTY. Each norm's editions are gathered in one sorted array, a small
    dimension, so a citation is matched without a window over all citations of its norm.
    """
    editions = clauses.groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("valid_from", "edition"))).alias("editions"))
    out = citations.join(editions, "norm", "left")
    in_force = F.element_at(F.filter("editions", lambda e: e["valid_from"] <= F.col("cited_on")), -1)
    current = F.element_at("editions", -1)["edition"]
    out = out.withColumns({"_in": F.when(F.size(F.filter("editions", lambda e: e["valid_from"] <= F.col("cited_on"))) > 0, in_force), "_current": current})
    edition = F.col("_in.edition")
    status = F.when(edition.isNull(), "UNCERTAINTY").when(edition == F.col("_current"), "CURRENT").otherwise("HISTORICAL")
    return out.select("citation_id", "norm", "cited_on", edition.alias("edition"), status.alias("status"))


def contradictions(findings: DataFrame) -> DataFrame:
    """(task_id, element, n_accepting, n_blocking, accepting, blocking): each element on which findings contradict each other.

    The last two are the smallest finding_id of either side; with contested_findings they say every pair of
    contradiction_pairs in one row per element and finding, whatever the number of findings.
    """
    yes, no = F.col("status").isin(*ACCEPTING), F.col("status").isin(*S.BLOCKING)
    found = findings.where(yes | no).groupBy("task_id", "element").agg(
        F.count_if(yes).alias("n_accepting"), F.count_if(no).alias("n_blocking"), F.min(F.when(yes, F.col("finding_id"))).alias("accepting"), F.min(F.when(no, F.col("finding_id"))).alias("blocking")
    )
    return found.where("n_accepting > 0 and n_blocking > 0")


def contested_findings(findings: DataFrame) -> DataFrame:
    """(task_id, element, finding_id, accepts, n_against): the findings that contradict others, and how many these are."""
    rows = findings.where(F.col("status").isin(*ACCEPTING, *S.BLOCKING)).select("task_id", "element", "finding_id", F.col("status").isin(*ACCEPTING).alias("accepts"))
    rows = rows.join(contradictions(findings).select("task_id", "element", "n_accepting", "n_blocking"), ["task_id", "element"])
    return rows.select("task_id", "element", "finding_id", "accepts", F.when(F.col("accepts"), F.col("n_blocking")).otherwise(F.col("n_accepting")).alias("n_against"))


def contradiction_pairs(findings: DataFrame) -> DataFrame:
    """(task_id, element, a, b): findings of one element of a task of which one accepts and the other blocks, a < b.

    For elements of few findings: an element's rows are the product of its two sides. contradictions and
    contested_findings hold the same in rows that grow with the findings.
    """
    blocks = S.BLOCKING
    yes = findings.where(F.col("status").isin(*ACCEPTING)).select("task_id", "element", F.col("finding_id").alias("x"))
    no = findings.where(F.col("status").isin(*blocks)).select("task_id", "element", F.col("finding_id").alias("y"))
    return yes.join(no, ["task_id", "element"]).where("x <> y").select("task_id", "element", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def final_audit_gate(status: DataFrame, undisclosed: DataFrame, trace: DataFrame, coverage: DataFrame) -> DataFrame:
    """(task_id, releasable, failed): the checks of a release that fail, comma-separated.

    status: (task_id, status). undisclosed: (task_id, n) of warnings and uncertainties that are not disclosed.
    """
    traced = trace.groupBy("task_id").agg(F.bool_and("traceable").alias("traced"))
    covered = coverage.groupBy("task_id").agg(F.bool_and("covered").alias("covered"))
    out = status.join(undisclosed, "task_id", "left").join(traced, "task_id", "left").join(covered, "task_id", "left")
    checks = [
        (F.col("status").isin(*S.BLOCKING), "blocking"),
        (F.coalesce("n", F.lit(0)) > 0, "undisclosed"),
        (~F.coalesce("traced", F.lit(True)), "untraceable"),
        (~F.coalesce("covered", F.lit(True)), "uncovered"),
    ]
    failed = F.array_join(F.array_compact(F.array(*[F.when(bad, said) for bad, said in checks])), ",")
    return out.select("task_id", (failed == "").alias("releasable"), failed.alias("failed"))
