"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

A run of RUN consecutive lines that occurred before, in the order of (doc_id, hash of the text, line), is
deleted; the earliest occurrence stays. Each document's lines are hashed, and of every RUN lines in a row the smallest
hash is selected, so that equal runs are sure to select equal fingerprints: about 2 / (RUN + 1) of the
lines, and only these positions leave the documents, with the hashes of their RUN - 1 neighbours on either
side. Positions meet by fingerprint, and those that meet nobody are done with. From the others matches
are extended before and behind, to each run that the fingerprint stands for; runs that were met before
join to the whole stretch to be deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import joined, written

#: Lines of the shortest run that is deleted, and so the window of the guarantee: of op4_line_dedup, whose SQL says two,
#: and of the pipeline's stage, where a line that is repeated alone goes too.
RUN, STAGE_RUN = 2, 1


def deduplicated(docs: DataFrame, run: int = RUN) -> DataFrame:
    """All columns of docs, text without the lines of later repeated runs, and n_lines, n_removed.

    Lines end at \\n. Lines of white space alone take no part: they stay and do not part a run. A document
    with fewer than `run` other lines keeps all. Null text stays null with no lines, and a text whose lines all
    go becomes empty. Lines are compared without white space at their ends. Rows with equal doc_id and
    text are one document and get the same result; of different texts under one doc_id, or without one, that with the
    smaller 64-bit hash comes first; a null doc_id comes before all others. Columns of
    docs named n_lines or n_removed are replaced. No rows in, no rows out.
    """
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    doc, copy = F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text")
    # of each line with other than white space: its place, and its hash
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("line")))
    lines = F.transform(F.filter(lines, lambda s: s["line"] != ""), lambda s: F.struct(s["at"], F.xxhash64(s["line"]).alias("h")))
    hashed = docs.select(doc.alias("doc"), copy.alias("copy"), lines.alias("lines")).where(F.size("lines") >= run)

    n = F.size("lines")

    def least(i: Column) -> Column:
        """Where the smallest hash of the run from i on is."""
        return F.array_min(F.transform(F.slice("lines", i + 1, run), lambda s, j: F.struct(s["h"], (i + j).alias("i"))))["i"]

    def position(i: Column) -> Column:
        from_ = F.greatest(i - run + 1, F.lit(0))
        around = F.slice("lines", from_ + 1, F.least(i + run, n) - from_)
        return F.struct(F.element_at("lines", i + 1)["h"].alias("fingerprint"), from_.alias("from"), around.alias("around"))

    selected = F.array_distinct(F.transform(F.sequence(F.lit(0), n - run), least)) if run > 1 else F.sequence(F.lit(0), n - 1)
    positions = hashed.select("doc", "copy", F.explode(F.transform(selected, position)).alias("p"))
    positions = written(positions.select("doc", "copy", "p.*"))
    # sums come before the shuffle, so a frequent line is a row per task
    repeated = written(positions.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1"))
    race = joined(positions, repeated, ["fingerprint"])

    def extended(i: Column) -> Column:
        own = F.slice("around", i + 1, run)
        h = F.transform(own, lambda s: s["h"])
        return F.struct((F.col("from") + i).alias("first"), F.array_min(h).alias("least"), F.xxhash64(h).alias("whole"), F.transform(own, lambda s: s["at"]).alias("at"))

    runs = F.filter(F.transform(F.sequence(F.lit(0), F.size("around") - run), extended), lambda r: r["least"] == F.col("fingerprint"))
    race = written(race.select("doc", "copy", "fingerprint", F.explode(runs).alias("r")).select("doc", "copy", "fingerprint", "r.first", "r.whole", "r.at"))
    # where each run occurs first, if it occurs again
    spans = race.groupBy("fingerprint", "whole").agg(F.min(F.struct("doc", "copy", "first")).alias("earliest"), F.max(F.struct("doc", "copy", "first")).alias("latest"), F.count("*").alias("n"))
    spans = written(spans.where("earliest <> latest").drop("latest"))
    later = joined(race, spans, ["fingerprint", "whole"]).where(F.struct("doc", "copy", "first") > F.col("earliest"))
    gone = later.groupBy(F.col("doc").alias("_doc"), F.col("copy").alias("_copy")).agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("_gone"))

    rows = docs.select(F.struct(*others).alias("_row"), "text", doc.alias("_d"), copy.alias("_c"))
    rows = rows.join(gone, (F.col("_d") == F.col("_doc")) & (F.col("_c") == F.col("_copy")), "left")
    every = F.split("text", "\n")

    def without(s: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(s["every"]) - 1), s["gone"])
        return F.array_join(F.transform(left, lambda i: F.element_at(s["every"], i + 1)), "\n")

    # as an array of one struct, so that the lines are split once
    cut = F.transform(F.array(F.struct(every.alias("every"), F.col("_gone").alias("gone"))), without)[0]
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(cut)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(every)).cast("long")
    n_removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
    out = rows.select("_row.*", text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of all documents and how many of each are deleted; the text left as SHA-256."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
with lines as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
), own as (
  select doc_id, pos, regexp_replace(line, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') as line,
         row_number() over (partition by doc_id order by pos) as first
  from lines where regexp_replace(line, '[\s\x0B]+', '', 'g') <> ''
), runs as (
  select doc_id, first, pos, lead(pos) over w as pos2, line, lead(line) over w as line2
  from own window w as (partition by doc_id order by pos)
), judged as (
  select *, row_number() over (partition by line, line2 order by doc_id, first) as nth from runs where pos2 is not null
), gone as (
  select distinct doc_id, unnest([pos, pos2]) as pos from judged where nth > 1
)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines,
       (select count(*) from gone g where g.doc_id = d.doc_id)::bigint as n_removed,
       sha256(coalesce((select string_agg(line, chr(10) order by pos) from lines l
                        where l.doc_id = d.doc_id and not exists (select 1 from gone g where g.doc_id = l.doc_id and g.pos = l.pos)), '')) as kept_sha256
from documents d
"""


def stage_line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later repeated lines, be it one between others or a whole text; n_chars follows the text, all rows stay.

    A null text stays null, with null n_chars; a text all of whose lines go becomes empty. Rows with equal doc_id and text
    stay alike; other ties, null ids and extra columns are as `deduplicated` says. Empty in, empty out.
    """
    out = deduplicated(docs, STAGE_RUN)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
