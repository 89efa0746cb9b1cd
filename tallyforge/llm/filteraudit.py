"""Filter interaction audit: what each of five filters removes, alone and behind others, in every order.

Which filters a document fails says which of the 32 subsets of filters it survives: a truth table of 32 bits, its
survival word. Counting, for every bit, the words of a part and label in which it is set gives the survivors of
every subset, and from those follow all orders: what is kept after a step, removed by it, removed before it could
be, lost by no other filter, and each filter's share over all orders.

The bits are counted by carry-save adders: three words become their sum and their carry, place by place, until
at most two words of each weight are left. Counts leave the tasks, 32 to a part and label, never documents.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import written

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Fewest words; distinct words and capitals a hundred; and the odd characters of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, ODD = 200, 50, 2, r"[#$%&*|]"
#: By failures: the word whose bit S says that none of the subset S is failed.
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & fails) for fails in range(SUBSETS)], np.uint32)


def popcounts(words: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """(n_groups, 32): how many of a group's words have each bit set."""
    counts = np.zeros((n_groups, 32), np.int64)
    lanes, weight = np.arange(32, dtype=np.uint32), 0

    def in_order(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(group, kind="stable")
        words, group = words[order], group[order]
        n = np.bincount(group, minlength=n_groups)
        return words, group, np.arange(len(words)) - (np.cumsum(n) - n)[group], n[group]

    while len(words):
        carries = [(words[:0], group[:0])]
        while True:
            words, group, rank, n = in_order(words, group)
            whole = rank < n // 3 * 3
            if not whole.any():
                break
            a, b, c = words[whole].reshape(-1, 3).T
            own = group[whole][::3]
            carries.append((a & b | (a ^ b) & c, own))
            words, group = np.concatenate([a ^ b ^ c, words[~whole]]), np.concatenate([own, group[~whole]])
        for k in range(2):  # at most two words of this weight are left in a group
            counts[group[rank == k]] += (words[rank == k, None] >> lanes & np.uint32(1)).astype(np.int64) << weight
        words, group = (np.concatenate(x) for x in zip(*carries))
        weight += 1
    return counts


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, fails) of every row of docs: fails has the bit of each filter that the whole text fails.

    A row is the copy of another if the same text has a smaller doc_id; equal ids and null ids make no copies. Texts
    are told apart by 128 bits. Labels are those of the row's doc_id: good if any says quality 1, toxic if any says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.select("doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"))
    of_text = [F.col("n") < LEAST_WORDS, 100 * F.col("distinct") < LEAST_DISTINCT * F.col("n"), 100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.length("text"), F.col("text").rlike(ODD)]
    bits = lambda conditions: sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))
    # from here on no row has its text
    rows = written(rows.select("doc_id", "part", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("again"), "text").alias("b"), bits(of_text).alias("fails")))
    first = rows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # written first, so that both sides of a join are plain exchanges, whose large keys Spark can split
    rows = rows.join(written(first), ["a", "b"], "left").join(written(known), F.col("doc_id") == F.col("_doc"), "left")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return rows.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), (F.col("fails") + F.when(copy, 1 << len(of_text)).otherwise(0)).alias("fails"))


def survivors(failed: DataFrame) -> DataFrame:
    """(part, good, toxic, s0 … s31): rows of failed (part, good, toxic, fails) that survive each subset of the filters."""
    names = [f"s{s}" for s in range(SUBSETS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").dictionary_encode()
            of_label = batch.column("good").to_numpy(zero_copy_only=False) * 2 + batch.column("toxic").to_numpy(zero_copy_only=False)
            kind, group = np.unique(part.indices.to_numpy() * 4 + of_label, return_inverse=True)
            counts = popcounts(SURVIVAL[batch.column("fails").to_numpy()], group, len(kind))
            keys = [part.dictionary.take(pa.array(kind // 4)), pa.array(kind % 4 >= 2), pa.array(kind % 2 == 1)]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c) for c in counts.T)], ["part", "good", "toxic", *names])

    found = failed.mapInArrow(run, "part string, good boolean, toxic boolean, " + ", ".join(f"{s} long" for s in names))
    return found.groupBy("part", "good", "toxic").agg(*[F.sum(s).alias(s) for s in names])


def audited(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the survivors of all subsets."""
    by_part = counts.groupBy("part").agg(
        F.array(*[F.sum(f"s{s}") for s in range(SUBSETS)]).alias("n"),
        *[F.array(*[F.sum(F.when(F.col(label), F.col(f"s{s}")).otherwise(0)) for s in range(SUBSETS)]).alias(label) for label in ("good", "toxic")],
    )
    size = len(FILTERS)

    def share(bit: int) -> Column:
        """What the filter removes over all orders: behind each subset of the others, as often as that subset comes before it."""
        before = [s for s in range(SUBSETS) if not s & bit]
        weight = lambda s: math.factorial(s.bit_count()) * math.factorial(size - 1 - s.bit_count())
        return sum((weight(s) * (F.col("n")[s] - F.col("n")[s | bit]) for s in before), F.lit(0))

    shares = F.array(*[share(1 << k) for k in range(size)])
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(FILTERS)])
    rows = by_part.withColumns({"shares": shares, "filter_order": F.explode(orders)}).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    before = sum((F.when(earlier.contains(c), 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"at": F.instr(F.lit(FILTERS), letter) - 1, "before": before}).withColumn("bit", F.expr("shiftleft(1, at)"))
    rows = rows.withColumn("after", F.col("before") + F.col("bit"))
    n = lambda s, of="n": F.get(of, s)
    removed = n(F.col("before")) - n(F.col("after"))
    every = SUBSETS - 1
    return rows.select(
        "part", "filter_order", "step", n(F.col("after")).alias("kept"), removed.alias("removed"), (n(F.lit(0)) - n(F.col("bit")) - removed).alias("redundant"),
        (n(every - F.col("bit")) - n(F.lit(every))).alias("unique_fails"),
        *[(n(F.col("before"), label) - n(F.col("after"), label)).alias(f"{label}_lost") for label in ("good", "toxic")],
        F.get("shares", F.col("at")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of five filters.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are not looked at. The filters: A, under
    200 words; B, less than half of the words distinct; C, more than 2 % of the characters in A-Z; D, any of #$%&*|; E,
    a copy. A part is a source, null being the empty one. Null texts are empty, texts of any length are read whole.
    Repeated rows count as often as they are there; those with equal doc_id are no copies of each other, and a null
    doc_id neither is a copy nor makes one, and has no labels. Repeated labels of a doc_id are one. Without documents
    there are no parts and no rows; without labels nothing good or toxic is lost.
    """
    return audited(survivors(failures(docs, labels)))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All documents by source, in all 120 orders of the filters."""
    return filter_audit(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), labelled as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), firsts as (
  select text, min(doc_id) as first from d group by text
), failed as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(first < d.doc_id, false)] as fails
  from d join firsts using (text) left join labelled on labelled.doc_id = d.doc_id
), alike as (
  select part, good, toxic, fails, count(*) as n from failed group by all
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as c
), orders as (
  select a.c || b.c || c.c || d.c || e.c as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps as (
  select filter_order, unnest(range(1, 6)) as step from orders
), judged as (
  select part, good, toxic, n, filter_order, step, substring(filter_order, step, 1) as c, fails[ascii(substring(filter_order, step, 1)) - 64] as own,
         len(list_filter(range(1, step), lambda k: fails[ascii(substring(filter_order, k, 1)) - 64])) > 0 as gone, len(list_filter(fails, lambda x: x)) as n_fails
  from alike, steps
), summed as (
  select part, filter_order, step, c, coalesce(sum(n) filter (where not gone and not own), 0)::bigint as kept, coalesce(sum(n) filter (where not gone and own), 0)::bigint as removed,
         coalesce(sum(n) filter (where gone and own), 0)::bigint as redundant, coalesce(sum(n) filter (where own and n_fails = 1), 0)::bigint as unique_fails,
         coalesce(sum(n) filter (where not gone and own and good), 0)::bigint as good_lost, coalesce(sum(n) filter (where not gone and own and toxic), 0)::bigint as toxic_lost
  from judged group by part, filter_order, step, c
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, c))::bigint as shapley from summed
"""
