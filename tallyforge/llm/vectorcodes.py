"""Vector compression by codebooks, each searched by a geometric near-neighbour access tree (GNAT).

A vector of integers is cut into equal parts; a part is written as the number of its nearest entry in the codebook of
its place. Entries are looked up in a tree: a node has split points, each other entry belongs to its nearest
split point, and for each child and split point the node knows the least and greatest distance between them. A
query's distance to a split point and the best distance so far rule a whole child out if no distance in that range
can be as small. Square roots are rounded away from ruling out, a child goes only if all in it are strictly farther,
and what is left is compared by integer squares, ties by the entry's number: the answer is that of a full search.

Codebooks are a few hundred entries and go to all tasks as trees; back come sums by entry and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import joined, written

#: Parts of a vector, entries of a codebook, rounds of fitting, and integer steps in a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node, and entries up to which there is no node.
ARITY, LEAF = 8, 8
#: Part of a sum of distances that is allowed for rounding before a child is ruled out.
SLACK = 2.0**-40
#: Vectors searched at once, so that memory follows this number.
TOGETHER = 4_096


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b, integers of up to 64 bits."""
    most = max(int(np.abs(x).max(initial=0)) for x in (a, b))
    if 4 * a.shape[1] * most * most < 2**53:  # then every sum is exact in floating point too, and faster
        x, y = a.astype(float), b.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[:, k]) ** 2
    return out


class Node(NamedTuple):
    """Split points by entry number, children (a Node, entry numbers or None), and ranges of distances [split, child]."""

    splits: np.ndarray
    children: list
    least: np.ndarray
    greatest: np.ndarray


class Gnat:
    """The tree over the entries of one codebook."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.top = self._grown(np.arange(len(entries)))

    def _grown(self, own: np.ndarray) -> Node | np.ndarray:
        if len(own) <= LEAF:
            return own
        # split points far from each other: each is the entry farthest from those before
        chosen = [0]
        near = squares(self.entries[own], self.entries[own[:1]])[:, 0]
        while len(chosen) < ARITY and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, squares(self.entries[own], self.entries[own[chosen[-1:]]])[:, 0])
        if len(chosen) == 1:  # all alike: nothing can be ruled out
            return own
        splits, rest = own[chosen], np.delete(own, chosen)
        apart = squares(self.entries[splits], self.entries[rest])
        of = apart.argmin(0)
        least, greatest = np.zeros((len(splits),) * 2), np.full((len(splits),) * 2, np.inf)
        children: list = []
        for j in range(len(splits)):
            mine = of == j
            children.append(self._grown(rest[mine]) if mine.any() else None)
            if mine.any():
                least[:, j], greatest[:, j] = np.sqrt(apart[:, mine].min(1)), np.sqrt(apart[:, mine].max(1))
        return Node(splits, children, least, greatest)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest entry, the lowest number among equals."""
        number, best = np.full(len(queries), len(self.entries), np.int64), np.full(len(queries), np.iinfo(np.int64).max)
        self.ruled_out = 0
        self._search(self.top, queries, np.arange(len(queries)), number, best)
        return number, best

    def _better(self, entries: np.ndarray, found: np.ndarray, rows: np.ndarray, number: np.ndarray, best: np.ndarray) -> None:
        order = np.argsort(entries)  # argmin takes the first of equals
        at = order[found[:, order].argmin(1)]
        d, e = found[np.arange(len(rows)), at], entries[at]
        closer = (d < best[rows]) | (d == best[rows]) & (e < number[rows])
        best[rows[closer]], number[rows[closer]] = d[closer], e[closer]

    def _search(self, node: Node | np.ndarray, queries: np.ndarray, rows: np.ndarray, number: np.ndarray, best: np.ndarray) -> None:
        entries = node.splits if isinstance(node, Node) else node
        found = squares(queries[rows], self.entries[entries])
        self._better(entries, found, rows, number, best)
        if not isinstance(node, Node):
            return
        home, away = found.argmin(1), np.sqrt(found)
        for first in (True, False):  # the child of the nearest split point makes the best distance small before others are looked at
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                which = home == j if first else home != j
                if not first:
                    reach, to = np.sqrt(best[rows]), away
                    allowed = SLACK * (reach[:, None] + to + np.where(np.isinf(node.greatest[:, j]), 0, node.greatest[:, j]))
                    out = ((to - node.greatest[:, j] - reach[:, None] > allowed) | (node.least[:, j] - to - reach[:, None] > allowed)).any(1)
                    self.ruled_out += int((out & which).sum())
                    which &= ~out
                if which.any():
                    self._search(child, queries, rows[which], number, best)


def components(vectors: pa.Array, limit: int) -> tuple[np.ndarray, pa.Array]:
    """(which rows are kept, their integer components as lists): without null rows and those with null or non-finite components."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    n = len(lists)
    starts, ends = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:]
    flat = lists.values.to_numpy(zero_copy_only=False) if len(lists.values) else np.zeros(0)  # a null is no number here
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    keep = np.array(lists.is_valid()) & (bad[ends] == bad[starts])
    size = np.where(keep, ends - starts, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.clip(np.floor(SCALE * flat), -limit, limit)
    inside = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    values = whole[inside].astype(np.int32)
    own = size[keep]
    return keep, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(own)).astype(np.int32)), pa.array(values)) if n else pa.array([], pa.list_(pa.int32()))


def integers(vectors: DataFrame, limit: int) -> DataFrame:
    """(vec_id, label, v) of the rows of vectors (vec_id, embedding, label) that are kept; v has integers, held to +-limit."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    schema = rows.drop("v").schema.add("v", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, v = components(batch.column("v"), limit)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), v], schema.names)

    return rows.mapInArrow(run, schema)


def _matrix(v: pa.Array, parts: int, width: int) -> np.ndarray:
    """(parts, rows, width) of lists of integers; short lists are filled up with zeros."""
    n = len(v)
    offsets = v.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.zeros((n, parts * width), np.int64)
    flat = v.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if n else np.zeros(0, int)
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - (offsets[0] if n else 0), size)] = flat
    return out.reshape(n, parts, width).transpose(1, 0, 2)


class Codebooks(NamedTuple):
    """Entries (parts, entries, width) of whole numbers."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _batches(batches: Iterator[pa.RecordBatch], parts: int, width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            piece = batch.slice(at, TOGETHER)
            yield piece, _matrix(piece.column("v"), parts, width)


def fitted(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of rows (vec_id, v) of at most `size` components: from the rows of the smallest vec_ids, moved `rounds` times.

    A round gives each part to its nearest entry and moves each entry to the floor of the mean of its parts. The driver
    sees `entries` rows at first and then a sum for each entry and component.
    """
    width = -(-size // parts)
    first = rows.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    books = Codebooks(_matrix(first.chunk(0) if isinstance(first, pa.ChunkedArray) else first, parts, width))
    n = books.entries.shape[1]
    for _ in range(rounds if n else 0):
        sent = rows.sparkSession.sparkContext.broadcast([Gnat(e) for e in books.entries])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, n, width + 1), np.int64)  # the last place counts
            for _, cut in _batches(batches, parts, width):
                for p, tree in enumerate(sent.value):
                    to, _ = tree.nearest(cut[p])
                    order = np.argsort(to, kind="stable")
                    own, starts, counts = np.unique(to[order], return_index=True, return_counts=True)
                    if len(own):
                        total[p, own, :width] += np.add.reduceat(cut[p][order], starts)
                        total[p, own, width] += counts
            flat = total.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["place", "sum"])

        found = rows.select("v").mapInArrow(run, "place long, sum long").groupBy("place").agg(F.sum("sum").alias("sum")).toArrow()
        flat = np.zeros(parts * n * (width + 1), np.int64)
        flat[found.column("place").to_numpy()] = found.column("sum").to_numpy()
        sums, counts = np.split(flat.reshape(parts, n, width + 1), [width], axis=2)
        books = Codebooks(np.where(counts > 0, sums // np.maximum(counts, 1), books.entries))
        sent.unpersist()
    return books


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of rows (vec_id, label, v): the nearest entries' numbers in hexadecimal, and the squared distances summed."""
    parts, _, width = books.entries.shape
    sent = rows.sparkSession.sparkContext.broadcast([Gnat(e) for e in books.entries])
    digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{k:0{digits}x}" for k in range(len(sent.value[0].entries))], object)
        for piece, cut in _batches(batches, parts, width):
            found = [tree.nearest(cut[p]) for p, tree in enumerate(sent.value)]
            code = sum((names[k] for k, _ in found[1:]), names[found[0][0]])
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), pa.array(code, pa.string()), pa.array(sum(d for _, d in found))], schema.names)

    schema = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    return rows.mapInArrow(run, schema)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of the rows of vectors (vec_id, embedding, label) that are kept.

    Rows whose vector is null, or has a null or non-finite component, are dropped; an empty vector is kept. Vectors are
    as long as the longest one, or longer, so that it can be cut into `parts`: what others lack is zero. Components are
    held to whole numbers whose squared distances fit into 64 bits (2^27 at 64 components, so only values beyond 131072
    are touched). Null vec_ids begin no entry but are coded; of rows with equal vec_id those with the smaller vector
    come first; repeated rows count each. With fewer rows than `entries` there are as many entries as rows with ids; if
    no row has an id, code is empty and error null. label_error sums over equal labels, nulls together; it is null if the
    sum needs over 64 bits. Other columns are not looked at. Empty in, empty out.
    """
    size = max(vectors.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    rows = written(integers(vectors, math.isqrt(2**61 // (size + parts))))
    books = fitted(rows, size, parts, entries, rounds)
    if books.entries.shape[1]:
        coded = encoded(rows, books)
    else:
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(None).cast("long").alias("error"))
    label = F.col("label").cast("string")
    coded = written(coded.withColumns({"_none": label.isNull(), "_label": F.coalesce(label, F.lit(""))}))
    # summed in the tasks first, so a frequent label is a row of each
    sums = written(coded.groupBy("_none", "_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    out = joined(coded, sums, ["_none", "_label"])
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """All embeddings in four parts of 256 entries, after four rounds."""
    out = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """All distances by a join of all parts and entries; min over 256 * distance + number is the lowest number among the nearest."""
    nearest = "select vec_id, p, min((list_inner_product(c.x, c.x) - 2 * list_inner_product(c.x, b.x) + list_inner_product(b.x, b.x))::bigint * 256 + e) as m from cut c join {b} b using (p) group by vec_id, p"
    steps = []
    for k in range(ROUNDS):
        steps.append(f"near{k} as materialized ({nearest.format(b=f'book{k}')})")
        steps.append(f"""sums{k} as materialized (select p, e, list(v order by i)::double[] as x from (select p, m % 256 as e, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) / count(*) as v
  from (select n.p, n.m, unnest(c.x)::hugeint as v, unnest(range(len(c.x))) as i from near{k} n join cut c using (vec_id, p)) group by p, m % 256, i) group by p, e)""")
        steps.append(f"book{k + 1} as materialized (select b.p, b.e, coalesce(s.x, b.x) as x from book{k} b left join sums{k} s using (p, e))")
    return f"""
with whole as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cut as materialized (
  select vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] as x from whole, range({PARTS}) r(p)
), firsts as (
  select vec_id, row_number() over (order by vec_id) - 1 as e from whole qualify e < {ENTRIES}
), book0 as materialized (
  select p, e, x from cut join firsts using (vec_id)
), {", ".join(steps)}, last as materialized (
  {nearest.format(b=f"book{ROUNDS}")}
), coded as (
  select w.vec_id, w.label, string_agg(printf('%02x', (m % 256)::int), '' order by p) as code, sum(m // 256)::bigint as error from last join whole w using (vec_id) group by w.vec_id, w.label
), digest as (
  select sha256(string_agg(v::bigint::varchar, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, unnest(x) as v, unnest(range(len(x))) as i from book{ROUNDS})
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, digest
"""


OP12_SQL = _sql()
