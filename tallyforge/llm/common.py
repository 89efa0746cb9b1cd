"""What the corpus operators share: words of whole texts as arrays, rolling hashes, written tables.

Texts reach Python in Arrow batches; a batch is cut into pieces of a few megabytes, so memory
follows the piece (or the longest single text), never the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.sources import shared_path

#: Bytes and rows of text handled at once inside a task.
PIECE_BYTES, PIECE_ROWS = 4_000_000, 2_000
#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: ASCII letters, and what in ASCII is neither letter, digit nor white space.
LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
SYMBOL = NOT_ALNUM & ~SPACE

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Words of a batch: a 64-bit hash each, byte ranges in data, and where each row's words begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, so that equal inputs alone give equal outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and each row's offset. Null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, separators: np.ndarray = SPACE, table: np.ndarray | None = None, apart: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Words between separators, after replacing each byte by table's entry for it.

    apart: a word also ends between a byte of the first kind and one of the second.
    """
    data, offsets = text_bytes(texts)
    if table is not None:
        data = table[data]
    n = len(data)
    inside = ~separators[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    if apart is not None:
        parted = apart[0][data[:-1]] & apart[1][data[1:]]
        before[1:] |= parted
        after[:-1] |= parted
    start = np.flatnonzero(inside & (before | cut[:-1]))
    end = np.flatnonzero(inside & (after | cut[1:])) + 1
    return Words(hash_ranges(data, start, end), start, end, np.searchsorted(start, offsets), data)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, eight bytes at a time over all ranges that are long enough."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((max(len(data), 1),), "<u8", padded, 0, (1,))
    length = end - start
    keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    out = mix(length.astype(np.uint64) * _ODD)
    at, k = np.arange(len(start)), 0
    while len(at):
        out[at] = mix((out[at] ^ (lanes[start[at] + 8 * k] & keep[np.minimum(length[at] - 8 * k, 8)])) * _ODD + np.uint64(k))
        k += 1
        at = at[length[at] > 8 * k]
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length()) if n else 1 << 20
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have[0][:n], have[1][:n]


def windows(hashes: np.ndarray, length: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Rolling (Karp-Rabin) hash of every `length` consecutive values, by where they start."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(n, base)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * up, dtype=np.uint64)])
    return mix((sums[length:] - sums[:-length]) * down[: n - length + 1])


def fits(first: np.ndarray, length: int) -> np.ndarray:
    """For each value, whether `length` values from there on lie in its own row."""
    ends = np.repeat(first[1:], np.diff(first))
    return ends - np.arange(len(ends)) >= length


def sliding(a: np.ndarray, width: int, of: Callable) -> np.ndarray:
    """of (np.minimum or np.maximum) over every `width` consecutive values."""
    if len(a) < width:
        return a[:0]
    have = 1
    while have * 2 <= width:
        a = of(a[:-have], a[have:])
        have *= 2
    return of(a[: len(a) - (width - have)], a[width - have :]) if have < width else a


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches over which all keys stay equal."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return start, np.append(start[1:], n)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text; one longer text is a slice of its own."""
    for batch in batches:
        sizes = np.cumsum(np.diff(text_bytes(batch.column(column))[1]))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = int(min(max(np.searchsorted(sizes, done + most, "right"), at + 1), at + PIECE_ROWS))
            yield batch.slice(at, to - at)
            at = to


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, kept when executors are lost."""
    path = shared_path(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the caller's can clash with ours."""
    return df.select(*[F.col(n).cast("string").alias(n) if n == "text" else F.col(n) for n in names])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); only nodes that have edges.

    A round hooks every node to its smallest neighbour or itself, follows the hooks to their roots by
    pointer doubling, and replaces the ends of all edges by the roots. A root that still has edges stood
    for two nodes at least, so rounds and doublings are both logarithmic. Each result is a written table.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
        while True:
            up = written(_followed(up, up))
            if not up.where("moved").limit(1).count():
                break
        up = up.drop("moved")
        found = up if found is None else written(_followed(found, up).drop("moved"))
        a, b = up.select(F.col("node").alias("a"), F.col("component").alias("_a")), up.select(F.col("node").alias("b"), F.col("component").alias("_b"))
        moved = edges.join(a, "a").join(b, "b").where("_a <> _b")
        edges = written(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found


def _followed(found: DataFrame, up: DataFrame) -> DataFrame:
    step = up.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    to = F.coalesce("_to", "component")
    return found.drop("moved").join(step, "component", "left").select("node", to.alias("component"), (to != F.col("component")).alias("moved"))


#: A key is frequent if it has more than this part of a task's share of the rows, and so many at least.
SHARE, LEAST_ROWS = 0.25, 256


def joined(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """rows inner-joined with the written table known (keys, n, others): a row for each key, n of rows at most have it.

    Of keys that more than a quarter of a task's share of all n have, there are at most four a task. They are broadcast
    and their rows stay where they are; all others meet by an exchange, in which no key is frequent.
    """
    total = known.agg(F.sum("n")).first()[0] or 0
    often = max(SHARE * total / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_ROWS)
    frequent, others = known.where(F.col("n") > often), known.where(F.col("n") <= often)
    here = rows.join(F.broadcast(frequent), keys)
    there = rows.join(F.broadcast(frequent.select(*keys)), keys, "left_anti").join(others, keys)
    return here.unionByName(there)


def dealt(keys: DataFrame, squares: Column, *columns: str | Column) -> DataFrame:
    """Rows (choice, fp, columns) as (choice, part, columns), sorted by choice and part; a choice whose sum of squares is above 1 is dealt out as squares."""
    crowded = keys.groupBy("choice").agg(F.ceil(squares).cast("int").alias("sides")).where("sides > 1")
    keys = keys.join(crowded, "choice", "left")
    side = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("sides")).cast("int")
    # part 0: all pairs of the run; parts 1 and 2, the sides of a square off the diagonal: only pairs across
    pairs = F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda j: F.struct(F.least(side, j).alias("i"), F.greatest(side, j).alias("j"), F.when(side == j, 0).when(side < j, 1).otherwise(2).alias("part")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part")))
    rows = keys.withColumn("s", F.explode(F.when(F.col("sides").isNull(), one).otherwise(pairs)))
    rows = rows.select(F.xxhash64("choice", "s.i", "s.j").alias("choice"), "s.part", *columns)
    return rows.repartition("choice").sortWithinPartitions("choice", "part")


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables that hold all rows of each of their choices."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        choice = batch.column("choice").to_numpy()
        cut = int(np.searchsorted(choice, choice[-1])) if len(choice) else 0  # the last run may go on
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
