"""Substring dedup: which words lie in a window of consecutive words that also starts elsewhere.

Level-wise doubling. A window of the wanted size can repeat only if all that lies in it repeats. At
each length (9, then 18 for 35 words) every window still in the race is stood for by its smallest
sub-window of that length, a choice that depends on the window's words alone, so only about one
position in fourteen is counted. Windows whose sub-window occurs once leave; the others go on at
twice the length, and at last whole windows are compared. Which sub-windows repeat is handed to the
next level as a Bloom filter of bounded size: a false hit costs a comparison, never a wrong result, so
where more repeat than it can tell apart the levels leave out less and at most all windows are compared.

A passage in a large share of the documents would send them all to one task. Sub-windows behind which are
more windows than a fair share are therefore known beforehand, at most a few for each task; windows
behind them are counted by their whole content, in the tasks before they are exchanged, and compared
apart from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACE, fits, mix, pieces, runs, sliding, text_columns, windows, words, written

#: Bits of a level's filter: 16 for each repeated sub-window, within these powers of two (32 MB at most).
LEAST_BITS, MOST_BITS = 20, 28
#: Windows a reducer holds at once, unless a single sub-window, none of the frequent ones, has more.
HELD_WINDOWS = 1_000_000
#: A sub-window is frequent if it has more than this part of a task's share of windows, and so many at least; a window likewise by pieces of text that have it.
SHARE, LEAST_WINDOWS, LEAST_PIECES = 0.05, 256, 16


class Level(NamedTuple):
    """Which sub-windows of a length repeat, as a filter, and which of them are frequent, in order."""

    length: int
    bits: int
    filter: np.ndarray
    frequent: np.ndarray


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return hashes & mask, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)


def _known(level: Level, hashes: np.ndarray) -> np.ndarray:
    a, b = _slots(hashes, level.bits)
    at = lambda s: level.filter[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1)
    return (at(a) & at(b)).astype(bool)


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def lengths(size: int, least: int = 5) -> list[int]:
    """Ever doubled lengths below size: 35 gives 9 and 18."""
    out = []
    while (size := -(-size // 2)) >= least:
        out.append(size)
    return out[::-1]


def _racing(text: pa.Array, size: int, levels: list[Level]):
    """Words, starts of windows that have passed all levels, and their smallest sub-window at the last."""
    w = words(text, SPACE)
    starts = np.flatnonzero(fits(w.first, size))
    stand = None
    for level in levels:
        if not len(starts):
            break
        stand = sliding(windows(w.hash, level.length), size - level.length + 1, np.minimum)[starts]
        known = _known(level, stand)
        starts, stand = starts[known], stand[known]
    return w, starts, stand


def _counted(docs: DataFrame, size: int, length: int, sent: Broadcast) -> DataFrame:
    """(h, full, n, rows): sub-windows of this length that stand for racing windows at two places at least, full null;
    and windows that repeat and whose sub-window of the level before is frequent, h and full being their two hashes.
    rows: windows behind the sub-window, and pieces of text that have the window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for part in pieces(batches):
            w, starts, stand = _racing(part.column("text"), size, levels)
            if not len(starts):
                continue
            sub = windows(w.hash, length)
            width = size - length + 1
            least = sliding(sub, width, np.minimum)
            wanted = np.zeros(len(sub) + width - 1, np.uint64)
            wanted[starts + width - 1] = least[starts]
            # a place is chosen if it equals the minimum of a racing window around it
            values, counts = np.unique(sub[sliding(wanted, width, np.maximum) == sub], return_counts=True)
            none, behind = pa.nulls(len(values), pa.int64()), np.bincount(np.searchsorted(values, least[starts]), minlength=len(values))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), none, pa.array(np.minimum(counts, 2).astype(np.int64)), pa.array(behind)], ["h", "full", "n", "rows"])
            if levels and len(levels[-1].frequent):
                own = starts[_among(stand, levels[-1].frequent)]
                a, b = _whole(w.hash, size, own)
                order = np.lexsort((b, a))
                lo, hi = runs(a[order], b[order])
                yield pa.RecordBatch.from_arrays([pa.array(a[order][lo].view(np.int64)), pa.array(b[order][lo].view(np.int64)), pa.array(np.minimum(hi - lo, 2)), pa.array(np.ones(len(lo), np.int64))], ["h", "full", "n", "rows"])

    found = docs.mapInArrow(run, "h long, full long, n long, rows long").groupBy("h", "full")
    return found.agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).where("n > 1")


def _whole(hashes: np.ndarray, size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the whole windows at these places."""
    return windows(hashes, size)[starts], windows(hashes, size, base=0xC2B2AE3D27D4EB4F)[starts]


def _level(spark: SparkSession, counted: DataFrame, length: int) -> tuple[Level, tuple[np.ndarray, np.ndarray]] | None:
    """The level, its filter set bit by bit on the executors, and the frequent windows in order; None if nothing repeats."""
    counted = written(counted)
    repeated = counted.where("full is null").select("h")
    n, behind, pieces_ = counted.agg(F.count_if(F.col("full").isNull()), F.sum(F.when(F.col("full").isNull(), F.col("rows"))), F.sum(F.when(F.col("full").isNotNull(), F.col("rows")))).first()
    if not n:
        return None
    bits = min(max((16 * n - 1).bit_length(), LEAST_BITS), MOST_BITS)
    # of those with more than a twentieth of a task's share of all rows there are at most twenty a task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    often = F.when(F.col("full").isNull(), max(SHARE * behind / tasks, LEAST_WINDOWS)).otherwise(max(SHARE * (pieces_ or 0) / tasks, LEAST_PIECES))
    frequent = counted.where(F.col("rows") > often).select("h", "full").toArrow()
    h, full = frequent.column("h").to_numpy().view(np.uint64), frequent.column("full")
    sub = np.array(full.is_null())
    order = np.argsort(h[~sub])
    frequent_windows = h[~sub][order], full.drop_null().to_numpy().view(np.uint64)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.concatenate(_slots(batch.column("h").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slots & np.uint64(63))).view(np.int64))], ["w", "b"])

    set_words = repeated.mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[set_words.column("w").to_numpy()] = set_words.column("b").to_numpy().view(np.uint64)
    return Level(length, bits, table, np.sort(h[sub])), frequent_windows


def repeated_ranges(docs: DataFrame, size: int = 35) -> DataFrame:
    """(key, key2, lo, hi): ranges of words of the row with these keys covered by windows that also start elsewhere.

    docs: (key, key2, text). The union of a row's ranges is what matters; they may touch or overlap.
    """
    spark = docs.sparkSession
    levels: list[Level] = []
    frequent = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    schema = "sub long, key long, key2 long, lo long, n int, seen boolean, hashes binary"
    for length in lengths(size):
        found = _level(spark, _counted(docs, size, length, spark.sparkContext.broadcast(levels)), length)
        if found is None:
            return spark.createDataFrame([], "key long, key2 long, lo long, hi long")
        levels, frequent = [*levels, found[0]], found[1]
    sent = spark.sparkContext.broadcast((levels, frequent))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct racing window of a piece once: what repeats inside a piece is settled there, and what is known to be frequent."""
        levels, frequent = sent.value
        for part in pieces(batches):
            w, starts, stand = _racing(part.column("text"), size, levels)
            if not len(starts):
                continue
            if stand is None:
                stand = np.zeros(len(starts), np.uint64)
            also, full = _whole(w.hash, size, starts)
            row = np.searchsorted(w.first, starts, "right") - 1
            keys = tuple(part.column(c).to_numpy()[row] for c in ("key", "key2"))
            # without levels, and behind frequent sub-windows, windows meet by what they are
            alone = _among(stand, levels[-1].frequent) if levels else np.ones(len(starts), bool)
            stand = np.where(alone, mix(also), stand)
            order = np.lexsort((full, stand))
            lo, hi = runs(stand[order], full[order])
            many = np.zeros(len(starts), bool)
            many[order] = np.repeat(hi - lo > 1, hi - lo)
            once = np.zeros(len(starts), bool)
            once[order[lo]] = True
            if len(frequent[0]):
                at = np.minimum(np.searchsorted(frequent[0], also), len(frequent[0]) - 1)
                known = (frequent[0][at] == also) & (frequent[1][at] == full)
                many, once = many | known, once & ~known
            at = starts - w.first[row]
            # settled ranges go along with no hashes; windows to compare are packed by stretches
            yield from _packed(keys, at, stand, full, many, many, compare=False)
            yield from _packed(keys, at, stand, full, many, once, compare=True)

    def _packed(keys, at, stand, full, seen, take, compare: bool) -> Iterator[pa.RecordBatch]:
        take = np.flatnonzero(take)
        if not len(take):
            return
        at, stand, full, seen, key, key2 = (x[take] for x in (at, stand, full, seen, *keys))
        slope = at - np.arange(len(at))
        lo, hi = runs(key, key2, slope, stand, seen) if compare else runs(key, key2, slope)
        n = (hi - lo).astype(np.int32)
        sub = stand[lo] if compare else mix(key[lo].astype(np.uint64) + at[lo].astype(np.uint64))
        ends = np.append(lo, hi[-1]) * 8 if compare else np.zeros(len(lo) + 1, np.int64)
        blob = pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(full)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(sub.view(np.int64)), pa.array(key[lo]), pa.array(key2[lo]), pa.array(at[lo]), pa.array(n), pa.array(seen[lo] if compare else np.ones(len(lo), bool)), blob], ["sub", "key", "key2", "lo", "n", "seen", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def settle(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            sub, key, key2, lo, n, seen = (rows.column(c).to_numpy() for c in ("sub", "key", "key2", "lo", "n", "seen"))
            blob = rows.column("hashes").cast(pa.large_binary()).combine_chunks()
            size_of = np.array(pc.binary_length(blob)) // 8
            raw, _ = text_bytes_of(blob)
            full = raw.view(np.uint64)
            packed = np.flatnonzero(size_of)
            of = np.repeat(packed, size_of[packed])
            inner = np.arange(len(of)) - np.repeat(np.cumsum(size_of[packed]) - size_of[packed], size_of[packed])
            order = np.lexsort((full, sub[of]))
            a, b = runs(sub[of][order], full[order])
            any_seen = np.logical_or.reduceat(seen[of][order], a) if len(a) else np.zeros(0, bool)
            hit = np.zeros(len(of), bool)
            hit[order] = np.repeat((b - a > 1) | any_seen, b - a)
            hit = np.flatnonzero(hit & ~seen[of])  # seen ones are settled already
            start = lo[of[hit]] + inner[hit]
            c, d = runs(of[hit], start - np.arange(len(start)))
            done = np.flatnonzero(size_of == 0)
            both = [pa.array(np.concatenate([k[of[hit]][c], k[done]])) for k in (key, key2)]
            return pa.RecordBatch.from_arrays([*both, pa.array(np.concatenate([start[c], lo[done]])), pa.array(np.concatenate([start[d - 1] + size, lo[done] + n[done] - 1 + size]))], ["key", "key2", "lo", "hi"])

        for batch in batches:
            sub = batch.column("sub").to_numpy()
            cut = int(np.searchsorted(sub, sub[-1])) if len(sub) else 0
            count += int(batch.column("n").to_numpy().sum())
            if cut and count >= HELD_WINDOWS:
                yield settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, count = [batch.slice(cut)], 0
            else:
                held.append(batch)
        if held:
            yield settle(pa.Table.from_batches(held))

    offered = docs.mapInArrow(offer, schema)
    return offered.repartition("sub").sortWithinPartitions("sub").mapInArrow(compare, "key long, key2 long, lo long, hi long")


def text_bytes_of(blob: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
    data = np.frombuffer(blob.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if blob.buffers()[2] else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data), offsets


def substring_dedup(docs: DataFrame, size: int = 35) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and kept (the words left).

    Null, empty and white texts have no words and keep "". Texts shorter than a window keep all.
    Windows are judged on the input: all places of a repeated window lose its words, the first too.
    Documents are told apart by 128 bits of (doc_id, text); a repeated row's windows start elsewhere as well, so a
    row that occurs twice loses all windows, in both. doc_id may be null. Other columns are not looked at.
    """
    rows = text_columns(docs, "doc_id", "text")
    keyed = rows.withColumns({"key": F.xxhash64("doc_id", "text"), "key2": F.xxhash64("text", F.lit("and"), "doc_id")})
    found = repeated_ranges(keyed.select("key", "key2", "text"), size)
    # a row that is there many times gives its ranges each time: they are one set, and a plain table lets Spark split the join
    ranges = written(found.groupBy(F.col("key").alias("_key"), F.col("key2").alias("_key2")).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))
    joined = keyed.join(ranges, (F.col("key") == F.col("_key")) & (F.col("key2") == F.col("_key2")), "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            n_words, n_removed, kept = [], [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                left = (text or "").encode().split()
                n_words.append(len(left))
                if gone:
                    step = np.zeros(len(left) + 1, np.int64)
                    np.add.at(step, [r["lo"] for r in gone], 1)
                    np.add.at(step, [r["hi"] for r in gone], -1)
                    left = [left[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0)]
                n_removed.append(n_words[-1] - len(left))
                kept.append(b" ".join(left))
            digest = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op6_substring(spark, sf_dir: str) -> DataFrame:
    """Windows of 35 words over whole texts."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
with w as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents
), windows as (
  select doc_id, unnest(range(1, len(ws) - 33)) as i, ws from w where len(ws) >= 35
), repeated as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by array_to_string(ws[i:i + 34], ' ')) as n from windows) where n > 1
), gone as (
  select distinct doc_id, unnest(range(i, i + 35)) as pos from repeated
), each as (
  select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w
), kept as (
  select e.doc_id, string_agg(e.word, ' ' order by e.pos) as text, count(*) as n from each e
  where not exists (select 1 from gone g where g.doc_id = e.doc_id and g.pos = e.pos) group by e.doc_id
)
select w.doc_id, len(w.ws)::bigint as n_words, (len(w.ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from w left join kept k using (doc_id)
"""
