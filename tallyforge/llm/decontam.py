"""Benchmark decontamination by greedy string tiling.

Shared runs of five words (seeds) say which documents may hold which benchmark items. Not all of them do:
an item's most frequent seeds, as many as lie over too few of its words to reach the coverage alone, open
no pair, so a stem that many items share brings nobody together. For each pair that is opened the longest
stretches of words common to both are marked again and again, never a word twice, until none of five words
is left; seeds found by rolling Karp-Rabin hashes stand for all of them. The share of the item's words that
are marked is its coverage, whatever the order of the stretches in the document. Equal items are one.
Documents stay where they are; the benchmark comes to them in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import NOT_ALNUM, fits, pieces, runs, text_columns, windows, words

#: Bytes of benchmark text that are sent to the executors at once; a larger benchmark goes in blocks.
BLOCK_BYTES = 8_000_000
#: Meetings of seeds that are looked at in one go.
MOST_MET = 1 << 20


def tiles(doc_at: np.ndarray, item_at: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from all seeds (places in document and item of `seed` equal words): (doc, item, length).

    Seeds in a row on one diagonal are one stretch. The longest stretch goes first, earlier ones first among
    equals; what overlaps marked words is cut to its free parts and waits for its turn.
    """
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    new = np.flatnonzero(np.append(True, (np.diff(d - i) != 0) | (np.diff(d) != 1)))
    ends = np.append(new[1:], len(d))
    heap = [(-(b - a + seed - 1), int(d[a]), int(i[a])) for a, b in zip(new.tolist(), ends.tolist())]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n, free = -n, []
        for k in range(n):
            if a + k in in_doc or b + k in in_item:
                continue
            if free and free[-1][1] == k:
                free[-1][1] = k + 1
            else:
                free.append([k, k + 1])
        if free == [[0, n]]:
            out.append((a, b, n))
            in_doc.update(range(a, a + n))
            in_item.update(range(b, b + n))
        else:
            for s, e in free:
                if e - s >= seed:
                    heapq.heappush(heap, (s - e, a + s, b + s))
    return out


class Seeds:
    """A block of benchmark items by the hashes of their seeds."""

    def __init__(self, texts: pa.Array, seed: int, coverage: float) -> None:
        w = plain(texts)
        self.size, self.seed = np.diff(w.first), seed
        row = w.row
        #: items of fewer words than a seed are seeds as a whole: length to (hashes in order, their items)
        self.openers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        hashes, places = [np.zeros(0, np.uint64)] * len(self.size), [np.zeros(0, np.int64)] * len(self.size)
        for length in range(1, seed + 1):
            at = np.flatnonzero(fits(w.first, length) & ((self.size >= seed) if length == seed else (self.size == length))[row])
            if not len(at):
                continue
            h, item = windows(w.hash, length)[at], row[at]
            place = at - w.first[item]
            known, of = np.unique(h, return_inverse=True)
            often = np.bincount(of)[of]
            opens = np.ones(len(h), bool)
            for lo, hi in zip(*runs(item)):
                own = np.lexsort((place[lo:hi], h[lo:hi]))
                hashes[item[lo]], places[item[lo]] = h[lo:hi][own], place[lo:hi][own]
                opens[lo:hi] = self._rare(often[lo:hi], place[lo:hi], length, coverage * self.size[item[lo]])
            order = np.argsort(h[opens], kind="stable")
            self.openers[length] = h[opens][order], item[opens][order]
        #: all seeds, item after item, each item's in order of their hashes
        self.hashes, self.places = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*places, np.zeros(0, np.int64)])
        self.first = np.append(0, np.cumsum([len(x) for x in hashes])).astype(np.int64)

    @staticmethod
    def _rare(often: np.ndarray, place: np.ndarray, length: int, least: float) -> np.ndarray:
        """All seeds but the most frequent ones that together lie over fewer words than `least`: without one of these there is no coverage."""
        opens, under = np.ones(len(often), bool), np.zeros(int(place.max()) + length, bool)
        for k in np.argsort(-often, kind="stable").tolist():
            if often[k] == 1:
                break
            under[place[k] : place[k] + length] = True
            if under.sum() >= least:
                break
            opens[k] = False
        return opens

    def pairs(self, w) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(seed length, rows, items), distinct: who meets through an opening seed."""
        row = w.row
        for length, (known, item) in self.openers.items():
            h = windows(w.hash, length)
            at = np.flatnonzero(fits(w.first, length)[: len(h)])
            lo = np.searchsorted(known, h[at])
            hit = known[np.minimum(lo, len(known) - 1)] == h[at] if len(known) else np.zeros(len(at), bool)
            h, of, lo = h[at][hit], row[at][hit], lo[hit]
            order = np.lexsort((lo, of))  # a seed that a row repeats is met once
            once = order[runs(of[order], lo[order])[0]]
            h, of, lo = h[once], of[once], lo[once]
            n = np.searchsorted(known, h, "right") - lo
            met = [np.zeros(0, np.int64)]
            for cut in _stretches(n, MOST_MET):
                which = _ranges(lo[cut], n[cut])
                met.append(np.unique(np.repeat(of[cut], n[cut]) * len(self.size) + item[which]))
            met = np.unique(np.concatenate(met))
            yield length, met // len(self.size), met % len(self.size)

    def hits(self, w, length: int, doc: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, np.ndarray, Callable]]:
        """(which pair, places of the item's seeds that the row has, a call for all equal seeds' places in row and item) of pairs sorted by row."""
        for lo, hi in zip(*runs(doc)):
            own = w.hash[w.first[doc[lo]] : w.first[doc[lo] + 1]]
            h = windows(own, length)
            order = np.argsort(h, kind="stable")
            h = h[order]
            for k in range(lo, hi):
                a, b = self.first[item[k]], self.first[item[k] + 1]
                at = np.searchsorted(h, self.hashes[a:b])
                n = np.searchsorted(h, self.hashes[a:b], "right") - at
                place = self.places[a:b]
                yield k, place[n > 0], lambda at=at, n=n, place=place: (order[_ranges(at, n)], np.repeat(place, n))


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, … n times, one after the other."""
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _stretches(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sum is about `most`, or of one."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        yield slice(at, to)
        at = to


def plain(texts: pa.Array):
    """Words of letters and digits in lower case; ASCII punctuation parts words."""
    return words(pc.utf8_lower(texts.cast(pa.large_string())), NOT_ALNUM)


def item_classes(benchmark: DataFrame) -> DataFrame:
    """(class_id, item_id): items of equal text go by the smallest of their ids; nulls come first."""
    items = text_columns(benchmark, "item_id", "text").where("text is not null")
    one = items.groupBy(F.col("text").alias("_text")).agg(F.min("item_id").alias("class_id"))
    return items.join(one, F.col("text") == F.col("_text")).select("class_id", "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, seed: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, item_id, n_items, coverage, n_tiles, longest) of each pair whose coverage is reached.

    docs: doc_id, text. benchmark: item_id, text. Items of equal text are one, by their smallest item_id, n_items in
    number (see item_classes). Null and empty texts share nothing. An item of fewer words than a seed must occur as a
    whole. Repeated documents count as often as they occur; null ids are carried along. Texts are read whole, of any
    length. Of docs only text and the columns of `keep` are looked at. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = text_columns(benchmark, "item_id", "text").where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))
    items = items.withColumn("block", F.xxhash64("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_BYTES)
    rows, out = text_columns(docs, *keep, "text"), None
    schema = rows.drop("text").schema
    for name, kind in (("item_id", "long"), ("n_items", "long"), ("coverage", "double"), ("n_tiles", "integer"), ("longest", "integer")):
        schema = schema.add(name, kind)
    for block in range(n_blocks):
        own = items.where(F.pmod("block", F.lit(n_blocks)) == block).select("item_id", "n", "text").toArrow()
        sent = spark.sparkContext.broadcast(tuple(own.column(c).to_pylist() for c in ("item_id", "n", "text")))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, numbers, texts = sent.value
            seeds = Seeds(pa.array(texts, pa.string()), seed, coverage)
            for part in pieces(batches):
                w = plain(part.column("text"))
                found: list[tuple[int, int, float, int, int]] = []
                for length, doc, item in seeds.pairs(w):
                    for k, under, places in seeds.hits(w, length, doc, item):
                        m = int(seeds.size[item[k]])
                        if _most(under, length) < coverage * m:
                            continue  # even all of its seeds cover too little
                        got = tiles(*places(), length)
                        share = sum(n for _, _, n in got) / m
                        if share >= coverage:
                            found.append((int(doc[k]), int(item[k]), share, len(got), max(n for _, _, n in got)))
                if found:
                    doc, item, share, n, longest = zip(*found)
                    mine = [part.column(c).take(pa.array(doc)) for c in keep]
                    theirs = [pa.array([of[i] for i in item], pa.int64()) for of in (ids, numbers)]
                    yield pa.RecordBatch.from_arrays([*mine, *theirs, pa.array(share), pa.array(n, pa.int32()), pa.array(longest, pa.int32())], schema.names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _most(place: np.ndarray, seed: int) -> int:
    """Words of the item that lie under any seed."""
    if not len(place):
        return 0
    at = np.unique(place)
    return int(np.minimum(np.diff(at), seed).sum()) + seed


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in any order of its passages, and how much of it."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; all columns.

    Rows are judged by (doc_id, text): one without an id goes too if it holds an item, and one that repeats the id
    of such a row stays if its own text holds none. Equal rows stay or go together. Null and empty texts stay. No
    rows in, no rows out; an empty benchmark leaves all.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"), F.xxhash64("doc_id", "text").alias("_a"), F.xxhash64("text", F.lit("and"), "doc_id").alias("_b"))
    held = contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("_a", "_b")).select("_a", "_b").distinct()
    return keyed.join(held, ["_a", "_b"], "left_anti").select("_row.*")
