"""SimHash near-dedup over pivot distance tables.

Fingerprints are made where the texts lie, and only (doc_id, fingerprint) moves. Equal fingerprints
are one node. Nodes within max_distance bits agree on at least blocks - max_distance of the blocks
that 64 bits are cut into, so nodes meet under each such choice of blocks; nothing else can link.
Where they meet, a table of Hamming distances to reference fingerprints (pivots) discards every pair
whose largest coordinate difference exceeds max_distance (triangle inequality), and the survivors
are verified bit by bit. A task returns a spanning forest of the links it found, not the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import LOWER, SPACE, components, dealt, fits, mix, pieces, text_columns, whole_runs, windows, words, written

#: Reference fingerprints: fixed pseudo-random values of up to 256 bits, the same in every run.
PIVOTS = np.random.default_rng(7).integers(0, 2**64, (24, 4), dtype=np.uint64)
#: Rows that meet under one choice of blocks before their pairs are dealt out as squares of this side.
SQUARE = 8_192


def text_fingerprint(text: str | None, size: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, repeats included."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, size = b" ".join(parts), min(size, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_in: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long; zero where a text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            fps = np.array([text_fingerprint(t, words_in) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return text_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, each a row of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def linked(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows a and b those within `most` bits: first by the pivot table, then exactly."""
    for own in table:  # a pivot at a time: few pairs are left after the first
        near = np.abs(own[a] - own[b]) <= most
        a, b = a[near], b[near]
        if not len(a):
            return a, b
    near = distance(fp[a], fp[b]) <= most
    return a[near], b[near]


class _Forest:
    """Keeps of the offered links those that join two trees."""

    def __init__(self, n: int) -> None:
        self.up, self.kept = np.arange(n), []

    def _root(self, a: np.ndarray) -> np.ndarray:
        root = self.up[a]
        while not np.array_equal(above := self.up[root], root):
            root = above
        self.up[a] = root
        return root

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._root(a) != self._root(b)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            of_a, of_b = self._root(a), self._root(b)
            apart = of_a != of_b
            a, b, of_a, of_b = a[apart], b[apart], of_a[apart], of_b[apart]
            if not len(a):
                return
            low, high = np.minimum(of_a, of_b), np.maximum(of_a, of_b)
            high, one = np.unique(high, return_index=True)  # a root is hooked once, to a smaller one: no rings
            self.up[high] = low[one]
            self.kept.append((a[one], b[one]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in self.kept]), np.concatenate([y for _, y in self.kept])


def _meet(choice: np.ndarray, part: np.ndarray, fp: np.ndarray, most: int, alike: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by (choice, part): all pairs of a run, or only pairs across its two parts.

    alike: which of the pairs within `most` bits are links; not asked of pairs that verified links join already.
    """
    table = np.stack([distance(fp, p[: fp.shape[1]]) for p in PIVOTS])
    forest = _Forest(len(fp))
    starts = np.flatnonzero(np.append(True, choice[1:] != choice[:-1]))
    ends = np.append(starts[1:], len(fp))
    last = np.repeat(ends, ends - starts)
    shift, at = 1, np.arange(len(fp))
    while True:
        at = at[at + shift < last[at]]
        if not len(at):
            return forest.links()
        for cut in range(0, len(at), 1 << 18):
            a = at[cut : cut + (1 << 18)]
            b = a + shift
            fine = (part[a] != part[b]) | (part[a] == 0)
            a, b = linked(fp, table, a[fine], b[fine], most)
            if alike is not None and len(a):
                open_ = forest.apart(a, b)
                a, b = a[open_], b[open_]
                sure = alike(a, b)
                a, b = a[sure], b[sure]
            forest.add(a, b)
        shift += 1


def blocks_for(n: int, max_distance: int, meeting: int = 32) -> int:
    """The fewest blocks under a choice of which about `meeting` of n evenly spread nodes meet at most."""
    return next(b for b in range(max_distance + 2, 65) if n / 2 ** (64 * (b - max_distance) / b) <= meeting)


def links(nodes: DataFrame, max_distance: int = 4, blocks: int | None = None) -> DataFrame:
    """(a, b) by node id: a forest per task with the same connected sets as all links of the nodes.

    nodes: (id long, fp long), distinct fp. They meet under every choice of blocks - max_distance of the
    blocks that 64 bits are cut into: whatever their number, no link is lost. By default it follows the number
    of nodes: 6 blocks (15 choices of 21 bits) up to about 80 million, then 7 (35 of 27), then 8 (70 of 32).
    """
    blocks = blocks or blocks_for(nodes.count(), max_distance)
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in some) for some in combinations(range(blocks), blocks - max_distance)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    choices = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)])
    return _met(nodes.select("id", F.array("fp").alias("fp"), F.explode(choices).alias("choice")), 1, max_distance)


def _met(keys: DataFrame, width: int, max_distance: int) -> DataFrame:
    """links() among the rows (id, fp array of width longs, choice) of each choice.

    Choices under which more than SQUARE nodes meet are dealt out as squares of rows by rows, so no task
    holds more than two sides of a square of one choice.
    """
    words = [F.col("fp")[k].alias(f"f{k}") for k in range(width)]
    rows = dealt(keys, F.count("*") / SQUARE, "id", *words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_rows in whole_runs(batches):
            choice, part, ids, fp = _columns(run_rows, width)
            a, b = _meet(choice, part, fp, max_distance) if len(ids) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _columns(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    choice, part, ids = (rows.column(c).to_numpy() for c in ("choice", "part", "id"))
    return choice, part, ids, np.stack([rows.column(f"f{k}").to_numpy().view(np.uint64) for k in range(width)], axis=1)


def near_duplicates(docs: DataFrame, words_in: int = 4, max_distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest linked doc_id).

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other.
    Rows with a null doc_id keep their fingerprint and get the component of the others with that
    fingerprint, or null. Repeated rows stay, each with the same result. Ties (exactly half of the
    shingles) leave a bit at 0. Other columns are not looked at. No rows in, no rows out.
    """
    fps = written(fingerprints(docs, words_in))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"))
    of = components(links(nodes, max_distance, blocks)).select(F.col("node").alias("id"), F.col("component").alias("_component"))
    nodes = nodes.join(of, "id", "left").select("fp", F.coalesce("_component", "id").alias("component_id"))
    return fps.join(nodes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For similarity: bits of the wide fingerprint, and bands of two least shingles that bring documents together.
WIDE, BANDS = 256, 10
#: Rows and shingles of one group that a task holds for each side when sets are compared.
HELD_ROWS, HELD_SHINGLES = 1_024, 1 << 22
_ODD = np.random.default_rng(11).integers(0, 2**63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingle_sets(texts: pa.Array, words_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h, there, begin, n): hashes of each row's shingles, sorted and without repeats, and for the rows that have any their number, first and count."""
    w = words(texts, SPACE, LOWER)
    size = np.diff(w.first)
    h, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    of_word = w.row
    for n in range(1, words_in + 1):  # shorter texts are one shingle
        at = np.flatnonzero(fits(w.first, n) & ((size >= n) if n == words_in else (size == n))[of_word])
        if len(at):
            h.append(windows(w.hash, n)[at])
            row.append(of_word[at])
    h, row = np.concatenate(h), np.concatenate(row)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h = h[first]
    return h, *np.unique(row[first], return_index=True, return_counts=True)


def _set_keys(h: np.ndarray, there: np.ndarray, begin: np.ndarray, rows: int) -> np.ndarray:
    """128 bits by row that stand for its set; zero where it is empty."""
    keys = np.zeros((rows, 2), np.uint64)
    if len(there):
        for k in range(2):
            keys[there, k] = mix(np.add.reduceat(mix(h ^ _ODD[k]), begin))
    return keys


def _longs(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(m).view(np.int64).ravel()))


def sketches(docs: DataFrame, words_in: int) -> DataFrame:
    """(doc_id, key, fp, bands) of each set of shingles: what stands for it, a fingerprint of WIDE bits as longs, and keys that similar sets are likely to share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            h, there, begin, n = _shingle_sets(part.column("text"), words_in)
            fp, bands = np.zeros((part.num_rows, WIDE // 64), np.uint64), np.zeros((part.num_rows, BANDS), np.uint64)
            if len(there):
                for k in range(WIDE // 64):
                    own = mix(h + np.uint64(k) * _ODD[0])
                    for a, b, r in _cut(begin, n):
                        bits = np.unpackbits(own[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        ones = np.add.reduceat(bits, begin[r] - a, axis=0, dtype=np.int32)
                        fp[there[r], k] = np.packbits(2 * ones > n[r][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
                least = [np.minimum.reduceat(h * odd ^ h >> np.uint64(29), begin) for odd in _ODD]
                for k in range(BANDS):
                    bands[there, k] = mix(least[2 * k] * _ODD[0] + least[2 * k + 1] + np.uint64(k))
            key = _set_keys(h, there, begin, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _longs(key), _longs(fp), _longs(bands)], ["doc_id", "key", "fp", "bands"])

    return text_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, key array<long>, fp array<long>, bands array<long>")


def _cut(begin: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """Rows in stretches of about 2^16 shingles, or one longer row: (first, last shingle, rows)."""
    ends, at = begin + n, 0
    while at < len(begin):
        to = max(int(np.searchsorted(ends, begin[at] + (1 << 16), "right")), at + 1)
        yield int(begin[at]), int(ends[to - 1]), slice(at, to)
        at = to


def allowed_bits(similarity: float, bits: int = WIDE) -> int:
    """Bits in which two sets of this Jaccard similarity are expected to differ, and six standard deviations.

    The expectation is that of large sets. It is exceeded most by 4 shingles of 5: 0.19 of the bits instead of
    0.15 at 0.8, for which this bound is four deviations.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + 6 * np.sqrt(bits * p * (1 - p)))


def _sets(docs: DataFrame, wanted: DataFrame, words_in: int) -> DataFrame:
    """wanted (id, key, fp, choice) with shingles, the sorted 64-bit hashes of the set, and their count."""
    texts = text_columns(docs, "doc_id", "text").join(wanted, F.col("doc_id") == F.col("id")).drop("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            h, there, begin, n = _shingle_sets(part.column("text"), words_in)
            own = _set_keys(h, there, begin, part.num_rows).view(np.int64)
            ends = np.zeros(part.num_rows, np.int64)
            ends[there] = n
            ends = np.cumsum(ends)
            raw = [h[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]
            # another text under the same doc_id is not the wanted one
            same = pa.array((np.array(part.column("key").to_pylist(), np.int64).reshape(-1, 2) == own).all(axis=1))
            out = [part.column(c) for c in ("id", "key", "fp", "choice")] + [pa.array(raw, pa.binary()), pa.array(np.diff(ends, prepend=0))]
            yield pa.RecordBatch.from_arrays(out, ["id", "key", "fp", "choice", "shingles", "n"]).filter(same)

    return texts.mapInArrow(run, "id long, key array<long>, fp array<long>, choice long, shingles binary, n long").dropDuplicates(["id", "key"])


def _alike(sets: list[np.ndarray], similarity: float) -> Callable:
    """Of pairs of rows, which have that Jaccard similarity at least."""
    size = np.array([len(s) for s in sets])

    def sure(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        yes = np.minimum(size[a], size[b]) / np.maximum(size[a], size[b]) >= similarity
        for at in np.flatnonzero(yes):
            x, y = sets[a[at]], sets[b[at]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            yes[at] = both / (len(x) + len(y) - both) >= similarity
        return yes

    return sure


def _verified(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links among the rows of each choice whose sets have the similarity, a forest per task."""
    width = WIDE // 64
    words = [F.col("fp")[k].alias(f"f{k}") for k in range(width)]
    rows = dealt(sets, F.greatest(F.count("*") / HELD_ROWS, F.sum("n") / HELD_SHINGLES), "id", *words, "shingles")
    most = allowed_bits(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_rows in whole_runs(batches):
            choice, part, ids, fp = _columns(run_rows, width)
            own = [np.frombuffer(x, np.uint64) for x in run_rows.column("shingles").to_pylist()]
            a, b = _meet(choice, part, fp, most, _alike(own, similarity)) if len(ids) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, words_in: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): documents linked by a Jaccard similarity of shingle sets, to the smallest linked doc_id.

    At 0.8, fingerprints of 64 bits differ in about ten, too many to meet by equal blocks. So documents meet that
    share the two least shingles of a band (one pair in 25,000 of that similarity shares no band), and the wide
    fingerprints leave out who is far apart. What is left hangs together in groups; their members' sets are made
    again from the texts, meet once, by group, and link where the sets themselves have the similarity.
    Equal sets are one node, so bands and fingerprint are those of every member. Nulls, empty texts and repeats
    are treated as by near_duplicates.
    """
    rows = written(sketches(docs, words_in))
    nodes = written(rows.groupBy("key").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.min("bands").alias("bands")).where("id is not null"))
    keys = nodes.select("id", "fp", F.explode("bands").alias("choice"))
    groups = components(_met(keys, WIDE // 64, allowed_bits(similarity))).select(F.col("node").alias("id"), F.col("component").alias("choice"))
    sets = written(_sets(docs, nodes.drop("bands").join(groups, "id"), words_in))
    of = components(_verified(sets, similarity)).select(F.col("node").alias("id"), F.col("component").alias("_component"))
    nodes = nodes.join(of, "id", "left").select("key", F.coalesce("_component", "id").alias("component_id"))
    return rows.select("doc_id", "key").join(nodes, "key", "left").select("doc_id", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints over 4-word shingles of whole texts, linked at 4 or fewer differing bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words_in=4, max_distance=4)


def stage_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest doc_id; all columns.

    Five-word shingles, similarity 0.8 or more; rows that repeat the kept doc_id stay together, rows without
    doc_id are kept, null and empty texts are alike and one of them stays. No rows in, no rows out.
    """
    gone = similar(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
