"""Best-fit packing by patterns: which few lengths go together, how often, and who goes where.

Only the histogram of piece lengths (as many rows as a sequence has tokens) reaches the driver. There,
patterns of up to three lengths that fill a sequence are enumerated, their repeat counts fitted to the
histogram by non-negative least squares and rounded down, and what is left is packed best-fit
decreasing, still by counts. Pieces of equal length are interchangeable, so each finds its place on the
executors from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import pieces, text_columns, written
from tallyforge.llm.tokens import encoder, send_tokenizer

SWEEPS = 40


def tokenized(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and task and rank, its place among the pieces of its length in its task."""
    sent = send_tokenizer(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for part in pieces(batches):
            ids, first = encoder(sent)(part.column("text"))
            raw, end = ids.astype("<u4").tobytes(), b"\0\0\0\0"
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                own = raw[4 * a : 4 * b] + end
                for k, at in enumerate(range(0, b - a + 1, capacity)):
                    n = min(capacity, b - a + 1 - at)
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(own[4 * at : 4 * (at + n)]))
                    rank.append(met[n])
                    met[n] += 1
            columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(row), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"])

    return text_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task int")


def patterns(counts: np.ndarray) -> list[tuple[int, ...]]:
    """One, two or three lengths that fill a sequence: every such pair, and for each length some triples."""
    capacity = len(counts) - 1
    there = counts > 0
    found = {(capacity,)} if there[capacity] else set()
    common = np.argsort(-counts[: capacity // 2], kind="stable")[:8].tolist()
    for a in np.flatnonzero(there).tolist():
        rest = capacity - a
        if 0 < rest and there[rest]:
            found.add(tuple(sorted((a, rest))))
        for b in {rest // 2, rest // 3, rest // 4, *common}:
            if 0 < b < rest and there[b] and there[rest - b]:
                found.add(tuple(sorted((a, b, rest - b))))
    return sorted(found)


def fitted(counts: np.ndarray, chosen: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared difference of pattern use and histogram, by coordinate descent."""
    left, x = counts.astype(float), np.zeros(len(chosen))
    uses = [tuple({length: p.count(length) for length in p}.items()) for p in chosen]
    for _ in range(SWEEPS):
        moved = 0.0
        for p, use in enumerate(uses):
            step = max(sum(n * left[length] for length, n in use) / sum(n * n for _, n in use), -x[p])
            if step:
                x[p] += step
                moved = max(moved, abs(step))
                for length, n in use:
                    left[length] -= n * step
        if moved < 0.25:
            break
    return x


def plan(counts: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places (length, first rank, pieces in a sequence, first sequence, offset), and the number of sequences.

    counts[n] is the number of pieces of n tokens; its last index is the capacity.
    """
    capacity, left = len(counts) - 1, counts.astype(np.int64).copy()
    chosen = patterns(left)
    groups: list[tuple[int, tuple | None]] = []  # sequences alike: how many, and their content from the last in
    for p, wanted in zip(chosen, fitted(left, chosen)):
        use = {length: p.count(length) for length in p}
        n = min(int(wanted), *(int(left[length]) // k for length, k in use.items()))
        if n > 0:
            content = None
            for length, k in use.items():
                left[length] -= n * k
                content = (content, length, k)
            groups.append((n, content))
    # the rest, longest first, each into the fullest sequence that has room
    rooms: list[int] = []
    open_groups: dict[int, list[tuple[int, tuple | None]]] = {}

    def put(room: int, group: tuple[int, tuple | None]) -> None:
        if room not in open_groups:
            open_groups[room] = []
            bisect.insort(rooms, room)
        open_groups[room].append(group)

    for length in range(capacity, 0, -1):
        c = int(left[length])
        while c:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                n, content = open_groups[room].pop()
                if not open_groups[room]:
                    del open_groups[room], rooms[at]
            else:
                room, content = capacity, None
                n = -(-c // (capacity // length))
            k = room // length
            if full := min(n, c // k):
                put(room - k * length, (full, (content, length, k)))
                c, n = c - full * k, n - full
            if n and c and c < k:
                put(room - c * length, (1, (content, length, c)))
                c, n = 0, n - 1
            if n and content is not None:
                put(room, (n, content))
    groups += [g for room in rooms for g in open_groups[room]]
    places, met, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for n, content in groups:
        inside = []
        while content:
            content, length, k = content
            inside.append((length, k))
        offset = 0
        for length, k in reversed(inside):
            places.append((length, int(met[length]), k, sequence, offset))
            met[length] += n * k
            offset += length * k
        sequence += n
    return places, sequence


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0; null and empty texts are the id 0 alone. Longer documents are cut
    into pieces of capacity tokens. Repeated rows are packed as often as they occur, null doc_ids like any
    other; other columns are not looked at; no rows in, no rows out. Ties among equal lengths are broken
    by where the rows are stored.
    """
    rows = written(tokenized(docs, capacity, path))
    counts = np.zeros(capacity + 1, np.int64)
    per_task = rows.groupBy("length", "task").count()
    for length, n in rows.groupBy("length").count().collect():
        counts[length] = n
    places = np.array(sorted(plan(counts)[0]), np.int64).reshape(-1, 5)
    sent = docs.sparkSession.sparkContext.broadcast(places)  # a few rows for each length that there can be
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select(F.col("length").alias("_length"), F.col("task").alias("_task"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(bases, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_of, first, k, sequence, offset = sent.value.T
        keys = length_of << 44 | first
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[at] + nth // k[at]), pa.array(offset[at] + nth % k[at] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens of word_bpe_49k.json."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity=2048)


def stage_pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where each piece of each document goes.

    A null or empty text is one piece of the end id alone. Each of repeated rows is placed, rows without a doc_id too,
    and pieces of one length, in whatever order, fill the same places. Other columns are not looked at. Empty in, empty out.
    """
    return pack(docs, capacity=2048)
