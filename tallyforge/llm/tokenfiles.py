"""Token ids of documents in Parquet files, for reading a few documents, a stretch of tokens or the record alone.

A row has a document's ids as a list. The ids are dictionary-encoded (a vocabulary is one small dictionary to a row
group), doc_id, counts and offsets delta-encoded; row groups and pages have bounded sizes, rows are in order of doc_id,
and every page is in the page index. So a range of doc_ids or tokens is read by the few pages that have it, and a scan of
the record (doc_id, start, n_tokens) never touches the ids.

The folder has `data`, one file for each task in order, and `files`, a row for each file: how many tokens lie before it.

A byte-level tokenizer that splits texts by the usual pattern never looks across the start of white space, nor from a
letter to a symbol behind it. So texts are cut there; a worker process encodes each distinct piece once and looks
others up. Texts to which this doesn't apply are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import LETTER, SPACE, SYMBOL, hash_ranges, pieces, text_bytes, words
from tallyforge.llm.tokens import send_tokenizer, vocabulary
from tallyforge.sources import shared_path

#: Distinct pieces, and ids in all, that a worker process remembers before it starts anew; pieces encoded in a call, and in a text.
MOST_PIECES, MOST_IDS, TOGETHER, LINE = 2_000_000, 10_000_000, 20_000, 200
#: Bytes of a row group and of a page before compression; rows of a page.
GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 64 << 10, 1_000
#: The id that ends a document in the registered query.
END = 2
#: Bytes of characters at which a text isn't cut: white space beyond ASCII, and control characters that some count as such.
ODD_SPACE = [chr(c).encode() for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
#: U+2000 to U+200A share their first two bytes.
ODD_START = b"\xe2\x80"
#: A text with all kinds of boundaries, to see whether a tokenizer bears the cuts.
PROBE = "It's a  test,\n\nisn't it?  \t(No.) rock'n'roll don'T x's ('s) 3.14%of a1b2 -- Straße, naïve… été!? \n end \x0b A.B"


def _has(data: np.ndarray, needle: bytes) -> np.ndarray:
    """Where the bytes occur."""
    n = len(data) - len(needle) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = data[:n] == needle[0]
    for k, b in enumerate(needle[1:], 1):
        hit &= data[k : k + n] == b
    return np.flatnonzero(hit)


class PieceEncoder:
    """Ids of the whole texts of a batch; remembers the pieces it has met, by hash in order."""

    def __init__(self, described: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(described)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [t for t in added.values() if t]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: bytes of a token, in whose name each byte is a character
        self.length = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(added[i] if i in added else token)
        self._forget()
        self.cuts = True
        self.cuts = self(pa.array([PROBE]))[0].tolist() == self.tokenizer.encode(PROBE, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the texts, where pieces begin and end in all, and rows' offsets."""
        data, offsets = text_bytes(texts)
        bound = np.zeros(len(data) + 1, bool)
        if self.cuts:
            ends = words(texts, SPACE, None, (LETTER, SYMBOL)).end
            wide = _has(data, ODD_START)
            odd = np.concatenate([*(_has(data, needle) for needle in [*ODD_SPACE, *self.special]), wide[data[wide + 2] <= 0x8A]])
            bound[ends] = True
            for row in sorted(set((np.searchsorted(offsets, odd, "right") - 1).tolist())):
                bound[offsets[row] : offsets[row + 1]] = False
        bound[offsets] = True
        return data, np.flatnonzero(bound), offsets

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the strings in a row, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _pieces(self, pieces_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces. Those that begin with a blank and end in a plain character may follow each other in one text; ids are parted again by their lengths."""
        size = np.fromiter(map(len, pieces_), np.int64, len(pieces_))
        plain = np.fromiter((self.cuts and len(p) > 1 and p[0] == 32 and 32 < p[-1] < 127 for p in pieces_), bool, len(pieces_))
        alone, joined = np.flatnonzero(~plain), np.flatnonzero(plain)
        lines = [b"".join([pieces_[i] for i in joined[k : k + LINE]]).decode() for k in range(0, len(joined), LINE)]
        ids, _ = self._encoded(lines)
        ends = np.cumsum(self.length[ids])
        at = np.searchsorted(ends, np.cumsum(size[joined]))
        if len(joined) and (at[-1] != len(ids) - 1 or (ends[at] != np.cumsum(size[joined])).any()):
            alone, joined, ids, at = np.arange(len(pieces_)), joined[:0], ids[:0], at[:0]
        others, n_others = self._encoded([pieces_[i].decode() for i in alone])
        n = np.zeros(len(pieces_), np.int64)
        n[alone], n[joined] = n_others, np.diff(at, prepend=-1)
        out = np.zeros(int(n.sum()), np.int32)
        from_joined = np.repeat(np.isin(np.arange(len(pieces_)), joined), n)
        out[from_joined], out[~from_joined] = ids, others
        return out, n

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each row's begin."""
        data, bounds, offsets = self._cut(texts)
        if len(self.known) > MOST_PIECES or len(self.ids) > MOST_IDS:
            self._forget()
        start, end = bounds[:-1], bounds[1:]
        distinct, one, inverse = np.unique(hash_ranges(data, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        raw, grown, sizes = data.tobytes(), [self.ids], []
        for cut in range(0, len(new), TOGETHER):
            own = one[new[cut : cut + TOGETHER]]
            ids, n = self._pieces([raw[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())])
            grown.append(ids)
            sizes.append(n)
        if len(new):
            first = len(self.start) - 1
            self.known, self.slot = np.insert(self.known, at[new], distinct[new]), np.insert(self.slot, at[new], np.arange(first, first + len(new)))
            self.ids, self.start = np.concatenate(grown), np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))])
        slot = self.slot[np.searchsorted(self.known, distinct)][inverse]
        size = self.start[slot + 1] - self.start[slot]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[slot] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.append(np.int64(0), ends)[np.searchsorted(bounds, offsets)]


_ENCODERS: dict[int, PieceEncoder] = {}


def _encoder(described: str) -> PieceEncoder:
    """This process's encoder for a vocabulary."""
    key = hash(described)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(described)
    return _ENCODERS[key]


def _with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an id behind each row's."""
    return np.insert(ids, first[1:], end).astype(np.int32), first + np.arange(len(first))


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> TokenFiles:
    """Writes all documents' ids, each with the end id behind, to a new folder; in order of doc_id, nulls first.

    docs: doc_id, text; other columns are not looked at. Null texts are empty: the end id alone. Texts of any length are
    encoded whole. Rows of one doc_id follow by their text's hash, so repeated rows lie side by side; each is written.
    Empty in: files without rows. Tasks' files become visible when all are done; a lost executor's are written anew.
    """
    sent = send_tokenizer(docs.sparkSession, tokenizer or vocabulary("byte_bpe_50k.json"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # the last key deals out even a row that is a third of the table
    order = [F.asc_nulls_first("doc_id"), F.asc("_text"), F.asc("_row")]
    rows = rows.withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = rows.select("doc_id").schema
    for name, kind in (("n_tokens", T.IntegerType()), ("part", T.IntegerType()), ("at", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for piece in pieces(batches):
            ids, first = _with_end(*_encoder(sent.value)(piece.column("text")), end)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(first).astype(np.int32)), pa.array(np.full(len(lists), part, np.int32)), pa.array(at + first[:-1]), lists], schema.names)
            at += int(first[-1])

    writer = rows.select("doc_id", "text").mapInArrow(run, schema).write.option("parquet.writer.version", "v2").option("parquet.block.size", group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.enable.dictionary", "true")
    for delta in ("doc_id", "n_tokens", "part", "at"):
        writer = writer.option(f"parquet.enable.dictionary#{delta}", "false")
    writer.parquet(f"{path}/data")
    # a row for each file, of which there are as many as tasks: few enough for one task to add up
    files = docs.sparkSession.read.schema(schema).parquet(f"{path}/data").groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files.withColumn("base", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/files")
    return TokenFiles(docs.sparkSession, path)


class TokenFiles:
    """What write_tokens has written. Each frame reads only the columns, row groups and pages that it needs."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.data = spark.read.parquet(f"{path}/data")
        #: (part, n_docs, n, first_id, last_id, base): a row for each file
        self.files = spark.read.parquet(f"{path}/files")

    def _placed(self, rows: DataFrame, *more: str) -> DataFrame:
        # as many rows as files, which is the number of tasks that wrote
        base = F.broadcast(self.files.select("part", "base"))
        return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), *more)

    def documents(self) -> DataFrame:
        """(doc_id, start, n_tokens): the record without ids. start: ids of all documents before."""
        return self._placed(self.data.drop("ids"))

    def tokens(self, least: int | None = None, most: int | None = None) -> DataFrame:
        """(doc_id, start, n_tokens, ids) of the documents from one doc_id to another, both included; without bounds of all, and only then those without an id."""
        rows = self.data
        if least is not None:
            rows = rows.where(F.col("doc_id") >= least)
        if most is not None:
            rows = rows.where(F.col("doc_id") <= most)
        return self._placed(rows, "ids")

    def stretch(self, first: int, after: int) -> DataFrame:
        """(doc_id, start, n_tokens, ids) of the tokens first <= place < after of all tokens in a row: ids are cut to the stretch, start says where they begin."""
        met = self.files.where((F.col("base") < after) & (F.col("base") + F.col("n") > first)).select("part", "base").collect()  # two of them at the ends, and a row for each file between
        if not met:
            return self.tokens().limit(0)
        inside = None
        for r in (min(met, key=lambda r: r.part), max(met, key=lambda r: r.part)):  # only at the ends do places matter
            own = (F.col("part") == r.part) & (F.col("at") < after - r.base) & (F.col("at") + F.col("n_tokens") > first - r.base)
            inside = own if inside is None else inside | own
        parts = [r.part for r in met]
        rows = self._placed(self.data.where(inside | ((F.col("part") > min(parts)) & (F.col("part") < max(parts)))), "ids")
        skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
        n = F.least(F.col("start") + F.col("n_tokens"), F.lit(after)) - F.greatest(F.col("start"), F.lit(first))
        return rows.select("doc_id", (F.col("start") + skip).alias("start"), n.alias("n_tokens"), F.slice("ids", (skip + 1).cast("int"), n.cast("int")).alias("ids"))

    def checksums(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) from the ids in the files; the sum is over little-endian 32-bit ids."""
        rows = self.data
        schema = rows.drop("ids").schema.add("ids_crc32", "long")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("ids")
                first = lists.offsets.to_numpy()
                raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() if len(lists) else b""
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                n = pa.array(np.diff(first).astype(np.int32))
                yield pa.RecordBatch.from_arrays([n if c == "n_tokens" else pa.array(sums, pa.int64()) if c == "ids_crc32" else batch.column(c) for c in schema.names], schema.names)

        return self._placed(rows.mapInArrow(run, schema), "ids_crc32")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids of byte_bpe_50k.json, written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return write_tokens(docs, shared_path(spark, "tokens")).checksums()
