"""Token ids of whole texts by a public tokenizer that drops white space, and token totals kept by deltas.

Such a tokenizer never looks across white space, nor from a letter to a symbol behind it, so a text's ids are
its words' ids in a row. A worker process encodes each distinct word once, words of letters many at a time,
and looks the others up; memory is bounded by MOST_WORDS.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import LETTER, LOWER, SPACE, SYMBOL, pieces, text_columns, words, written
from tallyforge.sources import folders, remove_folder, rename_folder, shared_path

#: Distinct words that a worker process remembers before it starts anew; words encoded in a call, and in a text.
MOST_WORDS, TOGETHER, LINE = 500_000, 20_000, 200
#: What the vocabulary puts at the end of a word's last token.
WORD_END = "</w>"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def send_tokenizer(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary file's text (a few MB) for all executors."""
    with open(path or vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class Encoder:
    """Ids of the words of a batch; remembers the words it has met."""

    def __init__(self, described: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(described)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _alone(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings in a row, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(size.sum())), size

    def _together(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, many in a text. Each has an id that ends a word; if there are as many as words, each has one."""
        lines = [" ".join(strings[k : k + LINE]) for k in range(0, len(strings), LINE)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.uint32)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(strings) or len(ids) != ends[-1] + 1:
            return self._alone(strings)
        return ids, np.diff(ends, prepend=-1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each row's begin."""
        raw = words(texts, SPACE)
        # lower-casing first makes fewer words; with "<|" about it might make a special token
        w = raw if ((raw.data[:-1] == 60) & (raw.data[1:] == 124)).any() else words(texts, SPACE, LOWER, (LETTER, SYMBOL))
        if len(self.slots) > MOST_WORDS:
            self._forget()
        distinct, one, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        known = self.slots
        new = [i for i, h in enumerate(distinct.tolist()) if h not in known]
        if new:
            data = w.data.tobytes()
            at = one[new]
            strings = [data[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]
            plain = np.array([s.isalpha() for s in strings], bool)
            new = np.array(new)
            for at, encode in ((np.flatnonzero(plain), self._together), (np.flatnonzero(~plain), self._alone)):
                for cut in range(0, len(at), TOGETHER):
                    part = at[cut : cut + TOGETHER]
                    ids, size = encode([strings[i] for i in part])
                    first = len(self.start) - 1
                    known.update(zip(distinct[new[part]].tolist(), range(first, first + len(part))))
                    self.ids = np.concatenate([self.ids, ids])
                    self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
        slot = np.fromiter((known[h] for h in distinct.tolist()), np.int64, len(distinct))[inverse]
        size = self.start[slot + 1] - self.start[slot]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[slot] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.append(np.int64(0), ends)[w.first]


_ENCODERS: dict[int, Encoder] = {}


def encoder(sent: Broadcast) -> Encoder:
    """This process's encoder for the broadcast vocabulary."""
    key = hash(sent.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(sent.value)
    return _ENCODERS[key]


def token_counts(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The kept columns and n_tokens (long) of every row's whole text; null and empty texts have none.

    Each of repeated rows counts; other columns are not looked at, whatever their names; nulls are carried along. Empty
    in, empty out.
    """
    sent = send_tokenizer(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            _, first = encoder(sent)(part.column("text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.diff(first))], [*keep, "n_tokens"])

    rows = text_columns(docs, *keep, "text")
    schema = rows.select(*keep).schema.add("n_tokens", "long")
    return rows.mapInArrow(run, schema)


# Totals kept by deltas

TOTALS = ["source", "lang", "tokenizer"]
STATE = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """Totals by source, language and tokenizer version, kept in a folder that all executors share.

    A batch of changes is a table (source, lang, tokenizer, sign, n_tokens): +1 for an insert, -1 for a delete, and both,
    -1 with the old count and +1 with the new one, for a revised count. commit() adds a batch's sums to the newest version
    of the totals. A version is a folder with the totals and the ids of all batches in them; it is staged under a name of
    its own and gets its number by one rename, which fails if another writer has taken that number. Then the batch is
    added to that writer's version instead: of two writers neither loses an update. A batch id that is in already changes
    nothing, so a job may replay any commit after a failure. The newest KEPT versions stay for readers that have begun,
    older ones go, so a commit lists and reads as much after many commits as after few, but for the batch ids. Sums are
    taken before the shuffle, and only groups, never documents, are kept. Null keys are groups like any other; null signs
    count 0, null counts 0 tokens; groups whose documents and tokens are both 0 go. An empty batch is recorded.
    """

    #: Versions that stay, and how often a commit starts anew behind other writers before it gives up.
    KEPT, TRIES = 3, 8

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or shared_path(spark, "rollups")

    def _versions(self) -> list[int]:
        return sorted(int(name[1:]) for name in folders(self.spark, self.folder) if re.fullmatch(r"v\d{8}", name))

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version:08d}"

    def _batches(self, version: int) -> DataFrame:
        """(version, batch) of all that is in a version of the totals."""
        return self.spark.read.schema("version int, batch string").parquet(f"{self._path(version)}/batches") if version else self.spark.createDataFrame([], "version int, batch string")

    def _totals(self, version: int) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self._path(version)}/totals") if version else self.spark.createDataFrame([], STATE)

    def history(self) -> list[tuple[int, str]]:
        """(version, batch id) of all commits, in order."""
        return sorted(tuple(r) for r in self._batches(max(self._versions(), default=0)).collect())

    def totals(self) -> DataFrame:
        return self._totals(max(self._versions(), default=0))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds the batch and says so; False if this batch id is in already."""
        if not re.fullmatch(r"[\w.]+", batch_id):
            raise ValueError(f"a batch id has letters, digits, _ and . only: {batch_id!r}")
        sign = F.coalesce(F.col("sign"), F.lit(0)).cast("long")
        delta = changes.select(*TOTALS, sign.alias("n_docs"), (sign * F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))
        for _ in range(self.TRIES):
            newest = max(self._versions(), default=0)
            before = self._batches(newest)
            if before.where(F.col("batch") == batch_id).count():
                return False
            state = self._totals(newest).unionByName(delta).groupBy(*TOTALS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            staged = f"{self.folder}/_staged/{uuid.uuid4().hex}"
            state.where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{staged}/totals")
            before.unionByName(self.spark.createDataFrame([(newest + 1, batch_id)], before.schema)).coalesce(1).write.parquet(f"{staged}/batches")
            if rename_folder(self.spark, staged, self._path(newest + 1)):
                for version in self._versions()[: -self.KEPT]:
                    remove_folder(self.spark, self._path(version))
                return True
            remove_folder(self.spark, staged)
        raise RuntimeError(f"other writers were faster {self.TRIES} times; batch {batch_id} is not in")


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after inserts of all documents, deletes of toxic ones, revised counts, and replays.

    Counts are ids of word_bpe_49k.json. Version 2 of the tokenizer setting adds the end-of-text id, so
    the revision of a labelled, non-toxic document takes its old count out and puts one more in. Null texts have no
    tokens but are documents; null sources and languages are groups; rows without a doc_id have no label. Each of
    repeated rows counts, and a doc_id with several labels is toxic if any says so. No documents, no totals.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumnRenamed("doc_id", "_doc")
    counts = written(token_counts(docs, ["doc_id", "source", "lang"]))
    labelled = counts.join(toxic, F.col("doc_id") == F.col("_doc"))
    one, two = F.lit("word_bpe_49k/1").alias("tokenizer"), F.lit("word_bpe_49k/2").alias("tokenizer")
    plus, minus, at = F.lit(1).alias("sign"), F.lit(-1).alias("sign"), ["source", "lang"]
    inserts = counts.select(*at, one, plus, "n_tokens")
    deletes = labelled.where("toxic = 1").select(*at, one, minus, "n_tokens")
    revised = labelled.where("toxic = 0")
    revisions = revised.select(*at, one, minus, "n_tokens").union(revised.select(*at, two, plus, F.col("n_tokens") + 1))
    rollup = Rollup(spark)
    for batch, changes in (("inserts", inserts), ("deletes", deletes), ("revisions", revisions), ("deletes", deletes), ("inserts", inserts)):
        rollup.commit(batch, changes)
    return rollup.totals()
