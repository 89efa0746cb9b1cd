"""SpotSigs document fingerprints.

A common word (anchor) and the content words that follow it make a signature; a document's fingerprint
is the set of its signatures. Anchors are frequent in running prose and rare in menus and tables, so
the set follows what a page says. Which words are common is taken from the documents: articles and the like
of a few languages are anchors anywhere, and a stretch without them has its word of most documents. Likeness is the Jaccard coefficient of two sets. Near pairs are sought
only among sets of like length, since |A| / |B| bounds it, and only through their rarest signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import NOT_ALNUM, PIECE_BYTES, Words, dealt, fits, joined, mix, pieces, runs, sliding, text_columns, whole_runs, words, written

# Articles and forms of "to be" of four languages, and other words that carry no content.
ANCHORS = "a an the is are was were be das dem den der die ein eine ist war el es la las los un una le les une est de du des".split()
COMMON = ANCHORS + "and as at by for from in it of on or that this to with aber auf aus bei für im in mit nicht sich und von zu als con del en lo no para por que se su y au avec dans en et il ne pas pour qui sur".split()
CHAIN = 3
#: So many words in a row have an anchor; without a listed one it is the word of most documents.
STRETCH = 8
#: Numbers of documents are kept for so many buckets of words, 0.5 MB whatever the vocabulary: a rare word in a common word's bucket counts as common.
BUCKETS = 1 << 16
#: First bytes of the characters (U+3000 to U+9FFF, U+F000 to U+3FFFF) that begin a word of their own, for scripts without blanks.
ALONE = np.isin(np.arange(256), [*range(0xE3, 0xEA), 0xEF, 0xF0])
#: Parts into which the order of documents is cut, at most, and documents of one part.
PARTS, PART_ROWS = 100_000, 1_000
#: Frequent signatures, at most, and classes that each is in, at least; and classes that meet through one before their
#: pairs are dealt out as squares of this side.
MOST_FREQUENT, LEAST_FREQUENT, SIDE = 100_000, 64, 2_048
#: Signatures through which classes may meet that leave a task at once.
POSTINGS = 50_000

_START = np.uint64(0x2545F4914F6CDD1D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashes(of: list[str]) -> np.ndarray:
    return np.sort(words(pa.array(sorted(set(of))), NOT_ALNUM).hash)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def spot_words(texts: pa.Array) -> Words:
    """Words of letters and digits in lower case."""
    return words(pc.utf8_lower(texts.cast(pa.large_string())), NOT_ALNUM, None, (np.ones(256, bool), ALONE))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def document_counts(docs: DataFrame) -> np.ndarray:
    """In how many rows of docs (text) each bucket's words occur: BUCKETS sums, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for piece in pieces(batches):
            w = spot_words(piece.column("text"))
            n += np.bincount(np.unique(w.row * BUCKETS + _bucket(w.hash)) % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    sums = text_columns(docs, "text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def _anchors(w: Words, counts: np.ndarray) -> np.ndarray:
    """Which words are anchors: listed ones, and the word of most documents of any STRETCH words of a text without these."""
    most = np.uint64(2**64 - 1)
    rank = counts[_bucket(w.hash)].astype(np.uint64) << np.uint64(24) | w.hash & np.uint64(0xFFFFFF)
    listed = _among(w.hash, _hashes(ANCHORS))
    rank[listed] = most
    starts = np.flatnonzero(fits(w.first, STRETCH))
    best = sliding(rank, STRETCH, np.maximum)
    least = np.full(len(rank) + STRETCH - 1, most)
    least[starts + STRETCH - 1] = best[starts]
    # the highest of some stretch around it: as high as the least of these stretches' highest
    return listed | (sliding(least, STRETCH, np.minimum) == rank)


def signatures(texts: pa.Array, counts: np.ndarray, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature of 32 bits) of all rows, distinct and in order; counts as of document_counts.

    A chain holds the next `chain` content words after an anchor: words that are neither listed as common nor anchors
    themselves. The first words of a text, whatever they are, make one more signature, so any text with a word has one.
    """
    w = spot_words(texts)
    anchors = _anchors(w, counts)
    content = ~(anchors | _among(w.hash, _hashes(COMMON)))
    before = np.append(0, np.cumsum(content))
    at_content = np.flatnonzero(content)
    row = w.row
    last = before[w.first[1:]]
    anchor = np.flatnonzero(anchors)
    anchor = anchor[before[anchor] + chain <= last[row[anchor]]]
    h = mix(w.hash[anchor])
    for k in range(chain):
        h = mix(h * _STEP + w.hash[at_content[before[anchor] + k]])
    begins = np.flatnonzero(np.diff(w.first))
    s = np.full(len(begins), _START)
    for k in range(chain):
        there = w.first[begins] + k < w.first[begins + 1]
        s[there] = mix(s[there] * _STEP + w.hash[w.first[begins[there]] + k])
    both = np.unique(np.concatenate([row[anchor], begins]).astype(np.uint64) << np.uint64(32) | np.concatenate([h, s]) >> np.uint64(32))
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _texts(row: np.ndarray, sig: np.ndarray, n: int) -> list[str]:
    """Each row's signatures in order, eight hex digits each."""
    raw, cut = sig.astype(">u4").tobytes(), np.searchsorted(row, np.arange(n + 1)) * 4
    return [raw[a:b].hex() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def likeness(row_a: np.ndarray, sig_a: np.ndarray, row_b: np.ndarray, sig_b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard of rows 0 to n - 1 of two collections; two empty sets are alike."""
    a, b = (np.asarray(r, np.uint64) << np.uint64(32) | s for r, s in ((row_a, sig_a), (row_b, sig_b)))
    both = np.bincount(row_a[np.isin(a, b, assume_unique=True)], minlength=n)[:n]
    either = np.bincount(row_a, minlength=n)[:n] + np.bincount(row_b, minlength=n)[:n] - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


#: Where a row stands in the order: without an id or not, the id turned round, and the text's hash.
_KEY = np.dtype([("none", np.int8), ("id", np.int64), ("text", np.int64)])


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (part, tail, doc_id, text), each part stored in descending doc_id and ended by the row that follows it.

    Nulls come last; rows of one id, or none, are in the order of their texts' hashes. The order is cut into ranges of
    all three, so no task sorts all rows and many rows of one id are many parts; only equal rows are never parted. A
    part's first row is also sent to the part before, as its tail, and the very first row to the last part.
    """
    spark = docs.sparkSession
    rows = text_columns(docs, "doc_id", "text")
    keys = [F.col("doc_id").isNull().cast("tinyint").alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("h")]
    parts = parts or min(max(-(-rows.count() // PART_ROWS), 1), PARTS)
    ranges = rows.select(*keys).repartitionByRange(parts, "none", "id", "h").withColumn("range", F.spark_partition_id())
    firsts = ranges.groupBy("range").agg(F.min(F.struct("none", "id", "h")).alias("first")).select("first.*").collect()  # a row for each part
    sent = spark.sparkContext.broadcast(np.sort(np.array([tuple(r) for r in firsts], _KEY)))

    @F.pandas_udf("part int, before int")
    def place(none: pd.Series, ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        own = np.zeros(len(none), _KEY)
        own["none"], own["id"], own["text"] = none, ids, texts
        part = np.searchsorted(sent.value, own, "right") - 1
        before = np.where(sent.value[part] == own, (part - 1) % len(sent.value), -1)
        return pd.DataFrame({"part": part.astype(np.int32), "before": before.astype(np.int32)})

    own = F.struct(F.col("_at.part").alias("part"), F.lit(False).alias("tail"))
    copy = F.struct(F.col("_at.before").alias("part"), F.lit(True).alias("tail"))
    placed = rows.withColumn("_at", place(*keys))
    placed = placed.select("doc_id", "text", F.explode(F.when(F.col("_at.before") < 0, F.array(own)).otherwise(F.array(own, copy))).alias("at")).select("at.part", "at.tail", "doc_id", "text")
    return placed.repartition("part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of all texts, and likeness to an edited text and to the next document.

    One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text has its last third (rounded down) replaced by as many first characters of the
    next document in descending doc_id, after the last the first; a lone document follows itself. Null
    texts are empty; texts without words have an empty fingerprint, and two such are alike. Repeated ids
    follow each other in the order of a hash of their texts. Other columns are not looked at. Which words are
    anchors depends on all documents, so fingerprints of two tables are not to be compared.
    """
    sent = docs.sparkSession.sparkContext.broadcast(document_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for piece in pieces(batches):
            rows = (pa.Table.from_batches([held, piece] if held is not None else [piece])).combine_chunks().to_batches()
            if not rows:
                continue
            rows, n = rows[0], rows[0].num_rows
            held = rows.slice(n - 1)
            part, tail = rows.column("part").to_numpy(), rows.column("tail").to_numpy(zero_copy_only=False)
            has = np.flatnonzero((part[:-1] == part[1:]) & ~tail[:-1])
            if not len(has):
                continue
            texts = [t or "" for t in rows.column("text").to_pylist()]
            edited = []
            for i in has.tolist():
                cut = len(texts[i]) // 3
                edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
            row, sig = signatures(rows.column("text"), sent.value, chain)
            edited_row, edited_sig = signatures(pa.array(edited, pa.string()), sent.value, chain)
            back = np.full(n + 1, -1)
            back[has] = np.arange(len(has))
            own = back[row] >= 0
            own_row, own_sig = back[row[own]], sig[own]
            nxt = (row > 0) & (back[np.maximum(row - 1, 0)] >= 0)
            next_row, next_sig = back[row[nxt] - 1], sig[nxt]
            prints = _texts(row, sig, n)
            m = len(has)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(has)),
                    pa.array([len(texts[i]) for i in has.tolist()], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([prints[i] for i in has.tolist()]),
                    pa.array(_texts(edited_row, edited_sig, m)),
                    pa.array(likeness(own_row, own_sig, edited_row, edited_sig, m)),
                    pa.array(likeness(own_row, own_sig, next_row, next_sig, m)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _order(sigs: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures as values whose order puts frequent ones last."""
    return sigs.astype(np.uint64) | _among(sigs, frequent).astype(np.uint64) << np.uint64(32)


def near_classes(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN) -> DataFrame:
    """One row per document: doc_id, class_id, n_docs, n_links.

    Equal fingerprints are one class, by its smallest doc_id; n_docs documents are in it, and n_links other classes
    have a Jaccard coefficient of the threshold at least. Sets are partitioned by length, band k holding |A| in
    [1/t^k, 1/t^(k+1)), and meet in their own and the next band. There they meet through the first |A| - ceil(t |A|) + 1
    signatures, frequent ones last: two sets that meet through none of these cannot reach the threshold. Ids and sketches
    meet first: a sketch has the parity of the signatures in each of 128 cells, so sketches differ in no more cells than
    sets in signatures, and who has nobody near enough by it leaves. Those that are left of several signatures are one
    group where they are the same classes, and each class's set goes to a group once. A pair counts where its first common
    signature brings it together. Who meets through a crowded signature is dealt out as squares, and a task returns counts,
    never pairs. Empty fingerprints (null texts, texts without words) are a class without
    links. Rows without doc_id are in their class, whose id is null if all of it lack one. Repeated rows are one class.
    Texts of any length are read whole; other columns are not looked at; empty in, empty out.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(document_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            row, sig = signatures(piece.column("text"), known.value, chain)
            cut = np.searchsorted(row, np.arange(piece.num_rows + 1))
            keys = []
            for salt in (1, 2):
                sums = np.append(np.uint64(0), np.cumsum(mix(sig.astype(np.uint64) * np.uint64(2 * salt + 1) + np.uint64(salt)), dtype=np.uint64))
                keys.append(pa.array(mix(sums[cut[1:]] - sums[cut[:-1]]).view(np.int64)))
            sigs = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(sig.view(np.int32)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *keys, sigs], ["doc_id", "k1", "k2", "sigs"])

    sets = written(text_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, sigs array<int>"))
    classes = written(sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs"), F.any_value("sigs").alias("sigs")))
    counts = written(classes.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = np.sort(counts.where(F.col("n") > max(total / MOST_FREQUENT, LEAST_FREQUENT)).select("sig").toArrow().column("sig").to_numpy().astype(np.uint32))
    sent = spark.sparkContext.broadcast(frequent)

    def arranged(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each class's number of signatures, all of them with frequent ones last, and where a class's begin."""
        n = np.diff(batch.column("sigs").offsets.to_numpy())
        value = _order(batch.column("sigs").flatten().to_numpy().view(np.uint32), sent.value)
        return n, value[np.lexsort((value, np.repeat(np.arange(len(n)), n)))], np.append(0, np.cumsum(n))

    def meeting(batches: Iterator[pa.RecordBatch], whole: bool = True) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, value, first = arranged(batch)
            sketch = _sketch(value, first).view(np.int64) if whole else None
            band = np.floor(np.log(np.maximum(n, 1)) / np.log(1 / threshold) + 1e-9).astype(np.int64)
            prefix = np.where(n > 0, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)
            of = np.repeat(np.arange(len(n)), prefix)
            through = value[np.repeat(first[:-1], prefix) + np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)]
            for at in range(0, len(of), POSTINGS):
                own, by = of[at : at + POSTINGS], through[at : at + POSTINGS]
                for role in (0, 1):  # 0 at home in the band, 1 from the next one
                    choice = mix(by * np.uint64(0x9E3779B97F4A7C15) + (band[own] - role).astype(np.uint64))
                    columns = {"choice": pa.array(choice.view(np.int64)), "role": pa.array(np.full(len(own), role, np.int32))}
                    if whole:
                        columns |= {"through": pa.array(by.astype(np.uint32).view(np.int32)), "fp": batch.column("k1").take(pa.array(own)), "k2": batch.column("k2").take(pa.array(own)), "n": pa.array(n[own].astype(np.int32))}
                        columns |= {"s0": pa.array(sketch[own, 0]), "s1": pa.array(sketch[own, 1])}
                    yield pa.RecordBatch.from_pydict(columns)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, value, first = arranged(batch)
            offsets = pa.py_buffer((4 * first).astype(np.int32).tobytes())
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(value.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), raw], ["fp", "k2", "raw"])

    several = classes.select("sigs").mapInArrow(lambda batches: meeting(batches, False), "choice long, role int")
    several = written(several.groupBy("choice").agg(F.count("*").alias("n"), F.min("role").alias("least")).where("n > 1 and least = 0").drop("least"))
    keys = classes.select("k1", "k2", "sigs").mapInArrow(meeting, "choice long, role int, through int, fp long, k2 long, n int, s0 long, s1 long").withColumnRenamed("n", "size")
    keys = written(joined(keys, several, ["choice"]).drop("n"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in whole_runs(batches):
            choice, part, role, size, k1, k2 = (own.column(c).to_numpy() for c in ("choice", "part", "role", "size", "fp", "k2"))
            sketch = np.stack([own.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")], 1)
            has = np.zeros(len(choice), bool)
            for a, b in _meetings(choice, part, role, size, sketch, threshold, has):
                has[a] = has[b] = True
            at = np.flatnonzero(has)
            if not len(at):
                continue
            # a group is named by its classes and their roles and parts
            named = mix(mix(k1[at].view(np.uint64)) + mix(k2[at].view(np.uint64) ^ _STEP) + (3 * role[at] + part[at]).astype(np.uint64) * _STEP)
            start, end = runs(choice[at])
            sums = np.append(np.uint64(0), np.cumsum(named, dtype=np.uint64))
            group = np.repeat(mix(sums[end] - sums[start]), end - start).view(np.int64)
            rest = own.select(["part", "role", "fp", "k2", "through"]).take(pa.array(at)).combine_chunks()
            yield from rest.add_column(0, "choice", pa.array(group)).to_batches()

    met = dealt(keys, F.count("*") / SIDE, "role", "through", "fp", "k2", "size", "s0", "s1")
    met = met.mapInArrow(candidates, "choice long, part int, role int, fp long, k2 long, through int")
    groups = met.groupBy("choice", "part", "role", "fp", "k2").agg(F.collect_set("through").alias("through"))
    rows = groups.join(classes.select("k1", "k2", "sigs").mapInArrow(ordered, "fp long, k2 long, raw binary"), ["fp", "k2"])
    rows = rows.select("choice", "part", "role", "fp", "k2", "through", "raw").repartition("choice").sortWithinPartitions("choice", "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in whole_runs(batches):
            choice, part, role = (own.column(c).to_numpy() for c in ("choice", "part", "role"))
            through = own.column("through").combine_chunks()
            n = _links(choice, part, through.value_lengths().to_numpy(), through.flatten().to_numpy().view(np.uint32), role, own.column("raw").to_pylist(), threshold)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([own.column("fp").combine_chunks().take(pa.array(at)), own.column("k2").combine_chunks().take(pa.array(at)), pa.array(n[at])], ["k1", "k2", "n"])

    links = rows.mapInArrow(compare, "k1 long, k2 long, n long").groupBy("k1", "k2").agg(F.sum("n").alias("n_links"))
    found = written(classes.select("k1", "k2", "class_id", "n_docs").join(links, ["k1", "k2"], "left").withColumnRenamed("n_docs", "n"))
    return joined(sets.select("doc_id", "k1", "k2"), found, ["k1", "k2"]).select("doc_id", "class_id", F.col("n").alias("n_docs"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _sketch(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two words for each row's values: the parity of those in each of 128 cells."""
    cell = mix(values.astype(np.uint64) & np.uint64(0xFFFFFFFF)) & np.uint64(127)
    bit = np.uint64(1) << (cell & np.uint64(63))
    out = []
    for word in (0, 1):
        sums = np.append(np.uint64(0), np.bitwise_xor.accumulate(np.where(cell >> np.uint64(6) == word, bit, np.uint64(0))))
        out.append(sums[first[1:]] ^ sums[first[:-1]])
    return np.stack(out, 1)


def _meetings(choice: np.ndarray, part: np.ndarray, role: np.ndarray, size: np.ndarray, sketch: np.ndarray, threshold: float, done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of rows of one choice that may be near by their parts, roles, sizes and sketches, a few thousand at a time; not those that are both done."""
    _, ends = runs(choice)
    last = ends[np.searchsorted(ends, np.arange(len(choice)), "right")] if len(ends) else ends
    apart = (1 - threshold) / (1 + threshold)
    shift, at = 1, np.arange(len(choice))
    while len(at := at[at + shift < last[at]]):
        for cut in range(0, len(at), 1 << 14):
            a = at[cut : cut + (1 << 14)]
            b = a + shift
            fine = ((part[a] != part[b]) | (part[a] == 0)) & ((role[a] == 0) | (role[b] == 0)) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)
            if done is not None:
                fine &= ~(done[a] & done[b])
            a, b = a[fine], b[fine]
            near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64) <= apart * (size[a] + size[b]) + 1e-6
            if near.any():
                yield a[near], b[near]
        shift += 1


def _links(choice: np.ndarray, part: np.ndarray, n_through: np.ndarray, through: np.ndarray, role: np.ndarray, raw: list[bytes], threshold: float) -> np.ndarray:
    """How many of the rows they meet each row is near to, of pairs whose first common signature is one of those they meet through; raw has each row's, frequent ones last."""
    size = np.array([len(r) // 4 for r in raw], np.int64)
    values, first = np.frombuffer(b"".join(raw), "<u4").astype(np.uint64), np.append(0, np.cumsum(size))
    out = np.zeros(len(raw), np.int64)
    start, end = runs(choice)
    run = np.repeat(np.arange(len(start)), end - start).astype(np.uint64) << np.uint64(32)
    allowed = np.unique(np.repeat(run, n_through) | through)
    for a, b in _meetings(choice, part, role, size, _sketch(values, first), threshold):
        ends, at = np.cumsum(size[a] + size[b]), 0
        while at < len(a):  # so many signatures at once, or one pair
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES // 8, "right")), at + 1)
            _count_near(a[at:to], b[at:to], size, values, first, run, allowed, threshold, out)
            at = to
    return out


def _count_near(a: np.ndarray, b: np.ndarray, size: np.ndarray, values: np.ndarray, first: np.ndarray, run: np.ndarray, allowed: np.ndarray, threshold: float, out: np.ndarray) -> None:
    pair, theirs = np.repeat(np.arange(len(a)), size[a]), np.repeat(np.arange(len(b)), size[b])
    x = values[np.arange(len(pair)) + np.repeat(first[a] - (np.cumsum(size[a]) - size[a]), size[a])]
    y = values[np.arange(len(theirs)) + np.repeat(first[b] - (np.cumsum(size[b]) - size[b]), size[b])]
    common = np.flatnonzero(np.isin(pair.astype(np.uint64) << np.uint64(32) | x, theirs.astype(np.uint64) << np.uint64(32) | y, assume_unique=True))
    both = np.bincount(pair[common], minlength=len(a))
    met, where = np.unique(pair[common], return_index=True)
    near = both[met] / (size[a[met]] + size[b[met]] - both[met]) >= threshold - 1e-12
    near &= _among(run[a[met]] | x[common[where]], allowed)
    np.add.at(out, a[met[near]], 1)
    np.add.at(out, b[met[near]], 1)


def spotsigs_near_classes(spark, sf_dir: str) -> DataFrame:
    """The class of each document and to how many classes it is near."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, with their edited texts and their neighbours."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
