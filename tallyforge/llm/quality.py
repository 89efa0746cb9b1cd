"""Quality classifier by co-training.

Two views of a document each have a classifier: what its text says (hashed words, runs of symbols, shares of
symbols, capitals, digits, lines and repeated words) and what its record says (source, language, recorded size).
The text view is a logistic regression over the buckets that differ between good and bad, the record's view adds
up log odds. Both start from labelled documents; each round, each view hands the unlabelled documents of which it is
surest, a share of all that grows by the round, to the other one with its label for them. Each view is calibrated on labelled documents
from which neither learns, and what it has learned in a round is taken back if that makes it worse on them; at last
their log odds are added, and all documents are scored.

Texts are read three times: for which buckets count among the documents that the record's view hands over at first, for
a compact table of chosen buckets, and to be scored. Everything learned from unlabelled documents is a sum over all of
them, made in the tasks, so no document is left out and none moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import LOWER, NOT_ALNUM, SYMBOL, mix, pieces, text_bytes, words, written

#: Buckets of hashed features: of the text view, and of the record's view.
DIMS_BITS, META_BITS = 17, 12
#: Labelled documents to learn from. Of unlabelled ones all take part.
MAX_LABELLED = 20_000
#: Rounds, and the share of the unlabelled documents by which what a view hands over grows in each; weight of a pseudo-labelled document, less for the kind of which there are too many.
ROUNDS, HANDED, PSEUDO = 2, 0.2, 0.5
#: Steps in which log odds from -20 to 20 are counted; loss a held document by which a view may get worse before it forgets a round.
BINS, WORSE = 4_000, 0.01
#: A bucket is chosen if its likelihood ratio statistic is that large (about one in ten thousand by chance), the best ones up to a number.
LEAST_G, MOST_CHOSEN = 15.0, 4_096
#: Steps of a fit to labelled documents alone, and of one that pseudo-labelled ones take part in, each a pass over the compact table.
STEPS, SHARED_STEPS = 60, 12
NAMES = ("score", "p_text", "p_meta", "good")


def text_buckets(texts: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), distinct and in order, of all rows; only buckets with a place in chosen, given as that place."""
    n = len(texts)
    w, s = words(texts, NOT_ALNUM, LOWER), words(texts, ~SYMBOL)
    data, offsets = text_bytes(texts)
    size, n_words = np.diff(offsets), np.diff(w.first)

    def share(of: np.ndarray, steps: int, salt: int) -> np.ndarray:
        sums = np.append(0, np.cumsum(of))
        part = sums[offsets[1:]] - sums[offsets[:-1]]
        return mix(np.ceil(steps * part / np.maximum(size, 1)).astype(np.uint64) + np.uint64(salt))

    of_word = w.row
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])
    repeats = np.bincount(of_word[again], minlength=n)
    wholes = [
        share(SYMBOL[data], 50, 1_000), share((data >= 65) & (data <= 90), 20, 2_000), share((data >= 48) & (data <= 57), 50, 3_000), share(data == 10, 50, 4_000),
        mix(np.ceil(10 * repeats / np.maximum(n_words, 1)).astype(np.uint64) + np.uint64(5_000)),
    ]
    row = np.concatenate([of_word, s.row, *[np.arange(n)] * len(wholes)])
    bucket = (np.concatenate([w.hash, mix(s.hash + np.uint64(1)), *wholes]) >> np.uint64(64 - DIMS_BITS)).astype(np.int64)
    if chosen is not None:
        bucket = chosen[bucket]
        row, bucket = row[bucket >= 0], bucket[bucket >= 0]
    both = np.unique(row << DIMS_BITS | bucket)
    return both >> DIMS_BITS, both & ((1 << DIMS_BITS) - 1)


def _lists(row: np.ndarray, bucket: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(bucket.astype(np.int32)))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists without nulls."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), n), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _record(source: str = "_source", lang: str = "_lang", size: str = "_n"):
    """The record's buckets as an array column: source, language, recorded size in half powers of two, source with language."""
    key = lambda salt, *c: F.pmod(F.xxhash64(F.lit(salt), *[F.coalesce(F.col(x).cast("string"), F.lit("\0")) for x in c]), F.lit(1 << META_BITS)).cast("int")
    step = F.floor(2 * F.log2(F.coalesce(F.col(size), F.lit(-1)).cast("double") + 2)).cast("string")
    of_size = F.pmod(F.xxhash64(F.lit(3), F.coalesce(step, F.lit("\0"))), F.lit(1 << META_BITS)).cast("int")
    return F.array_distinct(F.array(key(1, source), key(2, lang), of_size, key(4, source, lang)))


class View(NamedTuple):
    """Weights by place, and the log odds of a document that has none of them."""

    weights: np.ndarray
    base: float

    def logit(self, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weights=self.weights[place], minlength=n)[:n] + self.base


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def likelihood_ratio(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """The G statistic of each bucket's presence against the label."""
    both, n = good + bad, n_good + n_bad

    def term(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    return 2 * (term(good, both * n_good / n) + term(bad, both * n_bad / n) + term(n_good - good, (n - both) * n_good / n) + term(n_bad - bad, (n - both) * n_bad / n))


def odds(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> View:
    """Naive Bayes from sums; a bucket's log odds shrink as its G statistic gets small, and it takes about 70 documents of one label to be sure."""
    shrunk = np.clip(1 - 4 / np.maximum(likelihood_ratio(good, bad, n_good, n_bad), 1e-9), 0, 1)
    return View(shrunk * (np.log((good + 2) / (n_good + 4)) - np.log((bad + 2) / (n_bad + 4))), float(np.log(n_good / n_bad)))


def _chosen(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """The buckets that tell good from bad, in order."""
    g = likelihood_ratio(good, bad, n_good, n_bad)
    best = np.argsort(-g, kind="stable")[:MOST_CHOSEN]
    return np.sort(best[g[best] >= LEAST_G])


def _of(which: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of some rows, rows numbered anew."""
    new, own = np.cumsum(which) - 1, which[pairs[0]]
    return new[pairs[0][own]], pairs[1][own]


def _descended(view: View, steps: int, labelled: tuple, more=None, free: np.ndarray | None = None) -> View:
    """Logistic regression, ridge 1, by steps scaled with each place's sum of weights. more(view): the same sums over pseudo-labelled documents. free: the places that may move."""
    row, place, y, weight = labelled
    w, base, n = view.weights.copy(), view.base, len(y)
    often = np.bincount(place, weights=weight[row], minlength=len(w))
    for _ in range(steps):
        error = weight * (probability(View(w, base).logit(row, place, n)) - y)
        slope, seen, of_base, total = np.bincount(place, weights=error[row], minlength=len(w)), often, error.sum(), weight.sum()
        if more is not None:
            slope2, seen2, of_base2, total2 = more(View(w, base))
            slope, seen, of_base, total = slope + slope2, seen + seen2, of_base + of_base2, total + total2
        w = w - (slope + w) / (seen + 1) * (1 if free is None else free)
        base -= 2 * of_base / max(total, 1e-9)
    return View(w, base)


def calibrated(z: np.ndarray, y: np.ndarray, slope: float = 1.0) -> tuple[float, float]:
    """(slope, shift) of the log odds on documents not learned from, held to (slope, 0) by a ridge; 2 at most, so a few easy documents make no view sure."""
    held, ridge = np.array([slope, 0.0]), np.diag([2.0, 1.0])
    x, at = np.stack([z, np.ones(len(z))]), held
    for _ in range(30):
        p = probability(at @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + ridge, x @ (p - y) + ridge @ (at - held))
        at = at - step
        if np.abs(step).max() < 1e-6:
            break
    return min(max(float(at[0]), 0.0), 2.0), float(at[1])


def _aligned(view: View, row: np.ndarray, place: np.ndarray, y: np.ndarray, slope: float = 1.0) -> View:
    """The view with calibrated log odds."""
    slope, shift = calibrated(view.logit(row, place, len(y)), y, slope)
    return View(slope * view.weights, slope * view.base + shift)


def _loss(view: View, row: np.ndarray, place: np.ndarray, y: np.ndarray) -> float:
    """Mean log loss on documents not learned from."""
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * view.logit(row, place, len(y))))) if len(y) else 0.0


def bins(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + 20) * (BINS / 40)), 0, BINS - 1).astype(np.int64)


class Surest(NamedTuple):
    """A view, and the bins of log odds up to which it hands documents over as bad, and from which on as good."""

    view: View
    bad: int
    good: int

    def __call__(self, row: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = bins(self.view.logit(row, place, n))
        return at <= self.bad, at >= self.good


class Handed(NamedTuple):
    """What a view has handed over in all rounds so far; of a document's labels the last one counts."""

    rounds: tuple[Surest, ...]

    def __call__(self, row: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        bad, good = np.zeros(n, bool), np.zeros(n, bool)
        for says in self.rounds:
            b, g = says(row, place, n)
            bad, good = bad & ~g | b, good & ~b | g
        return bad, good


def surest(view: View, counts: np.ndarray, n_bad: float, n_good: float, base: float, share: float = HANDED) -> Surest:
    """The documents of which the view is surest: that share of all counted ones, in the labelled ones' proportion.

    A bin of equals goes whole or not at all, but the most extreme one goes in any case. Bad ones lie below the log odds
    of all documents, good ones above; a view that tells nothing apart hands nothing over.
    """
    wanted, middle = share * counts.sum(), int(bins(np.array([base]))[0])
    there = np.flatnonzero(counts)
    if not len(there) or there[0] >= middle or there[-1] <= middle:
        return Surest(view, -1, BINS)
    up, down = np.cumsum(counts), np.cumsum(counts[::-1])
    bad = max(int(np.searchsorted(up, wanted * n_bad / (n_bad + n_good), "right")) - 1, int(there[0]))
    good = min(BINS - int(np.searchsorted(down, wanted * n_good / (n_bad + n_good), "right")), int(there[-1]))
    return Surest(view, min(bad, middle - 1), max(good, middle + 1))


def _in_proportion(bad: float, good: float, n_bad: float, n_good: float) -> tuple[float, float]:
    """Weights of surely bad and surely good documents, so that together they are as many to one as labelled ones."""
    ratio = n_good / n_bad
    if not bad or not good:
        return 0.0, 0.0
    return PSEUDO * min(1.0, good / (ratio * bad)), PSEUDO * min(1.0, ratio * bad / good)


def _sums(rows: DataFrame, state: dict, size: int, add) -> np.ndarray:
    """A vector of sums over compact rows: add(state, chosen, record, rows, vector) in the tasks, then by place."""
    sent = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                add(sent.value, _flat(batch.column("chosen")), _flat(batch.column("record")), batch.num_rows, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "sum"])

    found = rows.select("chosen", "record").mapInArrow(run, "place int, sum double").groupBy("place").agg(F.sum("sum").alias("sum")).toArrow()
    out = np.zeros(size)
    out[found.column("place").to_numpy()] = found.column("sum").to_numpy()
    return out


def _histogram(state: dict, text: tuple, meta: tuple, n: int, total: np.ndarray) -> None:
    """How many rows are in each bin of a view's log odds."""
    np.add.at(total, bins(state["view"].logit(*(text if state["of"] == "text" else meta), n)), 1)


def _by_label(state: dict, text: tuple, meta: tuple, n: int, total: np.ndarray) -> None:
    """Buckets of one view's rows that the other view hands over, by label; then how many rows that are, and how many there were."""
    teacher, taught = ((text, meta), (meta, text))[state["taught"] == "text"]
    size = (len(total) - 3) // 2
    for k, own in enumerate(state["teacher"](*teacher, n)):
        total[k * size : (k + 1) * size] += np.bincount(taught[1][own[taught[0]]], minlength=size)
        total[2 * size + k] += own.sum()
    total[-1] += n


def _slope(state: dict, text: tuple, meta: tuple, n: int, total: np.ndarray) -> None:
    """The text view's slope over the rows that the record's view hands over."""
    m = (len(total) - 2) // 2
    bad, good = state["meta"](*meta, n)
    weight = state["weights"][0] * bad + state["weights"][1] * good
    error = weight * (probability(state["text"].logit(*text, n)) - good)
    total[:m] += np.bincount(text[1], weights=error[text[0]], minlength=m)
    total[m : 2 * m] += np.bincount(text[1], weights=weight[text[0]], minlength=m)
    total[2 * m] += error.sum()
    total[2 * m + 1] += weight.sum()


class Model(NamedTuple):
    """Both views, calibrated, the chosen buckets' places, and the log odds of any document, which both views count."""

    chosen: np.ndarray
    text: View
    meta: View
    prior: float

    def scores(self, texts: pa.Array, record: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, p_text, p_meta) of each row."""
        n = len(texts)
        a, b = self.text.logit(*text_buckets(texts, self.chosen), n), self.meta.logit(*_flat(record), n)
        return probability(a + b - self.prior), probability(a), probability(b)


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED, report: list | None = None) -> Model | float:
    """A model, or the share of good documents (1 if none is labelled) where labels are of one kind only.

    report: gets a dict for each round: unlabelled documents judged, how many the text and the record's view have handed
    over (text_sure, meta_sure), and whether the text and the record's view have kept what they learned of the other
    (text_kept, meta_kept).
    """
    spark = docs.sparkSession
    known = written(labels.where("doc_id is not null and label is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("label").cast("double").alias("label")))
    n = known.count()
    at = lambda c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1_000_000))
    sample = known.where(at("_id", 1) < 1e6 * max_labelled / max(n, 1))
    rows = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("n_chars").alias("_n"))
    record = _record().alias("record")

    def compact(of: DataFrame, chosen: np.ndarray | None, keep: list[str], schema: str, sure: Surest | None = None) -> DataFrame:
        """Rows by their buckets; given what the record's view hands over, only those."""
        sent = spark.sparkContext.broadcast((chosen, sure))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen, sure = sent.value
            for part in pieces(batches):
                if sure is not None:
                    bad, good = sure(*_flat(part.column("record")), part.num_rows)
                    part = part.filter(pa.array(bad | good))
                own = _lists(*text_buckets(part.column("text"), chosen), part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), part.column("record"), own], [*keep, "record", "chosen"])

        return of.select(*keep, record, "text").mapInArrow(run, f"{schema}, record array<int>, chosen array<int>")

    # the sample's size is bounded by max_labelled, so it may go to all executors
    taught = rows.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).withColumn("held", F.pmod(F.xxhash64("_doc", F.lit(3)), F.lit(5)) == 0)
    taught = written(compact(taught, None, ["label", "held"], "label double, held boolean"))
    counts = {r.label: r.n for r in taught.where("not held").groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_good, n_bad = counts.get(1.0, 0), counts.get(0.0, 0)
    if not n_good or not n_bad:
        return float(n_good / (n_good + n_bad)) if n_good + n_bad else 1.0
    own = taught.where("not held").select("label", F.explode("chosen").alias("b")).groupBy("b").agg(F.sum("label").alias("good"), F.count("*").alias("n")).toArrow()
    dims, size = 1 << DIMS_BITS, 1 << META_BITS
    text_good, text_bad = np.zeros(dims), np.zeros(dims)
    b, g = own.column("b").to_numpy(), own.column("good").to_numpy()
    text_good[b], text_bad[b] = g, own.column("n").to_numpy() - g
    # labelled documents: a bounded sample; their text buckets are fetched once some are chosen
    def fetched(best: np.ndarray) -> tuple:
        places = F.array(*map(F.lit, best.tolist())) if len(best) else F.array().cast("array<int>")
        few = taught.select("label", "held", "record", F.array_intersect("chosen", places).alias("chosen")).toArrow()
        return few.column("label").to_numpy(), few.column("held").to_numpy(zero_copy_only=False).astype(bool), _flat(few.column("record")), _flat(few.column("chosen"))

    y, held, meta, _ = fetched(np.zeros(0, int))
    start = ~held
    own_meta, y_start = _of(start, meta), y[start]
    meta_good, meta_bad = (np.bincount(own_meta[1][y_start[own_meta[0]] == k], minlength=size).astype(float) for k in (1, 0))
    view_meta = _aligned(odds(meta_good, meta_bad, n_good, n_bad), *_of(held, meta), y[held], 0.0)
    of_id = f"_doc {rows.schema['_doc'].dataType.simpleString()}"
    base = float(np.log(n_good / n_bad))

    def unlabelled(compacted: DataFrame) -> DataFrame:
        return compacted.join(known.select(F.col("_id").alias("_doc")), "_doc", "left_anti").drop("_doc")

    def handed_over(by: str, of: DataFrame, view: View, k: int = 0) -> Surest:
        return surest(view, _sums(of, {"of": by, "view": view}, BINS, _histogram), n_bad, n_good, base, HANDED * (k + 1))

    records = written(unlabelled(rows.select("_doc", record, F.array().cast("array<int>").alias("chosen"))))
    best = by_labels = _chosen(text_good, text_bad, n_good, n_bad)
    first = handed_over("meta", records, view_meta) if rounds else Surest(view_meta, -1, BINS)
    if first.bad >= 0:
        # buckets that count among what the record's view hands over, besides those that count among labelled documents
        # written first, so that no task has two Python workers behind each other
        some = written(unlabelled(compact(rows, None, ["_doc"], of_id, first)))
        more = _sums(some, {"teacher": first, "taught": "text"}, 2 * dims + 3, _by_label)
        also = _chosen(more[dims : 2 * dims], more[:dims], max(more[2 * dims + 1], 1), max(more[2 * dims], 1))
        best = np.sort(np.append(by_labels, also[~np.isin(also, by_labels)][: MOST_CHOSEN - len(by_labels)]))
    chosen = np.full(dims, -1, np.int64)
    chosen[best] = np.arange(len(best))
    y, held, meta, short = fetched(best)
    short, start = (short[0], chosen[short[1]]), ~held
    labelled = (*_of(start, short), y[start], np.ones(start.sum()))
    held_text, held_meta = (*_of(held, short), y[held]), (*_of(held, meta), y[held])
    view_text = _aligned(_descended(View(np.zeros(len(best)), base), STEPS, labelled, free=np.isin(best, by_labels)), *held_text)
    made = written(unlabelled(compact(rows, chosen, ["_doc"], of_id))) if rounds else None  # every unlabelled document, by its chosen buckets
    m, by_meta, by_text = len(best), Handed(()), Handed(())
    for k in range(rounds):
        # the record's view teaches the text view
        meta_says = Handed((*by_meta.rounds, handed_over("meta", records, view_meta, k) if k else first))
        of_meta = _sums(records, {"teacher": meta_says, "taught": "text"}, 2 + 3, _by_label)[2:4]
        weights = _in_proportion(*of_meta, n_bad, n_good)

        def shared(view: View, teacher=meta_says, weights=weights) -> tuple:
            s = _sums(made, {"text": view, "meta": teacher, "weights": weights}, 2 * m + 2, _slope)
            return s[:m], s[m : 2 * m], s[2 * m], s[2 * m + 1]

        text_kept = meta_kept = False
        if weights[0]:
            taught_text = _aligned(_descended(view_text, SHARED_STEPS, labelled, shared), *held_text)
            text_kept = _loss(taught_text, *held_text) <= _loss(view_text, *held_text) + WORSE
            view_text, by_meta = (taught_text, meta_says) if text_kept else (view_text, by_meta)
        # and the text view the record's
        text_says = Handed((*by_text.rounds, handed_over("text", made, view_text, k)))
        more = _sums(made, {"teacher": text_says, "taught": "meta"}, 2 * size + 3, _by_label)
        of_text = more[2 * size : 2 * size + 2]
        w_bad, w_good = _in_proportion(*of_text, n_bad, n_good)
        if w_bad:
            taught_meta = odds(meta_good + w_good * more[size : 2 * size], meta_bad + w_bad * more[:size], n_good + w_good * of_text[1], n_bad + w_bad * of_text[0])
            taught_meta = _aligned(taught_meta, *held_meta, 0.0)
            meta_kept = _loss(taught_meta, *held_meta) <= _loss(view_meta, *held_meta) + WORSE
            view_meta, by_text = (taught_meta, text_says) if meta_kept else (view_meta, by_text)
        if report is not None:
            report.append({"judged": int(more[-1]), "text_sure": int(of_text.sum()), "meta_sure": int(of_meta.sum()), "text_kept": bool(text_kept), "meta_kept": bool(meta_kept)})
    prior = float(np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1)))
    return Model(chosen, view_text, view_meta, prior)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED, report: list | None = None) -> DataFrame:
    """All rows and columns of docs, and score (0 to 1), p_text, p_meta and good (score >= threshold).

    docs: doc_id, text, lang, source, n_chars; labels: doc_id, label (1 good, 0 bad, null unknown). The views
    learn from at most about max_labelled labelled documents, those whose hash of doc_id falls under the bound's
    share, and label all unlabelled ones for each other; every fifth labelled one is kept for calibration.
    A view that gets worse by what the other hands over takes it back. Documents whose repeated labels differ count as bad. Rows with equal doc_id share its label; a null doc_id is
    unlabelled. Null and empty texts are texts without words, texts of any length are read whole; other nulls are
    values of their own. With labels of one kind only, or none, the score is the share of good ones, or 1. Columns
    of docs with the names of ours are replaced. Empty in, empty out.
    """
    own = [c for c in docs.columns if c not in NAMES]
    model = fit(docs, labels, rounds, max_labelled, report)
    if isinstance(model, float):
        return docs.select(*own, *[F.lit(model).alias(c) for c in NAMES[:3]], F.lit(model >= threshold).alias("good"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # columns by number, so that no name of the caller's can clash with ours
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)], F.col("text").cast("string").alias("_text"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("n_chars").alias("_n"))
    rows = rows.select(*[f"c{i}" for i in range(len(own)) if own[i] != "text"], "_text", _record().alias("_record"))
    kept = [c for c in rows.columns if c not in ("_text", "_record")]
    schema = rows.drop("_record").schema
    for c in NAMES[:3]:
        schema = schema.add(c, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "_text"):
            found = sent.value.scores(part.column("_text"), part.column("_record"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), part.column("_text"), *map(pa.array, found)], [*kept, "_text", *NAMES[:3]])

    out = rows.mapInArrow(run, schema)
    back = [(F.col("_text").cast(docs.schema["text"].dataType) if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(own)]
    return out.select(*back, *NAMES[:3], (F.col("score") >= threshold).alias("good"))


def good_labels(labels: DataFrame) -> DataFrame:
    """Good is what was labelled of high quality and not toxic."""
    return labels.select("doc_id", F.expr("case when quality = 0 or toxic = 1 then 0 when quality = 1 then 1 end").alias("label"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, good_labels(labels)).select("doc_id", "score", "p_text", "p_meta", "good")


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected, all columns; nulls, repeats and empty tables as `scored` says, so a row without an id or a text is judged like any other."""
    out = scored(docs, good_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.where("good").select(*docs.columns)
