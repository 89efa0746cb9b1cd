"""Language identification by the nearest of several centroids per language.

A text is its character trigrams (bytes of the lower-cased text, all that is neither a letter nor beyond
ASCII read as one space), hashed to DIMS features, weighted by TF-IDF and scaled to length 1. The
training texts of a language are clustered, and a text gets the language of the centroid with the largest
cosine; one that is too far from all centroids can be rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import pieces, text_bytes, text_columns

DIMS = 4096
UNKNOWN = "und"
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count), in order: the hashed trigrams of each row, with a space before and after it."""
    data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    n = len(offsets) - 1
    # a space between rows belongs to both
    spaced = np.full(len(data) + n + 1, 32, np.uint8)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    spaced[np.arange(len(data)) + row_of + 1] = _FOLD[data]
    keep = np.append(True, (spaced[1:] != 32) | (spaced[:-1] != 32))  # several spaces are one
    bounds = offsets + np.arange(n + 1)  # where each row's leading space is
    keep[bounds] = True
    place = np.cumsum(keep) - 1
    s, first = spaced[keep].astype(np.uint32), place[bounds]
    if len(s) < 3:
        return (np.zeros(0, np.int64),) * 3
    code = (s[:-2] << 16 | s[1:-1] << 8 | s[2:]) * np.uint32(2654435761) >> np.uint32(32 - 12)
    at = np.arange(len(code))
    row = np.searchsorted(first, at, "right") - 1
    inside = (row < n) & (at + 2 <= first[np.minimum(row + 1, n)]) & ~((s[1:-1] == 32) & ((s[:-2] == 32) | (s[2:] == 32)))
    values, counts = np.unique(row[inside] * DIMS + code[inside].astype(np.int64), return_counts=True)
    return values // DIMS, values % DIMS, counts


def vectors(row: np.ndarray, feature: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    x = np.zeros((n, DIMS), np.float32)
    x[row, feature] = (1 + np.log(count)) * idf[feature]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all rows each feature occurs, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS + 1, np.int64), 0
        for part in pieces(batches):
            _, feature, _ = trigrams(part.column("text"))
            seen[:DIMS] += np.bincount(feature, minlength=DIMS)
            n += part.num_rows
        seen[DIMS] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["feature", "n"])

    table = docs.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIMS + 1, np.int64)
    out[table.column("feature").to_numpy()] = table.column("n").to_numpy()
    return out[:DIMS], int(out[DIMS])


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the seeds are the texts farthest from those taken before."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in np.unique(own):
            c[j] = x[own == j].sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


class Model:
    """Centroids of all languages and the features' IDF."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray) -> None:
        self.langs, self.centroids, self.idf = langs, centroids, idf


def fit(labelled: DataFrame, per_language: int = 2_000, k: int = 4, key: str = "doc_id") -> Model:
    """From rows (key, text, lang): IDF over all of them, centroids from about per_language texts of each language.

    The sample takes the rows whose key's hash falls under per_language / (texts of the language); a language of
    fewer texts gives all. Null and empty texts, and rows without lang, teach nothing.
    """
    rows = labelled.select(F.xxhash64(key).alias("at"), "text", "lang").where("text <> '' and lang is not null")
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    share = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    shares = {r.lang: r.share for r in share.collect()}
    if not shares:
        return Model([], np.zeros((0, DIMS), np.float32), idf)
    of = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    sample = rows.where(F.pmod("at", F.lit(1_000_000)) < of[F.col("lang")] * 1_000_000).select("text", "lang")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            row, feature, count = trigrams(part.column("text"))
            cut = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.ListArray.from_arrays(cut, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(count.astype(np.int32)))], ["lang", "features", "counts"])

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["features"].map(len).to_numpy()
        row = np.repeat(np.arange(len(rows)), size)
        x = vectors(row, np.concatenate([*rows["features"], []]).astype(np.int64), np.concatenate([*rows["counts"], []]), len(rows), idf)
        x = x[x.any(axis=1)]
        c = clustered(x[np.lexsort(x[:, :8].T)], k) if len(x) else x
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": list(c)})

    found = sample.mapInArrow(sparse, "lang string, features array<int>, counts array<int>").groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>")
    rows = sorted((r.lang, r.centroid) for r in found.collect())
    return Model([lang for lang, _ in rows], np.array([c for _, c in rows], np.float32).reshape(-1, DIMS), idf)


def predict(docs: DataFrame, model: Model, keep: list[str | Column], least: float = 0.0) -> DataFrame:
    """The kept columns, lang_pred, score (cosine of the nearest centroid) and rejected.

    A text that is null or has no letter is `und` with score 0. So is any text if nothing was learned. A
    text whose cosine is under `least` is rejected: true in that column, and the nearest language stays
    in lang_pred. Of equal cosines the language that sorts first wins.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.select(*keep).columns]
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in pieces(batches, "_text"):
            texts = part.column("_text")
            row, feature, count = trigrams(texts)
            cos = vectors(row, feature, count, part.num_rows, m.idf) @ m.centroids.T
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if not m.langs:
                cos, letters = np.zeros((part.num_rows, 1)), np.zeros(part.num_rows, bool)
            best = np.argmax(cos, axis=1)
            score = np.where(letters, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0).astype(float)
            lang = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang), pa.array(score), pa.array(letters & (score < least))], [*names, "lang_pred", "score", "rejected"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(run, schema)


def op3_langid(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned where crc32(doc_id) mod 3 is not 1."""
    docs = text_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit(docs.where(fold != 1))
    out = predict(docs, model, ["doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out")], least=0.2)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
