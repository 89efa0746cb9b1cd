"""Operators in pieces of a few bytes, so that nearly every text is longer than a piece, and the stages and the pipeline on hard rows."""

import functools
import zlib

import pytest
from helpers import HARD, docs, grouped, line_dedup, simhash
from pyspark.sql import functions as F
from test_dedup import alike_groups, given_docs, shingle_sets
from test_others import ODD, check_spots, covered, tokenizer

import corpus_pipeline
from tallyforge.llm import decontam, langid, packing, quality, spotsigs, tokens
from tallyforge.llm import simhash as S

ROWS = [*HARD, *ODD]


@pytest.fixture(params=[1, 60])
def small(request, monkeypatch):
    for module in (decontam, langid, packing, quality, spotsigs, tokens, S):
        monkeypatch.setattr(module, "pieces", functools.partial(module.pieces, most=request.param))
    return request.param


def in_one(spark, rows):
    """All rows in one partition, so that what a task carries from piece to piece counts."""
    return docs(spark, rows).coalesce(1)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_simhash_in_small_pieces(spark, small):
    texts = [(i, t) for i, t in ROWS]
    fps = {t: simhash(t, 4) for _, t in texts}
    ids = {}
    for i, t in texts:
        if i is not None:
            ids[fps[t]] = min(ids.get(fps[t], i), i)
    root = grouped({i: f for f, i in ids.items()}, 4)
    got = plain(S.near_duplicates(in_one(spark, texts)).select("doc_id", "fingerprint", "component_id").collect())
    assert got == plain((i, f"{fps[t]:016x}", root[ids[fps[t]]] if fps[t] in ids else None) for i, t in texts)


def test_similar_in_small_pieces(spark, small):
    rows = [(i, t) for i, t in dict((i, t) for i, t in ROWS if i is not None).items()]
    got = {r.doc_id: r.component_id for r in S.similar(in_one(spark, rows)).collect()}
    assert got == alike_groups(shingle_sets(rows))


def test_spots_in_small_pieces(spark, small):
    rows = [r for k, r in enumerate(ROWS) if r[0] not in [x for x, _ in ROWS[:k]]]
    check_spots(rows, {r.doc_id: r for r in spotsigs.fingerprints(in_one(spark, rows)).collect()})


def test_spot_order_of_repeated_rows_in_small_pieces(spark, small):
    rows = [(i % 7, f"text {i % 11} is the one and only " * (i % 5)) for i in range(60)]
    assert spotsigs.fingerprints(in_one(spark, rows)).count() == len(rows)


def test_packing_in_small_pieces(spark, small):
    t, want = tokenizer(), []
    for i, text in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(ids[at : at + 2048])) + (zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + 2048])),) for k, at in enumerate(range(0, len(ids), 2048))]
    got = packing.pack(in_one(spark, ROWS)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert plain(got) == plain(want)


def test_encoder_that_forgets_its_words(spark):
    import pyarrow as pa

    e = tokens.Encoder(tokens.send_tokenizer(spark).value)
    want = [tokenizer().encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    for again in range(2):
        for (_, t), ids in zip(ROWS, want):
            e._forget()
            got, _ = e(pa.array([t, t], pa.string()))
            assert got.tolist() == ids * 2


def test_token_counts_in_small_pieces(spark, small):
    t = tokenizer()
    got = tokens.token_counts(in_one(spark, ROWS), ["doc_id"]).collect()
    assert plain(got) == plain((i, len(t.encode(text or "", add_special_tokens=False).ids)) for i, text in ROWS)


def test_languages_in_small_pieces(spark, sf, monkeypatch):
    known = spark.read.parquet(f"{sf}/documents.parquet").coalesce(2)
    model = langid.fit(known)
    want = plain(langid.predict(in_one(spark, ROWS), model, ["doc_id"]).collect())
    monkeypatch.setattr(langid, "pieces", functools.partial(langid.pieces, most=60))
    assert [r[:2] for r in plain(langid.predict(in_one(spark, ROWS), model, ["doc_id"]).collect())] == [r[:2] for r in want]
    again = langid.fit(known)
    assert again.langs == model.langs and again.idf == pytest.approx(model.idf, abs=1e-5)


def test_languages_of_an_empty_table(spark, sf):
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    assert langid.predict(docs(spark, []), model, ["doc_id"]).count() == 0


def test_quality_in_small_pieces(spark, monkeypatch):
    rows = docs(spark, ROWS + [(100 + i, f"good words here number {i}") for i in range(30)] + [(200 + i, f"### ||| junk $$$ {i}") for i in range(30)])
    label = spark.createDataFrame([(100 + i, 1) for i in range(20)] + [(200 + i, 0) for i in range(20)], "doc_id long, label int")
    key = ["doc_id", "text", "score"]
    want = plain(quality.scored(rows, label).select(*key).collect())
    monkeypatch.setattr(quality, "pieces", functools.partial(quality.pieces, most=60))
    got = plain(quality.scored(rows.coalesce(1), label).select(*key).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-6)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_hard_rows_and_empty_tables(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = docs(spark, ROWS)
    out = stage(spark, rows, sf)
    got = out.collect()
    if name != "pack":
        assert out.columns == rows.columns
    ids = {r.doc_id for r in got}
    assert ids <= {i for i, _ in ROWS}
    if name in ("line_dedup", "decontaminate"):  # no benchmark item among them; emptied texts stay
        assert len(got) == len(ROWS)
    empty = stage(spark, docs(spark, []), sf)
    assert empty.count() == 0 and empty.columns == out.columns


def test_pipeline_without_labels_or_benchmark(spark, sf, tmp_path):
    """Empty side tables: nothing is rejected and nothing is a leak."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = docs(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES:
        if name in ("quality", "decontaminate"):
            assert stage(spark, rows, str(tmp_path)).count() == len(ROWS)


def test_pipeline_equals_plain_stages(spark, sf):
    """Each stage after the classifier against a brute-force version over what its predecessor kept, and run() against the chain."""
    stages, at = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")
    labels = quality.good_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    kept = stages["quality"](spark, at, sf)
    assert plain(kept.collect()) == plain(quality.scored(at, labels).where("good").select(*at.columns).collect())

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    at = stages["line_dedup"](spark, kept, sf)
    left = line_dedup(rows, 1)
    assert plain(at.select("doc_id", "text").collect()) == plain((i, left[i, t]) for i, t in rows)

    rows = [(i, left[i, t]) for i, t in rows]
    at = stages["near_dedup"](spark, at, sf)
    groups = alike_groups(shingle_sets(rows))
    rows = [(i, t) for i, t in rows if groups[i] == i]
    assert plain(at.select("doc_id", "text").collect()) == plain(rows)

    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    at = stages["decontaminate"](spark, at, sf)
    rows = [(i, t) for i, t in rows if not any(shares(t, x) and covered(t, x) >= 0.8 for x in items)]
    assert plain(at.select("doc_id", "text").collect()) == plain(rows)

    t, want = tokenizer(), []
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        want += [(i, k, a, min(2048, n - a)) for k, a in enumerate(range(0, n, 2048))]
    columns = ("doc_id", "piece", "start", "length")
    assert plain(stages["pack"](spark, at, sf).select(*columns).collect()) == plain(want)
    out = corpus_pipeline.run(spark, sf)
    assert plain(out.select(*columns).collect()) == plain(want)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert len(rows) < len(given_docs(spark, sf))


def shares(text, item):
    """Whether a text can cover 0.8 of an item: as many of its words occur there."""
    from test_others import plain_words

    have, own = set(plain_words(text)), plain_words(item)
    return bool(own) and sum(x in have for x in own) >= 0.8 * len(own)
