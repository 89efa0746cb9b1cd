"""Decontamination, packing, totals, fingerprints, languages, URLs, quality and the pipeline."""

import functools
import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import HARD, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import decontam, langid, packing, quality, spotsigs, tokens, urlfilter

TEXTS = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "short item", "one two three four five six seven eight nine ten"]


def items(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "item_id long, text string, coverage string")


def tiled(doc, item, least):
    """Words of item covered by greedy tiling, by search over all pairs of places."""
    in_doc, in_item, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in in_doc and i + n not in in_item:
                    n += 1
                best = max(best, (n, -d, -i))
        n, d, i = best[0], -best[1], -best[2]
        if n < least:
            return total
        in_doc.update(range(d, d + n))
        in_item.update(range(i, i + n))
        total += n


def test_decontamination(spark):
    halves = TEXTS[0].split()
    rows = [
        (1, f"Before. {TEXTS[0].upper()}! after"), (2, " ".join(halves[6:] + ["x"] + halves[:6])), (3, " ".join(halves[:8])), (4, "a short, item"), (5, "a short longer item"),
        (6, "one two three four five X six seven eight nine ten"), *[(i + 100 if i else None, t) for i, t in HARD],
    ]
    got = sorted((r.doc_id, r.item_id, r.n_tiles) for r in decontam.contaminated(docs(spark, rows), items(spark)).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (4, 1, 1), (6, 2, 2)]
    assert decontam.contaminated(docs(spark, []), items(spark)).count() == 0
    assert decontam.contaminated(docs(spark, HARD), items(spark, [None, "", "..."])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=3, max_size=25), st.lists(st.sampled_from("abc"), min_size=3, max_size=14))
def test_tiles_cover_as_a_full_search_does(doc, item):
    least = 3
    hits = [(d, i) for d in range(len(doc) - least + 1) for i in range(len(item) - least + 1) if doc[d : d + least] == item[i : i + least]]
    found = decontam.tiles(np.array([d for d, _ in hits], int), np.array([i for _, i in hits], int), least) if hits else []
    assert all(doc[d : d + n] == item[i : i + n] and n >= least for d, i, n in found)
    covered = [k for _, i, n in found for k in range(i, i + n)]
    assert len(covered) == len(set(covered))
    assert (max((n for _, _, n in found), default=0)) == max((n for d, i in hits for n in [_common(doc, item, d, i)]), default=0)


def _common(doc, item, d, i):
    n = 0
    while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n]:
        n += 1
    return n


def plain_words(text):
    return [x for x in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (text or "").lower()) if x]


def covered(doc, item, least=5):
    item, doc = plain_words(item), plain_words(doc)
    if not item:
        return 0.0
    return tiled(doc, item, min(least, len(item))) / len(item)


def test_decontamination_equals_a_full_search(spark, monkeypatch):
    """Reordered, cut, repeated and interleaved passages of items with and without a stem that all share; pieces of a few texts."""
    rng = np.random.default_rng(3)
    stem = [f"stem{k}" for k in range(10)]
    texts = [" ".join((stem if i % 2 else []) + [f"i{i}w{k}" for k in rng.integers(0, 60, rng.integers(6, 40))]) for i in range(12)] + ["short item", "short item", "a a a a a a a a"]
    rows = []
    for i, text in enumerate(texts):
        w = text.split()
        for part in (1.0, 0.85, 0.8, 0.78, 0.5):
            own, blocks, at = w[: int(np.ceil(part * len(w)))], [], 0
            while at < len(own):
                n = int(rng.integers(3, 12))
                blocks.append(own[at : at + n])
                at += n
            for k in rng.permutation(len(blocks)) if part < 1 else range(len(blocks)):
                blocks[k] = blocks[k] + ([f"x{rng.integers(99)}"] if rng.random() < 0.5 else [])
            order = rng.permutation(len(blocks))
            rows.append(" ".join(x for k in order for x in blocks[k]))
    rows += [" ".join(stem * 20), "a " * 300, " ".join(texts)]
    rows = list(enumerate(rows))
    monkeypatch.setattr(decontam, "pieces", functools.partial(decontam.pieces, most=400))
    got = {(r.doc_id, r.item_id): r.coverage for r in decontam.contaminated(docs(spark, rows), items(spark, texts)).collect()}
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(t, k)
    want = {(i, k): covered(t, x) for i, t in rows for x, k in first.items()}
    assert got == pytest.approx({p: c for p, c in want.items() if c >= 0.8})
    assert any(0.8 <= c < 1 for c in want.values()) and any(0.5 < c < 0.8 for c in want.values())
    assert {(r.class_id, r.item_id) for r in decontam.item_classes(items(spark, texts)).collect()} == {(first[t], k) for k, t in enumerate(texts)}


def test_a_stem_of_all_items_opens_no_pairs():
    texts = [" ".join([f"stem{k}" for k in range(10)] + [f"i{i}w{k}" for k in range(15)]) for i in range(3_000)]
    seeds = decontam.Seeds(pa.array(texts), 5, 0.8)
    lines = pa.array([" ".join(f"stem{k}" for k in range(10))] * 300 + [texts[7]])
    [(length, doc, item)] = seeds.pairs(decontam.plain(lines))
    assert (length, doc.tolist(), item.tolist()) == (5, [300], [7])


def test_decontamination_stage(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    leak = next(b.text for b in bench if b.text and len(b.text.split()) > 8)
    rows = docs(spark, [*HARD, (50, f"x {leak} y"), (50, "a clean text"), (None, f"{leak}"), (51, f"x {leak} y"), (51, f"x {leak} y")])
    kept = decontam.stage_decontaminate(spark, rows, sf)
    assert kept.columns == rows.columns
    key = lambda r: (r[0] or 0, r[1] or "", r[1] is None)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted([*HARD, (50, "a clean text")], key=key)
    assert decontam.stage_decontaminate(spark, docs(spark, []), sf).count() == 0


def test_decontamination_in_blocks(spark, sf, monkeypatch):
    given_docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontam.contaminated(given_docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    assert sorted(map(tuple, decontam.contaminated(given_docs, bench).collect())) == whole
    found = {d for d, *_ in whole}
    texts = {r.doc_id: r.text for r in given_docs.collect()}
    exact = {d for d, t in texts.items() for b in bench.collect() if t and b.text in t}
    assert exact <= found


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


ODD = [(30, "It's <|endoftext|> A<|startoftext|>B <|EndOfText|>"), (31, "x\u2003y\u00a0z E\u0301\u212b ΣΑΣ İ"), (32, "don't DON'T 123 4-5 émigré…the 日本語"), (33, "word " * 5000)]


def test_pieces_hold_the_tokenizers_ids(spark):
    rows = [*HARD, *ODD]
    t = tokenizer()
    want = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want.append((i or 0, k, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    out = packing.pack(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    filled = {}
    for r in out:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(4, 40), st.data())
def test_plan_places_every_piece_once(capacity, data):
    counts = np.array([0, *data.draw(st.lists(st.integers(0, 30), min_size=capacity, max_size=capacity))])
    places, n = packing.plan(counts)
    filled, met = {}, np.zeros(capacity + 1, int)
    for length, first, k, sequence, offset in sorted(places):
        assert first == met[length]
        more = [p[1] for p in places if p[0] == length and p[1] > first]
        total = (min(more) if more else counts[length]) - first
        met[length] += total
        for j in range(total):
            filled.setdefault(sequence + j // k, []).append((offset + j % k * length, length))
    assert (met == counts).all() and len(filled) == n and set(filled) == set(range(n))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert n >= -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)


@settings(max_examples=25, deadline=None)
@given(st.integers(6, 30), st.integers(0, 10**6))
def test_repeat_counts_fit_the_histogram(capacity, seed):
    """As good a fit as projected gradient steps find that go on until nothing moves."""
    rng = np.random.default_rng(seed)
    counts = np.append(0, rng.integers(0, 60, capacity)) * (rng.random(capacity + 1) < 0.7)
    chosen = packing.patterns(counts)
    x = packing.fitted(counts, chosen)
    assert (x >= 0).all() and len(x) == len(chosen)
    if not chosen:
        return
    use = np.array([[p.count(n) for n in range(capacity + 1)] for p in chosen], float)
    best, step = np.zeros(len(chosen)), 1 / np.linalg.norm(use @ use.T, 2)
    for _ in range(4_000):
        best = np.maximum(best - step * (use @ (best @ use - counts)), 0)
    loss = lambda x: float(((x @ use - counts) ** 2).sum())
    assert loss(x) <= 1.02 * loss(best) + 2.0 * len(chosen)


def test_given_documents_fill_their_sequences(spark, sf):
    out = packing.op7_packing(spark, sf).agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert out[0] <= -(-out[1] // 2048) * 1.01 + 1


def test_rollup_by_deltas(spark, tmp_path):
    changes = "source string, lang string, tokenizer string, sign int, n_tokens long"
    r = tokens.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    first = spark.createDataFrame([("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, 5), (None, None, "v1", 1, None), ("b", "de", "v1", 1, 7)], changes)
    assert r.commit("b1", first) and not r.commit("b1", first)
    revised = spark.createDataFrame([("a", "en", "v1", -1, 5), ("a", "en", "v2", 1, 6), ("b", "de", "v1", -1, 7), ("c", "fr", "v1", None, 3)], changes)
    assert r.commit("b2", revised) and not r.commit("b1", first)
    again = tokens.Rollup(spark, str(tmp_path / "r"))
    assert not again.commit("b2", revised) and again.commit("empty", first.where("false"))
    assert sorted(map(tuple, again.totals().fillna("?").collect())) == [("?", "?", "v1", 1, 0), ("a", "en", "v1", 1, 10), ("a", "en", "v2", 1, 6)]
    (tmp_path / "r" / "_staged" / "x" / "totals").mkdir(parents=True)  # a version that was not finished
    assert again.history() == [(1, "b1"), (2, "b2"), (3, "empty")]
    with pytest.raises(ValueError, match="batch id"):
        again.commit("a/b", first)


def test_two_writers_lose_no_update(spark, tmp_path, monkeypatch):
    changes = "source string, lang string, tokenizer string, sign int, n_tokens long"
    one = lambda source, n: spark.createDataFrame([(source, "en", "v1", 1, n)], changes)
    mine, other = (tokens.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    rename, calls = tokens.rename_folder, []

    def late(*a):  # another writer commits between this one's reading and its rename, twice, and one of them the same batch
        calls.append(a)
        if len(calls) in (1, 3):
            assert other.commit(f"other{len(calls)}", one("b", 1))
        return rename(*a)

    monkeypatch.setattr(tokens, "rename_folder", late)
    assert mine.commit("mine", one("a", 10))
    assert mine.history() == [(1, "other1"), (2, "other3"), (3, "mine")]
    assert sorted((r.source, r.n_docs, r.n_tokens) for r in other.totals().collect()) == [("a", 1, 10), ("b", 2, 2)]
    monkeypatch.setattr(tokens, "rename_folder", rename)
    assert not other.commit("mine", one("a", 10))
    for k in range(5):
        assert other.commit(f"more{k}", one("c", 1))
    assert len(list((tmp_path / "r").glob("v*"))) == tokens.Rollup.KEPT and not list((tmp_path / "r" / "_staged").glob("*"))
    assert len(mine.history()) == 8 and not mine.commit("other1", one("b", 1))
    monkeypatch.setattr(tokens, "rename_folder", lambda *a: False)
    with pytest.raises(RuntimeError, match="other writers"):
        mine.commit("never", one("a", 1))


def test_rollup_query_equals_recount(spark, sf):
    t, want = tokenizer(), {}
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if labels.get(r.doc_id) == 1:
            continue
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        key = (r.source, r.lang, "word_bpe_49k/2" if r.doc_id in labels else "word_bpe_49k/1")
        d, k = want.get(key, (0, 0))
        want[key] = d + 1, k + n + (r.doc_id in labels)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in tokens.op10_token_rollup(spark, sf).collect()}
    assert got == want


def spot_words(text):
    w = [x for x in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (text or "").lower()) if x]
    return [x for y in w for x in re.split(r"(?=[\u3000-\u9fff\uf000-\U0003ffff])", y) if x]


@functools.cache
def spot_hash(word):
    return int(spotsigs.spot_words(pa.array([word])).hash[0])


def spot_counts(texts):
    """In how many texts a word of each bucket occurs."""
    return Counter(b for t in texts for b in {spot_hash(x) >> 48 for x in spot_words(t)})


def spot_set(text, counts, chain=3):
    w = spot_words(text)
    h = [spot_hash(x) for x in w]
    rank = [(float("inf"), 0) if x in spotsigs.ANCHORS else (counts[y >> 48], y & 0xFFFFFF) for x, y in zip(w, h)]
    anchors = {k for k, x in enumerate(w) if x in spotsigs.ANCHORS}
    for k in range(len(w) - 7):
        anchors |= {j for j in range(k, k + 8) if rank[j] == max(rank[k : k + 8])}
    content = [k for k, x in enumerate(w) if x not in spotsigs.COMMON and k not in anchors]
    out = {("", *w[:chain])} if w else set()
    for k in anchors:
        if len(after := [w[j] for j in content if j >= k][:chain]) == chain:
            out.add((w[k], *after))
    return out


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_spots(rows, got):
    key = lambda r: (r[0] is None, -(r[0] or 0))
    rows = sorted(rows, key=key)
    assert len({i for i, _ in rows}) == len(rows)
    counts = spot_counts(t for _, t in rows)
    for (i, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]]):
        t, nxt, r = t or "", nxt or "", got[i]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (spot_set(x, counts) for x in (t, edited, nxt))
        assert len(r.fingerprint) == 8 * len(a) and len(r.edited_fingerprint) == 8 * len(b)
        assert r.near_edited == pytest.approx(alike(a, b)) and r.near_next == pytest.approx(alike(a, c))


def test_spots(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_spots(rows, {r.doc_id: r for r in spotsigs.op8_spotsigs(spark, sf).collect()})
    hard = [r for k, r in enumerate(HARD) if r[0] not in [x for x, _ in HARD[:k]]]
    check_spots(hard, {r.doc_id: r for r in spotsigs.fingerprints(docs(spark, hard)).collect()})
    assert spotsigs.fingerprints(docs(spark, HARD)).count() == len(HARD)
    assert spotsigs.fingerprints(docs(spark, [])).count() == 0
    one = spotsigs.fingerprints(docs(spark, [(5, "the end of it all")])).first()
    assert one.near_next == 1.0


def test_spot_order_in_many_parts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    got = spotsigs.in_order(rows, parts=17)
    assert got.where("tail").count() == got.select("part").distinct().count() and got.where("not tail").count() == rows.count()


def test_spot_order_of_rows_of_one_id(spark):
    """Rows that share an id, or have none, are many parts, and each is followed by the next of the one order."""
    rows = [(None, f"none {k}") for k in range(300)] + [(7, f"seven {k}") for k in range(300)] + [(9, "nine")]
    placed = spotsigs.in_order(docs(spark, rows), parts=12)
    sizes = [r["count"] for r in placed.where("not tail").groupBy("part").count().collect()]
    assert len(sizes) == 12 and sum(sizes) == len(rows) and max(sizes) < 150
    got = placed.orderBy("part", "tail").collect()
    order = [r.text for r in placed.where("not tail").selectExpr("*", "xxhash64(text) as h").orderBy("part", F.desc_nulls_last("doc_id"), "h").collect()]
    assert order[0] == "nine" and {t.split()[0] for t in order[1:301]} == {"seven"}
    first = {p: next(r.text for r in spotsigs.in_order(docs(spark, rows), parts=12).where(f"part = {p} and not tail").orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()) for p in (0, 5, 11)}
    tails = {r.part: r.text for r in got if r.tail}
    assert tails[11] == first[0] and tails[4] == first[5] and tails[10] == first[11] and len(tails) == 12


def test_spots_in_five_scripts(spark):
    """Texts of 100 words in languages without listed anchors have several signatures, also where words are not parted by blanks."""
    rng = random.Random(5)
    common = {"sv": "och att som på av för", "ru": "и в не на что с", "zh": "的 是 了 在 不 我", "el": "και το να της με στο", "hi": "और के में है की से"}
    letters = {"sv": "abcdefåäö", "ru": "абвгдежз", "zh": "一丁七万丈三上下丑且世丘丙业东丝两严", "el": "αβγδεζηθ", "hi": "कखगघचछजझ"}
    rows, lang = [], {}
    for k, name in enumerate(list(common) * 6):
        blank = "" if name == "zh" else " "
        own = ["".join(rng.choices(letters[name], k=1 if name == "zh" else 6)) for _ in range(100)]
        rows.append((k, blank.join(rng.choice(common[name].split()) if j % 4 == 0 else x for j, x in enumerate(own))))
        lang[k] = name
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs(spark, rows)).collect()}
    check_spots(rows, got)
    assert all(len(r.fingerprint) >= 8 * 8 for r in got.values())
    low = [(lang[i], r.near_edited, r.near_next, len(r.fingerprint) // 8) for i, r in got.items() if r.near_edited <= max(r.near_next, 0.2)]
    assert not low


@pytest.mark.parametrize("side", [2_048, 3])
@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_spot_classes(spark, sf, monkeypatch, side, threshold):
    monkeypatch.setattr(spotsigs, "SIDE", side)
    if side == 3:
        monkeypatch.setattr(spotsigs, "LEAST_FREQUENT", 5)
    template = " ".join(f"the word{k} item{k} thing{k} part{k}" for k in range(12))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(5_000 + i, f"{template} the own{i} kind{i} sort{i}" + (f" an extra{i} word{i} more{i}" if i % 3 else "")) for i in range(40)] + [(6_000 + i, f"{template} the own1 kind1 sort1") for i in range(5)]
    rows += [(7_000, None), (7_001, ""), (None, "a row without an id"), (None, f"{template} the own2 kind2 sort2")]
    counts = spot_counts(t for _, t in rows)
    own = [spot_set(t, counts) for _, t in rows]
    members = {}
    for (i, _), s in zip(rows, own):
        members.setdefault(frozenset(s), []).append(i)
    links = {s: sum(t != s and bool(s) and bool(t) and alike(s, t) >= threshold for t in members) for s in members}
    smallest = lambda ids: min((i for i in ids if i is not None), default=None)
    want = sorted(((i or -1, smallest(members[frozenset(s)]) or -1, len(members[frozenset(s)]), links[frozenset(s)]) for (i, _), s in zip(rows, own)))
    got = spotsigs.near_classes(spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string"), threshold).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_docs, r.n_links) for r in got) == want
    assert max(links.values()) >= 30
    assert spotsigs.near_classes(docs(spark, [])).count() == 0


def test_spot_sets_of_long_near_copies_move_once(spark):
    def shuffled():
        spark.range(10).repartition(2).count()
        time.sleep(1)  # the status store is written with some delay
        return sum(e.totalShuffleWrite() for e in (store.apply(k) for store in [spark.sparkContext._jsc.sc().statusStore().executorList(False)] for k in range(store.size())))

    parts = [f"the thing{k} sort{k} kind{k}" for k in range(2_000)]
    texts = [" ".join([*parts[:50 * i], f"the own{i} word{i} part{i}", *parts[50 * i :]]) for i in range(30)]
    before = shuffled()
    got = spotsigs.near_classes(docs(spark, list(enumerate(texts)))).collect()
    assert {r.n_links for r in got} == {29} and len(got) == 30
    assert shuffled() - before < 3 * sum(map(len, texts))


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_spot_sketches_lose_no_near_pair(threshold):
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 40, 300, 3_000):
        a = [np.unique(rng.integers(0, 2**32, size, np.uint64)) for _ in range(20)]
        b = [np.concatenate([x[: int(np.ceil(2 * threshold / (1 + threshold) * len(x)))], rng.integers(2**31, 2**32, len(x) - int(np.ceil(2 * threshold / (1 + threshold) * len(x))), np.uint64)]) for x in a]
        sets = [np.unique(x) for pair in zip(a, b) for x in pair]
        n = np.array([len(x) for x in sets])
        sketch = spotsigs._sketch(np.concatenate(sets), np.append(0, np.cumsum(n)))
        none = np.zeros(len(sets), np.int32)
        found = {(i, j) for x, y in spotsigs._meetings(none.astype(np.int64), none, none, n, sketch, threshold) for i, j in zip(x.tolist(), y.tolist())}
        near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(np.intersect1d(sets[i], sets[j])) >= threshold * len(np.union1d(sets[i], sets[j]))}
        assert near <= found and len(near) >= 20


def test_languages(spark, sf):
    got = langid.op3_langid(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def plain_trigrams(text):
    """Hashed trigrams of the lower-cased bytes, everything in ASCII but letters being one space, with a space at both ends."""
    folded = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").lower().encode())
    spaced = re.sub(rb" +", b" ", b" " + folded + b" ")
    out = {}
    for k in range(len(spaced) - 2):
        a, b, c = spaced[k : k + 3]
        if b != 32 or (a != 32 and c != 32):
            code = ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20
            out[code] = out.get(code, 0) + 1
    return out


def test_languages_equal_a_plain_nearest_centroid(spark, sf):
    """IDF and cosines written out, for the given documents and hard rows, against the model's own centroids."""
    from math import log, sqrt

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    taught = [(i, t, y) for i, t, y in rows if y is not None and t]
    model = langid.fit(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    grams = {t: plain_trigrams(t) for _, t, _ in [*rows, *((i, t, None) for i, t in HARD)]}
    df = {}
    for _, t, _ in taught:
        for g in grams[t]:
            df[g] = df.get(g, 0) + 1
    idf = [log((1 + len(taught)) / (1 + df.get(g, 0))) + 1 for g in range(langid.DIMS)]
    assert model.idf == pytest.approx(idf)
    assert len(model.langs) <= 4 * len({y for _, _, y in taught}) and np.linalg.norm(model.centroids, axis=1) == pytest.approx(1, abs=1e-4)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(docs(spark, [(i, t) for i, t, _ in rows] + HARD), model, ["doc_id", "text"]).collect()}
    for (_, t), (lang, score) in got.items():
        x = {g: (1 + log(n)) * idf[g] for g, n in grams[t].items()}
        norm = sqrt(sum(v * v for v in x.values())) or 1
        cos = [sum(v * c[g] for g, v in x.items()) / norm for c in model.centroids.tolist()]
        if not any(c.isalpha() for c in t or ""):
            assert (lang, score) == ("und", 0.0)
        else:
            assert score == pytest.approx(max(0, min(1, max(cos))), abs=1e-4) and cos[model.langs.index(lang)] >= -1 and max(c for c, y in zip(cos, model.langs) if y == lang) >= max(cos) - 1e-4


def test_languages_hard_rows(spark, sf):
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = langid.predict(docs(spark, HARD), model, ["doc_id", "text"], least=0.3).collect()
    for r in rows:
        none = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == none and (r.score == 0 or not none)
    empty = langid.fit(docs(spark, []))
    assert {r.lang_pred for r in langid.predict(docs(spark, HARD), empty, ["doc_id"]).collect()} == {"und"}
    again = langid.fit(spark.read.parquet(f"{sf}/documents.parquet").repartition(7))
    assert again.langs == model.langs and np.allclose(again.centroids, model.centroids, atol=1e-4)


URLS = [
    "http://a.example.com/en/1", "https://WWW.Example.com/en/2?q=/es/", "http://www.example.com/en/3", "http://x.net/es/", "http://x.net/es", "http://net/fr/x", "http://internet/es/1", "example.com/en/1",
    None, "", "http://", "ftp://com", "http://b.com#/x", "mailto:x://y.com/z://w.net/es/", "http://example.com:80/en/", "http://x.org/" + "a" * 5000 + "?a=1&b=2",
]


def judge(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urlfilter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best and best[1], best and best[0]


def test_urls(spark):
    urls = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    teach = spark.createDataFrame([(f"http://good{i}.org/a/{i}", 0) for i in range(60)] + [(f"http://spam-{i}.info/x?a={i}&b=2&c=3", 1) for i in range(60)] + [(None, 1), ("http://z.org", None)], "url string, label int")
    got = {r.page_id: r for r in urlfilter.judged(urls, teach, urlfilter.RULES).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = judge(u)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or got[i].method_verdict)
        assert got[i].method_verdict == ("block" if got[i].p_block >= 0.5 else "allow")
    new = spark.createDataFrame([(1, "http://spam-x.info/x?a=9&b=2&c=3"), (2, "http://goodx.org/a/9")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urlfilter.judged(new, teach).collect()} == {1: "block", 2: "allow"}
    for some in (teach.where("false"), teach.where("label = 0")):
        assert {r.method_verdict for r in urlfilter.judged(urls, some).collect()} == {"allow"}
    assert urlfilter.judged(urls.where("false"), teach).count() == 0


def test_labels_that_say_nothing_block_next_to_nothing(spark):
    """Trees score every url all the same; what they have not learned does not show, because a fold they do not know calibrates them."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    report, seeing = {}, {}
    for salt in range(3):
        shuffled = pages.select("url", (F.pmod(F.xxhash64("url", F.lit(100 + salt)), F.lit(4)) == 0).cast("int").alias("label"))
        out = urlfilter.judged(pages, shuffled, report=report)
        assert out.select("p_block").distinct().count() > 20 and report["loss"] <= report["prior_loss"] + 0.01, report
        assert out.where("method_verdict = 'block'").count() <= 0.02 * pages.count()
        assert abs(out.agg(F.avg("p_block")).first()[0] - shuffled.agg(F.avg("label")).first()[0]) < 0.1
    telling = pages.select("url", F.col("url").contains("?").cast("int").alias("label"))
    out = urlfilter.judged(pages, telling, report=seeing)
    assert seeing["auc"] > 0.95 and seeing["loss"] < 0.5 * seeing["prior_loss"]
    assert out.join(pages, "page_id").where("(method_verdict = 'block') <> contains(url, '?')").count() <= 0.05 * pages.count()


def test_given_pages_are_scored_by_calibrated_trees(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        pages, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "labels"))
        report = {}
        out = urlfilter.judged(pages, urlfilter.labelled_urls(pages, labels), urlfilter.RULES, report=report)
        p = out.agg(F.countDistinct("p_block"), F.min("p_block"), F.max("p_block")).first()
        assert p[0] > 20 and 0 < p[1] < p[2] < 1 and report["loss"] <= report["prior_loss"] + 0.005, (p, report)


def test_url_statistics_are_counts(spark):
    """How many urls have a suffix, and shares of blocked ones, in all and without each fold."""
    rows = [(f"https://h{i % 3}.{'ab'[i % 2]}.com/{i}", i % 4 == 0) for i in range(40)]
    df = spark.createDataFrame([(i, u, f"{'ab'[i % 2]}.com", i % urlfilter.FOLDS, float(y)) for i, (u, y) in enumerate(rows)], "i long, url string, _suffix string, fold int, label double")
    got = {r._suffix: r for r in urlfilter._statistics(df, df.where("i < 30"), "suffix", 0.25).collect()}
    for key in ("a.com", "b.com"):
        own = [(i, y) for i, (u, y) in enumerate(rows) if f".{key}/" in u]
        share = lambda some: (sum(y for _, y in some) + 5) / (len(some) + 20)
        taught = [x for x in own if x[0] < 30]
        assert got[key].suffix_count == pytest.approx(np.log1p(len(own)))
        assert got[key].suffix_apart == pytest.approx([share([x for x in taught if x[0] % urlfilter.FOLDS != k]) for k in range(urlfilter.FOLDS)])


def plain_features(url):
    from math import log2

    u = url or ""
    host, path, *_ = judge(url)
    query = re.search(r"\?([^#]*)", u)
    query = query[1] if query else ""
    shares = [u.count(c) / len(u) for c in set(u)]
    digits = sum("0" <= c <= "9" for c in u)
    return {
        "url_len": len(u), "host_len": len(host), "path_len": len(path), "query_len": len(query), "depth": path.rstrip("/").count("/"), "labels": host.count(".") + 1 if host else 0, "digits": digits,
        "digit_ratio": digits / len(u) if u else 0, "hyphens": host.count("-"), "entropy": -sum(p * log2(p) for p in shares), "params": query.count("&") + 1 if query else 0,
        "has_fragment": "#" in u, "secure": u.startswith("https:"),
    }


def test_url_features(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    host, path = urlfilter.parts(F.col("url"))
    for r in urlfilter.lexical(rows.withColumns({"host": host, "path": path})).collect():
        want = plain_features(r.url)
        assert {k: r[k] for k in want} == pytest.approx({k: float(v) for k, v in want.items()}), r.url


def test_url_query(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = urlfilter.op2_urlfilter(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = judge(pages[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or r.method_verdict)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    labels = quality.good_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    taught = labels.where("doc_id % 4 <> 0")
    out = quality.scored(rows, taught)
    assert out.count() == rows.count()
    seen = out.join(labels.where("doc_id % 4 = 0 and label is not null"), "doc_id").groupBy("label").agg(F.avg(F.col("good").cast("int")).alias("kept")).collect()
    kept = {r.label: r.kept for r in seen}
    assert kept[1] >= 0.9 and kept[0] <= 0.5


def test_quality_hard_rows(spark):
    rows = docs(spark, HARD + [(100 + i, f"good words here number {i}") for i in range(30)] + [(200 + i, f"### ||| junk $$$ {i}") for i in range(30)])
    label = spark.createDataFrame([(100 + i, 1) for i in range(20)] + [(200 + i, 0) for i in range(20)] + [(None, 1), (100, None)], "doc_id long, label int")
    out = quality.scored(rows, label)
    assert out.count() == rows.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert out.where("doc_id between 220 and 229 and not good").count() == 10 and out.where("doc_id between 120 and 129 and good").count() == 10
    assert "component_id" in out.columns and out.columns.count("score") == 1
    for some in (label.where("false"), label.where("label = 1")):
        assert {r.good for r in quality.scored(rows, some).collect()} == {True}
    assert quality.scored(docs(spark, []), label).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    rows = spark.read.parquet(f"{sf}/documents.parquet")
    at, ids = rows, {r.doc_id for r in rows.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        if name != "pack":
            assert at.columns == rows.columns
        now = {r.doc_id for r in at.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
    assert corpus_pipeline.run(spark, sf).count() == at.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_quality_learns_from_all_unlabelled(spark):
    """More unlabelled documents than a fixed pool would hold: every one is judged by the views in each round."""
    n, report = 12_000, []
    rows = spark.range(n).selectExpr("id as doc_id", "concat(if(id % 2 = 0, 'fine words here ', 'junk ### buy '), id) as text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    labels = spark.range(60).selectExpr("id as doc_id", "cast(if(id % 2 = 0, 1, 0) as int) as label")
    out = quality.scored(rows, labels, report=report)
    assert [r["judged"] for r in report] == [n - 60] * quality.ROUNDS
    assert out.where("good <> (doc_id % 2 = 0)").count() == 0


def test_views_teach_each_other(spark):
    """What a view alone can't know from the labelled documents it learns from the other's pseudo-labels."""
    rows = [(i, f"{'fine words' if i % 2 else 'junk ### buy'} {i}", "en", "good site" if i % 2 else "bad site", 20) for i in range(600)]
    rows += [(i, f"{'novel prose' if i % 2 else 'fresh spam'} {i}", "en", "good site" if i % 2 else "bad site", 20) for i in range(600, 1000)]  # words without a label
    rows += [(i, f"{'fine words' if i % 2 else 'junk ### buy'} {i}", "en", "new good" if i % 2 else "new bad", 20) for i in range(1000, 2600)]  # sources without a label
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, label int")
    report = []
    model = quality.fit(docs_, labels, report=report)
    assert report[0]["meta_sure"] >= 400 and report[-1]["text_sure"] >= 400 and all(r["judged"] == 2000 for r in report), report
    assert report[0]["text_kept"] and report[0]["meta_kept"], report
    out = quality.scored(docs_, labels).collect()
    assert all(r.good == (r.doc_id % 2 == 1) for r in out)
    untaught = quality.fit(docs_, labels, rounds=0)
    key = lambda s: docs_.where(F.col("source") == s).limit(1).select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("n_chars").alias("_n")).select(quality._record()).first()[0][0]
    for source, sign in (("new good", 1), ("new bad", -1)):
        assert untaught.meta.weights[key(source)] == 0 and sign * model.meta.weights[key(source)] > 1
    said = lambda m, text: m.scores(pa.array([text]), pa.array([[0]], pa.list_(pa.int32())))[1][0]
    learned = [said(m, "novel prose 1234") - said(m, "fresh spam 1234") for m in (model, untaught)]
    assert learned[0] > 0.3 and abs(learned[1]) < 0.1, learned


def test_given_views_both_teach(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        report = []
        quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), quality.good_labels(spark.read.parquet(f"{sf}/labels.parquet")), report=report)
        n = report[0]["judged"]
        assert all(0.02 * n <= r[view] <= 0.6 * n for r in report for view in ("text_sure", "meta_sure")), report


def test_surest_documents_are_handed_over():
    """As many as the share in the labels' proportion, a group of equals whole, none on the wrong side."""
    counts = np.zeros(quality.BINS)
    place = lambda z: int(quality.bins(np.array([z]))[0])
    for z in np.linspace(-5, 5, 1001):
        counts[place(z)] += 1
    view = quality.View(np.zeros(1), 0.0)
    got = quality.surest(view, counts, n_bad=1, n_good=3, base=0.0)
    n = quality.HANDED * counts.sum()
    assert counts[: got.bad + 1].sum() == pytest.approx(n / 4, abs=2) and counts[got.good :].sum() == pytest.approx(3 * n / 4, abs=2)
    few = np.zeros(quality.BINS)
    few[place(-1.0)], few[place(0.5)] = 60, 40
    got = quality.surest(view, few, 1, 1, 0.0)
    assert (got.bad, got.good) == (place(-1.0), place(0.5))
    for only in (1.0, -1.0, 0.0):
        few = np.zeros(quality.BINS)
        few[place(only)] = 100
        got = quality.surest(view, few, 1, 1, 0.0)
        assert got.bad < 0 or got.good >= quality.BINS


def auc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    return float(np.mean([(score[y == 1] > s).mean() + (score[y == 1] == s).mean() / 2 for s in score[y == 0]]))


def test_combined_is_no_worse_than_either_view(spark):
    sf = "/root/testdata/sf0.01"
    rows, labels = spark.read.parquet(f"{sf}/documents.parquet"), quality.good_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    got = {c: 0.0 for c in ("score", "p_text", "p_meta")}
    for k in range(5):
        out = quality.scored(rows, labels.where(f"doc_id % 5 <> {k}")).join(labels.where(f"doc_id % 5 = {k} and label is not null"), "doc_id").select("label", *got).collect()
        got = {c: got[c] + auc([r[c] for r in out], [r.label for r in out]) / 5 for c in got}
    assert got["score"] >= 0.92 and got["score"] >= max(got["p_text"], got["p_meta"]) - 0.005, got


def test_quality_of_one_text_longer_than_a_piece(spark, monkeypatch):
    rows = docs(spark, HARD + [(100 + i, f"good words here number {i}") for i in range(30)] + [(200 + i, f"### ||| junk $$$ {i}") for i in range(30)])
    label = spark.createDataFrame([(100 + i, 1) for i in range(20)] + [(200 + i, 0) for i in range(20)], "doc_id long, label int")
    model = quality.fit(rows, label)
    texts, record = [t for _, t in HARD], [[1, 2]] * len(HARD)
    whole = model.scores(pa.array(texts, pa.string()), pa.array(record, pa.list_(pa.int32())))
    for i, t in enumerate(texts):
        one = model.scores(pa.array([t], pa.string()), pa.array([[1, 2]], pa.list_(pa.int32())))
        assert [x[0] for x in one] == pytest.approx([x[i] for x in whole])
