"""SimHash, substring and line dedup against plain versions."""

import functools
import hashlib

import numpy as np
import pytest
from helpers import HARD, docs, grouped, line_dedup, simhash, substring
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyforge.llm import simhash as S
from tallyforge.llm.common import components, hash_ranges, sliding, windows, words
from tallyforge.llm.linededup import deduplicated, op4_line_dedup, stage_line_dedup
from tallyforge.llm.substring import substring_dedup

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def given_docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_words_and_windows():
    import pyarrow as pa

    w = words(pa.array(["a bb", None, "", "a  bb\n" + "x" * 40, "x" * 40 + "y"]))
    assert np.diff(w.first).tolist() == [2, 0, 0, 3, 1]
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and w.hash[4] != w.hash[5]
    h = windows(np.array([1, 2, 1, 2, 1], np.uint64), 2)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    a = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 5, 8, 27, 50):
        assert sliding(a, width, np.minimum).tolist() == [a[i : i + width].min() for i in range(50 - width + 1)]
    assert len(hash_ranges(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0


def test_simhash_of_given_documents(spark, sf):
    rows = given_docs(spark, sf)
    fps = {i: simhash(t, 4) for i, t in rows}
    of = grouped(fps, 4)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.op5_simhash(spark, sf).collect()}
    assert got == {(i, f"{fps[i]:016x}", of[i]) for i in fps}


def test_simhash_hard_rows(spark):
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in S.near_duplicates(docs(spark, HARD)).collect())
    fps = {i: simhash(t, 4) for i, t in HARD if i is not None}
    of = grouped(fps, 4)
    same = {fps[i]: of[i] for i in fps}
    assert got == sorted((i or 0, f"{simhash(t, 4):016x}", same.get(simhash(t, 4))) for i, t in HARD)
    assert S.near_duplicates(docs(spark, [])).count() == 0


@SLOW
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.integers(0, 2**32), st.integers(2, 9))
def test_links_are_whole(spark, base, seed, side):
    """Planted neighbours at 1 to 6 bits, with squares so small that choices of blocks are dealt out."""
    rng = np.random.default_rng(seed)
    fps = set(base)
    for b in base:
        for _ in range(6):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 7), replace=False)))
    fps = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in fps.items()], "id long, fp long")
    before, S.SQUARE = S.SQUARE, side
    try:
        got = {r.node: r.component for r in components(S.links(nodes)).collect()}
    finally:
        S.SQUARE = before
    assert {i: got.get(i, i) for i in fps} == grouped(fps, 4)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(21), 0) | dict.fromkeys(range(100, 140), 100) | {200: 200, 201: 200}


def test_stage_keeps_one_of_each_group(spark, sf):
    rows = docs(spark, HARD)
    kept = S.stage_near_dedup(spark, rows, sf)
    assert kept.columns == rows.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 6 in ids and 7 not in ids and 4 in ids and 1 in ids and 2 not in ids


@pytest.mark.parametrize("size", [35, 6, 3])
def test_substring_of_given_documents(spark, sf, size):
    rows = given_docs(spark, sf)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.read.parquet(f"{sf}/documents.parquet"), size).collect()}
    assert got == dict(zip([i for i, _ in rows], substring(rows, size)))


def test_substring_hard_rows(spark):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs(spark, HARD)).collect())
    assert got == sorted((i or 0, *x) for (i, _), x in zip(HARD, substring(HARD, 35)))
    assert substring_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("size", [35, 6])
def test_substring_with_frequent_passages_in_small_pieces(spark, sf, monkeypatch, size):
    """Pieces of a few texts, reducers that settle often, and nearly every repeated window a frequent one; a text is longer than a piece."""
    from tallyforge.llm import common, substring as M

    for name, value in (("pieces", functools.partial(common.pieces, most=3_000)), ("HELD_WINDOWS", 50), ("SHARE", 0.0), ("LEAST_WINDOWS", 2), ("LEAST_PIECES", 1)):
        monkeypatch.setattr(M, name, value)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = given_docs(spark, sf)[:120]
    rows += [(10_000 + i, f"before {i} {passage} after {i} " + " ".join(f"own{i}x{k}" for k in range(30))) for i in range(60)]
    rows += [(20_000 + i, f"{passage[:90]} " + " ".join(f"pair{i // 2}x{k}" for k in range(50))) for i in range(40)]
    rows += [(30_000, " ".join(f"long{k % 700}" for k in range(2_000)))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs(spark, rows).repartition(7), size).collect()}
    assert got == dict(zip([i for i, _ in rows], substring(rows, size)))


@SLOW
@given(st.lists(st.text("ab \n", max_size=60), min_size=1, max_size=6), st.integers(2, 12))
def test_substring_of_few_words(spark, texts, size):
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs(spark, rows), size).collect()}
    assert got == dict(zip(range(len(rows)), substring(rows, size)))


def test_lines_of_given_documents(spark, sf):
    rows = given_docs(spark, sf)
    want = line_dedup(rows, 2)
    got = {r.doc_id: r.kept_sha256 for r in op4_line_dedup(spark, sf).collect()}
    assert got == {i: hashlib.sha256((want[i, t] or "").encode()).hexdigest() for i, t in rows}


@pytest.mark.parametrize("run", [1, 2, 4])
def test_lines_hard_rows(spark, run):
    rows = [*HARD, (20, "x\n\nline number 3 of the long document goes on and on\n  line number 4 of the long document goes on and on  \ny"), (21, "a\na\na\na\na\nb")]
    shared = "p\nq\nr\ns"
    rows += [(22, f"{shared}\nx1"), (22, f"{shared}\nx2"), (None, f"{shared}\ny1"), (None, f"{shared}\ny2"), (None, f"{shared}\ny2")]  # texts under one id, and without one
    want = line_dedup(rows, run)
    assert sum(shared in (want[i, t] or "") for i, t in {(i, t) for i, t in rows}) == 1
    got = deduplicated(docs(spark, rows), run).collect()
    key = lambda x: (x[0] or 0, x[1] or "", x[1] is None)
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((i, want[i, t]) for i, t in rows), key=key)
    assert all(r.score == 0.5 and r.component_id == "x" for r in got)
    assert deduplicated(docs(spark, [])).count() == 0


@pytest.mark.parametrize("run", [2, 4, 7])
def test_lines_leave_at_the_density_of_winnowing(spark, monkeypatch, run):
    from tallyforge.llm import linededup as L

    rng, tables, keep = np.random.default_rng(8), [], L.written
    monkeypatch.setattr(L, "written", lambda df: tables.append(keep(df)) or tables[-1])
    body = [f"line {k}" for k in rng.integers(0, 10**9, 4_000)]
    rows = [(i, "\n".join(body[i * 200 : i * 200 + 200])) for i in range(20)] + [(99, "\n".join(["own start", *body[930:960], "own end"]))]
    got = {r.doc_id: r.text for r in deduplicated(docs(spark, rows), run).collect()}
    want = line_dedup(rows, run)
    assert got == {i: want[i, t] for i, t in rows} and got[99] == "own start\nown end"
    n_lines = sum(t.count("\n") + 1 for _, t in rows)
    assert tables[0].count() <= 1.15 * n_lines * 2 / (run + 1)
    assert tables[1].count() <= 200  # only what meets goes on


def test_substring_of_a_row_that_is_there_very_often(spark):
    """Ranges of equal rows are one set: work and results grow with the copies, not with their square."""
    import time

    text = " ".join(f"w{k}" for k in range(60))
    took = []
    for n in (500, 8_000):
        rows = spark.range(n).selectExpr("cast(null as long) as doc_id", f"'{text}' as text").repartition(4)
        began = time.monotonic()
        got = substring_dedup(rows).groupBy("n_words", "n_removed").count().collect()
        took.append(time.monotonic() - began)
        assert [tuple(r) for r in got] == [(60, 60, n)]
    assert took[1] < 8 * max(took[0], 2)


@SLOW
@given(st.lists(st.lists(st.sampled_from("abcd "), max_size=14), min_size=1, max_size=5), st.integers(1, 4))
def test_lines_of_few_letters(spark, texts, run):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    want = line_dedup(rows, run)
    assert {r.doc_id: r.text for r in deduplicated(docs(spark, rows), run).collect()} == {i: want[i, t] for i, t in rows}


def test_line_stage_keeps_rows_and_columns(spark, sf):
    rows = docs(spark, HARD)
    out = stage_line_dedup(spark, rows, sf)
    assert out.columns == rows.columns and out.count() == len(HARD)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in out.collect())


def test_similar_documents_of_given_ones(spark):
    """Pairs at 0.85 or more are together; whoever is in a group has a member that is at least half like it."""
    sf = "/root/testdata/sf0.01"
    from helpers import words as split

    rows = given_docs(spark, sf)
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in split(t)]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    where, both = {}, {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for own in where.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    like = {(a, b): n / len(sets[a] | sets[b]) for (a, b), n in both.items()}
    got = {r.doc_id: r.component_id for r in S.similar(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert all(got[a] == got[b] for (a, b), j in like.items() if j >= 0.85)
    near = {a for (a, b), j in like.items() if j >= 0.5 and got[a] == got[b]} | {b for (a, b), j in like.items() if j >= 0.5 and got[a] == got[b]}
    sizes = {}
    for c in got.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(i in near for i, c in got.items() if sizes[c] > 1)
    assert any(n > 1 for n in sizes.values())


def test_similar_hard_rows(spark):
    got = sorted((r.doc_id, r.component_id) for r in S.similar(docs(spark, HARD)).where("doc_id is not null").collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 6), (7, 6), (8, 6), (9, 9), (10, 10), (11, 11)]
    assert S.similar(docs(spark, [])).count() == 0


def shingle_sets(rows, size=5):
    from helpers import words as split

    out = {}
    for i, t in rows:
        w = [x.lower() for x in split(t)]
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))
    return out


def alike_groups(sets, similarity=0.8):
    """Smallest reachable id of each id, all pairs that share a shingle compared by exact Jaccard."""
    where, up = {}, {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sorted(sets):
        for j in {j for x in sets[i] for j in where.get(x, ())}:
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for x in sets[i]:
            where.setdefault(x, []).append(i)
    return {i: root(i) for i in sets}


def edited():
    """Texts of 8 to 300 words and copies whose ends were replaced, to similarities of 0.5 to 0.97; one shingle repeated often before unlike ends."""
    rng, rows = np.random.default_rng(5), []
    for n in (8, 9, 14, 40, 300):
        for _ in range(12):
            base = [f"w{k}" for k in rng.integers(0, 10**9, n)]
            rows.append(" ".join(base))
            for like in (0.5, 0.6, 0.7, 0.75, 0.79, 0.8, 0.81, 0.9, 0.97):
                keep = max(5, int(np.ceil((n - 4) * 2 * like / (1 + like))) + 4)
                rows.append(" ".join(base[:keep] + [f"x{k}" for k in rng.integers(0, 10**9, n - keep)]))
    for _ in range(2):
        rows.append("same " * 400 + " ".join(f"y{k}" for k in rng.integers(0, 10**9, 30)))
    return list(enumerate(rows))


@pytest.mark.parametrize("squares", [False, True])
def test_similar_is_exact_on_both_sides_of_the_threshold(spark, monkeypatch, squares):
    if squares:
        monkeypatch.setattr(S, "HELD_ROWS", 3)
    rows = edited()
    sets = shingle_sets(rows)
    got = {r.doc_id: r.component_id for r in S.similar(docs(spark, rows)).collect()}
    assert got == alike_groups(sets)
    assert any(0.7 < len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8 and got[i] != got[j] for i in range(0, len(rows), 10) for j in range(i + 1, min(i + 10, len(rows))))


def test_similar_of_given_documents_is_exact(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.component_id for r in S.similar(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == alike_groups(shingle_sets(given_docs(spark, sf)))


def test_line_stage_takes_single_repeated_lines(spark, sf):
    rows = [(1, "one of its own\nshared line\nanother of its own"), (2, "first here\n shared line \nlast here"), (3, "a text of one line"), (4, "a text of one line"), (5, "shared line"), (6, None)]
    got = {r.doc_id: r.text for r in stage_line_dedup(spark, docs(spark, rows), sf).collect()}
    assert got == {1: rows[0][1], 2: "first here\nlast here", 3: rows[2][1], 4: "", 5: "", 6: None}
    sizes = {r.doc_id: r.n_chars for r in stage_line_dedup(spark, docs(spark, rows), sf).collect()}
    assert sizes[2] == len("first here\nlast here") and sizes[4] == 0
