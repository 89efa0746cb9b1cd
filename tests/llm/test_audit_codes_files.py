"""The filter audit, vector codes and token files against plain versions."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import HARD, docs, words
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import filteraudit, tokenfiles, tokens, vectorcodes

# The audit


def fails(rows):
    """Letters that each row (doc_id, text, …) fails."""
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = words(t)
        capitals = sum("A" <= c <= "Z" for c in t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * capitals > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        out.append({k for k, v in own.items() if v})
    return out


def plain_audit(rows, labels):
    """Every order applied to every row, one by one. rows: (doc_id, text, source)."""
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    failed, out, shapley = fails(rows), {}, {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, failed) if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                lost = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                before = set(order[: step - 1])
                out[part, order, step] = [len(left), len(lost), sum(c in f and bool(before & f) for _, f in own), sum(f == {c} for _, f in own), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
                shapley[part, c] = shapley.get((part, c), 0) + len(lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LONG = " ".join(f"word{i}" for i in range(250))
AUDITED = [
    (1, LONG, "s"), (2, LONG, "s"), (2, LONG, "t"), (3, LONG + " #", "s"), (4, "AB CD", None), (5, "ab " * 300, ""), (6, None, "s"), (7, "", "t"), (None, "", "s"), (None, LONG, "s"), (8, "İ|É 🙂 x", "t"), (9, LONG.upper(), "s"), (1, LONG, "s"),
    *[(i, t, "h") for i, t in HARD],
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, 0, 1), (4, None, None), (None, 1, 1), (5, 1, 0), (99, 1, 1)]


def test_audit_equals_every_order_row_by_row(spark):
    table = spark.createDataFrame([(*r, 5, "x") for r in AUDITED], "doc_id long, text string, source string, fails int, part string")
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filteraudit.filter_audit(table, labels).collect()}
    assert got == plain_audit(AUDITED, LABELS)
    assert len(got) == 600 * 4
    bare = filteraudit.filter_audit(table, labels.limit(0))
    assert sum(r.good_lost + r.toxic_lost for r in bare.collect()) == 0
    assert filteraudit.filter_audit(table.limit(0), labels).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 4)), max_size=300))
def test_carry_save_popcounts(pairs):
    w, g = np.array([p[0] for p in pairs], np.uint32), np.array([p[1] for p in pairs], np.int64)
    want = np.zeros((5, 32), np.int64)
    for x, k in pairs:
        want[k] += [x >> b & 1 for b in range(32)]
    assert (filteraudit.popcounts(w, g, 5) == want).all()


# Vector codes


def plain_codes(rows, parts, entries, rounds):
    """Full search over Python integers. rows: (vec_id, vector, label); gives (vec_id, code, error, label_error) and all entries."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = max((len(v) for _, v, _ in kept), default=1)
    width = -(-max(size, 1) // parts)
    full = [(i, v + [0] * (width * parts - len(v)), y) for i, v, y in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in full]
    first = sorted((i, v, k) for k, (i, v, _) in enumerate(full) if i is not None)[:entries]
    books = [[list(cut[k][p]) for _, _, k in first] for p in range(parts)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            own = [nearest(p, c[p])[1] for c in cut]
            mine = lambda k: [c[p] for c, o in zip(cut, own) if o == k]  # noqa: E731, B023
            moved.append([[sum(x) // len(m) for x in zip(*m)] if (m := mine(k)) else e for k, e in enumerate(books[p])])
        books = moved
    coded = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = {}
    for (_, _, y), c in zip(full, coded):
        errors[y] = errors.get(y, 0) + sum(d for d, _ in c)
    out = [(i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), errors[y]) for (i, _, y), c in zip(full, coded)]
    return out, ",".join(str(x) for b in books for e in b for x in e)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long"


def test_codes_equal_full_search(spark):
    import hashlib

    rng = np.random.default_rng(5)
    near = lambda n, spread: [[float(np.float32(x)) for x in rng.integers(-spread, spread, 6) / 64] for _ in range(n)]
    vectors = [*near(60, 3), *near(40, 40), [0.0] * 6, [0.0] * 6, [1000.0] * 6, [-1e9, 0.0, 1e9], [float("nan")] * 6, [float("inf"), 0.0], None, [], [0.5], [None, 0.0]]
    rows = [(None if k % 17 == 3 else k // 2 if k % 5 == 0 else k, v, None if k % 7 == 0 else k % 3) for k, v in enumerate(vectors)]
    limit = int((2**61 // 10) ** 0.5)
    held = [(i, v and [x if x is None or not np.isfinite(x) else min(max(x, -limit / 1024), limit / 1024) for x in v], y) for i, v, y in rows]
    got = vectorcodes.compressed(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), 4, 20, 3).collect()
    want, books = plain_codes(held, 4, 20, 3)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(books.encode()).hexdigest()}


def test_codes_of_few_and_odd_rows(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert vectorcodes.compressed(frame([])).count() == 0
    assert vectorcodes.compressed(frame([(1, None, 1)])).count() == 0
    (one,) = vectorcodes.compressed(frame([(7, [0.5] * 8, None)])).collect()
    assert (one.code, one.error, one.label_error) == ("00000000", 0, 0)
    (unnamed,) = vectorcodes.compressed(frame([(None, [0.5] * 8, 1)])).collect()
    assert (unnamed.code, unnamed.error) == ("", None)
    same = vectorcodes.compressed(frame([(i, [0.25] * 8, 1) for i in range(300)])).collect()
    assert len(same) == 300 and {(r.code, r.error, r.label_error) for r in same} == {("00000000", 0, 0)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(1, 5), st.integers(1, 60), st.integers(0, 10**6), st.sampled_from([2, 30, 5000, 2**26]))
def test_tree_finds_what_a_full_search_finds(n, width, queries, seed, spread):
    rng = np.random.default_rng(seed)
    entries, asked = rng.integers(-spread, spread, (n, width)), rng.integers(-spread, spread, (queries, width))
    number, best = vectorcodes.Gnat(entries).nearest(asked)
    d = ((asked[:, None] - entries[None]) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all()


def test_tree_rules_out_most_far_children():
    rng = np.random.default_rng(1)
    centres = rng.integers(-20_000, 20_000, (16, 8))
    entries = (centres[:, None] + rng.integers(-50, 50, (16, 16, 8))).reshape(-1, 8)
    tree = vectorcodes.Gnat(entries)
    tree.nearest(entries + 3)
    assert tree.ruled_out > 4 * len(entries)


# Token files

ODD_TEXTS = ["", " ", "  two  spaces ", "It's here, isn't it?", "a b c", "x<|endoftext|>y z", "日本語 テキスト。", "tab\tand\r\nline\n\n\nend ", "'s 't 'twas rock'n'roll", "x　 y", "\x1c odd \x85", "a" * 5000, "9.99$ #tag @me", "é combining"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab'st, .\n  #1é", max_size=40)), max_size=8))
def test_pieces_give_the_ids_of_whole_texts(tokenizer, texts):
    found = tokenfiles._encoder(_described())
    assert found.cuts
    ids, first = found(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def _described():
    with open(tokens.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_a_tokenizer_that_bears_no_cuts_gets_whole_texts():
    from tokenizers import Tokenizer, models, pre_tokenizers

    whole = Tokenizer(models.WordLevel({"a b": 0, "c": 1, "?": 2}, "?"))
    whole.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    found = tokenfiles.PieceEncoder(whole.to_str())
    assert not found.cuts
    ids, first = found(pa.array(["a b,c", None, "x"]))
    assert ids.tolist() == [0, 1, 2] and first.tolist() == [0, 2, 2, 3]


def test_files_round_trip(spark, tmp_path, tokenizer):
    rows = [*HARD, *[(100 - i, t) for i, t in enumerate(ODD_TEXTS)]]
    files = tokenfiles.write_tokens(docs(spark, rows), str(tmp_path / "t"), end=2)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    got = files.tokens().collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == sorted(((i, ids(t)) for i, t in rows), key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i))
    sums = {(r.start, r.doc_id, r.n_tokens): r.ids_crc32 for r in files.checksums().collect()}
    assert sums == {(r.start, r.doc_id, r.n_tokens): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    # stretches are cut out of the same row of tokens
    flat = [i for r in sorted(got, key=lambda r: r.start) for i in r.ids]
    for a, b in ((0, 1), (3, 700), (at - 5, at + 9), (at // 2, at // 2), (0, at), (at, at + 1)):
        part = sorted(files.stretch(a, b).collect(), key=lambda r: r.start)
        assert [i for r in part for i in r.ids] == flat[a:b] and all(r.n_tokens == len(r.ids) for r in part)
        assert not part or part[0].start == a
    assert sorted(r.doc_id for r in files.tokens(90, 92).collect()) == [90, 91, 92]
    empty = tokenfiles.write_tokens(docs(spark, []), str(tmp_path / "none"))
    assert empty.checksums().count() == empty.documents().count() == empty.stretch(0, 5).count() == 0


def test_files_are_encoded_and_read_selectively(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("w"), (F.col("id") * k % 9973).cast("string")))).alias("text"))
    files = tokenfiles.write_tokens(rows, str(tmp_path / "t"), group_bytes=100_000, page_bytes=8_000)
    found = [pq.ParquetFile(f).metadata for f in (tmp_path / "t" / "data").glob("*.parquet")]
    column = lambda m, g, name: next(c for k in range(m.num_columns) for c in [m.row_group(g).column(k)] if c.path_in_schema.startswith(name))
    groups = [(m, g) for m in found for g in range(m.num_row_groups)]
    assert len(groups) >= 8
    for m, g in groups:
        assert "RLE_DICTIONARY" in column(m, g, "ids").encodings
        for name in ("doc_id", "n_tokens", "at"):
            c = column(m, g, name)
            assert c.has_column_index and c.has_offset_index and "DELTA_BINARY_PACKED" in c.encodings and "RLE_DICTIONARY" not in c.encodings
    assert "ids" not in files.documents()._jdf.queryExecution().executedPlan().toString()
    few = files.tokens(1000, 1009)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,1000)" in plan and few.count() == 10
