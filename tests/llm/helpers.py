"""Plain versions of what the corpus operators compute, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: What every operator must bear: null, empty, white and long texts, repeats, ties.
LINES = "\n".join(f"line number {i} of the long document goes on and on" for i in range(40))
HARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two\nthree"), (6, LINES), (7, LINES), (7, LINES), (8, LINES + "\nand a new end"), (9, "###|||"), (10, "The cat is on the mat. " * 300),
    (11, "über straße naïve façade"), (None, "a row without an id"), (None, None),
]


def docs(spark, rows, extra=True):
    """documents with columns whose names clash with the operators' own."""
    full = [(i, t, "en" if (i or 0) % 3 else None, None if i == 5 else "s", len(t) if t else None, "x", 1, 0.5) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, n_removed int, score double"
    df = spark.createDataFrame(full, schema)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def words(text):
    return WORD.findall((text or "").encode())


def simhash(text, size):
    w = [x.lower() for x in words(text)]
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def grouped(fps, most):
    """Smallest reachable key of each key, all pairs compared."""
    keys, up = sorted(fps), {k: k for k in fps}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def substring(rows, size):
    """(n_words, n_removed, sha256 of what is left) of each row."""
    all_words = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in all_words for i in range(len(w) - size + 1))
    out = []
    for w in all_words:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def line_dedup(rows, run):
    """Text left of each distinct (doc_id, text); one of two texts under one id is first, by their hashes."""
    lines = {}
    for i, t in rows:
        lines[i, t] = [(n, x.strip(" \t\n\x0b\f\r")) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\f\r")]
    first = {}
    signed = lambda h: h - (h >> 63 << 64)
    at = lambda i, t: (-(2**63) if i is None else i, 42 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42)))
    for (i, t), own in lines.items():
        for k in range(len(own) - run + 1):
            key = tuple(x for _, x in own[k : k + run])
            first[key] = min(first.get(key, (at(i, t), k)), (at(i, t), k))
    out = {}
    for (i, t), own in lines.items():
        gone = set()
        for k in range(len(own) - run + 1):
            if first[tuple(x for _, x in own[k : k + run])] < (at(i, t), k):
                gone.update(n for n, _ in own[k : k + run])
        out[i, t] = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return out
