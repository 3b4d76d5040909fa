"""Periodic runs against a search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tessera.llm")
from tessera.llm import queries, runs  # noqa: E402


def all_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x < len(w) - q:
            if w[x] != w[x + q]:
                x += 1
                continue
            y = x
            while y < len(w) - q and w[y] == w[y + q]:
                y += 1
            if y - x + q >= max(least, 2 * q):
                found.setdefault((x, y - x + q), q)
            x = y
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def found(texts, least=12):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    flat = np.array([x for t in texts for x in t], np.int64)
    out = [[] for _ in texts]
    for t, *run in zip(*(x.tolist() for x in runs.find_runs(flat, bounds, least)), strict=True):
        out[t].append(tuple(run))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=120), max_size=5), st.integers(2, 15))
def test_runs_of_small_alphabets(texts, least):
    assert found(texts, least) == [all_runs(t, least) for t in texts]


def test_runs_longer_than_the_cover():
    r = random.Random(3)
    texts = []
    for n, p in ((700, 150), (1000, 333), (900, 1), (640, 64), (64, 32), (513, 128), (12, 6), (11, 1)):
        base = [r.randrange(50) for _ in range(n)]
        a = r.randrange(n // 4 + 1)
        texts.append([base[i] if i < a else base[a + (i - a) % p] for i in range(n)])
    word = [0, 1]
    for _ in range(9):  # Fibonacci words hold many runs
        word = [*word, *word[: len(word) * 21 // 34]]
    assert found([*texts, word]) == [all_runs(t) for t in [*texts, word]]


def test_the_harmonic_grid_has_every_multiple_once():
    sizes = np.array([7, 0, 30, 1])
    first = np.array([0, 8, 9, 40])
    want = {(first[t] + k * p, p) for t, n in enumerate(sizes) for p in range(1, n // 2 + 1) for k in range(n) if k * p + p < n}
    for most in (1, 5, 1 << 20):
        got = [x for i, p in runs.grid(sizes, first, most) for x in zip(i.tolist(), p.tolist(), strict=True)]
        assert len(got) == len(want) and set(got) == want


def expected(doc, text):
    cut = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "")
    w = [x for x in cut.split(" ") if x]
    n = len(w)
    if doc is not None and n and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    own = all_runs(w)
    gone = {x for s, m, q in own for x in range(s + q, s + m)}
    top = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    last = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc, len(own), *last, sha("".join(f"{s},{m},{q}\n" for s, m, q in own)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def rows():
    r = random.Random(8)
    vocab = [*"abcé", "A", "日本", "x y", "-"]
    out = [(i, r.choice([" ", "  ", "\n", "\t\x0b"]).join(r.choice(vocab) for _ in range(r.randint(0, 150)))) for i in range(120)]
    return [*out, (500, None), (501, ""), (502, " \n "), (None, "a b " * 20), (503, "w " * 3000), (504, "one"), (5, out[5][1])]


def test_query(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    want = sorted((expected(*r) for r in rows()), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert sum(r[1] > 0 for r in want) > 10


def test_clashing_columns_stay_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 9, 1, 2, 3, 4, 5)], "doc_id long, text string, words int, `a.b` int, P int, N_WORDS int, `c``0` int")
    got = runs.periodic_runs(runs.with_loops(docs))
    assert got.columns == ["doc_id", "text", "words", "a.b", "P", "c`0", "n_words", "runs", "collapsed"]
    row = got.first()
    assert row[2:6] == (1, 2, 3, 5) and row.n_words == 18 and row.collapsed == "a b"
    empty = runs.periodic_runs(runs.with_loops(docs.limit(0)))
    assert empty.collect() == []
    broken = spark.sql("select 7L doc_id, cast(x'6120ff2062' as string) text")
    assert runs.periodic_runs(broken).first().collapsed == "a � b"
