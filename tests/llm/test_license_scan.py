"""Licence scans: the automaton and the places of phrases against brute force, spans on known texts."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tessera.llm")
from tessera.llm import license_scan, queries  # noqa: E402
from tessera.llm.license_scan import PHRASES, TEMPLATES, Scanner, SuffixAutomaton  # noqa: E402

WORDS = st.lists(st.integers(0, 2), max_size=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), WORDS)
def test_matching_statistics_and_places(templates, text):
    a = SuffixAutomaton(templates)
    lengths, states = a.stream(text)
    inside = lambda w, t: [e for e in range(len(w) - 1, len(t)) if t[e - len(w) + 1 : e + 1] == w]
    for i in range(len(text)):
        best = max((n for n in range(1, i + 2) if any(inside(text[i - n + 1 : i + 1], t) for t in templates)), default=0)
        assert lengths[i] == best
        if best:
            want = sorted((s, e) for s, t in enumerate(templates) for e in inside(text[i - best + 1 : i + 1], t))
            assert sorted(a.places[states[i]]) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(3, 5)), max_size=9))
def test_chains_cover_as_much_as_any(matches):
    size, gap = 20, 4
    own = sorted({(n + x - 1, n + y - 1, n) for x, y, n in matches})
    scanner = Scanner((("x", " ".join(map(str, range(size)))),), PHRASES, 3, 0.0, gap, 0)
    best = 0

    def follow(at, covered):
        nonlocal best
        best = max(best, covered)
        for j in range(at + 1, len(own)):
            (pi, pe, _), (i, e, n) = own[at], own[j]
            if pi >= i - n - gap and min(n, i - pi, e - pe) > 0:
                follow(j, covered + min(n, i - pi, e - pe))

    for j, m in enumerate(own):
        follow(j, m[2])
    chains = scanner.chain([(0, e, i, n) for i, e, n in own])
    assert max((c[0] for c in chains), default=0) == best


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w, out = words(text), []
    for label, phrase in PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return sorted(out)


def rows():
    r = random.Random(4)
    vocab = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "the", "Licensed", "under", "of", "version", "é", "2", "CC-BY", "GNU"]
    out = [(i, "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "-", ". "]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    out += [(1000 + k, f"Text before, with ordinary words. {t}\nmore follows after it") for k, (_, t) in enumerate(TEMPLATES)]
    return [*out, (500, None), (501, ""), (502, " \n "), (None, "All rights reserved."), (503, "all rights " * 2000 + "reserved"), (504, "CC_BY\x85cc by cc by"), (7, out[7][1])]


def test_query(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows())
    key = lambda r: tuple(str(x) for x in r)
    want = []
    for i, t in rows():
        b = base(t)
        want.append((i, len(words(t)), len(b), b[0][0] if b else None, b[-1][0] if b else None, ",".join(sorted({x for _, x in b}))))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        mine = set(r.labels.split(",")) - {""}
        assert mine >= set(r.base_labels.split(",")) - {""} and r.labels == ",".join(sorted(mine)) and 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id >= 1000:
            assert TEMPLATES[r.doc_id - 1000][0] in mine and r.score == 1


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
        ("Released under the MIT License.", ["mit"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
        ("Licensed under the Mozilla Public License, version 2.0", []),
        ("released under the terms of the agreement", []),
        ("Permission is hereby granted, free of charge, to any person (or group) obtaining a copy of this software and associated documentation files", []),
    ],
)
def test_spans_of_notices(spark, text, label):
    out = license_scan.scan_licenses(spark.createDataFrame([(text,)], "text string")).first()
    assert [s.label for s in out.spans] == label


def test_a_changed_text_is_still_its_template(spark):
    text = TEMPLATES[6][1] if len(TEMPLATES[6][1]) > 300 else next(t for label, t in TEMPLATES if label == "mit" and len(t) > 300)
    w = text.split(" ")
    for at in (11, 25, 40, 55):
        w[at] = "changed"
    out = license_scan.scan_licenses(spark.createDataFrame([("some words here " + " ".join(w) + " the end " + " ".join(w),)], "text string")).first()
    assert [s.label for s in out.spans] == ["mit", "mit"]
    first, second = out.spans
    assert first.start == 3 and first.end <= second.start and 0.75 <= first.share < 1


def test_clashing_columns_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "cc by", 1, 2, 3)], "doc_id long, text string, `a.b` int, SPANS int, label int")
    got = license_scan.scan_licenses(docs)
    assert got.columns == ["doc_id", "text", "a.b", "label", "n_words", "places", "spans"] and got.first()["a.b"] == 1
    assert license_scan.scan_licenses(docs.limit(0)).collect() == []
    assert license_scan.scan_licenses(spark.sql("select cast(x'6363ff206279' as string) text")).first().n_words == 2
