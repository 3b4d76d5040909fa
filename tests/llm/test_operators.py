"""Training-data operators against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
from tessera.llm import fingerprint, line_dedup, lm_score, media, near_dedup, packing, quality, sentencepiece, shared, toxicity, url_filter  # noqa: E402

SCHEMA = "doc_id long, text string, n_lines string, n long"


def table(spark, rows):
    """Rows (doc_id, text) with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 90))) for _ in range(60)]
    rows = list(enumerate(base))
    for k in range(30):  # near copies, copies and short texts
        w = r.choice(base).split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((100 + k, " ".join(w)))
    passage = "\n" + " ".join(r.choice(vocab) for _ in range(30)) + "\n"
    rows += [(200 + k, r.choice(base) + passage + r.choice(base)) for k in range(8)]
    return [*rows, (300, None), (301, ""), (302, " \n\t "), (303, "One two"), (304, "one TWO"), (305, "a b c d e"), (306, "x" * 3000), (None, "lost id"), (5, base[5]), (307, "\n\n")]


# ------------------------------------------------------------------ shared
def test_token_hashes_tell_words_apart_and_forget_places():
    data = "Foo bar foo\tBAR\n\nfoo é É".encode()
    h, at = shared.token_hashes(np.frombuffer(data, np.uint8), np.array([0, 8, len(data)]))
    assert at.tolist() == [0, 2, 7]
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[5] != h[6] and len(set(h.tolist())) == 4


# ------------------------------------------------------------------ 1 packing
def test_plan_is_best_fit():
    counts = {7: 3, 5: 2, 3: 4, 2: 5, 10: 2}
    steps = packing.plan(counts, 10)
    placed = defaultdict(list)
    for length, _, ranks, each, first, at in steps:
        for q in range(ranks):
            placed[first + q // each].append((at + q % each * length, length))
    for own in placed.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(n for _, n in own) <= 10
    assert Counter(n for own in placed.values() for _, n in own) == counts
    # item by item: the fullest sequence that holds it
    rooms = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [i for i, x in enumerate(rooms) if x >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(10 - n)
    assert len(placed) == len(rooms)


@pytest.mark.parametrize(("broadcast", "file"), [(64 << 20, "word_bpe_49k.json"), (0, "word_bpe_49k.json"), (64 << 20, "byte_bpe_50k.json")])
def test_packing(spark, corpus, broadcast, file):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path(file)
    out = packing.pack(table(spark, corpus), path, capacity=64, broadcast_bytes=broadcast).collect()
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, text in corpus:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.update((i, k, s, tuple(ids[s : s + 64])) for k, s in enumerate(range(0, len(ids), 64)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out) == want
    rows = defaultdict(list)
    for r in out:
        rows[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in own) <= 64 and [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] for own in rows.values())


def test_words_are_encoded_as_in_their_texts():
    P = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["don't «foo», bar's 's,t A_B 12,3.4 é,à é, İstanbul ΑΣ, a\x1cb\x85c\xa0d", "日本語。テスト, ok", "it'll've 'S 'RE", "ǅ ﬁ ½, ² ٣,", "!!?? ...", "<|endoftext|> x", "a<|startoftext|>B <|ENDOFTEXT|>", "", None]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    memory = packing.PartMemory(P.path("word_bpe_49k.json"), most=5)  # forgets in between
    for _ in range(2):
        ids, bounds = packing.token_ids(memory, pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


# ------------------------------------------------------------------ 2 line dedup
def test_perfect_hash_is_minimal_and_survives_its_dump():
    keys = shared.mix(np.arange(5000, dtype=np.uint64))
    low = shared.mix(keys)
    h = line_dedup.PerfectHash.build(keys, low)
    assert sorted(line_dedup.PerfectHash.load(h.dump())(keys, low).tolist()) == list(range(5000))


def test_keys_of_equal_halves_are_kept_apart():
    h1 = np.array([7, 7, 7, -5, 9], np.int64)
    h2 = np.array([1, 2, -3, 1, 1], np.int64)
    doc = np.arange(10, 15)
    row = line_dedup._build(shared.pa.table({"shard": np.zeros(5, np.int64), "h1": h1, "h2": h2, "n": np.full(5, 6), "doc": doc})).to_pylist()[0]
    known, keeper, counts = line_dedup.Shard(row).keeper(h1, h2)
    assert known.all() and keeper.tolist() == doc.tolist() and counts.tolist() == [6] * 5
    assert not line_dedup.Shard(row).keeper(np.array([7, 9]), np.array([5, 2]))[0].any()


@pytest.mark.parametrize("broadcast", [32 << 20, -1])
def test_frequent_lines(spark, corpus, broadcast):
    line = "  This Line is longer than forty characters, I am sure of that\t"
    rows = [*corpus, *((400 + i, f"start {i}\n{line if i % 2 else line.lower()}\nshort\n{line}") for i in range(7)), (None, f"a\n{line}")]
    out = line_dedup.drop_frequent_lines(table(spark, rows), broadcast_bytes=broadcast, shard_keys=1)
    docs = defaultdict(set)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                docs[key(x)].add(i)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(docs[key(x)]) < 5 or max(docs[key(x)]) == i]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == want
    assert any(d for *_, d in want) and {r.most_docs for r in got if r.n_dropped == 0} == {0} and {r.most_docs for r in got if 400 <= (r.doc_id or 0) < 406} == {7}


# ------------------------------------------------------------------ 3 toxicity, 8 quality
def labelled(spark, n=400):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 60))]
        bad, junk = r.random() < 0.2, r.random() < 0.2
        if bad:
            for _ in range(r.randint(1, 8)):
                w.insert(r.randrange(len(w)), r.choice(["nasty", "vile"]))
        docs.append((i, " ".join(x.upper() + "!!" if junk else x for x in w)))
        labels.append((i, int(not junk), int(bad)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_severity_grades_follow_the_load(spark):
    docs, labels, flags = labelled(spark)
    model = toxicity.fit(table(spark, docs[:250]), labels.where("doc_id < 250"))
    assert np.all(np.diff(model.cuts) > 0)
    out = {r.doc_id: r for r in toxicity.severity(table(spark, [*docs, (900, None), (901, ""), (None, "vile nasty")]), model).collect()}
    assert np.mean([out[i].toxic == bool(t) for i, _, t in flags if i >= 250]) > 0.97
    assert not out[900].toxic and not out[901].toxic and out[None].toxic
    assert 0 <= min(r.severity for r in out.values()) and max(r.severity for r in out.values()) <= 3


def test_ordinal_gradient_is_the_objectives_slope():
    r = np.random.default_rng(1)
    row, column = np.repeat(np.arange(40), 3), r.integers(0, 4, 120)
    grade, p = r.integers(0, 4, 40), r.normal(size=4 + 3)
    value = lambda q: toxicity.OrdinalModel.objective(q, 4, row, column, grade, 0.3)
    slope = [(value(p + e)[0] - value(p - e)[0]) / 2e-6 for e in np.eye(7) * 1e-6]
    assert np.allclose(value(p)[1], slope, atol=1e-6)


def test_ordinal_fit_is_the_best_on_a_grid():
    grade = np.repeat([0, 1, 0, 1], [40, 10, 10, 40])
    row = np.arange(50, 100)
    m = toxicity.OrdinalModel.fit(np.array([3]), row, np.zeros(50, int), grade, 1, decay=0.5)
    value = lambda w, c: toxicity.OrdinalModel.objective(np.array([w, c]), 1, row, np.zeros(50, int), grade, 0.5)[0]
    best = max(((value(w, c), w, c) for w in np.arange(1.5, 4, 0.02) for c in np.arange(0, 3, 0.02)))
    assert abs(m.weights[0] - best[1]) < 0.03 and abs(m.cuts[0] - best[2]) < 0.03


def test_features_and_grades_by_brute_force(spark):
    docs, labels, flags = labelled(spark, 200)
    docs = [*docs, (3, "zz another text of one id"), (900, None)]
    model = toxicity.fit(table(spark, docs), labels, features=40, least=3)
    last = {}
    for i, t in docs:
        if i < 900:
            last[i] = max(last.get(i, ""), t or "")
    toxic = {i: t for i, _, t in flags}
    tokens = {i: [w.lower() for w in re.findall(r"[\w]+|[^\w\s]+", t)] for i, t in last.items()}
    parts = {i: [*t, *(f"{x[:4]}\0" for x in t), *(f"{x[:5]}\0\0" for x in t)] for i, t in tokens.items()}
    # strings stand in for buckets: heads of a word are features of their own
    nt, nc = sum(toxic.values()), len(toxic) - sum(toxic.values())
    count = Counter((x, toxic[i]) for i, p in parts.items() for x in set(p))
    z = {}
    part = lambda k, n, p: k * np.log(k / (n * p)) if k else 0.0
    for x in {x for x, _ in count}:
        t, c = count[x, 1], count[x, 0]
        if t + c >= 3:
            p = (t + c) / (nt + nc)
            z[x] = 2 * (part(t, nt, p) + part(nt - t, nt, 1 - p) + part(c, nc, p) + part(nc - c, nc, 1 - p))
    best = sorted(z.values(), reverse=True)
    assert len(model.buckets) == max(16, sum(x >= toxicity.SURE for x in best)) and z["nasty"] >= best[15] and z["vile"] >= best[15]
    h = shared.token_hashes(np.frombuffer(b"nasty vile", np.uint8), np.array([0, 10]), shared.PUNCT_CLASS)[0]
    assert np.isin((h >> np.uint64(44)).astype(np.int64), model.buckets).all()
    load, flag = np.array([0.1, 0.5, 0.2, 0.9, 0.2, 0.0]), np.array([True, True, True, True, True, False])
    assert toxicity.grades_by_load(load, flag, 2).tolist() == [1, 2, 1, 2, 1, 0]


def test_severity_held_out_and_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(4))
    model = toxicity.fit(docs, labels.where(fold != 0))
    out = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    held = [(r.doc_id, r.toxic) for r in labels.where(fold == 0).collect()]
    toxic = [out[i].toxic for i, t in held if t == 1]
    assert np.mean(toxic) >= 0.75 and np.mean([out[i].toxic for i, t in held if t == 0]) <= 0.005 and len(toxic) >= 50
    known = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))

    def bucket(word, head=None):
        data = np.frombuffer(word.encode(), np.uint8)
        return int(shared.token_hashes(data, np.array([0, len(data)]), shared.PUNCT_CLASS, heads=(4, 5))[0 if head is None else head - 2][0] >> np.uint64(44))

    for i in list(out)[:200]:
        found = {bucket(w, head) for w in re.findall(r"[a-zA-Z0-9\x80-\U0010ffff]+|[^\sa-zA-Z0-9\x80-\U0010ffff]+", out[i].text) for head in (None, 4, 5)}
        score = sum(known.get(b, 0.0) for b in found)
        above = [1 / (1 + np.exp(-(score - c))) for c in model.cuts]
        assert abs(out[i].severity - sum(above)) < 1e-5 and out[i].grade == sum(a >= 0.5 for a in above)


def test_severity_of_odd_rows(spark):
    docs, labels, _ = labelled(spark, 120)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (6, 1, 1), (6, 0, 0)], labels.schema))
    clash = table(spark, [*docs, docs[0], (None, None), (950, "vile " * 60_000)]).select("*", F.lit("x").alias("severity"), F.lit("y").alias("grade"), F.lit(1).alias("toxic"), F.lit(2).alias("bucket"))
    out = toxicity.severity(clash, toxicity.fit(clash, labels.withColumn("text", F.lit("no text"))))
    rows = out.collect()
    assert dict(out.dtypes) | {"severity": "double", "grade": "int", "toxic": "boolean", "bucket": "int"} == dict(out.dtypes) and len(rows) == 123
    assert len({(r.severity, r.grade) for r in rows if r.doc_id == 0}) == 1 and next(r for r in rows if r.doc_id == 950).toxic


def test_importance_resampling(spark):
    docs, labels, flags = labelled(spark)
    out = {r.doc_id: r for r in quality.importance_resample(table(spark, [*docs, (900, None), (901, "")]), labels.where("doc_id < 200")).collect()}
    assert np.mean([out[i].selected == bool(q) for i, q, _ in flags if i >= 200]) > 0.97
    assert out[900].log_weight == out[901].log_weight == 0
    same = quality.importance_resample(table(spark, docs[:20]), labels.limit(0)).collect()
    assert all(r.selected for r in same)


def test_weights_by_brute_force(spark):
    docs = [(0, "good one two"), (1, "bad bad bad!"), (2, "one GOOD two two"), (3, None), (4, "x")]
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.importance_resample(table(spark, docs), labels).collect()}

    def grams(t):
        w = re.findall(r"[\w]+|[^\w\s]+", t or "")
        return [x for a, b in zip(w, [*w[1:], None][: len(w)], strict=True) for x in (a, "again" if a == b else (a, b) if b else a)]

    raw, target = Counter(x for _, t in docs for x in grams(t)), Counter(x for i, t in docs if i in (0, 2) for x in grams(t))
    share = lambda c, x: np.log((c[x] + 1) / (sum(c.values()) + quality.BUCKETS))
    for i, t in docs:
        assert out[i].n_grams == len(grams(t)) and abs(out[i].log_weight - sum(share(target, x) - share(raw, x) for x in grams(t)) / max(len(grams(t)), 1)) < 1e-6


def test_inclusion_follows_the_weights(spark):
    docs = [(i, "good " * (i + 1)) for i in range(4)] + [(9, "other words here")]
    labels = spark.createDataFrame([(3, 1), (9, 0)], "doc_id long, quality int")
    seen, runs = Counter(), 300
    one = table(spark, docs)
    weight = {r.doc_id: r.log_weight for r in quality.importance_resample(one, labels, k=1).collect()}
    hot = max(weight.values()) - min(weight.values())
    for seed in range(runs):  # the noise alone depends on the seed; keys are recomputed here as in the operator
        u = {r.doc_id: r.u for r in one.select("doc_id", ((F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).collect()}
        seen[max(u, key=lambda i: weight[i] / hot - np.log(-np.log(u[i])))] += 1
    p = {i: np.exp(w / hot) for i, w in weight.items()}
    for i in p:
        share = p[i] / sum(p.values())
        assert abs(seen[i] / runs - share) < 4 * np.sqrt(share * (1 - share) / runs)
    for seed in (1, 2, 3):
        got = quality.importance_resample(one, labels, k=2, temperature=hot, seed=seed).collect()
        best = sorted(got, key=lambda r: -r.gumbel_key)[:2]
        assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in best}
    assert sum(r.selected for r in quality.importance_resample(one, labels, k=0.6).collect()) == 3
    assert sum(r.selected for r in quality.importance_resample(one, labels, k=50).collect()) == 5 and not any(r.selected for r in quality.importance_resample(one, labels, k=0).collect())


def test_resampling_of_the_given_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {seed: quality.importance_resample(docs.select("doc_id", "text"), labels, seed=seed).drop("text").collect() for seed in range(1, 9)}
    taken = {seed: frozenset(r.doc_id for r in own if r.selected) for seed, own in rows.items()}
    sizes = {len(x) for x in taken.values()}
    assert len(sizes) == 1 and len(set(taken.values())) > 4  # graded, not a threshold
    good = {r.doc_id: r.quality for r in labels.collect()}
    for own in taken.values():
        assert sum(q == 1 and i not in own for i, q in good.items()) <= 1 and sum(q == 0 and i in own for i, q in good.items()) <= 2
    # the sure ones are always in or out, and inclusion rises with the weight
    often = Counter(i for own in taken.values() for i in own)
    by_weight = sorted(rows[1], key=lambda r: r.log_weight)
    edge = len(by_weight) - sizes.pop()
    rate = [np.mean([often[r.doc_id] for r in by_weight[max(0, lo) : lo + 12]]) for lo in (edge - 60, edge - 12, edge, edge + 48)]
    assert rate[0] <= 1 and rate[3] >= 7.5 and rate == sorted(rate)


def test_resampling_of_odd_rows(spark):
    docs, labels, _ = labelled(spark, 120)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    clash = table(spark, [*docs, docs[0], (None, None), (None, "a b"), (950, "vile word " * 30_000)]).select("*", F.lit("x").alias("n_grams"), F.lit("y").alias("selected"), F.lit(1).alias("key"), F.lit("q").alias("quality"))
    out = quality.importance_resample(clash, labels)
    rows = out.collect()
    assert len(rows) == 124 and len({(r.gumbel_key, r.selected) for r in rows if r.doc_id == 0}) == 1 and dict(out.dtypes)["selected"] == "boolean" and rows[0].quality == "q"


def test_kth_largest(spark):
    r = random.Random(1)
    v = [r.randint(-(10**9), 10**9) * r.choice([1, 10**6]) for _ in range(200)] + [5, 5, 5, -1, 0]
    t = spark.createDataFrame([(x,) for x in v], "o long")
    for k in (1, 2, 77, 205):
        assert quality.kth_largest(t, "o", k) == sorted(v, reverse=True)[k - 1]
    assert quality.kth_largest(t, "o", 206) is None and quality.kth_largest(t, "o", 0) is None


# ------------------------------------------------------------------ 4 near duplicates
def components(rows, percent):
    sets, ids = [], [i for i, t in rows if i is not None]
    for i, t in rows:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
            sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    part = {i: i for i in ids}
    find = lambda x: x if part[x] == x else find(part[x])
    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                part[y] = x
    return Counter((i, len(s), find(i)) for i, s in zip(ids, sets, strict=True))


@pytest.mark.parametrize(("percent", "short"), [(85, 64), (60, 2)])
def test_near_duplicates(spark, corpus, percent, short):
    out = near_dedup.near_duplicates(table(spark, corpus), percent=percent, short=short).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None) == components(corpus, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    assert [r.kept for r in out if r.doc_id is None] == [True]


def test_components_of_all_given_documents(spark):
    """Every link of the thousand documents at both thresholds: recall is one."""
    path = "/root/testdata/sf0.01/documents.parquet"
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(path)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, lists = {}, defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for x in sets[i]:
            lists[x].append(i)
    common = Counter(p for own in lists.values() for k, a in enumerate(own) for p in ((a, b) for b in own[k + 1 :]))
    for percent in (80, 85):
        part = {i: i for i, _ in rows}
        find = lambda x: x if part[x] == x else find(part[x])  # noqa: B023, E731
        for (a, b), n in common.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                part[y] = x
        out = near_dedup.near_duplicates(docs, percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(sets[i]), find(i)) for i, _ in rows}


@pytest.mark.parametrize("share", [1 / 1024, 0.01])
def test_hot_classes_and_hubs(spark, monkeypatch, share):
    monkeypatch.setattr(near_dedup, "HOT", share)
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**9)}"
    base = [word() for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(5, 40)]
    rows += [(100 + i, " ".join(base[:k] + [word()] + base[k + 1 :])) for i, k in enumerate([0, 59] * 20)]
    rows += [(200 + i, " ".join(word() for _ in range(8))) for i in range(30)] + [(300, "  "), (301, None)]
    out = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in out) == components(rows, 80)


def test_near_copies_of_near_copies(spark):
    r = random.Random(8)
    w = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):  # chains: each differs from the one before by a word
        w = list(w)
        w[r.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    out = near_dedup.near_duplicates(table(spark, rows), percent=85, short=4).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in out) == components(rows, 85)


def test_contained_texts_at_the_threshold(spark):
    r = random.Random(3)
    rows = []
    for i in range(1800):  # sets of 80 to 140 shingles, one holding the other, at a similarity of exactly 0.8
        small = (80, 96, 104)[i % 3]
        w = [f"w{r.randrange(10**9)}" for _ in range(small * 5 // 4 + 4)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: small + 4]))]
    out = near_dedup.near_duplicates(table(spark, rows), percent=80).collect()
    assert {r.doc_id for r in out if r.component_id != r.doc_id // 2 * 2} == set()


def test_long_lists_of_short_texts(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**9)}"
    rows, i = [], 0
    for _ in range(8):  # a sentence of 8 words: in 150 texts with more, then alone and with one word
        stock = [word() for _ in range(8)]
        for _ in range(150):
            rows.append((i := i + 1, " ".join([*stock, word(), word(), word()])))
        rows += [(i := i + 1, " ".join(stock)), (i := i + 1, " ".join([*stock, word()]))]
    out = near_dedup.near_duplicates(table(spark, rows), percent=80).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in out) == components(rows, 80)


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(6)
    for percent in (60, 75, 80, 85, 100):
        common = r.permutation(np.arange(60))[:30]
        sets = [np.sort(r.choice(np.arange(60), r.integers(1, 40), replace=False)) for _ in range(120)]
        sets += [np.sort(np.union1d(s[: len(s) * 9 // 10], r.integers(60, 90, 2))) for s in sets]
        sets += sets[:5]
        cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        ids = shared.pa.array(np.arange(len(sets)))
        batch = shared.pa.RecordBatch.from_arrays([ids, ids, shared.lists(np.concatenate(sets), cut)], names=["rep", "family", "shingles"])
        keys = defaultdict(set)
        for out in near_dedup._prefixes(common, percent)(iter([batch])):
            for row in out.to_pylist():
                assert row["n"] == len(sets[row["rep"]]) and row["key"] in sets[row["rep"]]
                keys[row["rep"]].add(row["key"])
        met = [keys[a] & keys[b] for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        assert met and all(met)


def test_blocks_of_short_texts_are_bounded(spark):
    full = spark.range(9000).select(F.col("id").alias("rep"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.floor(F.col("id") / 2) * 20 + k + F.col("id") % 2 * F.when(k == 7, 1).otherwise(0)).cast("long")).alias("shingles"))
    groups = full.select(F.lit(1).alias("group"), "rep", F.col("rep").alias("component"), (F.col("rep") == 0).alias("main"))
    sizes = near_dedup._blocks(groups, full).groupBy("x", "y", "block").count().agg(F.max("count"), F.countDistinct("x", "y")).first()
    assert sizes[0] <= 2048 * 1.1 and sizes[1] >= 15
    got = {tuple(r) for r in near_dedup._in_blocks(groups, full, 75).collect()}
    assert got == {(i, i + 1) for i in range(0, 9000, 2)}  # 7 of 9 in common


# ------------------------------------------------------------------ 5 language model
def brute_ppm(train, texts, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        s = b"\n" * order + lm_score.normal(t)
        for i in range(order, len(s)):
            for k in range(order, -1, -1):
                new = s[i] not in counts[k][s[i - k : i]]
                counts[k][s[i - k : i]][s[i]] += 1
                if not new:
                    break  # a shorter context learns only what is new to the longer one
    off = []
    for k in range(order + 1):
        n = [sum(c == j for own in counts[k].values() for c in own.values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        off.append([0, *(min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.05), j - 0.05) if n[j] else 0.5 for j in (1, 2, 3))])

    memory = {}

    def spread(context):  # the whole distribution after a context, by escape and exclusion
        if context in memory:
            return memory[context]
        shorter = spread(context[1:]) if context else [1 / 256] * 256
        k, own = len(context), counts[len(context)].get(context)
        if own:
            total, lost = sum(own.values()), sum(off[k][min(c, 3)] for c in own.values())
            mass = sum(shorter[x] for x in own)
            escape = lost / total * (1 - mass)
            shorter = [(own[x] - off[k][min(own[x], 3)]) / total + lost / total * shorter[x] if x in own else escape * shorter[x] / (1 - mass) for x in range(256)]
        memory[context] = shorter
        return shorter

    out = []
    for t in texts:
        s = b"\n" * order + lm_score.normal(t)
        out.append(sum(np.log10(spread(s[i - order : i])[s[i]]) for i in range(order, len(s))))
    assert all(abs(sum(p) - 1) < 1e-9 for p in memory.values())
    return out


@pytest.mark.parametrize(("hot", "shard"), [(2_000_000, 500_000), (40, 300)])
def test_language_model(spark, corpus, hot, shard):
    rows = [*corpus, (777, "every word is new xyzzy plugh " * 12_000)]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    train = [t for (_, t), h in zip(rows, held, strict=True) if not h]
    tokens = lambda t: [*(t or "").encode().lower().split(), 0]
    c = Counter(x for t in train for x in tokens(t))
    norm = sum(c.values()) + 0.5 * (len(c) + 1)
    want = defaultdict(list)
    for (i, t), h, s in zip(rows, held, brute_ppm(train, [t for _, t in rows], 3), strict=True):
        x = tokens(t)
        want[i].append((h, len(x), sum(c[k] > 0 for k in x), sum(c.values()), round(sum(np.log10((c[k] + 0.5) / norm) for k in x), 5), round(s, 5)))
    got = defaultdict(list)
    for r in lm_score.score(table(spark, rows), order=3, hot_grams=hot, shard_grams=shard).collect():
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)))
    near = lambda a, b: len(a) == len(b) and all(x[:4] == y[:4] and np.allclose(x[4:], y[4:], atol=3e-5) for x, y in zip(sorted(a), sorted(b), strict=True))
    assert got.keys() == want.keys() and all(near(got[i], want[i]) for i in want)


def test_busy_shards_are_split(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm_score._answers, "__defaults__", (50,))
    split = lm_score.score(table(spark, corpus), order=4, hot_grams=10, shard_grams=10**6).collect()
    monkeypatch.undo()
    whole = lm_score.score(table(spark, corpus), order=4).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
    assert sorted(map(key, split)) == sorted(map(key, whole))


def test_held_out_scores_beat_the_words(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    out = lm_score.score(spark.read.parquet(path)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


# ------------------------------------------------------------------ 6 fingerprints
def test_winnowing_keeps_the_rightmost_least_hash(spark, corpus):
    k, window = 4, 8
    rows = [*corpus, (600, "many words of a long text " * 11_000)]
    out = fingerprint.fingerprint(table(spark, rows), "text", "fp", k=k, window=window)
    got = out.select("doc_id", "text", "fp").collect()
    split = [(t or "").encode().lower().decode().split() for _, t in rows]
    known = {r.w: r.h % 2**64 for r in spark.createDataFrame([(w,) for w in {w for own in split for w in own}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    turn = lambda h, n: ((h << n) | (h >> (64 - n))) % 2**64
    for r, own in zip(got, split, strict=True):
        h = []
        for j in range(len(own) - k + 1):
            x = 0
            for q in range(k):
                x ^= turn(known[own[j + q]], k - 1 - q)
            h.append(x)
        fp = [(x.hash % 2**64, x.position) for x in r.fp]
        assert [p for _, p in fp] == sorted(p for _, p in fp)
        if len(h) >= window:
            least = lambda s: max(x for x in range(s, s + window) if h[x] >> 32 == min(v >> 32 for v in h[s : s + window]))  # noqa: B023, E731
            want = sorted({least(s) for s in range(0, len(h) - window + 1)})
            assert fp == [(h[p], p) for p in want]
        else:
            assert len(fp) == (1 if own else 0)


@pytest.mark.parametrize("rows_of_a_range", [4096, 7])
def test_edited_texts(spark, corpus, monkeypatch, rows_of_a_range):
    monkeypatch.setitem(fingerprint.in_order.__kwdefaults__, "rows", rows_of_a_range)
    rows = [*corpus, (None, "another lost text of some words"), (None, None), (5, "the same id again")]
    tie = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (-(1 << 63) if x[0] is None else x[0], tie[x[1] or ""]))
    frame = table(spark, rows).select("*", F.lit(1).alias("edited"), F.lit("z").alias("next"), F.lit(3).alias("fingerprint"))
    got = fingerprint.compare_with_edits(frame).collect()
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        want[i, t[: len(t) - q] + n[:q], len(t)] += 1
    assert Counter((r.doc_id, r.edited, r.n_chars) for r in got) == want
    prints = {x.text: {y.hash for y in x.fp} for x in fingerprint.fingerprint(table(spark, [(0, t or "") for _, t in rows] + [(0, e) for _, e, _ in want]), "text", "fp").select("text", "fp").collect()}
    alike = lambda a, b: 1.0 if not prints[a] | prints[b] else len(prints[a] & prints[b]) / len(prints[a] | prints[b])
    near = Counter()
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        near[i, round(alike(t, t[: len(t) - q] + n[:q]), 9), round(alike(t, n), 9)] += 1
    assert Counter((r.doc_id, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == near
    assert fingerprint.compare_with_edits(table(spark, [])).count() == 0


def test_places_among_many_bounds(spark):
    bounds = sorted({i * i - 500 for i in range(150)})
    values = [-600, -500, -499, 0, 4, 22000, 10**9]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", fingerprint.place_of(F.col("v"), bounds).alias("p")).collect()
    assert {r.v: r.p for r in got} == {v: sum(b <= v for b in bounds) for v in values}


# ------------------------------------------------------------------ 7 media
def test_media_round_trip(spark, corpus):
    rows = [*corpus, (600, "a long text, ÄÖ " * 20_000)]
    clash = table(spark, rows).select("*", F.lit("m").alias("media"), F.lit(1).alias("payload"), F.lit(2).alias("feature"))
    out = media.read_media(media.to_media(clash)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    for r in out:
        b = (r.text or "").encode()
        assert r.payload == b + b"\0" * ((-len(b)) % 64 or (64 if not b else 0)) and r.n_bytes == len(b) and r.n == 7
        pixels = np.frombuffer(r.payload, np.uint8).reshape(-1, 64).astype(float)
        edge = np.arange(33) * len(pixels) // 32
        tall = np.array([pixels[a : max(b, a + 1)].mean(0) for a, b in zip(edge[:-1], edge[1:], strict=True)])
        small = tall.reshape(32, 32, 2).mean(2)
        low = np.array([[sum(small[y] @ np.cos(np.pi * v * (2 * np.arange(32) + 1) / 64) * np.cos(np.pi * u * (2 * y + 1) / 64) for y in range(32)) for v in range(8)] for u in range(8)]).ravel()
        cut = np.median(low[1:])
        bits = np.unpackbits(np.frombuffer(r.feature, np.uint8))
        assert all(bit == (x > cut) for bit, x in zip(bits, low, strict=True) if abs(x - cut) > 1e-6)


def test_every_filter_is_undone_and_damage_is_seen():
    r = np.random.default_rng(3)
    image = r.integers(0, 256, (10, 16), dtype=np.uint8)
    rows = np.zeros((10, 17), np.uint8)
    for y in range(10):
        kind, up = y % 5, image[y - 1] if y else np.zeros(16, np.uint8)
        for x in range(16):
            a, b, c = (int(image[y, x - 1]) if x else 0), int(up[x]), (int(up[x - 1]) if x else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            rows[y, 1 + x] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256
        rows[y, 0] = kind
    assert (media.unfilter(rows) == image).all()
    smooth = np.cumsum(r.integers(0, 3, (40, 64)), 0).astype(np.uint8)
    smooth[20:] = np.cumsum(r.integers(0, 2, (20, 64)), 1)
    png = media.encode_png(smooth)
    assert (media.decode_png(png) == smooth).all() and len(png) < len(media.encode_png(r.integers(0, 256, (40, 64), dtype=np.uint8))) / 2
    import zlib as z

    kinds = np.frombuffer(z.decompress(png[41:-16]), np.uint8).reshape(40, 65)[:, 0]
    assert {1, 2} <= set(kinds.tolist())
    png = bytearray(media.encode_png(image))
    assert (media.decode_png(bytes(png)) == image).all()
    png[50] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.decode_png(bytes(png))
    near, far = image.copy(), 255 - image
    near[0, 0] ^= 1
    bits = lambda x: np.unpackbits(np.frombuffer(media.cosine_hash(x), np.uint8))
    assert (bits(image) != bits(near)).sum() <= 2 < (bits(image) != bits(far)).sum()


# ------------------------------------------------------------------ 9 SentencePiece
def test_sentencepiece_parity_and_round_trip(spark, corpus):
    P = pytest.importorskip("public_tokenizers")
    from sentencepiece import SentencePieceProcessor

    path = P.path("piece_bpe_32k.model")
    extra = ["  two  lead", "a\n\n  b\tc", "日本語 𝔘 😀   ", "aaaa aaaaa <s> </s> <0x41>", "\nx", " \n y", "\0abc d", "a \nb", " ", "\n", "a\n", "é $5.00, (x)"]
    rows = [*corpus, *((500 + i, t) for i, t in enumerate(extra)), (600, "long text, ÄÖ " * 20_000)]
    clash = table(spark, rows).select("*", F.lit("m").alias("ids"), F.lit(1).alias("parity"), F.lit(2).alias("decoded"))
    out = sentencepiece.decode(sentencepiece.encode(clash, path, parity=True), path).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    sp = SentencePieceProcessor(model_file=path)
    for r in out:
        assert list(r.ids) == sp.encode(r.text or "") and r.parity and r.decoded == (r.text or ""), r.text


def test_words_of_pair_merges_are_encoded_once(spark):
    """Words whose ids are those of the text are remembered; models with pieces over several words encode whole texts.  Null ids stay null."""
    P = pytest.importorskip("public_tokenizers")
    from sentencepiece import SentencePieceProcessor

    path = P.path("piece_bpe_32k.model")
    own, sp = sentencepiece.Encoder(path, False, 1), SentencePieceProcessor(model_file=path)
    texts = ["", " ", "▁a ▁", "two  words\n\n 12,345 é日", "two  words\n\n 12,345 é日 again", "\u0301x \U0001f600\U0001f600"]
    assert own.encode(texts)[0] == sp.encode(texts)
    met = len(own.words.known)
    assert own.encode(texts * 3)[0] == sp.encode(texts * 3) and len(own.words.known) == met
    own.words.most = 0
    assert own.encode(["other words"])[0] == sp.encode(["other words"]) and set(own.words.known) == {"▁other", "▁words"}
    with open(path, "rb") as f:
        model = sentencepiece.Model.parse(f.read())
    assert sentencepiece.word_pattern(model).findall("▁▁a1\n▁b") == ["▁▁a", "1\n", "▁b"]
    model.pieces.append(("a▁b", -1.0, sentencepiece.NORMAL))
    assert sentencepiece.word_pattern(model) is None
    rows = [(1, [10, 11]), (2, None), (3, []), (4, own.encode(["a b"])[0][0])]
    out = {r.i: r.decoded for r in sentencepiece.decode(spark.createDataFrame(rows, "i int, ids array<int>").coalesce(1), path).collect()}
    assert out == {i: None if x is None else sentencepiece.decoder(path).decode(x) for i, x in rows} and out[2] is None and out[3] == "" and out[4] == "a b"


def test_unigram_models_are_rebuilt():
    m = sentencepiece.Model([("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁a", -1.0, 1), ("b", -3.0, 1), ("ab", -1.5, 1)], 1)
    assert sentencepiece.build(m).encode("a ab", add_special_tokens=False).tokens == ["▁a", "▁", "ab"]


# ------------------------------------------------------------------ 10 URL filter
@pytest.mark.parametrize("inline", [256, 0])
def test_urls(spark, inline):
    urls = ["http://A.Example.org/es/1?x", "https://example.org/en/12", "https://x.org/", "https://x.org", "ftp://shop.com/fr/a", "http://com/de/", "http://notcom/de/", "no url", None, "", "http://www.spam-farm.example.net/x", "http://e.org\n/es/", "https://u@example.com:80/de/", "://example.org/en/1", "http://spammer.net/", "http://x.net/" + "spam/" * 60_000, "http://x.org/", "http://x.org/"]
    rules = [url_filter.site_rule(t, v) for t, v in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))]
    pages = spark.createDataFrame([(i, u, "x", "h", 1, "t") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string, verdict int, token string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, fallback=[url_filter.word_rule("spam", "block")], inline=inline).collect()}
    want = []
    for u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (m[1].lower(), m[2]) if m else ("", "")
        fit = [r.text for r in rules if (h == r.text.split("/")[0] or h.endswith("." + r.text.split("/")[0])) and p.startswith(r.text[r.text.index("/") :])]
        best = max(fit, key=len, default=None)
        want.append((best, next((r.verdict for r in rules if r.text == best), "block" if re.search(r"(^|[._-])spam([._-]|$)", h) else "allow")))
    assert [got[i] for i in range(len(urls))] == want


# ------------------------------------------------------------------ all
def test_empty_tables(spark):
    none, labels = table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    P = pytest.importorskip("public_tokenizers")
    frames = [
        packing.pack(none, P.path("word_bpe_49k.json")), line_dedup.drop_frequent_lines(none), toxicity.severity(none, toxicity.fit(none, labels)), near_dedup.near_duplicates(none), lm_score.score(none),
        fingerprint.fingerprint(none, "text", "fp"), media.read_media(media.to_media(none)), quality.importance_resample(none, labels), sentencepiece.encode(none, P.path("piece_bpe_32k.model")),
        url_filter.judge(spark.createDataFrame([], "url string"), [url_filter.site_rule("org/", "allow")]),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_line_dedup_and_packing_of_long_and_repeated_texts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    line = "a line of more than forty code points, which is in all texts"
    rows = [(i, f"{line}\nown {i}") for i in range(6)] + [(3, f"{line}\nown 3"), (50, "word " * 80_000 + "\n" + line), (None, line)]
    clash = table(spark, rows).select("*", F.lit(1).alias("h1"), F.lit("d").alias("doc"), F.lit("p").alias("piece"), F.lit("k").alias("length"))
    out = line_dedup.drop_frequent_lines(clash).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t if i in (50, None) else t[len(line) + 1 :]) for i, t in rows)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = defaultdict(list)
    for r in sorted(packing.pack(clash, P.path("word_bpe_49k.json")).where("doc_id = 50").collect(), key=lambda r: r.piece):
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert ids[50] == [*t.encode(rows[-2][1], add_special_tokens=False).ids, 0]


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, selected int, toxic string, task int"


@pytest.mark.parametrize("name", ["quality", "toxicity", "line_dedup", "near_dedup", "packing"])
def test_pipeline_stages(spark, tmp_path, name):
    """Nulls, empty, long and repeated texts, ties, an empty table and clashing names, in each stage."""
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    docs, labels, flags = labelled(spark, 300)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    line = "this line of over forty code points stands in many documents"
    odd = [(900, None), (901, ""), (902, " \n\t"), (None, "lost"), (None, "lost"), (903, "word " * 80_000), docs[0], (docs[0][0], docs[1][1]), *((910 + i, line) for i in range(6)), (917, f"{line}\n\t\x0b\n"), (920, line + "\nrest")]
    rows = [(i, t, "en", None, 5, "k", 1, "x", 2) for i, t in [*docs, *odd]]
    stage = dict(corpus_pipeline.STAGES)[name]
    given = spark.createDataFrame(rows, STAGE_SCHEMA)
    got = stage(spark, given, str(tmp_path))
    assert stage(spark, given.limit(0), str(tmp_path)).count() == 0
    if name != "packing":
        assert got.columns == list(corpus_pipeline.COLUMNS)
    out = Counter(r.doc_id for r in got.collect())
    same = lambda a: Counter(i for i, _ in [*docs, *odd] if i in a)
    if name in ("quality", "toxicity"):
        clean = {i for i, q, t in flags if (q if name == "quality" else not t)}
        assert len(clean - out.keys()) <= 2 and len((out.keys() & {i for i, *_ in flags}) - clean) <= 3
        if name == "toxicity":
            assert out[900] == out[901] == out[902] == out[903] == 1 and out[None] == 2
    elif name == "line_dedup":
        assert {i for i in out if i is not None and 910 <= i < 920} == set() and out[920] == out[900] == out[901] == out[902] == 1 and out[None] == 2
        text = {r.doc_id: (r.text, r.n_chars) for r in got.where("doc_id >= 900").collect()}
        assert text[920] == (f"{line}\nrest", len(line) + 5) and text[900] == ("", 0)
    elif name == "near_dedup":
        assert out[910] == 1 and not any(out[i] for i in range(911, 916)) and out[None] == 2 and out[900] == out[901] == out[902] == 1 and out[docs[0][0]] == 2 and not out[docs[1][0]]
    else:
        assert out.keys() == same({i for i, _ in [*docs, *odd]}).keys() and out[None] == 2 and out[903] > 30


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    docs, labels, flags = labelled(spark)
    docs = [*docs, *((1000 + i, t) for i, t in docs[:30])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    good = {i for i, q, t in flags if q and not t}
    assert len(good - kept) <= 2 and len(kept - good) <= 6
    one = corpus_pipeline.run(spark, str(tmp_path)).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in one)
