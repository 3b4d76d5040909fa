"""Repair of conversations against a search over whole series of edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
from tessera.llm import conversations, queries  # noqa: E402

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults_of(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired) by Dijkstra over (cost, audit), whose states are the initials so far."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, made = heapq.heappop(heap)
        end = initials[-1:] in ("", "a")
        if i == len(rows) and end:
            return cost, audit, made
        state = (i, initials if initials in ("", "s") else initials[-1])
        if (state, cost, audit) in done or len(initials) > 2 * len(rows) + 4:
            continue
        done.add((state, cost, audit))
        fits = lambda x: bool(re.fullmatch(r"s?(ua)*u?", initials + x))  # noqa: B023, E731
        for role in ("user", "assistant"):
            if fits(role[0]) and audit[-2:] != "II":
                heapq.heappush(heap, (cost + 3, audit + "I", i, initials + role[0], (*made, (role, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, initials, made))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if role[:1] and role[0] in "sua" and fits(role[0]):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initials + role[0], (*made, (role, text))))
                for other in ("user", "assistant"):
                    if fits(other[0]):
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, initials + other[0], (*made, (other, text))))


def summary(rows):
    """Columns of one conversation of (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    known = [t for t, _, _ in rows if t is not None]
    own = [(r, x) for _, r, x in rows]
    faults = faults_of(own)
    cost, audit, made = cheapest(own, faults)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def grouped(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return out


def odd_rows(n=60, seed=1):
    r = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sam"], ["Yes.", "no", "Well!", "", " \n", None, "A?", "é. ", "b"]
    return [(c, r.choice([None, t, t, t, t + 3]), r.choice(roles), r.choice(texts)) for c in range(n) for t in range(r.randint(1, 7))]


def plain(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize(("rows_", "bytes_"), [(1 << 14, 1 << 20), (2, 1 << 20), (100, 1)])
def test_repair(spark, rows_, bytes_):
    rows = [*odd_rows(), (None, 1, "user", "Lost."), (None, 2, "assistant", "Found.")]
    got = plain(conversations.repair(spark.createDataFrame(rows, SCHEMA), chunk_rows=rows_, chunk_bytes=bytes_).conversations)
    want = {c: summary(own) for c, own in grouped(rows).items()}
    assert got == want


def test_one_conversation_over_many_tasks(spark):
    r = random.Random(2)
    rows = [(7, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["One.", "Two", f"{t}.", ""])) for t in range(3000)]
    rows += [(c, 0, "user", "Hi.") for c in range(20)]
    found = conversations.repair(spark.createDataFrame(rows, SCHEMA).repartition(7), chunk_rows=64)
    got = plain(found.conversations)
    assert set(got) == set(range(20))
    first = sorted((role, text) for c, t, role, text in rows if c == 7 and t == 0)
    turns = first + [(role, text) for c, t, role, text in rows if c == 7 and t > 0]
    faults = faults_of(turns)
    kinds = bytes(
        ("sua".index(role[0]) if role[0] in "sua" else 3) + {"blank": 4, "duplicate": 8, "truncated": 16, "": 0}[f] for (role, _), f in zip(turns, faults, strict=True)
    )
    edits, cost = conversations._solved(kinds)
    assert got[7][1:4] == tuple(faults.count(x) for x in ("blank", "duplicate", "truncated")) and got[7][5:7] == (cost, edits)
    repaired = list(conversations.edited(edits, 0, kinds, [x for x, _ in turns], [x for _, x in turns]))
    assert got[7][7] == hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in repaired).encode()).hexdigest()
    shown = found.turns().where("conv_id = 7").orderBy("part", "chunk", "place").select("edit", "role", "text")
    assert [tuple(x) for x in shown.collect()] == repaired
    assert re.fullmatch("s?(ua)+", "".join(x[1][0] for x in repaired))


def test_all_short_conversations():
    kinds = [0, 1, 2, 3, 4, 16, 17, 18, 19]
    for n in range(4):
        for own in itertools.product(kinds, repeat=n):
            rows = [(["system", "user", "assistant", "tool"][k & 3], "x") for k in own]
            faults = ["blank" if k & 4 else "truncated" if k & 16 else "" for k in own]
            cost, audit, made = cheapest(rows, faults)
            edits, total = conversations._solved(bytes(own))
            assert (total, edits) == (cost, audit)
            assert [x[1:] for x in conversations.edited(edits, 0, bytes(own), [x for x, _ in rows], [x for _, x in rows])] == list(made)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(conv, turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    return out


def test_query(spark, tmp_path):
    rows = odd_rows(80, seed=5) + [(None, 3, "user", "x."), (900, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    after = grouped(damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert plain(got) == {c: summary(after[c]) if c in after else nothing for c in {r[0] for r in rows}}


def test_given_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    got = plain(queries.op11_conversation_repair(spark, "/root/testdata/sf0.001"))
    after = grouped(damaged(rows))
    assert {c: v for c, v in got.items() if c in after} == {c: summary(own) for c, own in after.items()} and len(got) == len({r[0] for r in rows})


def test_odd_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, 0, "user", "Hi.", 5, 6, 7)], SCHEMA + ", `a.b` int, CONV int, kind int")
    assert plain(conversations.repair(docs).conversations)[1][5:7] == (3, "KI")
    assert conversations.repair(docs.limit(0)).conversations.collect() == []
    named = docs.select(F.col("conv_id").cast("string").alias("Conversation"), "turn", "role", F.col("text").alias("Body"))
    assert conversations.repair(named, conv_col="conversation", text_col="body").conversations.first().conv_id == "1"
    broken = spark.sql("select 1L conv_id, 0L turn, 'user' role, cast(x'61ff2e' as string) text")
    assert conversations.repair(broken).conversations.first().truncated == 0
