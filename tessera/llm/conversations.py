"""Repair of conversations' structure by cheapest edits, streamed in secondary order.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Turns are kept (0), get another role (3) or go (4, must for blank
and repeated ones); turns without a text are put in (3); a truncated turn that stays costs 3 more.  Of the cheapest series of
edits the one whose initials come first in ASCII order is taken.

The state of the search is small: for each of four states of that expression, how much more than the best it cost to get
there and how the series of edits that lead there are ordered.  States more than 7 above the best can't come back, so
there are few such vectors; all of them and their steps by kind of turn are listed once, and a turn is one look-up.  What is left of
the way here, its number (node, kind), is the back pointer, two bytes a turn.

Turns are dealt by ranges of conversation and order, so that a giant conversation lies in several tasks, sorted, and put into
chunks of bounded size.  A conversation that lies inside a task in one chunk is solved there.  Chunks of the
others are dealt by conversation and sorted; the search's node goes from batch to batch, back pointers are written
for each chunk, the way back reads them from the last chunk to the first, and hashes run over chunks of repaired text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shared

# kinds of turns: the role's initial (s, u, a, another), and faults
OTHER, BLANK, DUPLICATE, TRUNCATED = 3, 4, 8, 16
#: Where an initial leads: start, after s, after u, after a.  The start and the state after an assistant may end.
STEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
INSERT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, 3)
#: No state that is more than this above the best one is on a cheapest way: every state can follow any other's way for so much.
SPREAD = 7
CLASSES = 9  # an initial, an initial of a truncated turn, or a turn that must go

Vector = tuple[tuple[int, int] | None, ...]


def _inserted(q: int) -> Iterator[tuple[int, int]]:
    """After none, one and two inserted turns: (state, number); more lead to a state that fewer lead to."""
    for k in range(3):
        yield q, k
        q = INSERT[q]


def _advance(vector: Vector, kind: int) -> tuple[Vector, int, tuple]:
    """The vector after a turn, the best cost's growth, and for each state (state before, edits)."""
    best: list = [None] * 4

    def offer(q: int, cost: int, series: tuple, way: tuple) -> None:
        if best[q] is None or (cost, series) < best[q][:2]:
            best[q] = (cost, series, way)

    for q, entry in enumerate(vector):
        if entry is None:
            continue
        cost, rank = entry
        for r, k in _inserted(q):
            put = lambda to, more, edit: offer(to, cost + 3 * k + more, (rank, "I" * k + edit), (q, "I" * k + edit))  # noqa: B023, E731
            put(r, 4, "D")
            if kind < 8:
                extra = 3 * (kind >= 4)
                if (r, kind % 4) in STEP:
                    put(STEP[r, kind % 4], extra, "K")
                put(INSERT[r], 3 + extra, "R")
    low = min(b[0] for b in best if b)
    best = [b if b and b[0] <= low + SPREAD else None for b in best]
    # no series that ends with a turn's own edit begins another: the order of two is that of their first difference
    order = {b[1]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1]))}
    return tuple((b[0] - low, order[b[1]]) if b else None for b in best), low, tuple(b[2] if b else None for b in best)


def _finish(vector: Vector) -> tuple[int, int, str]:
    """(cost, last state before inserted turns, those turns' edits) of the cheapest end."""
    cost, _, q, edits = min((c + 3 * k, (rank, "I" * k), q, "I" * k) for q, e in enumerate(vector) if e for c, rank in [e] for r, k in _inserted(q) if r in ENDS)
    return cost, q, edits


@functools.cache
def search() -> tuple[list[int], list[int], list[tuple], list[tuple[int, int, str]]]:
    """All vectors: by node * CLASSES + kind the next node, the cost and the ways; by node its end."""
    nodes: dict[Vector, int] = {((0, 0), None, None, None): 0}
    queue, following, costs, ways = [next(iter(nodes))], [], [], []
    for vector in queue:
        for kind in range(CLASSES):
            after, cost, way = _advance(vector, kind)
            if after not in nodes:
                nodes[after] = len(nodes)
                queue.append(after)
            following.append(nodes[after])
            costs.append(cost)
            ways.append(way)
    return following, costs, ways, [_finish(v) for v in queue]


_CLASS = bytes(8 if k & (BLANK | DUPLICATE) else (k & 3) + (4 if k & TRUNCATED else 0) for k in range(256))


def forward(kinds: bytes, node: int) -> tuple[np.ndarray, int, int]:
    """Back pointers of a run of turns, the node after it and the cost added."""
    following, costs, _, _ = search()
    trace, cost = [], 0
    for c in kinds.translate(_CLASS):
        t = node * CLASSES + c
        trace.append(t)
        cost += costs[t]
        node = following[t]
    return np.array(trace, "<u2"), node, cost


def backward(trace: np.ndarray, state: int) -> tuple[str, int]:
    """The edits of a run of turns that ends in ``state``, and the state before it."""
    ways, edits = search()[2], []
    for t in trace[::-1].tolist():
        state, edit = ways[t][state]
        edits.append(edit)
    return "".join(reversed(edits)), state


def edited(edits: str, state: int, initials: bytes, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns of a run that begins in ``state``."""
    at = 0
    for edit in edits:
        if edit == "I":
            state = INSERT[state]
            yield edit, ROLE[state], ""
            continue
        if edit == "K":
            state = STEP[state, initials[at] & 3]
            yield edit, roles[at], texts[at]
        elif edit == "R":
            state = INSERT[state]
            yield edit, ROLE[state], texts[at]
        at += 1


def _faults(kinds: bytes) -> tuple[int, int, int]:
    k = np.frombuffer(kinds, np.uint8)
    blank, again = k & BLANK > 0, k & DUPLICATE > 0
    return int(blank.sum()), int((again & ~blank).sum()), int((~blank & ~again & (k & TRUNCATED > 0)).sum())


def _illegal(kinds: bytes, before: int | None = None) -> int:
    k = np.frombuffer(kinds, np.uint8) & 3
    if before is not None:
        k = np.concatenate([[before], k])
    a, b = k[:-1], k[1:]
    return int((~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))).sum())


# ------------------------------------------------------------------ turns to chunks
CHUNK = "conv string, part int, chunk int, whole boolean, kinds binary, roles array<string>, texts array<string>, first_turn long, last_turn long, turns long, places array<int>, marks array<binary>"
PLACE = ["conv", "part", "chunk"]


class _Open:
    """A chunk that is being filled."""

    def __init__(self, conv: str, number: int):
        self.conv, self.number, self.kinds, self.roles, self.texts = conv, number, bytearray(), [], []
        self.first = self.last = None
        self.turns, self.size, self.places, self.marks = 0, 0, [], []

    def row(self, part: int, whole: bool) -> tuple:
        places, marks = ([], []) if whole else (self.places, self.marks)
        return (self.conv, part, self.number, whole, bytes(self.kinds), self.roles, self.texts, self.first or 0, self.last or 0, self.turns, places, marks)


def _chunks(most_rows: int, most_bytes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [x.split()[0] for x in CHUNK.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, own, first, seen, ready = TaskContext.get().partitionId(), None, True, set(), []
        for frame in frames:
            for conv, known, turn, role, text, kind, mark in zip(*(frame[c].tolist() for c in ("conv", "known", "turn", "role", "text", "kind", "mark")), strict=True):
                if own is None or conv != own.conv:
                    if own is not None:
                        # a task's first and last conversation may go on in other tasks
                        ready.append(own.row(part, own.number == 0 and not first))
                        first = False
                    own, seen = _Open(conv, 0), set()
                elif len(own.kinds) >= most_rows or own.size >= most_bytes:
                    ready.append(own.row(part, False))
                    own = _Open(conv, own.number + 1)
                if not kind & BLANK:
                    if mark in seen:
                        kind |= DUPLICATE
                    else:
                        seen.add(mark)
                        own.places.append(len(own.kinds))
                        own.marks.append(mark)
                if known:
                    if own.turns == 0:
                        own.first = turn
                    own.turns += own.turns == 0 or turn != own.last
                    own.last = turn
                own.kinds.append(kind)
                own.roles.append(role)
                own.texts.append(text)
                own.size += len(text)
            if ready:
                yield pd.DataFrame(ready, columns=names)
                ready = []
        if own is not None:
            yield pd.DataFrame([own.row(part, False)], columns=names)

    return run


def _streamed(names: list[str], begin: Callable, each: Callable, end: Callable | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function over sorted rows that carries one conversation's state from row to row and from batch to batch.

    ``begin(row)`` makes the state, ``each(state, row)`` changes it and may return a row, ``end(state)`` likewise.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if conv is None or row.conv != conv:
                    if conv is not None and end:
                        out.append(end(state))
                    conv, state = row.conv, begin(row)
                made = each(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)
        if conv is not None and end:
            yield pd.DataFrame([end(state)], columns=names)

    return run


def _forward(state: dict, row) -> tuple:
    trace, state["node"], cost = forward(row.kinds, state["node"])
    return (*row[:3], trace.tobytes(), state["node"], cost)


def _backward(state: dict, row) -> tuple:
    if "state" not in state:  # the last chunk
        cost, state["state"], tail = search()[3][row.node]
    else:
        cost, tail = 0, ""
    edits, state["state"] = backward(np.frombuffer(row.trace, "<u2"), state["state"])
    return (*row[:3], edits + tail, state["state"], row.cost + cost)


SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Summary:
    """A conversation's numbers, gathered from its chunks in order."""

    def __init__(self, conv: str):
        self.conv, self.faults, self.illegal, self.cost, self.edits, self.hash = conv, np.zeros(3, np.int64), 0, 0, [], hashlib.sha256()
        self.least = self.last = self.initial = None
        self.turns, self.any = 0, False

    def add(self, kinds: bytes, first: int, last: int, turns: int, edits: str, cost: int, repaired: bytes | None) -> None:
        self.faults += _faults(kinds)
        self.illegal += _illegal(kinds, self.initial)
        self.initial = kinds[-1] & 3
        if turns:
            self.turns += turns - (self.last is not None and first == self.last)
            self.least = first if self.least is None else self.least
            self.last = last
        self.cost += cost
        self.edits.append(edits)
        if repaired is not None:
            self.hash.update(b"\n" + repaired if self.any else repaired)
            self.any = True

    def row(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *map(int, self.faults), self.illegal, self.cost, "".join(self.edits), self.hash.hexdigest())


def _lines(edits: str, state: int, kinds: bytes, roles, texts) -> bytes | None:
    """The repaired turns as lines; None if there are none."""
    out = [f"{role}:{text}" for _, role, text in edited(edits, state, kinds, roles, texts)]
    return "\n".join(out).encode() if out else None


def _solved(kinds: bytes) -> tuple[str, int]:
    trace, node, cost = forward(kinds, 0)
    more, state, tail = search()[3][node]
    return backward(trace, state)[0] + tail, cost + more


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            own = _Summary(row.conv)
            edits, cost = _solved(row.kinds)
            own.add(row.kinds, row.first_turn, row.last_turn, row.turns, edits, cost, _lines(edits, 0, row.kinds, row.roles, row.texts))
            out.append(own.row())
        yield pd.DataFrame(out, columns=names)


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["repaired"] = [_lines(*row) for row in zip(*(frame[c] for c in ("edits", "state", "kinds", "roles", "texts")), strict=True)]
        yield frame.drop(columns=["roles", "texts", "state"])


def _gather(state: _Summary, row) -> None:
    state.add(row.kinds, row.first_turn, row.last_turn, row.turns, row.edits, row.cost, row.repaired)


def _turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            edits, state = (row.edits, row.state) if isinstance(row.edits, str) else (_solved(row.kinds)[0], 0)
            out += [(row.conv, row.part, row.chunk, i, *x) for i, x in enumerate(edited(edits, state, row.kinds, row.roles, row.texts))]
        yield pd.DataFrame(out, columns=[*PLACE, "place", "edit", "role", "text"])


class Repaired:
    """What a repair found: ``conversations`` (a row each) and, on demand, the repaired ``turns()``."""

    def __init__(self, conversations: DataFrame, chunks: DataFrame, loose: DataFrame, found: DataFrame, kind):
        self.conversations, self._chunks, self._loose, self._found, self._kind = conversations, chunks, loose, found, kind

    def turns(self) -> DataFrame:
        """(conv_id, part, chunk, place, edit, role, text): turns in the order of part, chunk and place; edits K, R and I."""
        columns = [*PLACE, "kinds", "roles", "texts"]
        whole = self._chunks.where("whole").select(*columns, F.lit(None).cast("string").alias("edits"), F.lit(0).alias("state"))
        loose = self._loose.select(*columns).join(self._found.select(*PLACE, "edits", "state"), PLACE)
        rows = whole.unionByName(loose).mapInPandas(_turns, "conv string, part int, chunk int, place int, edit string, role string, text string")
        return rows.select(_named(F.col("conv"), self._kind).alias("conv_id"), "part", "chunk", "place", "edit", "role", "text")


def _key(conv: Column) -> Column:
    return F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string")))


def _named(key: Column, kind) -> Column:
    return F.when(key != "", F.substring(key, 2, 1 << 30)).cast(kind)


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_rows: int = 1 << 14, chunk_bytes: int = 1 << 20) -> Repaired:
    """Repairs conversations of ``turns``, taken by turn (nulls first), then role and text.

    ``conversations`` has (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): turn numbers
    missing between the least and the largest; turns by their first fault (nothing but blanks, role and text seen
    earlier, last sign not one of ``.!?``); neighbours whose initials aren't su, ua or au; the edits' cost and initials;
    the SHA-256 of ``role:text`` lines.

    Null roles and texts are one blank.  A role without an initial, like any initial but s, u and a, can't be kept.  Null
    conversation ids are one conversation, null turns come first and count for no gap.  Repeated rows repeat turns, so
    all but the first are duplicates.  Bytes that aren't UTF-8 become U+FFFD.  Other columns are ignored, whatever their
    names.  Texts are compared by 128-bit digests.  An empty table gives no conversations.
    """
    spark = turns.sparkSession
    shared.small_batches(spark)
    scratch = shared.Scratch(spark, "conversations")
    kind = turns.select(shared.quoted(conv_col)).schema[0].dataType
    role, text = (shared.valid_text(F.coalesce(shared.quoted(c).cast("string"), F.lit(" "))) for c in (role_col, text_col))
    rows = turns.select(_key(shared.quoted(conv_col)).alias("conv"), shared.quoted(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    bare = shared.strip_blanks(F.col("text"))
    initial = F.left("role", F.lit(1))
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    mark = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    # ranges of the order itself: rows that agree in all of it, up to the beginning of their texts, meet in one task
    dealt = rows.repartitionByRange("conv", F.asc_nulls_first("turn"), "role", F.left("text", F.lit(32))).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    flat = dealt.select("conv", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", (number + fault).alias("kind"), mark.alias("mark"))
    chunks = scratch.table(flat.mapInPandas(_chunks(chunk_rows, chunk_bytes), CHUNK))
    whole = chunks.where("whole").drop("places", "marks").mapInPandas(_whole, SUMMARY)
    loose, found = _over_tasks(scratch, chunks.where("not whole"))
    small = [*PLACE, "kinds", "first_turn", "last_turn", "turns"]
    pieces = loose.select(*small, "roles", "texts").join(found, PLACE).select(*small, "roles", "texts", "edits", "state", "cost")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("roles", "texts", "state"))
    made = _in_order(pieces.mapInPandas(_pieces, fields + ", repaired binary"))
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    united = whole.unionByName(made.mapInPandas(_streamed(names, lambda row: _Summary(row.conv), _gather, _Summary.row), SUMMARY))
    return Repaired(united.select(_named(F.col("conv"), kind).alias("conv_id"), *names[1:]), chunks, loose, found, kind)


def _in_order(df: DataFrame, order: Callable = F.asc) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions("conv", order("part"), order("chunk"))


def _over_tasks(scratch: shared.Scratch, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of conversations that lie in several chunks or may lie in several tasks, with repeats found over all of
    them, and (conv, part, chunk, edits, state, cost)."""
    # a task lists a digest once, so a digest's rows are at most as many as tasks
    marks = chunks.select(*PLACE, F.explode(F.arrays_zip("places", "marks")).alias("m")).select(*PLACE, F.col("m.places").alias("place"), F.col("m.marks").alias("mark"))
    nth = F.row_number().over(Window.partitionBy("conv", "mark").orderBy("part", "chunk", "place"))
    again = marks.withColumn("nth", nth).where("nth > 1").groupBy(*PLACE).agg(F.collect_list("place").alias("again"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema if f.name not in ("places", "marks", "whole"))

    def marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kinds = []
            for k, at in zip(frame["kinds"], frame["again"], strict=True):
                own = np.frombuffer(k, np.uint8).copy()
                if at is not None:
                    own[np.asarray(at, np.int64)] |= DUPLICATE
                kinds.append(own.tobytes())
            frame["kinds"] = kinds
            yield frame.drop(columns=["again"])

    loose = scratch.table(chunks.drop("places", "marks", "whole").join(again, PLACE, "left").mapInPandas(marked, fields))
    names = [*PLACE, "trace", "node", "cost"]
    traces = scratch.table(_in_order(loose.select(*PLACE, "kinds")).mapInPandas(_streamed(names, lambda row: {"node": 0}, _forward), "conv string, part int, chunk int, trace binary, node int, cost long"))
    ways = _in_order(traces, F.desc).mapInPandas(_streamed([*PLACE, "edits", "state", "cost"], lambda row: {}, _backward), "conv string, part int, chunk int, edits string, state int, cost long")
    return loose, scratch.table(ways)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user.  Nulls are one blank."""
    blank = F.lit(" ")
    n = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    rows = turns.select(
        "conv_id", "turn", n.alias("n"), F.when(n == 4, "user").otherwise(role).alias("role"), F.when(n == 1, "").when(n == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).where("n <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("n", "copy")
