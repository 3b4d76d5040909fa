"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct word shingles.  The smallest ``sketch`` hashes are its sketch.

1. Documents with equal sets form a class; its smallest id stands for it.
2. Inverted lists of retained values: each of the ``lists`` smallest hashes of a class has a list, divided by the value
   that follows it in the sketch; the two values are the list's key.  A list holds the classes whose sketches overlap in
   these two values.  Two sets with similarity s share two neighbours in the order of their union with probability s*s, so
   they share no key with probability 5e-9 at s = 0.85 and 2e-7 at s = 0.8, if one holds the other, and less else (and
   share one for certain while both sets lie inside the sketch).  A list of one value alone would hold every text with
   some shared passage; divided by the next value it seldom does.  How many values two sketches share is counted on
   the union sketch, in step 3, for the pairs that the lists give.
3. In each list the class with the most company is the centre; every other class is compared with it: one pair for each
   entry of a list, however long the list.  Pairs are estimated on the sketch of the union, then confirmed on full sets.
4. Connected components follow.  What may still link two components is then compared as well:
   classes that are alike but not linked (families, by estimate) and the entries of lists, within lists of at most
   ``short`` entries pair by pair.  For the classes of longer lists, lists by the prefixes of their full sets take their
   place: ordered by how common a shingle is, two linked sets of sizes n share one of their n - ceil(s*n) + 1 first for
   certain.  Those that are still long, like families, are compared exactly in blocks of bounded size, by products of
   incidence matrices.  So no link between components is lost; links inside one change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared

#: Positions of the bitmap that keeps texts out of the verification pass; its size is fixed, whatever the input.
BITMAP = 1 << 20

#: Shingles that are ranked by how common they are, at most; the others come first, in any order.
RANKED = 1 << 16


def _sets(data: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    h, at = shared.token_hashes(data, bounds)
    grams = shared.join_hashes(h, n)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield shared.join_hashes(h[a:b], b - a) if b > a else h[:0]


def _sketches(shingle: int, k: int, r: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("key_1", pa.int64()), ("key_2", pa.int64()), ("sketch", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = shared.text_bytes(batch.column(2))
            for lo, hi, part, at in shared.chunks(data, bounds):
                sizes, keys, sketches, lists = [], [], [], []
                for s in _sets(part, at, shingle):
                    mixed = shared.mix(s)
                    sizes.append(len(s))
                    keys.append((int(s.sum(dtype=np.uint64)), int(mixed.sum(dtype=np.uint64))) if len(s) else (0, 0))
                    sketches.append(s[:k])
                    low = s[:r]
                    lists.append(shared.mix(low[:-1] * np.uint64(0x9E3779B97F4A7C15) + low[1:]))
                cut = lambda x: np.concatenate([[0], np.cumsum([len(y) for y in x])])
                both = np.array(keys, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(lo, hi - lo).columns[:2], pa.array(sizes, pa.int64()), pa.array(both[:, 0].view(np.int64) if len(both) else [], pa.int64()),
                        pa.array(np.ascontiguousarray(both[:, 1]).view(np.int64), pa.int64()),
                        # the top bit is flipped: as signed numbers they keep the order in which they were chosen
                        shared.lists(shared.signed(np.concatenate(sketches) ^ np.uint64(1 << 63)), cut(sketches)), shared.lists(shared.signed(np.concatenate(lists)), cut(lists)),
                    ],
                    schema=schema,
                )

    return shared.frugal(run)


def _full_sets(shingle: int, wanted: np.ndarray):
    """Full sets of the documents whose place in the bitmap is set."""
    schema = pa.schema([("doc_id", pa.int64()), ("key_1", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column(1).to_numpy()] > 0))
            data, bounds = shared.text_bytes(batch.column(2))
            for lo, hi, part, at in shared.chunks(data, bounds):
                sets = list(_sets(part, at, shingle))
                cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                keys = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(shared.signed(keys)), shared.lists(shared.signed(np.concatenate(sets)), cut)], schema=schema)

    return shared.frugal(run)


def _counts(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """How many sets of a partition have each shingle; beyond ``most`` different ones, counts are passed on in parts."""

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def given(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "count"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append(np.unique(batch.column(0).flatten().to_numpy(), return_counts=True))
        if len(held) > 8:
            held = [rows(held)]
            if len(held[0][0]) > most:
                yield given(*held[0])
                held = []
    if held:
        yield given(*rows(held))


def _prefixes(common: np.ndarray, percent: int):
    """The first shingles of each set in one order of all shingles: rising by place in ``common`` (-1 outside), then by value.

    Sets of sizes n and m that are linked have ceil(percent * n / 100) shingles in common or more, so the first
    n - ceil(percent * n / 100) + 1 of one and of the other have one in common, whatever the order is.
    """
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("family", pa.int64()), ("key", pa.int64())])
    by_value = np.argsort(common)
    values = common[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(2)
            n, flat = sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy()
            rank = np.full(len(flat), -1)
            if len(values):
                at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
                rank = np.where(values[at] == flat, by_value[at], -1)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, rank, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            first = place <= (n - (n * percent + 99) // 100)[row]
            of = row[first]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(n[of]), batch.column(1).take(pa.array(of)), pa.array(flat[order[first]])], schema=schema)

    return shared.frugal(run)


#: A key is hot if it has more than this share of all rows; so there are fewer hot keys than its inverse.
HOT = 1 / 1024


def components(scratch: shared.Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label of that label; rounds are written
    tables.  Labels are reduced before the shuffle, and those of hubs, at most 1023 nodes that a HOT share of all edges
    leads to, are broadcast, so no task sees all edges of a hub.
    """
    both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    hubs = scratch.table(both.groupBy("b").count().where(F.col("count") > max(1000.0, both.count() * HOT)).select(F.col("b").alias("node")))
    usual = both.join(F.broadcast(hubs), both.b == hubs.node, "left_anti")
    some = not hubs.isEmpty()
    while True:
        near = usual.join(labels, usual.b == labels.node).select("a", "component")
        if some:
            of_hubs = labels.join(F.broadcast(hubs), "node", "left_semi")
            near = near.union(both.join(F.broadcast(of_hubs), both.b == of_hubs.node).select("a", "component"))
        near = near.groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = scratch.table(step.join(up, "component").select("node", "was", F.least("component", "up").alias("component")))
        scratch.drop(labels)
        labels = new
        if labels.where("was <> component").isEmpty():
            scratch.drop(both, hubs)
            return labels.select("node", "component")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, sketch: int = 64, lists: int = 24, short: int = 64, slack: float = 0.3
) -> DataFrame:
    """One row for each document: (doc_id, n_shingles, component_id, kept, text_key).

    Documents are linked when 100 * intersection >= percent * union of their word-shingle sets; ``component_id`` is the
    smallest id reachable over links and ``kept`` marks the document that bears it.  Pairs whose estimate lies
    ``slack`` below the threshold (nearly seven standard deviations at 64 hashes) aren't confirmed.

    ``text_key``, a hash of the text, tells rows of one id apart.

    Null and blank texts have no shingles and are alone.  A text of fewer words than a shingle has one shingle.  Rows
    with the same id count as one document of several texts.  A null id is alone, with a null component, and kept.
    Other columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = shared.Scratch(spark, "near")
    shared.small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    sketches = scratch.table(
        docs.mapInArrow(_sketches(shingle, sketch, lists), "doc_id long, text_key long, n long, key_1 long, key_2 long, sketch array<long>, keys array<long>")
    )
    keyed = sketches.where("n > 0 and doc_id is not null")
    classes = scratch.table(keyed.groupBy("key_1", "key_2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = scratch.table(
        keyed.join(classes.select("key_1", "key_2", "n", F.col("rep").alias("doc_id")), ["key_1", "key_2", "n", "doc_id"], "left_semi")
        .dropDuplicates(["key_1", "key_2", "n", "doc_id"])
        .select(F.col("doc_id").alias("rep"), "n", "key_1", "sketch", "keys")
    )
    entries = reps.select("rep", "n", F.explode("keys").alias("key"))
    lists_ = entries.groupBy("key").agg(F.count("*").alias("company")).where("company > 1")
    shared_entries = scratch.table(entries.join(lists_, "key"))
    standing = shared_entries.groupBy("rep").agg(F.sum("company").alias("standing"))
    ranked = shared_entries.join(standing, "rep")
    centres = ranked.groupBy("key").agg(F.max(F.struct("standing", F.negative("rep").alias("neg"), "n")).alias("c"))
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    starred = scratch.table(
        shared_entries.join(centres, "key")
        .where((F.col("rep") != -F.col("c.neg")) & fits(F.col("n"), F.col("c.n")))
        .select(F.least("rep", -F.col("c.neg")).alias("a"), F.greatest("rep", -F.col("c.neg")).alias("b"))
        .distinct()
    )
    likely = scratch.table(_estimated(reps, starred, percent, sketch, slack))
    crowded = scratch.table(shared_entries.where(F.col("company") > short).select("rep").distinct())
    full = _full(scratch, docs, reps, likely.select(F.explode(F.array("a", "b")).alias("rep")).union(crowded), shingle)
    links = scratch.table(_confirmed(likely, full, percent))
    parts = components(scratch, links)
    families = components(scratch, likely).select(F.col("node").alias("rep"), F.col("component").alias("family"))

    placed = scratch.table(
        shared_entries.select("key", "rep", "n", "company").join(families, "rep", "left").withColumn("family", F.coalesce("family", "rep"))
    )
    few = _crossing(placed.where(F.col("company") <= short), fits)
    # a long list of one family connects nothing that the family's blocks don't
    long_ = placed.where(F.col("company") > short)
    crossing = long_.groupBy("key").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo < hi").select("key")
    sets = full.join(long_.join(crossing, "key", "left_semi").select("rep").distinct(), "rep", "left_semi")
    counts = sets.select("shingles").mapInArrow(_counts, "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))
    common = counts.where("count > 1").orderBy(F.desc("count"), "key").limit(RANKED).select("key").toArrow()  # at most RANKED rows
    common = common.column("key").to_numpy()[::-1]
    longer = (
        sets.join(families, "rep", "left").select("rep", F.coalesce("family", "rep").alias("family"), "shingles")
        .mapInArrow(_prefixes(common, percent), "rep long, n long, family long, key long")
    )
    longer = scratch.table(longer)
    company = longer.groupBy("key").agg(F.count("*").alias("company"), F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo < hi").select("key", "company")
    longer = scratch.table(longer.join(company, "key"))
    rest = scratch.table(few.union(_crossing(longer.where(F.col("company") <= short), fits)).distinct().join(starred, ["a", "b"], "left_anti"))
    perhaps = scratch.table(_estimated(reps, rest, percent, sketch, slack))
    groups = families.select(F.col("family").alias("group"), "rep").union(longer.where(F.col("company") > short).select(F.col("key").alias("group"), "rep"))
    groups = groups.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("group", "rep", F.coalesce("component", "rep").alias("component"))
    groups = scratch.table(_unsettled(groups))
    wanted = perhaps.select(F.explode(F.array("a", "b")).alias("rep")).union(groups.select("rep")).distinct()
    full = _full(scratch, docs, reps, wanted, shingle)
    more = scratch.table(_confirmed(perhaps, full, percent).union(_in_blocks(groups, full, percent)).distinct())
    if not more.isEmpty():
        parts = components(scratch, links.union(more))
    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key_1", "key_2", "n", "copies", F.coalesce("component", "rep").alias("component_id"))
    return _of_documents(sketches.select("doc_id", "text_key", "n", "key_1", "key_2"), scratch.table(of_class))


def _of_documents(keyed: DataFrame, of_class: DataFrame) -> DataFrame:
    """Classes' components given back to documents.  The classes of very many copies, at most 1023 that hold a HOT share of
    all rows, are broadcast; texts without shingles need no class."""
    keys, total = ["key_1", "key_2", "n"], keyed.count()
    hot = F.broadcast(of_class.where(F.col("copies") > total * HOT).drop("copies"))
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    usual = keyed.where(~alone)
    parts = (
        keyed.where(alone).withColumn("component_id", F.col("doc_id")),
        usual.join(hot, keys),
        usual.join(hot, keys, "left_anti").join(of_class.where(F.col("copies") <= total * HOT).drop("copies"), keys),
    )
    columns = ("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key")
    first, second, third = (p.select(*columns) for p in parts)
    return first.union(second).union(third)


def _crossing(entries: DataFrame, fits) -> DataFrame:
    """Pairs (a, b) of classes of fitting sizes that meet in a list and belong to different families."""
    x, y = entries.alias("x"), entries.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.family") != F.col("y.family")) & fits(F.col("x.n"), F.col("y.n"))
    return x.join(y, meet).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _estimated(reps: DataFrame, pairs: DataFrame, percent: int, k: int, slack: float) -> DataFrame:
    """The pairs (a, b) whose similarity, estimated on the sketch of the union, isn't far below the threshold."""
    side = lambda x, s: reps.select(F.col("rep").alias(x), F.col("sketch").alias(s))
    return (
        pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b")
        .withColumn("u", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k))
        .where(F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u")) >= F.size("u") * (percent / 100 - slack))
        .select("a", "b")
    )


def _full(scratch: shared.Scratch, docs: DataFrame, reps: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(rep, shingles) of the wanted classes.  A bitmap of fixed size keeps most other texts out of the pass."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)).cast("int").alias("place")
    wanted = wanted.select(F.col("rep").alias("doc_id")).distinct()
    bits = np.zeros(BITMAP, np.uint8)
    bits[[r.place for r in wanted.select(place).distinct().toLocalIterator()]] = 1  # at most BITMAP places
    found = docs.where("doc_id is not null").select("doc_id", place, "text").mapInArrow(_full_sets(shingle, np.packbits(bits)), "doc_id long, key_1 long, shingles array<long>")
    # rows that repeat an id may hold other texts than the one that stands for the class
    own = reps.join(wanted.select(F.col("doc_id").alias("rep")), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "key_1")
    return scratch.table(found.join(own, ["doc_id", "key_1"]).select(F.col("doc_id").alias("rep"), "shingles"))


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, counted on full sets."""
    a, b = full.select(F.col("rep").alias("a"), F.col("shingles").alias("fa")), full.select(F.col("rep").alias("b"), F.col("shingles").alias("fb"))
    return (
        pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("fa", "fb")))
        .where(F.col("i") * 100 >= (F.size("fa") + F.size("fb") - F.col("i")) * percent)
        .select("a", "b").distinct()
    )


def _unsettled(groups: DataFrame) -> DataFrame:
    """(group, rep, component, main) of the groups with several components; ``main``: of the group's largest one."""
    sizes = groups.groupBy("group", "component").count()
    largest = sizes.groupBy("group").agg(F.max(F.struct("count", "component")).alias("l"), F.count("*").alias("parts")).where("parts > 1")
    return groups.join(largest, "group").select("group", "rep", "component", (F.col("component") == F.col("l.component")).alias("main"))


def _blocks(groups: DataFrame, full: DataFrame, most: int = 1 << 20, texts: int = 2048) -> DataFrame:
    """The rows of every two blocks (x, y) that meet.  A block has about ``most`` shingles and ``texts`` texts at the most,
    so what a meeting needs is bounded, however large the group."""
    rows = groups.join(full, "rep")
    number = lambda w: F.ceil(F.greatest(F.sum(F.when(w, F.size("shingles")).otherwise(0)) / most, F.count_if(w) / texts)).cast("int")
    blocks = rows.groupBy("group").agg(number(~F.col("main")).alias("others"), number(F.col("main")).alias("mains"))
    rows = rows.join(blocks, "group").withColumn("block", F.when(F.col("main"), F.col("others") + F.pmod(F.xxhash64("rep"), F.greatest("mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("rep"), F.greatest("others", F.lit(1)))).cast("int"))
    last = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "component", "shingles")


def _in_blocks(groups: DataFrame, full: DataFrame, percent: int, **bounds: int) -> DataFrame:
    """Links (a, b) between different components of a group, exactly, from blocks of bounded size.

    Every two blocks meet in a task of their own, but for blocks of the group's largest component among themselves.
    """

    def links(key: tuple, table: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        block, rep, part = (table.column(c).to_numpy() for c in ("block", "rep", "component"))
        sets = table.column("shingles").combine_chunks()
        sizes, flat = sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy()
        _, code = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(rep)), sizes)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        if x == y:
            useful = np.bincount(code) > 1
        else:
            useful = (np.bincount(code[block[row] == x], minlength=code.max() + 1) > 0) & (np.bincount(code[block[row] == y], minlength=code.max() + 1) > 0)
        column = np.where(useful, np.cumsum(useful) - 1, -1)[code]
        place = np.zeros(len(rep), np.int64)
        place[left] = np.arange(len(left))
        place_right = np.zeros(len(rep), np.int64)
        place_right[right] = np.arange(len(right))
        in_left, in_right = (block == x)[row], (block == y)[row]
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(useful.sum()), 2048):
            now = (column >= lo) & (column < lo + 2048)
            a, b = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
            a[place[row[now & in_left]], column[now & in_left] - lo] = 1
            b[place_right[row[now & in_right]], column[now & in_right] - lo] = 1
            both += a @ b.T
        p, q = [rep[:0]], [rep[:0]]
        for lo in range(0, len(left), 256):  # in stripes: whole numbers of 64 bits are exact but large
            own = left[lo : lo + 256]
            linked = both[lo : lo + 256].astype(np.int64) * (100 + percent) >= (sizes[own][:, None] + sizes[right]) * percent
            i, j = np.nonzero(linked & (part[own][:, None] != part[right]))
            p.append(rep[own[i]])
            q.append(rep[right[j]])
        p, q = np.concatenate(p), np.concatenate(q)
        return pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q)})

    return _blocks(groups, full, **bounds).groupBy("group", "x", "y").applyInArrow(links, "a long, b long")
