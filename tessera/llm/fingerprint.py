"""Winnowing fingerprints of texts, in DataFrame and SQL functions only.

A text's words (A-Z lower-cased) are hashed to 64 bits, and a cyclic polynomial rolls over them: a k-gram's hash is the exclusive or of
its words' hashes, each rotated by the number of words that follow it.  It is put together from those of the two halves of the
k-gram, so every step serves all k-grams that overlap.  Of each ``window`` neighbouring k-grams the one with the
smallest hash is kept, ordered by the upper 32 bits, the rightmost among equals.  Any run of at least ``window + k - 1`` words
that two texts share gives them a common hash; k-grams of different words share their 64 bits by chance alone.  A
text of fewer words than a k-gram has one hash for all its words, and one of fewer k-grams than a window has one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shared

_LOW = (1 << 31) - 1


def _later(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.size(a))


def _rotated(h: Column, by: int) -> Column:
    return F.shiftleft(h, by % 64).bitwiseOR(F.shiftrightunsigned(h, 64 - by % 64)) if by % 64 else h


def _rolled(by: int):
    return lambda x, y: _rotated(x, by).bitwiseXOR(y)


def _but_last(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def fingerprint(frame: DataFrame, text: str, into: str, *, k: int = 4, window: int = 8) -> DataFrame:
    """``frame`` with the column ``into``: array<struct<hash: long, position: int>>, the kept k-grams by position.

    A position is the number of the k-gram's first word, from 0.  Null texts, empty ones and those of blanks alone have an
    empty fingerprint; repeated rows have equal ones.  ``k`` and ``window`` are powers of two.  A column named like
    ``into`` is replaced.
    """
    if k & (k - 1) or k < 1 or window & (window - 1) or window < 1:
        raise ValueError("k and window must be powers of two")
    w, g, m = f"__{into}_words", f"__{into}_grams", f"__{into}_least"
    out = frame.withColumn(w, F.transform(shared.words(shared.ascii_lower(F.coalesce(F.col(text), F.lit("")))), lambda x: F.xxhash64(x)))
    rolled, step = F.col(w), 1
    out = out.withColumn(g, rolled)
    while step < k:  # 2, 4, 8, ... words; the last ones, of too few, are cut off
        joined = F.zip_with(F.col(g), _later(F.col(g), step), _rolled(step))
        out = out.withColumn(g, _but_last(joined, step))
        step *= 2
    empty = F.array().cast("array<long>")
    out = out.withColumn(g, F.when(F.size(w) == 0, empty).when(F.size(w) < k, F.array(F.xxhash64(F.col(w)))).otherwise(F.col(g)))
    # 32 bits of the hash above a position that falls from left to right: the least number is the rightmost least hash
    out = out.withColumn(m, F.transform(g, lambda h, i: F.shiftrightunsigned(h, 32) * (_LOW + 1) + (F.lit(_LOW) - i)))
    out, step = out.withColumn(into, F.col(m)), 1
    while step < window:  # the least of 2, 4, 8, ... neighbours
        pairs = F.zip_with(F.col(into), _later(F.col(into), step), lambda x, y: F.least(x, y))
        out = out.withColumn(into, F.when(F.size(m) >= window, _but_last(pairs, step)).otherwise(F.col(into)))
        step *= 2
    kept = F.when(F.size(m) >= window, F.array_distinct(into)).when(F.size(m) == 0, empty).otherwise(F.array(F.array_min(m)))
    place = lambda v: (F.lit(_LOW) - v.bitwiseAND(_LOW)).cast("int")
    return out.withColumn(into, F.transform(kept, lambda v: F.struct(F.get(F.col(g), place(v)).alias("hash"), place(v).alias("position")))).drop(w, g, m)


def hashes(kept: Column) -> Column:
    """The distinct hashes of a fingerprint, by position."""
    return F.array_distinct(kept["hash"])


def shown(kept: Column) -> Column:
    """A fingerprint as text: hash:position in hexadecimal digits, by position."""
    return F.array_join(F.transform(kept, lambda v: F.concat(F.hex(v["hash"]), F.lit(":"), F.hex(v["position"]))), " ")


def likeness(a: Column, b: Column) -> Column:
    """The share of common hashes among all hashes of two fingerprints; 1 for two empty ones."""
    x, y = hashes(a), hashes(b)
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))


def cuts(docs: DataFrame, column: str, rows: int = 4096, most: int = 1 << 15) -> list[int]:
    """Bounds that deal a long column's values to ranges of about ``rows`` rows.

    There are as many ranges as the table needs, up to ``most``; of more than ``rows * most`` rows the ranges grow.
    """
    k = min(most, -(-docs.count() // rows))
    if k < 2:
        return []
    return sorted(set(docs.agg(F.percentile_approx(column, [i / k for i in range(1, k)], 20 * k)).first()[0] or []))


def place_of(value: Column, bounds: list[int], wide: int = 64) -> Column:
    """How many of the sorted bounds lie at or below the value, found in two steps of about ``wide`` and n / ``wide`` comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, -(-len(bounds) // wide))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda a: F.size(F.filter(a, lambda c: c <= value))
    block = F.greatest(below(F.array(*(F.lit(b[0]) for b in blocks))) - 1, F.lit(0))
    return (block * step + below(F.get(F.array(*(F.array(*(F.lit(c) for c in b)) for b in blocks)), block))).cast("int")


def in_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 4096) -> tuple[DataFrame, Window]:
    """``docs`` dealt to ranges of ids, and the window in which ``lead`` finds the next row by ascending id.

    No task sees all rows: each range also holds, marked by ``__guest`` = 1, the first row of the next range (the last
    range that of the first).  Drop those rows at the end.  Null ids come first, dealt to ranges by a hash of their texts; rows of one id
    are in the order of that hash and lie in one range.
    """
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    both = docs.withColumns({"__key": key, "__tie": tie, "__none": F.col(id_col).isNull()})
    ids = docs.where(F.col(id_col).isNotNull()).select(key.alias("__key"))
    spread = -(-docs.where(F.col(id_col).isNull()).count() // rows)  # hashes are even, so equal widths are equal shares
    of_null = F.floor((F.shiftrightunsigned("__tie", 1) - F.when(F.col("__tie") < 0, 1 << 62).otherwise(-(1 << 62))) / (2.0**63) * max(spread, 1)).cast("int")
    both = both.withColumn("__range", F.when(F.col("__none"), F.least(of_null, F.lit(max(spread, 1) - 1))).otherwise(spread + place_of(F.col("__key"), cuts(ids, "__key", rows))))
    both = both.withColumns({"__guest": F.lit(0)})
    first = F.min(F.struct("__key", "__tie"))
    firsts = sorted((r["__range"], r["f"]["__key"], r["f"]["__tie"]) for r in both.groupBy("__range").agg(first.alias("f")).collect())  # one for each range
    if firsts:
        # the first row of a range goes to the range before it as well; the small table is made of literals, in the JVM alone
        columns = {"__k": [k for _, k, _ in firsts], "__t": [t for _, _, t in firsts], "__to": [firsts[i - 1][0] for i in range(len(firsts))]}
        to = docs.sparkSession.range(len(firsts)).select(*(F.get(F.array(*(F.lit(x) for x in v)), F.col("id").cast("int")).alias(c) for c, v in columns.items()))
        guests = both.join(F.broadcast(to), (F.col("__key") == F.col("__k")) & (F.col("__tie") == F.col("__t")))
        both = both.unionByName(guests.withColumns({"__range": F.col("__to"), "__guest": F.lit(1)}).drop("__k", "__t", "__to"))
    return both, Window.partitionBy("__range").orderBy("__guest", "__key", "__tie")


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, window: int = 8) -> DataFrame:
    """Fingerprints of texts, of their edited texts and of the next texts.

    (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next).  The edited text has its last
    quarter of code points, rounded down, replaced by the beginning of the next text by ascending id (after the last:
    the first).  Null texts are empty.  Rows of one id, and rows without an id, which come first, follow each other in the
    order of a hash of their texts; every row has a result.  An only document is its own next one.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, order = in_order(docs)
    n = F.char_length("text")
    rows = rows.withColumn("next", F.lead("text").over(order))
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter))})
    rows = fingerprint(fingerprint(rows.drop("next"), "text", "fingerprint", k=k, window=window).drop("text"), "edited", "edited_fingerprint", k=k, window=window)
    rows = rows.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
    rows = rows.withColumn("near_next", likeness(F.col("fingerprint"), F.lead("fingerprint").over(order)))
    return rows.where("__guest = 0").select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
