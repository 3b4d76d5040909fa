"""URL rules found by their rarest literal token, in DataFrame operations only.

A rule is (text, verdict, pattern, tokens): a regular expression over host + path, and literal tokens of which every URL
that it fits has all.  Each rule is indexed by the token that the fewest URLs have.  The tokens of a URL fetch candidate
rules, and only those run their expressions; the fitting rule of the longest text decides.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared

#: What separates tokens in host and path.
TOKEN = r"[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def site_rule(text: str, verdict: str) -> Rule:
    """A rule like ``example.org/en/``: the host and all its subdomains, paths that start like the rule's."""
    host, slash, rest = text.partition("/")
    host = host.lower()
    path = slash + rest
    whole = [t for t in re.split(TOKEN, host) if t]
    inner = re.split(TOKEN, path)
    whole += [t for t in inner[:-1] if t]  # the last may go on in the URL
    return Rule(text, verdict, rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{re.escape(path) if path else '(?=/|$)'}.*$", tuple(whole))


def word_rule(word: str, verdict: str) -> Rule:
    """A rule for hosts of which ``word`` is a part between dots, hyphens or underscores."""
    return Rule(f"||{word}^", verdict, rf"(?s)^(?:[^/]*[._-])?{re.escape(word.lower())}(?:[._-][^/]*)?(?:/.*)?$", (word.lower(),))


#: General words of hosts of advertising, gambling, drugs, adult content and spam; blocked where no rule of the caller's fits.
#: They are this library's own choice, as word filters have them; give ``judge`` others for other corpora.
BLOCKED_WORDS = (
    "ad", "ads", "adserver", "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "lottery", "pharmacy", "pills", "poker",
    "porn", "popunder", "sex", "slots", "spam", "tracker", "viagra", "warez", "xxx",
)


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], *, fallback: list[Rule] | None = None, url_col: str = "url", default: str = "allow", inline: int = 256) -> DataFrame:
    """``pages`` with columns ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    ``fallback`` rules give verdicts, but no ``rule``, to URLs that no rule fits; ``default`` goes to the rest.  Of rules
    of equal length the first in alphabetic order decides.  Null URLs and those without ``://`` have an empty host and
    path.  Columns of the new names, in any case, are replaced, others and repeated rows stay.  An empty table gives an empty result.
    Up to ``inline`` rules the index is a literal array of buckets and no row is shuffled; more rules are joined by token.
    """
    every = [(r, 1) for r in rules] + [(r, 0) for r in (fallback or [])]
    new = ("host", "path", "rule", "verdict")
    kept = shared.others(pages, *new)
    site_, tokens_, best_, row_ = shared.unused(pages, "site", "tokens", "best", "row")
    rows = pages.select(*(shared.quoted(c) for c in kept), host(shared.quoted(url_col)).alias("host"), path(shared.quoted(url_col)).alias("path"))
    if not every:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    rows = rows.withColumn(site_, F.concat("host", "path"))
    rows = rows.withColumn(tokens_, F.array_distinct(F.filter(F.split(shared.quoted(site_), TOKEN), lambda t: t != "")))
    index = _by_rarest_token(rows.select(F.col(tokens_).alias("tokens")), every)
    order = ("own", "length", "order", "text", "verdict")
    if len(every) <= inline:
        fetched = _fetched(index, F.col(tokens_))
        fits = F.filter(fetched, lambda r: F.rlike(F.col(site_), r["pattern"]))
        found = rows.withColumn(best_, F.array_max(F.transform(fits, lambda r: F.struct(*(r[k].alias(k) for k in order))))).drop(site_, tokens_)
    else:
        flat = [(t, r["pattern"], *(r[k] for k in order)) for t, g in index.items() for r in g]
        table = pages.sparkSession.createDataFrame(flat, "token string, pattern string, own int, length int, `order` int, text string, verdict string")
        # numbered once: a second evaluation may number rows in another order
        keyed = shared.Scratch(pages.sparkSession, "urls").table(rows.withColumn(row_, F.monotonically_increasing_id()))
        asked = keyed.select(F.col(row_).alias("row"), F.col(site_).alias("site"), F.explode(F.array_union(tokens_, F.array(F.lit("")))).alias("token"))
        fits = asked.join(table, "token").where(F.expr("site rlike pattern"))
        chosen = fits.groupBy("row").agg(F.max(F.struct(*(F.col(f"`{k}`").alias(k) for k in order))).alias(best_)).withColumnRenamed("row", row_)
        found = keyed.join(chosen, row_, "left").drop(row_, site_, tokens_)
    best = F.col(best_)
    out = found.withColumns({"rule": F.when(best["own"] == 1, best["text"]), "verdict": F.coalesce(best["verdict"], F.lit(default))}).drop(best_)
    return out.select(*(shared.quoted(c) for c in (*kept, *new)))


def _fetched(index: dict[str, list[dict]], tokens: Column) -> Column:
    """The rules whose indexing token is one of ``tokens``: each token looks into one bucket of a literal array."""
    size = 1 << max(3, (4 * len(index) - 1).bit_length())
    shown = lambda token, r: F.struct(F.lit(token).alias("token"), *(F.lit(r[k]).alias(k) for k in ("pattern", "own", "length", "order", "text", "verdict")))
    held: list[list[Column]] = [[] for _ in range(size)]
    for token, group in index.items():
        if token:
            held[zlib.crc32(token.encode()) % size] += [shown(token, r) for r in group]
    kind = "array<struct<token:string,pattern:string,own:int,length:int,order:int,text:string,verdict:string>>"
    buckets = F.array(*(F.array(*b).cast(kind) if b else F.array().cast(kind) for b in held))
    by_token = F.flatten(F.transform(tokens, lambda t: F.filter(F.get(buckets, (F.crc32(t.cast("binary")) % size).cast("int")), lambda r: r["token"] == t)))
    without = index.get("")
    return F.concat(by_token, F.array(*(shown("", r) for r in without)).cast(kind)) if without else by_token


def _by_rarest_token(tokens: DataFrame, rules: list[tuple[Rule, int]]) -> dict[str, list[dict]]:
    """Rules by their token that the fewest URLs have; '' for rules without literal tokens.

    Only tokens of rules are counted, one number each.
    """
    of_rules = sorted({t for r, _ in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if of_rules:
        wanted = F.array(*(F.lit(t) for t in of_rules)) if len(of_rules) <= 256 else None
        if wanted is not None:
            seen = tokens.select(F.explode(F.array_intersect("tokens", wanted)).alias("token"))
        else:
            seen = tokens.select(F.explode("tokens").alias("token")).join(tokens.sparkSession.createDataFrame([(t,) for t in of_rules], "token string"), "token", "left_semi")
        counts = {r.token: r["count"] for r in seen.groupBy("token").count().collect()}
    names = sorted({r.text for r, _ in rules}, reverse=True)
    index: dict[str, list[dict]] = {}
    for r, own in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(token, []).append({"own": own, "length": len(r.text), "order": names.index(r.text), "text": r.text, "verdict": r.verdict, "pattern": r.pattern})
    return index
