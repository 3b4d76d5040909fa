"""Queries of the training-data operators: ``opN_<name>`` over whole tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).drop("text_key")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import drop_frequent_lines

    kept = drop_frequent_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH line AS (
  SELECT doc_id, n, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS l
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM line WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT line.*, coalesce(keeper <> doc_id, false) AS gone FROM line LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import fit, severity

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"))
    return severity(docs.select("doc_id", "text"), model).drop("text")


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lm_score import score

    return score(_table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprint import compare_with_edits, shown

    out = compare_with_edits(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("fingerprint")).alias("fingerprint"),
        shown(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op7_png_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.media import read_media, to_media

    out = read_media(to_media(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    size = F.octet_length("payload")
    return out.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("feature")).alias("feature"),
    )


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import importance_resample

    return importance_resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")).drop("text")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.sentencepiece import decode, encode

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = encode(docs.withColumn("text_sha256", F.sha2("text", 256)), model, parity=True).drop("text")
    return decode(ids, model).select(
        "doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "parity", "text_sha256", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("lossless"),
    )


URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filter import BLOCKED_WORDS, judge, site_rule, word_rule

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = [site_rule(text, verdict) for text, verdict in URL_RULES]
    return judge(pages, rules, fallback=[word_rule(x, "block") for x in BLOCKED_WORDS]).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), judged AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|[._-])(ad|ads|adserver|adult|bet|bets|betting|casino|escort|gambling|jackpot|lottery|pharmacy|pills|poker|porn|popunder|sex|slots|spam|tracker|viagra|warez|xxx)([._-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.conversations import damaged, repair

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(turns)).conversations
    ids = turns.select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = ids.join(found.withColumnRenamed("conv_id", "found"), F.col("conv_id").eqNullSafe(F.col("found")), "left").drop("found")
    return out.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))})


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.license_scan import scan_licenses

    out = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, own = F.array_sort(F.array_distinct("places.label")), F.col("spans.label")
    starts = F.col("places.start")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.runs import periodic_runs, with_loops

    out = periodic_runs(with_loops(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("top.length"), -F.col("top.period")
    return found.select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_line_dedup, op3_toxicity, op4_near_duplicates, op5_ppm_scores, op6_winnowing, op7_png_columns, op8_importance_resampling, op9_sentencepiece, op10_url_filter, op11_conversation_repair, op12_license_scan, op13_periodic_runs)}
ORACLES = {"op2_line_dedup": OP2_SQL, "op10_url_filter": OP10_SQL}
