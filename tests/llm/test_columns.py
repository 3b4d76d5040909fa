"""Callers' columns of any name, in any case, and bytes that aren't UTF-8, through every operator and both sides of its size switches."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
from tessera.llm import conversations, fingerprint, license_scan, line_dedup, lm_score, media, near_dedup, packing, quality, runs, sentencepiece, toxicity, url_filter  # noqa: E402

NAMES = "hits doc Host N_DROPPED Severity Selected a.b __id __site __tokens __best __row __noise site tokens best row noise id label half bucket key c0 n0 IDS MEDIA Payload Runs Places words p".split()


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i, t) for i, t in enumerate(["one two three four five six", "one two three four five six", "", "b a b a b a b a b a b a b a", "all rights reserved", "  \n"])] + [(None, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.unionByName(spark.sql("select 8L doc_id, cast(x'6120ff62' as string) text"))
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES)))


def kept(out, *new):
    """The caller's columns that aren't replaced are there, with their values."""
    gone = {n.lower() for n in new}
    want = {n: k for k, n in enumerate(NAMES) if n.lower() not in gone}
    rows = out.collect()
    assert len(rows) == 9 and [c.lower() for c in out.columns].count("text") <= 1 and len({c.lower() for c in out.columns}) == len(out.columns)
    for r in rows:
        held = dict(zip(out.columns, r, strict=True))
        assert all(held[n] == k for n, k in want.items())
    return rows


@pytest.mark.parametrize("broadcast", [32 << 20, -1])
def test_lines(crowded, broadcast):
    kept(line_dedup.drop_frequent_lines(crowded, broadcast_bytes=broadcast), "n_lines", "n_dropped", "most_docs")


@pytest.mark.parametrize("inline", [256, 0])
def test_urls(crowded, inline):
    pages = crowded.withColumnRenamed("text", "url")
    out = url_filter.judge(pages, [url_filter.site_rule("org/", "allow")], fallback=[url_filter.word_rule("ads", "block")], inline=inline)
    kept(out, "host", "path", "rule", "verdict")


def test_models(spark, crowded):
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    kept(quality.importance_resample(crowded, labels), "n_grams", "log_weight", "gumbel_key", "selected")
    kept(toxicity.severity(crowded, toxicity.fit(crowded, labels)), "severity", "grade", "toxic")


def test_texts(crowded):
    kept(runs.periodic_runs(runs.with_loops(crowded)), "n_words", "runs", "collapsed")
    kept(license_scan.scan_licenses(crowded), "n_words", "places", "spans")
    kept(media.read_media(media.to_media(crowded)), "n_bytes", "media", "payload", "feature")
    P = pytest.importorskip("public_tokenizers")
    model = P.path("piece_bpe_32k.model")
    kept(sentencepiece.decode(sentencepiece.encode(crowded, model, parity=True), model), "ids", "parity", "decoded")
    assert packing.pack(crowded, P.path("word_bpe_49k.json")).count() == 9


def test_whole_tables(spark, crowded):
    assert near_dedup.near_duplicates(crowded).count() == 9
    assert lm_score.score(crowded).count() == 9
    assert fingerprint.compare_with_edits(crowded).count() == 9
    turns = crowded.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "*")
    assert conversations.repair(turns).conversations.count() == 9
