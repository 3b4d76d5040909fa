"""From raw documents to packed training sequences: reject junk, reject toxic texts, drop repeated lines, keep one of each
group of near copies, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of ``documents``; further columns of ``docs`` are left out.  An empty
table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.line_dedup import drop_frequent_lines
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import importance_resample
from tessera.llm.shared import Scratch, strip_blanks
from tessera.llm.toxicity import fit, severity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects: as many as the labels let expect to be good.

    Null and empty texts have the log weight 0 and are kept or not like other texts of that weight; so are rows without
    an id.  Repeated rows are kept or rejected together.  Without labels of both kinds every row stays.
    """
    return importance_resample(docs, _labels(spark, sf_dir)).where("selected").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of severity grade 0.

    Null and empty texts stay wherever most labelled texts aren't toxic; rows without an id are judged by their text, repeated rows
    alike.  Without labels of both kinds every row stays.
    """
    return severity(docs, fit(docs, _labels(spark, sf_dir))).where("not toxic").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share, with ``n_chars`` counted again; a document that has nothing but
    blanks left after a line was dropped goes.

    A null text becomes an empty one and stays, as does an empty one.  Rows without an id lose no line; rows that repeat
    an id count as one document.
    """
    kept = drop_frequent_lines(docs)
    left = kept.where((F.col("n_dropped") == 0) | (strip_blanks(F.col("text")) != ""))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id.

    Texts without words, null ones among them, are in no group and stay.  The verdict holds for a row (id and text); of
    rows that repeat both, one stays.  Rows without an id are in no group and stay.
    """
    key = F.xxhash64("text").alias("text_key")
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id", "text_key").distinct()
    own = docs.where("doc_id is not null").select(*COLUMNS, key)
    return own.join(kept, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of 2048 tokens.

    A null or empty text is a piece of one token.  Repeated rows and rows without an id are packed like others.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: The classifiers and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
