"""Corpus pipeline: documents that a quality model rejects go, then copies, then near copies; what is left is
mixed to target weights and packed into training windows.

Each stage takes the documents that its predecessor kept, reread from Parquet, and returns documents with the
same columns; the last returns packed pieces. Null and empty texts, null columns, repeated rows and empty
tables have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup, mixing, ngram_join, packing, quality
from tidegauge.llm.common import Scratch, read, whole_text
from tidegauge.llm.queries import tokenizer_file

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    judged = quality.classify(docs, read(spark, sf_dir, "labels"), "quality")
    return judged.filter("predicted = 1").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, that of the smallest doc_id."""
    judged = exact_dedup.exact_dedup(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("mark"))
    return _only(docs, F.sha2(exact_dedup.normalised().cast("binary"), 256), judged)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest doc_id."""
    judged = ngram_join.ngram_join(docs).filter("_keep").select("doc_id", F.col("_tid").alias("mark"))
    return _only(docs, F.md5(whole_text().cast("binary")), judged)


def _only(docs: DataFrame, mark: Column, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``kept`` names by doc_id and mark; of rows that agree in both, one."""

    def name(mark: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), mark)

    named = docs.withColumn("_name", name(mark))
    found = named.join(kept.select(name(F.col("mark")).alias("_name")), "_name")
    again = Window.partitionBy("_name").orderBy("text", "source")
    return found.withColumn("_again", F.row_number().over(again)).filter("_again = 1").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target asks."""
    return mixing.mix(docs).select(*docs.columns)


#: Rows that a file of the training order may hold.
ROWS_A_FILE = 1 << 36


def training_place(docs: DataFrame) -> Column | None:
    """Place of a row in the order in which the mixed documents were written: number of its file, and of its row in it.

    None where the documents do not come from files.
    """
    if not docs.inputFiles():
        return None
    file = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    return file * ROWS_A_FILE + F.col("_metadata.row_index")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, which are numbered in training order."""
    columns = ("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    place = training_place(docs)
    pieces = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, place=place).select(*columns, "place")
    if place is not None:
        pieces = packing.in_order(Scratch(spark, "packing").stage(pieces, "pieces"))
    return pieces.drop("place")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.stage(out, f"stage-{k}")
    return out
