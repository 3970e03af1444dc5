"""Registered queries of the text operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bpe, class_lm, exact_dedup, fingerprint, line_dedup, mixing, ngram_join, packing, period_runs, quality, token_files, turn_repair, url_filter
from tidegauge.llm.common import WORD, Scratch, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_BLOCK = (("net", "/"), ("example.com", "/de/"))
URL_ALLOW = (("example.net", "/en/"), ("org", "/fr/"))


@query
def op1_url_filters(spark, sf):
    pages = read(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge(pages, "url", URL_BLOCK, URL_ALLOW).drop("url")


@query
def op2_exact_dedup(spark, sf):
    return exact_dedup.exact_dedup(read(spark, sf, "documents")).drop("_row")


@query
def op3_quality(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    rows = quality.classify(docs, read(spark, sf, "labels"), "quality")
    return rows.select("doc_id", "held_out", "score", "predicted")


@query
def op4_ngram_join(spark, sf):
    return ngram_join.ngram_join(read(spark, sf, "documents")).drop("_tid", "_keep")


@query
def op5_class_lm(spark, sf):
    return class_lm.class_lm(read(spark, sf, "documents"))


@query
def op6_token_files(spark, sf):
    docs = read(spark, sf, "documents")
    folder = Scratch(spark, "op6").path("ids")
    manifest = token_files.write_ids(docs, folder, tokenizer_file("word_bpe_49k.json"), end_id=2)
    rows = token_files.read_ids(manifest)
    return rows.select(
        F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op7_mixing(spark, sf):
    rows = mixing.plan(read(spark, sf, "documents"))
    rows = rows.withColumn("first_position", F.get("pieces", F.lit(0))["position"]).drop("pieces")
    return rows.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


@query
def op8_fingerprints(spark, sf):
    return fingerprint.with_edits(read(spark, sf, "documents").select("doc_id", "text"))


@query
def op9_line_dedup(spark, sf):
    rows = line_dedup.line_dedup(read(spark, sf, "documents").select("doc_id", "text"))
    return rows.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


@query
def op10_packing(spark, sf):
    pieces = packing.pack(read(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def with_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the checksum of its id, repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    some = some.withColumn("words", words).withColumn("n", F.size("words"))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    left = F.col("n") - F.col("a")
    some = some.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil(left / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    periodic = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n"))
    text = F.when(F.col("a").isNotNull(), F.array_join(periodic, " ")).otherwise(F.col("text"))
    return some.select("doc_id", text.alias("text"))


@query
def op11_period_runs(spark, sf):
    rows = period_runs.find_runs(with_periods(read(spark, sf, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with faults by the checksum of their conversation and number."""

    def shown(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    some = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return some.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query
def op12_turn_repair(spark, sf):
    rows = read(spark, sf, "conversations")
    found = turn_repair.report(damaged(rows)).withColumnRenamed("conv_id", "found_id")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in turn_repair.REPORT]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


@query
def op13_bpe(spark, sf):
    path = tokenizer_file("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(read(spark, sf, "documents"), path), path)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
