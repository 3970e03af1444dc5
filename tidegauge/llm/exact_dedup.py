"""Exact duplicates by an extendible-hash index on shared files. DataFrame functions only.

Texts are equal when identical after each run of white space became one space; null counts as empty.

1. Keys: one narrow row per document (hash of the text, sha-256, row number) is written once.
2. Directory: equal hashes are counted map-side first. A hash belongs to the bucket of its leading bits;
   a bucket with more distinct hashes than ``capacity`` is split, which doubles the directory, until it
   fits. Depth and capacity follow the number of rows so that the directory has at most 2**18 entries,
   which bounds its broadcast. A bucket that is overfull at full depth is no special case: owners cut it by hash.
3. Owners: copies are collapsed by task before the text moves, so a hot text arrives at most once per task.
   The collapsed texts are dealt to owners by ranges of (bucket, hash), so all texts of one hash meet in one task. There
   texts are told apart byte by byte; those that share a hash become links of a chain. (Two texts with one sha-256
   would stop the job.) The chains, in order, with size and smallest key of each text, are the index.
4. Probe: a key's leading bits name its directory cell, the cell its bucket, and bucket, hash and sha-256 the link
   that says which row stays.

Defined cases: of rows with the smallest id and equal texts the first read stays; null ids come after all
others; a row repeated with its id counts as a copy; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACE, Scratch, whole_text

#: Distinct hashes of a bucket.
CAPACITY = 4_096
MAX_DEPTH = 18


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole_text(text), SPACE, " ")


def _prefix(h: Column, depth: int) -> Column:
    """Leading ``depth`` bits of a 64-bit key as a number."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, rows: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Entries (cell, bucket, depth) of the doubled directory over distinct ``h``, and its depth.

    ``cell`` is the key's leading bits at the global depth, ``bucket`` the first cell of its bucket. Counts
    of all cells are taken once; each doubling sums them for one bit less.
    """
    capacity = max(capacity, math.ceil(rows / 2 ** (MAX_DEPTH - 2)))
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, rows / capacity)))) + 2)
    cells = hashes.groupBy(_prefix(F.col("h"), depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn(
        "head", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("d"))
    )
    fits = levels.groupBy("d", "head").agg(F.sum("n").alias("held")).filter((F.col("held") <= capacity) | (F.col("d") == depth))
    entries = levels.join(fits, ["d", "head"]).groupBy("cell").agg(F.min("d").alias("depth"))
    bits = F.lit(depth) - F.col("depth")
    bucket = F.call_function("shiftleft", F.call_function("shiftright", F.col("cell"), bits), bits)
    return entries.select("cell", bucket.alias("bucket"), "depth"), depth


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", hash_of=F.xxhash64, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``df`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``, without the text.

    Returns key, keep_id (key of the row that stays), group_size, kept, text_sha256 and ``_row``, the number
    by which rows that repeat a key are told apart. ``hash_of`` is replaceable to provoke collisions.
    """
    scratch = Scratch(df.sparkSession, "exact-dedup")
    norm = normalised(text)
    source = df.select(F.col(key).alias("id"), norm.alias("norm"))
    hashed = source.withColumn("h", hash_of(F.col("norm")).cast("long"))
    keys = scratch.stage(
        hashed.select("id", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.monotonically_increasing_id().alias("_row")), "keys"
    )
    rows = keys.count()
    hashes = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    entries, depth = directory(hashes, rows, capacity)
    entries = scratch.stage(entries, "directory")

    index = scratch.stage(chains(hashed, entries, depth), "index")

    probed = keys.withColumn("cell", _prefix(F.col("h"), depth)).join(F.broadcast(entries.select("cell", "bucket")), "cell")
    link = ["bucket", "h", "sha"]
    probed = probed.join(index.select(*link, F.col("n").alias("group_size"), "keep_id"), link)
    # The first row that has the key which stays.
    first = probed.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy(*link).agg(F.min("_row").alias("keep_row"))
    out = probed.join(first, link)
    return out.select(
        F.col("id").alias(key), "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), "_row"
    )


def chains(hashed: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """The index: rows (bucket, h, link, sha, n, keep_id), by owners of ranges of (bucket, h) and in that order.

    ``link`` numbers the texts of one hash; ``n`` counts a text's rows and ``keep_id`` is the smallest of their keys.
    """
    smallest = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    texts = (
        hashed.withColumn("cell", _prefix(F.col("h"), depth))
        .join(F.broadcast(entries.select("cell", "bucket")), "cell")
        .groupBy("bucket", "h", "norm")
        .agg(F.count(F.lit(1)).alias("n"), smallest.alias("first"))
        .withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    )
    owned = texts.repartitionByRange("bucket", "h")
    chain = Window.partitionBy("bucket", "h").orderBy("sha")
    linked = owned.select("bucket", "h", "sha", "n", "first", F.row_number().over(chain).alias("link"), F.lag("sha").over(chain).alias("before"))
    one_text = F.when(F.col("before") == F.col("sha"), F.raise_error(F.lit("two texts share a sha-256"))).otherwise(F.col("n"))
    return linked.select("bucket", "h", "link", "sha", one_text.cast("long").alias("n"), F.col("first.id").alias("keep_id"))
