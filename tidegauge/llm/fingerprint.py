"""Fingerprints of documents as homomorphic multiset hashes of their paragraphs. DataFrame functions only.

A paragraph is a line, or a sentence of a line, without the white space around it. Each is hashed to a wide
vector, and a document's fingerprint is the sum of the vectors, so it does not depend on order, and
paragraphs are added or taken away by adding or subtracting their vectors:

* ``DIGEST`` lanes of 32 bits summed modulo 2**32, which tell different multisets apart,
* ``SIGNS`` lanes that count the set bits of further hashes modulo 2**32. A lane read as twice its count
  less the number of paragraphs is a sum of signs, so the squared length of a difference of two
  fingerprints estimates by how many paragraphs they differ.

``likeness`` is one less that squared length over the sum of both squared lengths, kept in 0 to 1: 1 for equal
multisets, near 0 for disjoint ones.

Defined cases: null and empty texts are the empty multiset (all lanes 0); two empty ones have likeness 1;
white space between paragraphs and their order do not count; null keys are treated as smallest; rows that
repeat a key are ordered by text; an empty table gives an empty result; a table of one row is its own
next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import KeyBlocks, whole_text

#: Ends of paragraphs: line breaks, and blanks after the end of a sentence.
PARAGRAPH_ENDS = r"[\n\r]+|(?<=[.!?])[ \t]+"
BLANKS = " \t\x0b\x0c"
DIGEST = 8
SIGNS = 128
DOCS_PER_BLOCK = 4_000

_PAIR = 0x0000000100000001  # two counters of 32 bits in a long
_LOW = 0xFFFFFFFF


def paragraphs(text: Column) -> Column:
    return F.split(text, PARAGRAPH_ENDS)


def lane_sums(paragraph: Column, times: Column | None = None) -> list[Column]:
    """Aggregates that add up the vectors of paragraphs; ``times`` counts one as often, or takes it away.

    Counts stay below 2**31 per document, so no lane reaches the next one.
    """
    times = F.lit(1).cast("long") if times is None else times
    paragraph = F.btrim(paragraph, F.lit(BLANKS))
    real = F.when(F.length(paragraph) > 0, times).otherwise(F.lit(0).cast("long"))
    sums = []
    for i in range(DIGEST // 2):
        h = F.xxhash64(F.lit(i), paragraph)
        sums.append(F.sum(F.shiftrightunsigned(h, 32) * real))
        sums.append(F.sum(h.bitwiseAND(F.lit(_LOW)) * real))
    for i in range(SIGNS // 64):
        h = F.xxhash64(F.lit(1000 + i), paragraph)
        sums += [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_PAIR)) * real) for k in range(32)]
    sums.append(F.sum(real))
    return sums


def lanes(sums: list[Column]) -> tuple[Column, Column]:
    """(digest lanes, sign lanes) from the values of ``lane_sums``."""
    digest = F.array(*[F.pmod(s, F.lit(_LOW + 1)) for s in sums[:DIGEST]])
    count = sums[-1]
    signs = []
    for s in sums[DIGEST:-1]:
        signs += [2 * F.shiftrightunsigned(s, 32) - count, 2 * s.bitwiseAND(F.lit(_LOW)) - count]
    return digest, F.array(*[s.cast("int") for s in signs])


def printed(digest: Column, signs: Column) -> Column:
    """Both parts as text: digest lanes in hex, then the sign lanes."""
    head = F.array_join(F.transform(digest, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return F.concat(head, F.lit(":"), F.array_join(F.transform(signs, lambda x: x.cast("string")), ","))


def squared(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def likeness(a: Column, b: Column) -> Column:
    apart = squared(F.zip_with(a, b, lambda x, y: x - y))
    both = squared(a) + squared(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - apart / both))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: the key, its digest and sign lanes."""
    rows = df.select(F.col(key).alias("_key"), whole_text(text).alias("_t"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.select("_key", "_row", F.explode(paragraphs(F.col("_t"))).alias("_p"))
    sums = lane_sums(F.col("_p"))
    summed = rows.groupBy("_key", "_row").agg(*[s.alias(f"_{i}") for i, s in enumerate(sums)])
    digest, signs = lanes([F.col(f"_{i}") for i in range(len(sums))])
    return summed.select(F.col("_key").alias(key), digest.alias("digest"), signs.alias("signs"))


def with_edits(df: DataFrame, key: str = "doc_id", text: str = "text", docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """Fingerprints of texts and of edited texts, and how alike they and those of next documents are.

    The edited text ends, from its middle on, with the beginning of the next document in ascending order. The
    text is shuffled once, into blocks of neighbouring keys; a block also gets the first document
    after it.
    """
    docs = df.select(F.col(key).alias("key"), whole_text(text).alias("t"))
    blocks = KeyBlocks(docs, "key", docs_per_block)
    dealt = docs.withColumn("block", blocks.of())
    # First key of each block; the block before the last one wraps round. At most KeyBlocks.MAX_BLOCKS rows.
    firsts = dealt.groupBy("block").agg(F.min(F.struct(F.col("key").isNotNull().alias("known"), F.col("key").alias("key"))).alias("first")).orderBy("block").collect()
    after = [(r.first.key, prev.block) for r, prev in zip(firsts, [firsts[-1], *firsts[:-1]])] if firsts else []
    spark = df.sparkSession
    key_type = df.schema[key].dataType.simpleString()
    halo = F.broadcast(spark.createDataFrame(after, f"_first {key_type}, _to int"))
    extra = docs.join(halo, F.col("key").eqNullSafe(F.col("_first"))).select("key", "t", F.col("_to").alias("block"), F.lit(1).alias("late"))
    rows = dealt.withColumn("late", F.lit(0)).unionByName(extra)

    ahead = Window.partitionBy("block").orderBy("late", F.col("key").asc_nulls_first(), "t")
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("block", "late", "key", "t", F.row_number().over(ahead).alias("place"), F.lead("t").over(ahead).alias("next"))
    begin = F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)
    edited = F.concat(F.substring("t", F.lit(1), n - half), begin)
    rows = rows.select("block", "late", "key", "place", n.cast("long").alias("n_chars"), "t", edited.alias("edited"))
    rows = rows.select("block", "late", "key", "place", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("t").alias("x")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("x")))).alias("e"))
    rows = rows.select("block", "late", "key", "place", "n_chars", "sha", F.col("e.which").alias("which"), F.explode(paragraphs(F.col("e.x"))).alias("p"))
    sums = lane_sums(F.col("p"))
    names = [f"_{i}" for i in range(len(sums))]
    summed = rows.groupBy("block", "place", "late", "key", "n_chars", "sha", "which").agg(*[s.alias(c) for s, c in zip(sums, names)])
    digest, signs = lanes([F.col(c) for c in names])
    one = summed.select("block", "place", "late", "key", "n_chars", "sha", "which", F.struct(digest.alias("digest"), signs.alias("signs")).alias("f"))
    both = one.groupBy("block", "place").agg(
        F.first("late").alias("late"), F.first("key").alias("key"), F.first("n_chars").alias("n_chars"), F.first("sha").alias("edited_sha256"),
        F.max(F.when(F.col("which") == 0, F.col("f"))).alias("own"), F.max(F.when(F.col("which") == 1, F.col("f"))).alias("edited"),
    )
    follows = Window.partitionBy("block").orderBy("place")
    both = both.withColumn("next", F.lead("own").over(follows)).filter("late = 0")
    return both.select(
        F.col("key").alias(key), "n_chars", "edited_sha256",
        printed(F.col("own.digest"), F.col("own.signs")).alias("fingerprint"),
        printed(F.col("edited.digest"), F.col("edited.signs")).alias("edited_fingerprint"),
        likeness(F.col("own.signs"), F.col("edited.signs")).alias("near_edited"),
        likeness(F.col("own.signs"), F.col("next.signs")).alias("near_next"),
    )
