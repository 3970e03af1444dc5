"""Mixing of sources to target weights along a training curriculum.

Each source has a weight and a schedule, weights at points of training time from 0 to 1, linear between. A
source's target is its share of all words by weight, at most ``max_repeats`` times its own words; what is
above is shared among the others by weight until nothing is. The schedule's integral, scaled to the
target, is the source's cumulative demand. A source's documents, in a fixed random order and as often as
its target asks, form its stream of words; the time at which the demand reaches the middle of a document's
words is its training position, found by inverting the integral. The documents are then range-sorted by
position. The last document that a source's target reaches is cut after the words that are still wanted.

The order of a source is that of a hash of key and text. Leading bits of the hash cut it into buckets, and a
document's place in the stream is the total of the buckets before its own plus a running sum inside the
bucket, so a source with a third of all rows is many small groups. Sources may be as many as rows: they are ranked by
ranges, and the water level of the targets, the words per weight of a source below its limit, is found from sums over all
sources, of which the driver sees two numbers a round.

Defined cases: a null source is a source of its own and the last one; null and empty texts have size 0 and
are never taken; rows that repeat key and text are different documents and get neighbouring places; an
empty table gives an empty result; a source without words has target 0. Columns of the input that clash
with added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import WORD, Scratch, prefix_sums, whole_text
from tidegauge.session import hinted

WEIGHTS = (1.0, 2.0, 3.0)
#: Schedules, given to the sources in turn: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
MAX_REPEATS = 3
BUCKET_ROWS = 4_000
#: Sources (some 200 bytes each) that are broadcast; more are joined by shuffles.
BROADCAST_SOURCES = 50_000

PARTS = ("done", "time", "weight", "slope")
ADDED = ("size", "source_size", "target", "taken", "pieces")


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, max_repeats: float) -> DataFrame:
    """Rows of ``sizes`` (n, weight) with ``target``: shares of the total by weight, none above ``max_repeats`` sizes, the
    excess shared again.

    A source is at its limit if the level, words per weight of all others, is above its limit per weight. The level
    only rises from round to round, and each round is one aggregate.
    """
    limit = F.col("n") * F.lit(float(max_repeats))
    full = limit / F.col("weight")
    level, held = -1.0, -1
    while True:
        closed = full < F.lit(level)
        sums = sizes.agg(
            F.sum("n").alias("n"), F.sum(F.when(closed, limit)).alias("held"), F.sum(F.when(~closed, F.col("weight"))).alias("open"), F.count_if(closed).alias("closed")
        ).first()
        if not sums.open or sums.closed == held:
            break  # all sources are at their limits, or no other one has got there
        level, held = (sums.n - (sums.held or 0.0)) / sums.open, sums.closed
    return sizes.withColumn("target", F.least(limit, F.col("weight") * F.lit(max(level, 0.0))))


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with their rank from 0, by code point, null last: numbered within ranges, after the sources before."""
    order = [F.col("_source").isNull(), F.col("_source")]
    ranges = scratch.stage(sources.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = prefix_sums(ranges.select("_range", F.lit(1).alias("one")), "_range", ["one"])
    starts = ranges.sparkSession.createDataFrame([(r, x[0]) for r, x in before.items()], "_range int, _start long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_place", inside).join(F.broadcast(starts), "_range").withColumn("_rank", F.col("_start") + F.col("_place")).drop("_range", "_start", "_place")


def integral(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """Per stretch of a schedule: share of the integral before it, its time, weight and slope, scaled to 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    done, out = 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append((done, t0, w0 / area, (w1 - w0) / (t1 - t0) / area))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def position(share: Column, stretches: Column) -> Column:
    """Training time at which ``share`` of a source's demand is reached."""
    at = F.element_at(F.filter(stretches, lambda s: s["done"] <= share), -1)
    rest = share - at["done"]
    root = F.sqrt(F.greatest(F.lit(0.0), at["weight"] * at["weight"] + 2 * at["slope"] * rest))
    steep = at["weight"] + root
    return at["time"] + F.when(steep > 0, 2 * rest / steep).otherwise(F.lit(0.0))


def plan(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] | None = None,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    max_repeats: int = MAX_REPEATS,
    seed: int = 17,
) -> DataFrame:
    """One row per document: the columns of ``keep`` (the key if None), size, source_size, target, taken, pieces.

    ``pieces`` holds (repeat, position, words) of each time the document is trained on, whole but for the
    source's last one. ``taken`` is the sum of their words.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mixing")
    keep = [key] if keep is None else list(keep)
    names = [c for c in keep if c not in ADDED]
    order = F.xxhash64(F.lit(seed), F.col(key), whole_text(text))
    base = df.select(*names, F.col(source).alias("_source"), word_count(text).alias("size"), order.alias("_order"))
    rows = df.count()
    bits = max(0, math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))
    base = base.withColumn("_bucket", F.shiftrightunsigned("_order", 64 - bits) if bits else F.lit(0).cast("long"))

    totals = scratch.stage(base.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words")), "totals")
    sources = scratch.stage(ranked(totals.groupBy("_source").agg(F.sum("_words").alias("n")), scratch), "ranked")
    turn = F.col("_rank") % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    kinds = [F.array(*[F.struct(*[F.lit(float(x)).alias(c) for x, c in zip(part, PARTS)]) for part in integral(s)]) for s in schedules]
    stretches = F.element_at(F.array(*kinds), (F.col("_rank") % len(kinds) + 1).cast("int"))
    planned = targets(sources, max_repeats).select(
        F.col("_source").alias("_name"), "_rank", F.col("n").alias("source_size"), "target", stretches.alias("_stretches")
    )
    table = scratch.stage(planned, "sources")
    sources = hinted(table, BROADCAST_SOURCES)
    earlier = Window.partitionBy("_rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranks = hinted(table.select("_name", "_rank"), BROADCAST_SOURCES)
    offsets = totals.join(ranks, F.col("_source").eqNullSafe(F.col("_name"))).select(
        "_rank", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before")
    )
    rows_ = base.join(ranks, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name", "_source")
    inside = Window.partitionBy("_rank", "_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows_.withColumn("_end", F.sum("size").over(inside)).join(offsets, ["_rank", "_bucket"])
    placed = placed.withColumn("_from", F.col("_before") + F.col("_end") - F.col("size")).join(sources.drop("_name"), "_rank")

    n, target, size = F.col("source_size"), F.col("target"), F.col("size")
    whole = F.when(n > 0, F.floor(target / n)).otherwise(F.lit(0)).cast("long")
    left = F.round(target - whole * n).cast("long")
    last = F.greatest(F.lit(0), F.least(size, left - F.col("_from"))).cast("long")
    # One entry for each whole repeat and, if words are still wanted, one for the rest.
    repeats = F.sequence(F.lit(0).cast("long"), whole)

    def piece(r: Column) -> Column:
        words = F.when(r < whole, size).otherwise(last)
        middle = (r * n + F.col("_from") + words / 2.0) / target
        at = position(F.least(F.lit(1.0), middle), F.col("_stretches"))
        return F.struct(r.cast("int").alias("repeat"), at.alias("position"), words.alias("words"))

    pieces = F.filter(F.transform(repeats, piece), lambda p: p["words"] > 0)
    none = F.array().cast("array<struct<repeat:int,position:double,words:bigint>>")
    pieces = F.when((target > 0) & (size > 0), pieces).otherwise(none)
    taken = F.when((target > 0) & (size > 0), whole * size + last).otherwise(F.lit(0)).cast("long")
    return placed.select(*names, "size", "source_size", "target", taken.alias("taken"), pieces.alias("pieces"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents in training order: columns of ``df``, once per piece, and ``position``.

    A piece that is not the whole document has the beginning of the text with as many words as it takes.
    """
    planned = plan(df, key, text, source, keep=df.columns, **options)
    rows = planned.select(*[c for c in planned.columns if c != "pieces"], F.explode("pieces").alias("_piece"))
    words = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(words, 1, F.col("_piece.words").cast("int")), "")
    out = rows.withColumn(text, F.when(F.col("_piece.words") < F.col("size"), cut).otherwise(F.col(text)))
    names = [c for c in df.columns if c not in ADDED and c != "position"]
    out = out.select(*names, F.col("_piece.position").alias("position"))
    return out.repartitionByRange("position", key).sortWithinPartitions("position", key)
