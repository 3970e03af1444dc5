"""Global order, running totals, exact quantiles, halos and as-of joins without single-task sorts.

The common device: rows are cut into key ranges ("slices") of bounded size; a small table of
per-slice totals is prefix-summed, and each slice is ordered on its own. Ranges that turn out
dense (bursts, ties) are cut again, so one hot range does not end up in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import BROADCAST_ROWS, small, stage

SLICE_ROWS = 250_000
SMALL_SLICE_ROWS = 100_000
HOT_FACTOR = 4
#: Ranges that a dense range is cut into at once.
CUT_WAYS = 64


@dataclass
class Slices:
    rows: DataFrame
    columns: list[str]
    n_slices: int
    n_groups: int


def _cut_label(x: Column, lo: Column, hi: Column, ways: Column) -> Column:
    """Range of equal width between finite bounds; infinities and NaN fall in the outer ranges."""
    share = (x - lo).cast("double") / F.greatest((hi - lo).cast("double"), F.lit(1e-300))
    return F.greatest(F.lit(0.0), F.least(share * ways, ways - 1.0)).cast("long")


def _edge_label(x: Column, edges: Column) -> Column:
    """Twice the number of edges below the value, one more for each it equals: ties get a range of their own."""
    return (F.size(F.filter(edges, lambda e: e < x)) + F.size(F.filter(edges, lambda e: e <= x))).cast("long")


def _edges(key: str, dtype: str) -> Column:
    """Approximate quantiles of the finite values of a numeric key, and infinity."""
    shares = [i / CUT_WAYS for i in range(CUT_WAYS)]
    if dtype not in ("double", "float"):
        return F.percentile_approx(F.col(key), shares, 20 * CUT_WAYS)
    value = F.col(key).cast("double")
    found = F.percentile_approx(F.when(_finite(value), value), shares, 20 * CUT_WAYS)
    return F.concat(F.coalesce(found, F.array().cast("array<double>")), F.array(F.lit(float("inf"))))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def _text_label(text: Column, skip: Column) -> Column:
    """Order-preserving number from the three characters that follow ``skip`` shared ones."""
    label = F.lit(0).cast("long")
    for i in range(1, 4):
        label = label * 2097152 + F.ascii(F.substring(text, skip + i, F.lit(1))).cast("long")
    return label


def _shared_prefix(a: Column, b: Column) -> Column:
    positions = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b))))
    return F.aggregate(
        positions,
        F.lit(0),
        lambda acc, i: F.when(F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i), i).otherwise(acc),
    )


def slice_rows(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    tie: str | None = None,
    target_rows: int | None = None,
    plan_from: DataFrame | None = None,
) -> Slices:
    """Cut rows into ranges of ``key`` (then of ``tie``) with about ``target_rows`` rows each.

    The first cut is by equal widths. Ranges that turn out dense are cut at their own quantiles, and again
    until each is bounded or holds one key and one tie. Infinities and NaN do not disturb the widths. The
    driver reads a handful of totals per cut, never rows. By default slices are small enough to keep all
    cores busy on small tables. ``plan_from``: a cheaper table with the same keys and at least the same
    rows, for instance the input of a deduplication, to take the totals from.
    """
    by = list(by)
    k = F.col(key)
    types = dict(df.dtypes)
    plan = df if plan_from is None else plan_from
    measured = F.when(_finite(k.cast("double")), k) if types[key] in ("double", "float") else k
    head = plan.agg(F.min(measured).alias("lo"), F.max(measured).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if target_rows is None:
        per_core = head.n // (2 * df.sparkSession.sparkContext.defaultParallelism)
        target_rows = max(SMALL_SLICE_ROWS, min(SLICE_ROWS, per_core))
    ways = max(1, math.ceil(head.n / target_rows))
    if head.lo is None or head.lo == head.hi:
        first = F.lit(0).cast("long")
    else:
        first = _cut_label(k, F.lit(head.lo), F.lit(head.hi), F.lit(ways))
    rows, plan = df.withColumn("_s0", first), plan.withColumn("_s0", first)
    columns = ["_s0"]
    if ways == 1:
        return Slices(rows, columns, 1, 1)
    tie_is_text = tie is not None and types[tie] == "string"
    while True:
        stats = [
            F.count(F.lit(1)).alias("_n"),
            F.min(k).alias("_lo"),
            F.max(k).alias("_hi"),
        ]
        if tie is not None:
            stats += [F.min(tie).alias("_tlo"), F.max(tie).alias("_thi")]
        counts = plan.groupBy(*by, *columns).agg(*stats)
        divisible = F.col("_lo") < F.col("_hi")
        if tie is not None:
            divisible = divisible | (F.col("_tlo") < F.col("_thi"))
        hot_test = (F.col("_n") > HOT_FACTOR * target_rows) & divisible
        head = counts.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct(F.struct(*by)).alias("g") if by else F.lit(1).alias("g"),
            F.count_if(hot_test).alias("hot"),
        ).first()
        if head.hot == 0:
            return Slices(rows, columns, head.n, head.g)
        hot = counts.filter(hot_test).withColumn("_hot", F.lit(True))
        hot = F.broadcast(hot) if head.hot <= BROADCAST_ROWS else hot
        edges = [_edges(key, types[key]).alias("_edges")]
        if tie is not None and not tie_is_text:
            edges.append(_edges(tie, types[tie]).alias("_tie_edges"))
        cuts = plan.join(hot.select(*by, *columns), [*by, *columns], "left_semi").groupBy(*by, *columns).agg(*edges)
        hot = stage(hot.join(cuts, [*by, *columns]), "cuts")
        hot = F.broadcast(hot) if head.hot <= BROADCAST_ROWS // CUT_WAYS else hot
        label = by_key = _edge_label(k, F.col("_edges"))
        if tie is not None:
            if tie_is_text:
                by_tie = _text_label(F.col(tie), _shared_prefix(F.col("_tlo"), F.col("_thi")))
            else:
                by_tie = _edge_label(F.col(tie), F.col("_tie_edges"))
            label = F.when(F.col("_lo") < F.col("_hi"), by_key).otherwise(by_tie)
        name = f"_s{len(columns)}"
        cut = F.when(F.col("_hot"), label).otherwise(F.lit(0)).cast("long").alias(name)
        rows, plan = (
            side.join(hot, [*by, *columns], "left").select(*side.columns, cut) for side in (rows, plan)
        )
        columns.append(name)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    target_rows: int | None = None,
    plan_from: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums of ``totals`` in ``order`` within ``by``; order[0] is numeric."""
    by, order = list(by), list(order)
    tie = order[1] if len(order) > 1 else None
    work = df.select("*", *[c.alias(f"_w_{n}") for n, c in totals.items()])
    cut = slice_rows(work, by, order[0], tie, target_rows, plan_from)
    within = (
        Window.partitionBy(*by, *cut.columns).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = cut.rows
    if cut.n_slices > cut.n_groups:
        before = (
            Window.partitionBy(*by).orderBy(*cut.columns).rowsBetween(Window.unboundedPreceding, -1)
        )
        slice_totals = rows.groupBy(*by, *cut.columns).agg(
            *[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in totals]
        )
        offsets = slice_totals.select(
            *by,
            *cut.columns,
            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals],
        )
        if cut.n_slices <= BROADCAST_ROWS:
            offsets = F.broadcast(offsets)
        rows = rows.join(offsets, [*by, *cut.columns])
        out = {n: F.sum(f"_w_{n}").over(within) + F.col(f"_o_{n}") for n in totals}
    else:
        out = {n: F.sum(f"_w_{n}").over(within) for n in totals}
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def event_index(
    df: DataFrame,
    by: Sequence[str] = ("stream_id",),
    order: Sequence[str] = ("ts_us", "event_id"),
    name: str = "idx",
    target_rows: int | None = None,
    plan_from: DataFrame | None = None,
) -> DataFrame:
    """1-based position of each row in the canonical order of its stream."""
    return running_totals(df, by, order, {name: F.lit(1).cast("long")}, target_rows, plan_from)


def first_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, name: str = "idx", target_rows: int | None = None
) -> DataFrame:
    """First ``n`` rows per group with their position.

    Only ranges that open before position ``n`` are kept, so what gets ordered per group is bounded
    by ``n`` and one range, not by the group.
    """
    by, order = list(by), list(order)
    cut = slice_rows(df, by, order[0], order[1] if len(order) > 1 else None, target_rows)
    rows = cut.rows
    if cut.n_slices > cut.n_groups:
        earlier = (
            Window.partitionBy(*by).orderBy(*cut.columns).rowsBetween(Window.unboundedPreceding, -1)
        )
        totals = rows.groupBy(*by, *cut.columns).agg(F.count(F.lit(1)).alias("_n"))
        opens = totals.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        near = small(opens.filter(F.col("_before") < n).select(*by, *cut.columns))
        rows = rows.join(near, [*by, *cut.columns], "left_semi")
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return rows.select(*df.columns, position.alias(name)).filter(F.col(name) <= n)


def with_halo(
    df: DataFrame, position: str, size: int, halo: int, chunk: str = "_chunk", core: str = "_core"
) -> DataFrame:
    """Copy each row into every later chunk whose first ``halo`` positions look back on it.

    With size >= halo a row is copied once at most. Rows in their own chunk have ``core`` true.
    """
    p = F.col(position)
    own = F.floor(p / F.lit(size)).cast("long")
    last = F.floor((p + F.lit(halo)) / F.lit(size)).cast("long")
    return df.withColumn(chunk, F.explode(F.sequence(own, last))).withColumn(core, F.col(chunk) == own)


def with_previous(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], chunk: float, name: str = "_prev"
) -> DataFrame:
    """Add a struct of ``columns`` of the previous row in ``order`` within ``by``, null for the first.

    Rows are ordered inside ranges of order[0]; the last row before a range is carried in from a
    per-range summary, so a group of any size spreads over tasks.
    """
    by, order = list(by), list(order)
    bundle = F.struct(*columns)
    rows = df.withColumn("_range", F.floor(F.col(order[0]) / F.lit(chunk)).cast("long"))
    closing = rows.groupBy(*by, "_range").agg(F.max_by(bundle, F.struct(*order)).alias("_closing"))
    carry = F.lag("_closing").over(Window.partitionBy(*by).orderBy("_range"))
    opening = closing.select(*by, "_range", carry.alias("_carry"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    rows = rows.withColumn("_near", F.lag(bundle).over(inside)).join(opening, [*by, "_range"])
    return rows.select(*df.columns, F.coalesce("_near", "_carry").alias(name))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], target_rows: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group; null and NaN values are left out, infinities are not.

    Equal values are counted before the shuffle, and the ranks are read off a distributed running count,
    whatever the size of a group.
    """
    by = list(by)
    v = F.col(value).cast("double")
    data = df.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = stage(data.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), "counted")
    ranked = running_totals(counted, by, ["_v"], {"_cum": F.col("_c")}, target_rows)
    sizes = counted.groupBy(*by).agg(F.sum("_c").alias("_n"))
    ranked = ranked.join(sizes, by) if by else ranked.withColumn("_n", F.lit(sizes.first()._n))
    picks = []
    for n, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        picks.append(F.min(F.when(F.col("_cum") > F.floor(pos), F.col("_v"))).alias(f"_lo_{n}"))
        picks.append(F.min(F.when(F.col("_cum") > F.ceil(pos), F.col("_v"))).alias(f"_hi_{n}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_f_{n}"))
    picked = ranked.groupBy(*by).agg(*picks)

    def between(n: str) -> Column:
        lo, hi, f = (F.col(f"_{c}_{n}") for c in ("lo", "hi", "f"))
        return F.when((f == 0) | (lo == hi), lo).otherwise(lo * (1 - f) + hi * f)

    return picked.select(*by, *[between(n).alias(n) for n in probs])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    ts: str,
    chunk_us: int,
    right_tie: str | None = None,
    salts: int = 1,
    sparse_left: bool = False,
) -> DataFrame:
    """Each left row with the latest right row at or before it, right columns null where none.

    Both sides are cut into time chunks; the row in force when a chunk opens is carried in from a
    per-chunk summary of the right side, so no stream is ordered in one task. ``salts`` splits the
    left rows of a chunk further (for a short right side, which is repeated per salt);
    ``sparse_left`` orders only the chunks that hold left rows (for a long right side).
    """
    by = list(by)
    payload = [c for c in right.columns if c not in (*by, ts)]
    bundle = F.struct(F.col(ts).alias("_rts"), *payload)
    newest = F.struct(F.col(ts), *([F.col(right_tie)] if right_tie else []))
    chunk = F.floor(F.col(ts) / F.lit(chunk_us)).cast("long")
    right_rows = right.select(*by, F.col(ts), chunk.alias("_chunk"), bundle.alias("_r"), newest.alias("_o"))
    salt = F.pmod(F.xxhash64(*by, ts), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
    left_rows = left.withColumns({"_chunk": chunk, "_salt": salt})

    closing = right_rows.groupBy(*by, "_chunk").agg(F.max_by("_r", "_o").alias("_r"))
    wanted = left_rows.select(*by, "_chunk").distinct().withColumn("_r", F.lit(None).cast(closing.schema["_r"].dataType))
    timeline = closing.unionByName(wanted).groupBy(*by, "_chunk").agg(F.max("_r").alias("_r"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = timeline.select(*by, "_chunk", F.last("_r", ignorenulls=True).over(before).alias("_carry"))

    # Right rows sort before left rows of the same instant, later right rows win.
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema if f.name not in (*by, ts)]
    near = right_rows
    if sparse_left:
        near = near.join(small(left_rows.select(*by, "_chunk").distinct()), [*by, "_chunk"], "left_semi")
    marks = near.select(
        *by, ts, "_chunk", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), *empty, "_r",
        F.lit(0).alias("_side"), (F.col(f"_o.{right_tie}") if right_tie else F.lit(0)).alias("_rt"),
    )
    rows = left_rows.withColumns(
        {
            "_r": F.lit(None).cast(closing.schema["_r"].dataType),
            "_side": F.lit(1),
            "_rt": F.lit(None).cast(marks.schema["_rt"].dataType),
        }
    )
    inside = (
        Window.partitionBy(*by, "_chunk", "_salt")
        .orderBy(ts, "_side", "_rt")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    merged = rows.unionByName(marks).withColumn("_hit", F.last("_r", ignorenulls=True).over(inside))
    matched = merged.filter("_side = 1").join(carried, [*by, "_chunk"], "left")
    hit = F.coalesce(F.col("_hit"), F.col("_carry"))
    return matched.select(*left.columns, *[hit[c].alias(c) for c in payload], hit["_rts"].alias(f"right_{ts}"))
