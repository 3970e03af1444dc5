"""Frozen reference profiles and windowed comparison against them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import BINS, SCORE, DriftConfig
from tidegauge.functions import distance as D
from tidegauge.operators.ordering import asof_join, exact_quantiles, running_totals, with_halo, with_previous
from tidegauge.session import hinted, small, stage

# Quantile positions of the bin edges.
DECILES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
PANE_CHUNK = 256
ACTION_CHUNK_US = 600_000_000
#: Positions of one range in which versions are put in order.
VERSION_RANGE = 1_000_000
#: Positions of one range whose rows meet the versions that look back on them.
VERSION_ROWS = 20_000


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys..., feature, value), one row per column."""
    items = ", ".join(f"named_struct('feature', '{c}', 'value', CAST({c} AS DOUBLE))" for c in columns)
    return df.select(*keys, F.expr(f"inline(array({items}))"))


def bin_counts() -> list[Column]:
    return [F.expr(f"count_if(bin = {i}) AS b{i}") for i in range(1, BINS + 1)]


def count_names(prefix: str = "b") -> list[str]:
    return [f"{prefix}{i}" for i in range(1, BINS + 1)]


def total_of(prefix: str = "b") -> str:
    return "(" + " + ".join(count_names(prefix)) + ")"


def decile_edges(values: DataFrame, keys: Sequence[str], bounded: bool = True) -> DataFrame:
    """Per key: padded decile edges, size, mean and spread of a sample ``value``.

    A sample of bounded size, as a reference is, uses the built-in percentile; for others the deciles come
    from the distributed ranks. Both interpolate alike.
    """
    names = [f"_q{i}" for i in range(len(DECILES))]
    moments = [
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("value").alias("n"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("_std"),
    ]
    if bounded:
        probs = F.array(*[F.lit(p) for p in DECILES])
        stats = values.groupBy(*keys).agg(F.percentile("value", probs).alias("_q"), *moments)
    else:
        levels = exact_quantiles(values, keys, "value", dict(zip(names, DECILES, strict=True)))
        stats = values.groupBy(*keys).agg(*moments).join(levels, list(keys)).withColumn("_q", F.array(*names))
    q = F.col("_q")
    edges = F.array(
        F.col("_lo") - D.EDGE_PAD, *[q[i] for i in range(1, BINS)], F.col("_hi") + D.EDGE_PAD
    )
    return stats.select(*keys, edges.alias("edges"), "n", "mean", (F.col("_std") + F.lit(1e-9)).alias("std"))


def build_profile(reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Profile table (keys..., feature): edges, reference shares, size, mean, spread.

    ``reference`` is long form and bounded by the reference size per key.
    """
    group = [*keys, "feature"]
    edges = decile_edges(reference, group)
    binned = reference.join(small(edges), group).withColumn("bin", D.bin_of("value", "edges"))
    counts = binned.groupBy(*group).agg(
        *bin_counts(), F.first("edges").alias("edges"), F.first("n").alias("n"),
        F.first("mean").alias("mean"), F.first("std").alias("std"),
    )
    shares = F.expr("array(" + ", ".join(D.clipped_share(c, total_of()) for c in count_names()) + ")")
    return counts.select(*group, "edges", shares.alias("ref_perc"), "n", "mean", "std")


def reference_profile(scored: DataFrame, cfg: DriftConfig, features: Sequence[str]) -> DataFrame:
    """Version 0 of every stream whose reference phase is complete."""
    rows = scored.filter(F.col("t") <= cfg.reference_events)
    full = build_profile(long_form(rows, ["stream_id"], [*features, SCORE]), ["stream_id"])
    return full.filter(F.col("n") == cfg.reference_events).withColumns(
        {"profile_id": F.lit(0), "from_u": F.lit(0).cast("long"), "to_u": F.lit(None).cast("long")}
    )


def _wide(columns: Sequence[str]) -> list[Column]:
    """Columns as doubles, and a number whose bits say which of them are null (pandas has NaN for both)."""
    nulls = " + ".join(f"IF({c} IS NULL, {1 << i}, 0)" for i, c in enumerate(columns))
    return [*[F.col(c).cast("double").alias(c) for c in columns], F.expr(f"CAST({nulls} AS INT)").alias("_nulls")]


def _matrix(pdf: pd.DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``_wide`` rows, and where they are null."""
    nulls = (pdf["_nulls"].to_numpy()[:, None] >> np.arange(len(columns))) & 1
    return np.column_stack([pdf[c].to_numpy(float) for c in columns]), nulls.astype(bool)


def _bins_of(values: np.ndarray, null: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """``distance.bin_of`` for a matrix of rows and features; ``edges``: one row of edges a feature."""
    passed = np.zeros(values.shape, dtype=np.int64)
    for i in range(BINS + 1):
        passed += values >= edges[:, i]
    inside = ~null & ~np.isnan(values) & ~(values < edges[:, 0]) & ~(values > edges[:, BINS])
    return np.where(inside, np.minimum(passed, BINS), 0)


def _deciles(ordered: np.ndarray) -> np.ndarray:
    """Interpolated as the built-in percentile does it; rows in order, one column a feature."""
    out = np.empty((len(DECILES), ordered.shape[1]))
    for i, p in enumerate(DECILES):
        at = (len(ordered) - 1) * p
        low, high = math.floor(at), math.ceil(at)
        a, b = ordered[low], ordered[high]
        with np.errstate(invalid="ignore"):
            out[i] = a if low == high else np.where(a == b, a, (high - at) * a + (at - low) * b)
    return out


BUILT_SCHEMA = (
    "stream_id string, profile_id int, feature string, edges array<double>, ref_perc array<double>, n long, "
    "mean double, std double, at_u long, to_u long"
)


def _built_profiles(rows: DataFrame, versions: DataFrame, kept: int, columns: Sequence[str]) -> DataFrame:
    """Profiles of the versions of each range of positions, as ``build_profile`` gives them: a version's window is cut
    out of its range's rows, so rows are neither repeated nor shuffled by version."""
    width = len(columns)

    def one(values: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges, size, mean and spread a feature."""
        if not null.any():
            quantiles, n = _deciles(np.sort(values, axis=0)), np.full(width, len(values))
            mean, std = values.mean(axis=0), values.std(axis=0)
        else:
            quantiles, mean, std = np.full((len(DECILES), width), np.nan), np.full(width, np.nan), np.full(width, np.nan)
            n = (~null).sum(axis=0)
            for k in np.flatnonzero(n):
                known = values[~null[:, k], k]
                quantiles[:, k] = _deciles(np.sort(known)[:, None])[:, 0]
                mean[k], std[k] = known.mean(), known.std()
        edges = quantiles.T.copy()
        edges[:, 0] -= D.EDGE_PAD
        edges[:, BINS] += D.EDGE_PAD
        return edges, n, mean, std + 1e-9

    def build(key: tuple[Any, ...], pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        u = pdf["u"].to_numpy()
        values, null = _matrix(pdf, columns)
        found: list[tuple] = []
        for at in asked["at_u"].to_numpy():
            a, b = np.searchsorted(u, [at - kept, at], side="right")
            edges, n, mean, std = one(values[a:b], null[a:b])
            bins = _bins_of(values[a:b], null[a:b], edges) + (BINS + 1) * np.arange(width)
            counts = np.bincount(bins.ravel(), minlength=(BINS + 1) * width).reshape(width, BINS + 1)[:, 1:]
            shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True)).astype(float)
            found.append((edges, np.clip(shares, D.SHARE_FLOOR, 1.0), n, mean, std))
        def laid(i: int) -> np.ndarray:
            return np.concatenate([f[i] for f in found]) if found else np.empty(0)
        each = asked.loc[asked.index.repeat(width)]
        return pd.DataFrame(
            {
                "stream_id": each["stream_id"].to_numpy(), "profile_id": each["profile_id"].to_numpy(), "feature": list(columns) * len(asked),
                "edges": list(laid(0)), "ref_perc": list(laid(1)), "n": laid(2).astype(np.int64), "mean": laid(3), "std": laid(4),
                "at_u": each["at_u"].to_numpy(), "to_u": each["to_u"].astype("Int64").to_numpy(dtype=object, na_value=None),
            }
        )

    place = ["stream_id", "_chunk"]
    table = rows.groupBy(*place).cogroup(versions.groupBy(*place)).applyInPandas(build, BUILT_SCHEMA)
    # What is NaN comes back from pandas as null.
    nan = F.lit(float("nan"))
    some = F.col("n") > 0
    return table.withColumns(
        {
            "edges": F.when(some, F.transform("edges", lambda e: F.coalesce(e, nan))).otherwise(F.transform("edges", lambda e: F.lit(None).cast("double"))),
            "mean": F.when(some, F.coalesce("mean", nan)), "std": F.when(some, F.coalesce("std", nan)),
        }
    )


def refreshed_profiles(
    scored: DataFrame, base: DataFrame, refreshes: DataFrame, cfg: DriftConfig, features: Sequence[str]
) -> DataFrame:
    """Add a version per operator refresh: the current window becomes the reference.

    ``refreshes`` (stream_id, ts_us) is an operator action log. A refresh with fewer than
    ``min_samples`` current rows has no effect. ``base``: one version per stream; later ones are numbered on from it.
    """
    current = scored.filter(F.col("t") > cfg.reference_events).select(
        "stream_id", "ts_us", (F.col("t") - cfg.reference_events).alias("u"), *features, SCORE
    )
    # Position of the last row at or before each action: an as-of join, no pairing of rows and actions.
    at = (
        asof_join(refreshes.select("stream_id", "ts_us"), current.select("stream_id", "ts_us", "u"), ["stream_id"], "ts_us", ACTION_CHUNK_US, "u", sparse_left=True)
        .filter(F.col("u") >= cfg.min_samples)
        .groupBy(F.col("stream_id"), F.col("u").alias("at_u"))
        .agg(F.min("ts_us").alias("act_us"))
        .withColumn("back", -F.col("at_u"))
    )
    at = stage(at, "refreshes")
    # Numbers and successors come from ranges of positions, so a stream's versions meet in no single window.
    following = with_previous(at, ["stream_id"], ["back"], ["at_u"], VERSION_RANGE).select(
        "stream_id", "at_u", F.col("_prev.at_u").alias("to_u")
    )
    numbered = running_totals(at, ["stream_id"], ["at_u"], {"_n": F.lit(1).cast("long")}).select("stream_id", "at_u", "_n")
    held = base.groupBy("stream_id").agg(F.max("profile_id").alias("_held"))
    versions = numbered.join(following, ["stream_id", "at_u"]).join(small(held), "stream_id", "left")
    versions = versions.withColumn("profile_id", (F.coalesce("_held", F.lit(0)) + F.col("_n")).cast("int")).drop("_held")
    versions = stage(versions, "versions")
    kept = min(cfg.window_size, cfg.reference_events)
    # A version draws on the last `kept` rows, which its range of positions carries as a halo.
    size = max(VERSION_ROWS, kept)
    wanted = versions.select("stream_id", "profile_id", "at_u", "to_u", F.floor(F.col("at_u") / size).cast("long").alias("_chunk"))
    places = hinted(stage(wanted.select("stream_id", "_chunk").distinct(), "version-places"))
    rows = with_halo(current.select("stream_id", "u", *_wide([*features, SCORE])), "u", size, kept).join(places, ["stream_id", "_chunk"], "left_semi")
    built = _built_profiles(rows, wanted, kept, [*features, SCORE])
    later = built.select(
        "stream_id", "feature", "edges", "ref_perc", "n", "mean", "std", "profile_id",
        F.col("at_u").alias("from_u"), "to_u",
    )
    first = versions.filter("_n = 1").select("stream_id", F.col("at_u").alias("_first"))
    opened = base.join(first, "stream_id", "left").withColumn("to_u", F.col("_first")).drop("_first")
    return opened.unionByName(later)


def _single_version(profile: DataFrame) -> bool:
    """Whether every stream has its first version only, in force throughout."""
    return profile.filter(F.col("feature") == SCORE).filter(F.col("to_u").isNotNull() | (F.col("from_u") > 0)).isEmpty()


def pane_stats(scored: DataFrame, profile: DataFrame, cfg: DriftConfig, features: Sequence[str]) -> DataFrame:
    """Binned counts and sums per (stream, profile version, pane, feature).

    With one version a stream, columns turn into rows, meet the stored profile (broadcast if its size allows) and are
    pre-aggregated per pane on the map side, so the shuffle carries summaries only. With more versions, each meets
    the ranges of positions that its evaluations look back on.
    """
    rows = scored.filter(F.col("t") > cfg.reference_events).withColumn("u", F.col("t") - cfg.reference_events)
    if not _single_version(profile):
        return _version_panes(rows, profile, cfg, [*features, SCORE])
    pane = math.gcd(cfg.window_size, cfg.interval)
    rows = rows.withColumn("profile_id", F.lit(0))
    long = long_form(rows, ["stream_id", "u", "profile_id"], [*features, SCORE])
    edges = profile.select("stream_id", "feature", "profile_id", "from_u", "to_u", "edges")
    keys = ["stream_id", "profile_id", "from_u", "to_u", "pane", "feature"]
    binned = long.join(hinted(edges), ["stream_id", "profile_id", "feature"]).withColumns(
        {"bin": D.bin_of("value", "edges"), "pane": F.ceil(F.col("u") / pane).cast("long")}
    )
    return binned.groupBy(*keys).agg(*bin_counts(), F.sum("value").alias("total"), F.count(F.lit(1)).alias("rows"))


PANE_SCHEMA = (
    "stream_id string, profile_id int, from_u long, to_u long, pane long, feature string, "
    + ", ".join(f"{b} long" for b in count_names()) + ", total double, rows long, _known long"
)


def _version_panes(rows: DataFrame, profile: DataFrame, cfg: DriftConfig, columns: Sequence[str]) -> DataFrame:
    """``pane_stats`` where streams have several versions.

    Evaluations of a version lie in (from_u, to_u], at multiples of the interval, and each looks back on one window
    of rows. A version without an evaluation has no panes; the others are cut out of the ranges of positions
    they reach into, so rows are shuffled once, whatever the number of versions.
    """
    pane = math.gcd(cfg.window_size, cfg.interval)
    window, interval, width = cfg.window_size, cfg.interval, len(columns)
    size = window * max(1, VERSION_ROWS // window)
    spans = small(rows.groupBy("stream_id").agg(F.min("u").alias("_start"), F.max("u").alias("_last")))
    first = (F.floor(F.col("from_u") / interval) + 1) * interval
    last = F.floor(F.least(F.coalesce("to_u", "_last"), F.col("_last")) / interval) * interval
    low = F.greatest(F.col("_start"), first + 1 - window).cast("long")
    due = profile.join(spans, "stream_id").filter(first <= last).withColumns({"_low": low, "_high": last.cast("long")})
    ranges = F.sequence(F.floor((F.col("_low") - 1) / size).cast("long"), F.floor((F.col("_high") - 1) / size).cast("long"))
    due = due.filter("_low <= _high").select("stream_id", "profile_id", "feature", "from_u", "to_u", "edges", "_low", "_high", F.explode(ranges).alias("_chunk"))
    due = stage(due, "version-ranges")
    numbers = {c: i for i, c in enumerate(columns)}

    def count(key: tuple[Any, ...], pdf: pd.DataFrame, versions: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        u = pdf["u"].to_numpy()
        values, null = _matrix(pdf, columns)
        panes = -(-u // pane)
        heads, tables = [], []
        versions = versions.assign(_place=versions["feature"].map(numbers)).sort_values(["profile_id", "_place"])
        ids = versions["profile_id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
        for start, stop in zip(starts, [*starts[1:], len(ids)], strict=True):
            v = versions.iloc[start:stop]
            at = v["_place"].to_numpy()
            a, b = np.searchsorted(u, [v["_low"].iloc[0], v["_high"].iloc[0] + 1])
            if a == b:
                continue
            x, gone, mine = values[a:b][:, at], null[a:b][:, at], panes[a:b]
            bins = _bins_of(x, gone, np.stack(v["edges"].to_list()).astype(float))
            cuts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            row = np.repeat(np.arange(len(cuts)), np.diff(np.r_[cuts, len(mine)]))
            flat = (row[:, None] * len(at) + np.arange(len(at))) * (BINS + 1) + bins
            n = np.bincount(flat.ravel(), minlength=len(cuts) * len(at) * (BINS + 1)).reshape(-1, BINS + 1)
            total = np.add.reduceat(np.where(gone, 0.0, x), cuts, axis=0).ravel()
            known = np.add.reduceat((~gone).astype(np.int64), cuts, axis=0).ravel()
            full = np.repeat(np.diff(np.r_[cuts, len(mine)]), len(at))
            heads.append((ids[start], v["from_u"].iloc[0], v["to_u"].iloc[0], np.repeat(mine[cuts], len(at)), np.tile(v["feature"].to_numpy(), len(cuts))))
            tables.append((n, total, known, full))
        sizes = [len(t[1]) for t in tables]

        def spread(i: int) -> np.ndarray:
            return np.repeat(np.array([h[i] for h in heads], dtype=float if i == 2 else np.int64), sizes)

        def laid(parts: list) -> np.ndarray:
            return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)

        n = np.concatenate([t[0] for t in tables]) if tables else np.empty((0, BINS + 1), dtype=np.int64)
        out = {"stream_id": [key[0]] * sum(sizes), "profile_id": spread(0), "from_u": spread(1), "to_u": pd.array(spread(2), dtype="Int64") if sizes else [],
               "pane": laid([h[3] for h in heads]), "feature": laid([h[4] for h in heads])}
        out |= {b: n[:, i + 1] for i, b in enumerate(count_names())}
        return pd.DataFrame(out | {"total": laid([t[1] for t in tables]), "rows": laid([t[3] for t in tables]), "_known": laid([t[2] for t in tables])})

    place = ["stream_id", "_chunk"]
    ranged = rows.select("stream_id", "u", *_wide(columns), F.floor((F.col("u") - 1) / size).cast("long").alias("_chunk"))
    table = ranged.groupBy(*place).cogroup(due.groupBy(*place)).applyInPandas(count, PANE_SCHEMA)
    # What is NaN comes back from pandas as null.
    total = F.when(F.col("_known") > 0, F.coalesce("total", F.lit(float("nan"))))
    return table.withColumn("total", total).drop("_known")


def windowed_distances(panes: DataFrame, profile: DataFrame, cfg: DriftConfig) -> DataFrame:
    """Distances of the sliding window against the profile at every evaluation tick ``u``."""
    pane = math.gcd(cfg.window_size, cfg.interval)
    span = cfg.window_size // pane
    chunk = max(PANE_CHUNK, span)
    frame = (
        Window.partitionBy("stream_id", "profile_id", "feature", "_chunk")
        .orderBy("pane")
        .rowsBetween(-(span - 1), 0)
    )
    sums = [F.sum(b).over(frame).alias(w) for b, w in zip(count_names(), count_names("w"), strict=True)]
    rows = with_halo(panes, "pane", chunk, span - 1).select(
        "stream_id", "profile_id", "from_u", "to_u", "pane", "feature", "_core",
        F.col("rows").alias("_full"), *sums, F.sum("total").over(frame).alias("total"),
        F.sum("rows").over(frame).alias("n_cur"),
    )
    u = F.col("pane") * pane
    ticks = rows.withColumn("u", u).filter(
        F.col("_core")
        & (F.col("_full") == pane)
        & (F.col("u") % cfg.interval == 0)
        & (F.col("n_cur") >= cfg.min_samples)
        & (F.col("u") > F.col("from_u"))
        & (F.col("to_u").isNull() | (F.col("u") <= F.col("to_u")))
    )
    ref = hinted(profile).select("stream_id", "profile_id", "feature", "ref_perc", "n", "mean", "std")
    joined = ticks.join(ref, ["stream_id", "profile_id", "feature"])
    counts, inside = count_names("w"), total_of("w")
    shares = [f"ref_perc[{i}]" for i in range(BINS)]
    crit = F.when(
        F.col("feature") == SCORE, D.ks_critical(F.col("n"), F.col("n_cur"), cfg.pred_ks_p)
    ).otherwise(D.ks_critical(F.col("n"), F.col("n_cur"), cfg.feature_ks_p))
    return joined.select(
        "stream_id", "profile_id", "u", (F.col("u") + cfg.reference_events).alias("t"), "feature", "n_cur",
        D.psi([D.clipped_share(c, inside) for c in counts], shares).alias("psi"),
        D.ks_of_bins(counts, inside, shares).alias("ks"),
        crit.alias("ks_critical"),
        D.mean_shift(F.col("total") / F.col("n_cur"), F.col("mean"), F.col("std")).alias("mean_shift_z"),
    )
