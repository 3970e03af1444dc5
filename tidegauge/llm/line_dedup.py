"""Removal of lines that repeat, or nearly repeat, an earlier line anywhere in the corpus.

Lines end at line feeds; white space around a line does not count. A line's set are its runs of five
characters (a shorter line is one run). Lines are linked when their sets' similarity is at least the
threshold; all that links lead to is a component, and only its first line, in order of key, text and line
number, stays. Equal lines are one item in the search. See ``minhash`` for the search.

A line is known by 128 bits of hash, in the search by the first 64 of them.

Defined cases: lines of white space always stay; null and empty texts have one such line; null keys come
after all others; rows that repeat key and text keep and lose the same lines; an empty table gives an empty
result; columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm import minhash
from tidegauge.llm.common import Scratch, whole_text
from tidegauge.session import hinted

CHARACTERS = 5
THRESHOLD = 0.8
RECALL = 0.99
#: 16 bands of 6 rows: lines that only share common runs, whose pairs grow with the square of the corpus, seldom meet.
HASHES = 96
#: Numbers of lines (8 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 2_000_000
#: Repeated lines (about 60 bytes each) whose first places are broadcast.
BROADCAST_KINDS = 500_000
#: Documents whose numbers of dropped lines are broadcast; more are joined by a shuffle.
BROADCAST_DOCS = 250_000
#: Lines that a task remembers to have signed already.
REMEMBERED = 500_000
#: Characters of lines whose runs are hashed at once, and of texts whose lines go on together.
LETTERS = 1 << 16
TEXT_LETTERS = 1 << 21
BLANKS = " \t\x0b\x0c\r"

_POWERS = minhash.mixed(np.arange(501, 501 + 64, dtype=np.uint64)) | np.uint64(1)


def runs(lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of all lines, and where each line's begin. No line is empty."""
    lengths = np.array([len(x) for x in lines], np.int64)
    letters = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    total = len(letters)
    padded = np.concatenate([letters, np.zeros(n, np.uint32)]).astype(np.uint64)
    hashed, part = padded[:total] * _POWERS[0], np.empty(total, np.uint64)
    for k in range(1, n):
        np.multiply(padded[k : k + total], _POWERS[k], out=part)
        hashed += part
    hashed = minhash.mixed(hashed)
    count = np.maximum(lengths - n + 1, 1)
    ends = np.cumsum(lengths)
    first = ends - lengths
    starts = np.concatenate([[0], np.cumsum(count)])
    whole = np.ones(total, bool)  # n-grams that do not reach into the next line, and one of each line
    for k in range(1, n):
        whole[(ends - k)[lengths > k]] = False
    out = hashed[whole]
    for i in np.flatnonzero(lengths < n).tolist():
        a = int(first[i])
        some = padded[a : a + int(lengths[i])] * _POWERS[n : n + int(lengths[i])]
        out[starts[i]] = minhash.mixed(np.array([some.sum(dtype=np.uint64) + np.uint64(lengths[i])]))[0]
    return out, starts


def sets_of_runs(lines: list[str], n: int) -> list[np.ndarray]:
    """Each line's set of runs, sorted, by the first 52 bits of their hashes: lines are sorted together, some at a time."""
    out: list[np.ndarray] = []
    for a, b in stretches(lines):
        elements, starts = runs(lines[a:b], n)
        line = np.repeat(np.arange(b - a, dtype=np.uint64) << np.uint64(52), np.diff(starts))
        line |= elements >> np.uint64(12)
        line.sort()
        line = line[np.concatenate([[True], line[1:] != line[:-1]])]
        ends = np.searchsorted(line, np.arange(1, b - a, dtype=np.uint64) << np.uint64(52))
        out += np.split(line << np.uint64(12), ends)
    return out


def stretches(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Ends of stretches of lines of about ``LETTERS`` characters, which stay in the processor's cache."""
    a = size = 0
    for i, line in enumerate(lines):
        if i > a and (size + len(line) > LETTERS or i - a == 4096):
            yield a, i
            a, size = i, 0
        size += len(line)
    if lines:
        yield a, len(lines)


def lines_of(df: DataFrame, text: str) -> DataFrame:
    """Rows (item, line) of all lines that are not blank."""
    rows = df.select(F.explode(F.split(whole_text(text), "\n")).alias("line"))
    rows = rows.select(F.btrim("line", F.lit(BLANKS)).alias("line")).filter("line <> ''")
    return rows.select(F.xxhash64("line").alias("item"), "line")


def signed_lines(df: DataFrame, key: str, text: str, n: int, bands: int, per_band: int) -> DataFrame:
    """Rows (id, th, no, item, rest, bands) of all lines that are not blank; item, the xxhash64 of the line, and rest are hashes.

    A line has its band hashes where a task meets it first.
    """
    whole = whole_text(text)
    docs = df.select(F.col(key).alias("id"), F.xxhash64(whole).alias("th"), whole.alias("whole"))
    schema = docs.drop("whole").schema.add("no", "integer").add("item", "long").add("rest", "long").add("bands", T.ArrayType(T.LongType()))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        of = xxhash.xxh64_intdigest
        for batch in batches:
            texts = batch.column("whole").to_pylist()
            for a, b in pieces(texts):
                rows, numbers, items, rest, new, fresh = [], [], [], [], [], []
                for row in range(a, b):
                    for no, line in enumerate(texts[row].split("\n")):
                        line = line.strip(BLANKS)
                        if not line:
                            continue
                        raw = line.encode("utf-8", "surrogatepass")
                        item = of(raw, 42)
                        if item not in seen:
                            seen.add(item)
                            new.append(len(items))
                            fresh.append(line)
                        rows.append(row)
                        numbers.append(no)
                        items.append(item)
                        rest.append(of(raw, 1))
                if len(seen) > REMEMBERED:
                    seen.clear()
                if not items:
                    continue
                hashed = [minhash.band_hashes(*runs(fresh[x:y], n), bands, per_band, LETTERS) for x, y in stretches(fresh)]
                flat = np.concatenate(hashed).ravel().view(np.int64) if hashed else np.zeros(0, np.int64)
                signed = np.zeros(len(items), bool)
                signed[new] = True
                ends = np.concatenate([[0], np.cumsum(signed) * bands]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(~signed))
                held = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("id", "th")]
                hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (items, rest)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(numbers, pa.int32()), *hashes, lists], names=["id", "th", "no", "item", "rest", "bands"])

    return docs.mapInArrow(sign, schema)


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ends of stretches of texts of about ``TEXT_LETTERS`` characters."""
    a = size = 0
    for i, text in enumerate(texts):
        if i > a and size + len(text) > TEXT_LETTERS:
            yield a, i
            a, size = i, 0
        size += len(text)
    if texts:
        yield a, len(texts)


def dropped_lines(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = CHARACTERS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows (id, th, dropped): numbers of the lines to drop, for documents that lose any."""
    scratch = Scratch(df.sparkSession, "line-dedup")
    bands, per_band = minhash.choose_bands(threshold, recall, HASHES)
    signed = scratch.stage(signed_lines(df, key, text, n, bands, per_band), "signed")
    lines = scratch.stage(signed.drop("bands"), "lines")
    led = minhash.leaders(signed.filter("bands is not null").select("item", F.explode("bands").alias("h")))
    led = scratch.stage(led, "led")
    scratch.free("signed")
    wanted = hinted(led.select("item"), BROADCAST_LINES)
    found = lines_of(df, text).join(wanted, "item", "left_semi")
    # Lines given often: map-side, one each. The weight is that of the set, not of the copies.
    found = found.groupBy("item").agg(F.first("line").alias("line")).join(led, "item")
    candidates = scratch.stage(found.withColumns({"weight": F.length("line").cast("long"), "copies": F.lit(1).cast("long")}), "candidates")
    links = scratch.stage(minhash.link_groups(candidates, lambda texts: sets_of_runs(texts, n), threshold, "line"), "links")
    scratch.free("candidates")
    closed = minhash.components(links.filter("other is not null").select("item", "other"), scratch)
    closed = hinted(scratch.stage(closed, "closed"), BROADCAST_KINDS)

    # Linked lines belong to their component, others to their own kind. Only lines that are linked or given
    # twice are looked at by their places.
    often = lines.groupBy("item", "rest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    often = hinted(scratch.stage(often, "often"), BROADCAST_KINDS)
    some = lines.join(closed, "item", "left").join(often, ["item", "rest"], "left").filter("class is not null or n is not null")
    linked = F.col("class").isNotNull()
    kind = {"linked": linked, "kind": F.coalesce("class", "item"), "more": F.when(linked, 0).otherwise(F.col("rest"))}
    some = scratch.stage(some.withColumns(kind).select("id", "th", "no", *kind), "some")
    scratch.free("lines")
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("no").alias("no"))
    heads = some.groupBy(*kind).agg(F.min(place).alias("stays"))
    heads = hinted(scratch.stage(heads, "heads"), BROADCAST_KINDS)
    lost = some.join(heads, [*kind]).filter(~place.eqNullSafe(F.col("stays")))
    lost = lost.groupBy("id", "th").agg(F.sort_array(F.collect_set("no")).alias("dropped"))
    return hinted(scratch.stage(lost, "lost"), BROADCAST_DOCS)


@F.pandas_udf(T.StringType())
def without_lines(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for text, numbers in zip(texts, dropped):
        if numbers is not None and len(numbers):
            gone = set(numbers.tolist() if hasattr(numbers, "tolist") else numbers)
            text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
        out.append(text)
    return pd.Series(out, dtype=object)


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Columns of ``df`` with the text without its repeated lines, and n_lines, n_dropped, dropped."""
    lost = dropped_lines(df, key, text, **options)
    lost = lost.withColumnsRenamed({"id": "_id", "th": "_th"})
    whole: Column = whole_text(text)
    base = df.drop("n_lines", "n_dropped", "dropped").withColumn("_own", F.xxhash64(whole))
    joined = base.join(lost, (F.col("_own") == F.col("_th")) & F.col(key).eqNullSafe(F.col("_id")), "left").drop("_own", "_id", "_th")
    feeds = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit("")))
    counted = joined.withColumns(
        {"n_lines": (feeds + 1).cast("long"), "dropped": F.coalesce("dropped", F.array().cast("array<int>"))}
    )
    counted = counted.withColumn("n_dropped", F.size("dropped").cast("long"))
    loses = F.col("n_dropped") > 0
    # Texts that stay whole are not sent to Python.
    return counted.withColumn(text, F.when(loses, without_lines(F.when(loses, whole), F.col("dropped"))).otherwise(F.col(text)))
