"""MinHash signatures, banding and exact verification, shared by the joins on documents and on lines.

The search for links among distinct items runs in these steps.

1. Every item has a MinHash signature, cut into bands. ``choose_bands`` picks the rows per band and the number
   of bands so that a pair at the threshold shares a band with at least the target recall.
2. Band hashes are shuffled. A bucket is the items that share one; its leader is its smallest item. A bucket
   is only counted and minimised, never gathered.
3. All members of buckets with one leader form that leader's group, so each candidate pair, two items in one
   bucket, meets in a group. An item is in as many groups as it has different leaders, at most one a band.
4. A group's items come together with their full sets. A group is cut into blocks of bounded weight and each
   pair of blocks is one task's work, so a group may have any size. Inside, sets are intersected in
   bulk; a pair is counted in the group of its smallest common leader only. No pair is emitted: a block
   gives the number of links of each item and enough links to connect what is linked.
5. Links are closed to classes by ``components``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import Scratch
from tidegauge.session import hinted

#: Most hash functions of a signature.
HASHES = 160
#: Items and set elements in a block of a group.
BLOCK_ITEMS = 512
BLOCK_ELEMENTS = 1_000_000
#: Items of a group up to which its pairs are compared one by one, together with those of other groups.
SMALL_GROUP = 8

#: Buckets (16 bytes each) whose leaders are broadcast to their members; more are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def choose_bands(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which ``hashes`` functions still reach the recall."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def functions_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed pseudo-random xor masks and odd multipliers of 32 bits."""
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32), (seeds[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def band_hashes(elements: np.ndarray, starts: np.ndarray, bands: int, rows: int, chunk: int = 1 << 14) -> np.ndarray:
    """Band hashes, one row per item; item i holds the 64-bit ``elements[starts[i]:starts[i + 1]]``, none empty.

    The elements are worked off in stretches that stay in the processor's cache.
    """
    masks, factors = functions_of(bands * rows)
    n = len(starts) - 1
    small = (elements >> np.uint64(32)).astype(np.uint32) ^ elements.astype(np.uint32)
    signature = np.full((bands * rows, n), np.uint32(0xFFFFFFFF))
    for a in range(0, len(small), chunk):
        part = small[a : a + chunk]
        first = int(np.searchsorted(starts, a, "right")) - 1
        last = int(np.searchsorted(starts, a + len(part), "left"))
        cuts = np.maximum(starts[first:last] - a, 0)
        h = np.empty_like(part)
        for k in range(bands * rows):
            np.bitwise_xor(part, masks[k], out=h)
            np.multiply(h, factors[k], out=h)
            row = signature[k, first:last]
            np.minimum(row, np.minimum.reduceat(h, cuts), out=row)
    out = np.zeros((n, bands), np.uint64)
    for b in range(bands):
        h = np.full(n, np.uint64(b + 1))
        for k in range(b * rows, (b + 1) * rows):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + signature[k])
        out[:, b] = h
    return out


def leaders(bands: DataFrame) -> DataFrame:
    """Rows (item, leaders) of items that share a bucket, from rows (item, h) of band hashes.

    Buckets of two, by far the most, are complete in their minimum and maximum; only larger ones are joined
    with their members again (Spark splits such a join where one bucket is large).
    """
    buckets = bands.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("leader"), F.max("item").alias("other"))
    shared = Scratch(bands.sparkSession, "buckets").stage(buckets.filter("leader < other"), "shared")  # an item may be given twice
    pairs = shared.filter("n = 2").select(F.explode(F.array("leader", "other")).alias("item"), "leader")
    members = bands.join(hinted(shared.filter("n > 2").select("h", "leader"), BROADCAST_BUCKETS), "h").select("item", "leader")
    return pairs.unionByName(members).groupBy("item").agg(F.sort_array(F.collect_set("leader")).alias("leaders"))


def link_groups(items: DataFrame, sets_of: Callable[[list[str]], list[np.ndarray]], threshold: float, column: str) -> DataFrame:
    """Rows (item, other, links, copies) of verified links.

    ``items`` has item, leaders, weight (elements of its set), copies and the text ``column``, from which
    ``sets_of`` makes sorted arrays of distinct 64-bit elements. Rows with ``other`` null add to an item's
    number of linked items and of their copies, the others are links that connect all that is linked in a
    block pair.
    """
    member = items.select("item", "leaders", "weight", F.explode("leaders").alias("leader"))
    sizes = member.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("elements"))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK_ITEMS, F.col("elements") / BLOCK_ELEMENTS, F.lit(1.0))).cast("int")
    cut = Scratch(items.sparkSession, "groups").stage(sizes.select("leader", parts.alias("parts")).filter("parts > 1"), "cut")
    rows = items.select("item", "leaders", "copies", F.col(column).alias("text"), F.explode("leaders").alias("leader"))
    rows = rows.join(hinted(cut), "leader", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    # A block meets itself and every other block once.
    rows = rows.withColumn("with_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"one": F.least("part", "with_part"), "two": F.greatest("part", "with_part")})
    rows = rows.select("leader", "one", "two", "item", "part", "leaders", "copies", "text")
    group = ["leader", "one", "two"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            starts = _starts(table, group)
            held = table.slice(starts[-1])  # the last group may go on in the next batch
            if len(starts) > 1:
                yield links_in(table.slice(0, starts[-1]), starts, sets_of, threshold)
        if held is not None:
            yield links_in(held, [0, held.num_rows], sets_of, threshold)

    dealt = rows.repartition(*group).sortWithinPartitions(*group, "item")
    return dealt.mapInArrow(verify, "item long, other long, links long, copies long")


def _starts(table: pa.Table, group: list[str]) -> list[int]:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in group:
        x = table[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new).tolist()


def links_in(table: pa.Table, starts: list[int], sets_of, threshold: float) -> pa.RecordBatch:
    """Links of the block pairs that begin at ``starts`` (the last one is the end of the last pair)."""
    sets = sets_of(table["text"].to_pylist())
    items, parts, leader, copies = (table[c].to_numpy() for c in ("item", "part", "leader", "copies"))
    across = table["one"].to_numpy() != table["two"].to_numpy()
    leaders = [set(x) for x in table["leaders"].to_pylist()]
    small = [(a, b) for a, b in zip(starts[:-1], starts[1:]) if 1 < b - a <= SMALL_GROUP]
    tried = [
        (x, y)
        for a, b in small
        for x in range(a, b - 1)
        for y in range(x + 1, b)
        if not (across[a] and parts[x] == parts[y]) and min(leaders[x] & leaders[y]) == leader[a]
    ]
    one, two = np.array(tried, np.int64).reshape(-1, 2).T
    alike = linked_pairs(sets, one, two, threshold)
    one, two = one[alike], two[alike]
    out: list[tuple[int, int | None, int, int]] = []
    ends = np.searchsorted(one, [b for _, b in small])
    for (a, b), i, j in zip(small, [0, *ends[:-1].tolist()], ends.tolist()):
        if j > i:
            out += _counted(items[a:b].tolist(), copies[a:b], one[i:j] - a, two[i:j] - a)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a > SMALL_GROUP:
            own = int(leader[a])
            i, j = _linked(sets[a:b], parts[a:b] if across[a] else None, threshold)
            if len(i):
                mine = np.array([min(leaders[a + x] & leaders[a + y]) == own for x, y in zip(i.tolist(), j.tolist())], bool)
                out += _counted(items[a:b].tolist(), copies[a:b], i[mine], j[mine])
    columns = list(zip(*out)) if out else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "other", "links", "copies"])


def linked_pairs(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, threshold: float, at_once: int = 1 << 16) -> np.ndarray:
    """Which of the pairs of sets ``one[i]``, ``two[i]`` are linked.

    The elements of many pairs are sorted together, by pair and the first 52 bits; one that is there twice is shared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    less, more = np.minimum(sizes[one], sizes[two]), np.maximum(sizes[one], sizes[two])
    tried = np.flatnonzero((less > 0) & (less >= threshold * more - 1e-9))  # no set shares more than all it has
    both, shared = less + more, np.zeros(len(one), np.int64)
    ends = np.cumsum(both[tried])
    a = 0
    while a < len(tried):
        b = min(a + 4096, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + at_once, "right"))))
        some = tried[a:b]
        elements = np.concatenate([sets[k] for k in np.stack([one[some], two[some]], axis=1).ravel().tolist()])
        elements = elements.view(np.uint64) >> np.uint64(12)
        elements |= np.repeat(np.arange(b - a, dtype=np.uint64) << np.uint64(52), both[some])
        elements.sort()
        twice = elements[1:][elements[1:] == elements[:-1]]
        shared[some] = np.bincount((twice >> np.uint64(52)).astype(np.int64), minlength=b - a)
        a = b
    return (shared > 0) & (shared >= threshold * (both - shared) - 1e-9)


def _linked(sets: list[np.ndarray], parts: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of linked sets; only pairs of different parts where ``parts`` is given."""
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = overlaps(sets, sizes)
    alike = (shared > 0) & (shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9)
    if parts is not None:
        alike &= parts[:, None] != parts[None, :]
    return np.nonzero(np.triu(alike, 1))


def _counted(items: list[int], copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple]:
    """Numbers of links of each item, and links that connect all that ``i`` and ``j`` link."""
    n = len(items)
    links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    linked = np.rint(np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)).astype(np.int64)
    out = [(items[k], None, int(links[k]), int(linked[k])) for k in np.flatnonzero(links).tolist()]
    root = list(range(n))
    for x, y in zip(i.tolist(), j.tolist()):
        u, v = x, y
        while root[u] != u:
            root[u] = u = root[root[u]]
        while root[v] != v:
            root[v] = v = root[root[v]]
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((items[y], items[x], 0, 0))
    return out


def overlaps(sets: list[np.ndarray], sizes: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over elements that are in two sets or more."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    if n < 2 or not sizes.sum():
        return out.astype(np.int64)
    if n == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out.astype(np.int64)
    rows = np.repeat(np.arange(n), sizes)
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = seen > 1
    number = np.cumsum(common) - 1
    held = common[code]
    rows, code = rows[held], number[code[held]]
    by_code = np.argsort(code, kind="stable")
    rows, code = rows[by_code], code[by_code]
    edges = np.searchsorted(code, np.arange(0, int(common.sum()) + columns, columns))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            block = np.zeros((n, columns), np.float32)
            block[rows[a:b], code[a:b] - k * columns] = 1
            out += block @ block.T
    return np.rint(out).astype(np.int64)


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Rows (item, class) of linked items, the class being the smallest item that links lead to.

    Distributed union-find: a round first ties each item's larger neighbours to the smallest of its
    neighbourhood, then its smaller ones, until every item hangs on one that hangs on none. A round is
    narrow joins over at most as many rows as there are links and items; the driver sees one number of it.
    """
    edges = scratch.stage(links.select(F.least("item", "other").alias("a"), F.greatest("item", "other").alias("b")).filter("a < b").distinct(), "round-0")
    for k in range(1, rounds):
        ends = edges.select(F.col("a").alias("u"), F.lit(0).alias("below")).unionByName(edges.select(F.col("b").alias("u"), F.lit(1).alias("below")))
        ends = ends.groupBy("u").agg(F.min("below").alias("least"), F.sum("below").alias("below"))
        if ends.filter("below > 1 or (below = 1 and least = 0)").isEmpty():
            tops = edges.select(F.col("a").alias("item"), F.col("a").alias("class")).distinct()
            return edges.select(F.col("b").alias("item"), F.col("a").alias("class")).unionByName(tops)
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        own = least.filter("m < u").select(F.col("m").alias("a"), F.col("u").alias("b"))
        star = large.unionByName(own).distinct()
        low = star.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = star.join(low, star["b"] == low["u"])
        tied = small.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
        edges = scratch.stage(tied.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), f"round-{k}")
        scratch.free(f"round-{k - 1}")
    raise RuntimeError("links were not closed in the rounds allowed")
