"""Mixing and fingerprints against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from tidegauge.llm import common, fingerprint, mixing


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fair(sizes, weights, limit=3):
    """Targets by small steps: share, cap, share the excess again."""
    found, free, open_ = {}, float(sum(sizes.values())), set(sizes)
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if free * weights[s] / w > limit * sizes[s]}
        if not over:
            return found | {s: free * weights[s] / w for s in open_}
        for s in over:
            found[s] = float(limit * sizes[s])
        free -= sum(found[s] for s in over)
        open_ -= over
    return found


def by_source():
    sizes = Counter()
    for r in odd_rows():
        sizes[r[3]] += count(r[1])
    return sizes


def test_plan(odd):
    sizes = by_source()
    ranked = sorted((s for s in sizes if s is not None)) + [None]
    wanted = fair(sizes, {s: 1 + i % 3 for i, s in enumerate(ranked)})
    rows = mixing.plan(odd, keep=["doc_id", "text", "source"]).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r[0], count(r[1])) for r in odd_rows())
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(wanted[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == sum(p.words for p in r.pieces)
        assert all(0 <= p.position <= 1 and 0 < p.words <= r["size"] for p in r.pieces)
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - wanted[s]) <= 1
    again = mixing.plan(odd.repartition(7), keep=["doc_id", "text", "source"]).collect()
    assert Counter(map(str, again)) == Counter(map(str, rows))


def test_buckets_do_not_change_the_plan(odd, monkeypatch):
    whole = mixing.plan(odd).collect()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    taken = Counter()
    for r in mixing.plan(odd, keep=["doc_id", "text", "source"]).collect():
        taken[r.source] += r.taken
    total = sum(r.taken for r in whole)
    assert abs(sum(taken.values()) - total) <= 3


def test_positions_follow_the_schedule(spark):
    """A source's words before time t are the integral of its schedule up to t, times its target."""
    rows = [(i, "w " * 20, ["a", "b"][i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    schedules = (((0.0, 2.0), (1.0, 0.0)), ((0.0, 0.0), (0.25, 0.0), (1.0, 1.0)))
    pieces = mixing.plan(docs, keep=["source"], weights=(1.0,), schedules=schedules).select("source", "target", F.explode("pieces").alias("p")).collect()
    for source, share in (("a", 0.75), ("b", 1 / 9)):  # by time 1/2
        own = [r for r in pieces if r.source == source]
        early = sum(r.p.words for r in own if r.p.position <= 0.5)
        assert early == pytest.approx(share * own[0].target, abs=21)
    assert min(r.p.position for r in pieces if r.source == "b") > 0.25


def test_mix_gives_whole_texts_but_for_one_a_source(odd):
    rows = mixing.mix(odd).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    texts = defaultdict(list)
    for r in odd_rows():
        texts[r[0]].append(r[1])
    cut = Counter()
    for r in rows:
        if r.text not in texts[r.doc_id]:
            whole = next(t for t in texts[r.doc_id] if t and t.startswith(r.text))
            assert 0 < count(r.text) < count(whole)
            cut[r.source] += 1
    assert all(n <= 1 for n in cut.values())
    sizes = by_source()
    assert sum(count(r.text) for r in rows) == pytest.approx(sum(sizes.values()), abs=len(sizes))
    assert set(odd.columns) - {"size", "taken"} <= set(rows[0].asDict())


def edits():
    """(key, text) in order, ties by text, and the edited texts."""
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows()), key=lambda r: (r[0], r[1], r[2].encode()))
    out = []
    for (known, key, t), (_, _, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        out.append((key if known else None, t, t[: len(t) - half] + after[:half], after))
    return out


@pytest.mark.parametrize("block", [4000, 7])
def test_edits(odd, block):
    rows = fingerprint.with_edits(odd, docs_per_block=block).collect()
    want = Counter((k, len(t), hashlib.sha256(e.encode()).hexdigest()) for k, t, e, _ in edits())
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    prints = defaultdict(set)
    texts = {(k, hashlib.sha256(e.encode()).hexdigest()): t for k, t, e, _ in edits()}
    for r in rows:
        t = texts[r.doc_id, r.edited_sha256]
        prints[t].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    one = {next(iter(p)) for p in prints.values()}
    pieces = {tuple(sorted(x for x in (y.strip(" \t\x0b\x0c") for y in re.split(r"[\n\r]+|(?<=[.!?])[ \t]+", t)) if x)) for t in prints}
    assert len(one) == len(pieces)  # as many fingerprints as multisets of paragraphs
    long = [r for r in rows if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.8 * len(long)


def test_fingerprints_add_up(spark):
    """Order does not count; a fingerprint is the sum of those of its parts, lane by lane."""
    a, b = "First one.\nSecond two.\nThird three.", "Fourth four.\nFirst one."
    rows = spark.createDataFrame([(0, a), (1, "\n".join(reversed(a.split("\n")))), (2, b), (3, a + "\n" + b), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(rows).collect()}
    assert got[0].digest == got[1].digest and got[0].signs == got[1].signs
    assert got[3].digest == [(x + y) % 2**32 for x, y in zip(got[0].digest, got[2].digest)]
    assert got[3].signs == [x + y for x, y in zip(got[0].signs, got[2].signs)]
    assert set(got[4].digest) == {0} and set(got[4].signs) == {0}
    # Paragraphs are taken away by counting them -1 times.
    parts = spark.createDataFrame([("First one.", 1), ("Fourth four.", 1), ("Fourth four.", -1), ("Second two.", 1), ("Third three.", 1)], "p string, n long")
    sums = parts.agg(*[s.alias(f"_{i}") for i, s in enumerate(fingerprint.lane_sums(F.col("p"), F.col("n")))])
    digest, signs = fingerprint.lanes([F.col(c) for c in sums.columns])
    row = sums.select(digest.alias("d"), signs.alias("s")).first()
    assert row.d == got[0].digest and row.s == got[0].signs


def test_empty_and_single(spark, empty):
    assert mixing.plan(empty).collect() == [] and mixing.mix(empty).collect() == []
    assert fingerprint.with_edits(empty).collect() == []
    one = spark.createDataFrame([(4, "Alone here.")], "doc_id long, text string")
    row = fingerprint.with_edits(one).first()
    assert row.near_next == 1.0 and row.n_chars == 11


def test_key_blocks(spark):
    keys = spark.createDataFrame([(None,), (5,), (5,), (5,)] + [(i * i,) for i in range(2000)], "k long")
    blocks = common.KeyBlocks(keys, "k", 50)
    rows = keys.select("k", blocks.of().alias("b")).collect()
    assert blocks.n > 20 and max(Counter(r.b for r in rows).values()) < 250
    last = 0
    for r in sorted(rows, key=lambda r: (r.k is not None, r.k or 0)):
        assert r.b >= last
        last = r.b
    assert rows[0].b == 0
