"""Exact dedup, n-gram join and line dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows, prose, table
from tidegauge.llm import exact_dedup, line_dedup, minhash, ngram_join
from tidegauge.llm.common import Scratch


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda t: F.xxhash64(t) % 5], ids=["wide", "colliding"])
def test_exact_dedup(odd, hash_of):
    got = exact_dedup.exact_dedup(odd, hash_of=hash_of, capacity=4).collect()
    groups = defaultdict(list)
    for r in odd_rows():
        groups[norm(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    # Exactly one row of each text stays, also where its key repeats, and it has the smallest key.
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_directory_splits_until_buckets_fit(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    entries, depth = exact_dedup.directory(hashes, 5000, capacity=100)
    held = hashes.withColumn("cell", exact_dedup._prefix(F.col("h"), depth)).join(entries, "cell").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in held) == 5000 and max(r["count"] for r in held) <= 100 and len(held) > 40


def shingles(text):
    words = text.encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def alike(a, b, threshold=0.8):
    return bool(a and b) and len(a & b) >= threshold * len(a | b) - 1e-9


def near_rows(seed=4):
    """Texts with copies that differ in a few words, so that similarities lie around the threshold."""
    rng = random.Random(seed)
    rows = []
    for i in range(12):
        words = prose(rng, 120).split(" ")
        for _ in range(rng.choice([1, 2, 12])):
            new = list(words)
            for _ in range(rng.randint(0, 4)):
                new[rng.randrange(len(new))] = "edit" + str(rng.randint(0, 999))
            rows.append((len(rows), " ".join(new), "en", "s0", 0, 1.0, "k", 0))
    return rows


@pytest.mark.parametrize("blocks", [512, 5])
@pytest.mark.parametrize("rows", [odd_rows(), near_rows()], ids=["odd", "near"])
def test_ngram_join(spark, rows, blocks, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ITEMS", blocks)
    got = ngram_join.ngram_join(table(spark, rows)).collect()
    sets = [shingles(r[1] or "") for r in rows]
    same = [tuple((r[1] or "").encode().lower().split()) for r in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if same[a] == same[b] or alike(sets[a], sets[b])]
    root = union(len(rows), pairs)
    degree, texts = Counter(), defaultdict(set)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
        if same[a] != same[b]:
            texts[a].add(same[b])
            texts[b].add(same[a])
    members = defaultdict(list)
    for i, r in enumerate(root):
        members[r].append(rows[i][0])
    want = Counter()
    for i, r in enumerate(root):
        known = [x for x in members[r] if x is not None]
        want[rows[i][0], min(known) if known else None, degree[i], len(texts[i]), len(members[r])] += 1
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_text_links, r.class_size) for r in got) == want
    assert sum(r._keep for r in got) == len(members)


def test_banding_reaches_its_recall():
    bands, rows = minhash.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= minhash.HASHES
    rng = np.random.default_rng(2)
    hit = 0
    for _ in range(300):
        common, a, b = rng.integers(0, 2**63, 160), rng.integers(0, 2**63, 20), rng.integers(0, 2**63, 20)  # 160 of 200
        x, y = (minhash.mixed(np.concatenate([common, z]).astype(np.uint64)) for z in (a, b))
        h = minhash.band_hashes(np.concatenate([x, y]), np.array([0, 180, 360]), bands, rows, chunk=50)
        hit += bool((h[0] == h[1]).any())
    assert hit >= 298


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    pairs = [(a, b) for a, b in pairs if a != b]
    links = spark.createDataFrame(pairs, "item long, other long")
    got = {r.item: r["class"] for r in minhash.components(links, Scratch(spark, "test")).collect()}
    root = union(300, pairs)
    assert got == {i: root[i] for i in {x for p in pairs for x in p}}


def runs(line):
    return frozenset(line[i : i + 5] for i in range(max(1, len(line) - 4)))


@pytest.mark.parametrize("rows", [odd_rows(), near_rows(9)], ids=["odd", "near"])
def test_line_dedup(spark, rows, monkeypatch):
    got = line_dedup.line_dedup(table(spark, rows)).collect()
    places = []
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    # Order among different texts of one key follows a hash of theirs: such keys are left out of the check.
    doubled = {k for k, n in Counter(d[:2] for d in docs).items() if n > 1}
    for none, key, text in docs:
        for no, line in enumerate(text.split("\n")):
            line = line.strip(" \t\x0b\x0c\r")
            if line:
                places.append(((none, key), text, no, line))
    lines = list(dict.fromkeys(p[3] for p in places))
    sets = [runs(x) for x in lines]
    close = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) - 1 and alike(sets[a], sets[b])]
    root = dict(zip(lines, union(len(lines), close)))
    first = {}
    for p in places:
        first.setdefault(root[p[3]], p[:3])
    lost = defaultdict(list)
    for p in places:
        if first[root[p[3]]] != p[:3]:
            lost[p[0], p[1]].append(p[2])
    for r in got:
        own = (r.doc_id is None, r.doc_id or 0)
        whole = next(t for t in [r.text] if True)
        assert r.n_dropped == len(r.dropped)
        if own in doubled:
            continue
        text = next(t for n, k, t in docs if (n, k) == own)
        assert r.dropped == lost[own, text], r.doc_id
        gone = set(r.dropped)
        assert (whole or "") == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        assert r.n_lines == len(text.split("\n")) and r.item == "clash"


def test_lines_are_known_by_sparks_hash(spark):
    texts = ["one line\n  Übung macht\t\n\n\x0bx\r\n", "one line", "", " \n ", None, "日本 \U0001f600"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    signed = line_dedup.signed_lines(docs, "doc_id", "text", 5, 4, 3).collect()
    assert Counter(r.item for r in signed) == Counter(r.item for r in line_dedup.lines_of(docs, "text").collect())
    assert {(r.id, r.no) for r in signed} == {(0, 0), (0, 1), (0, 3), (1, 0), (5, 0)}
    assert all(r.bands is None or len(r.bands) == 4 for r in signed)
    assert {r.item for r in signed if r.bands} == {r.item for r in signed}


def test_items_given_twice_are_no_candidates(spark):
    rows = [(1, 10), (1, 10), (2, 20), (3, 20), (3, 20), (4, 30), (5, 40), (6, 40), (7, 40)]
    got = minhash.leaders(spark.createDataFrame(rows, "item long, h long")).collect()
    assert {r.item: r.leaders for r in got} == {2: [2], 3: [2], 5: [5], 6: [5], 7: [5]}


def test_unlike_lines_seldom_meet():
    bands, rows = minhash.choose_bands(line_dedup.THRESHOLD, line_dedup.RECALL, line_dedup.HASHES)
    assert 1 - (1 - line_dedup.THRESHOLD**rows) ** bands >= line_dedup.RECALL
    assert bands * 0.1**rows < 2e-5  # lines that share a tenth of their runs


@pytest.mark.parametrize("at_once", [1 << 16, 50])
def test_pairs_are_compared_together(at_once):
    rng = random.Random(3)
    lines = []
    for _ in range(40):
        line = prose(rng, rng.randint(1, 30))
        lines += [line, line[: len(line) * rng.randint(7, 10) // 10], line + "x" * rng.randint(0, 9), line[:3] or "y"]
    sets = line_dedup.sets_of_runs(lines, 5)
    own = [runs(x) for x in lines]
    assert [len(x) for x in sets] == [len(x) for x in own]
    one, two = np.array(list(itertools.combinations(range(len(lines)), 2))).T
    got = minhash.linked_pairs(sets, one, two, 0.8, at_once)
    assert got.tolist() == [alike(own[a], own[b]) for a, b in zip(one, two)] and 20 < got.sum() < len(got)


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []
    assert ngram_join.ngram_join(empty).collect() == []
    assert line_dedup.line_dedup(empty).collect() == []
