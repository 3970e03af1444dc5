"""Token-id files, packing, url filters and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import odd_rows, table
from tidegauge.llm import packing, quality, token_files, url_filter
from tidegauge.llm.common import Scratch

WORD_FILE, BYTE_FILE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def encoded(path, texts, end):
    t = Tokenizer.from_file(path)
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        for top in (1, 255, 2**17, 2**32 - 1):
            ids = rng.integers(0, top, n, endpoint=True).astype("<u4")
            planes = token_files.to_planes(ids, kind)
            assert (token_files.from_planes(planes, n, kind) == ids).all()
            assert all(not p for p in planes[-(-top.bit_length() // (8 if kind == "byte" else 1)) :])


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files(spark, odd, kind, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 700)
    folder = Scratch(spark, "test-ids").path("ids")
    manifest = token_files.write_ids(odd, folder, WORD_FILE, kind=kind, docs_per_file=9)
    files = manifest.orderBy("block").collect()
    assert len(files) > 3 and [f.start for f in files] == np.cumsum([0] + [f.n_ids for f in files])[:-1].tolist()
    got = token_files.read_ids(manifest).orderBy("start").collect()
    rows = sorted(((r[0] is not None, r[0] or 0, (r[1] or "").encode(), r[1] or "") for r in odd_rows()))
    wanted = encoded(WORD_FILE, [r[3] for r in rows], 2)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == wanted
    assert [r.key for r in got] == [r[1] if r[0] else None for r in rows]
    assert [r.start for r in got] == np.cumsum([0] + [len(w) for w in wanted])[:-1].tolist()
    # Any range of a file, by its chunk index.
    whole = [i for w in wanted for i in w]
    rng = random.Random(1)
    for f in files:
        reader = token_files.IdReader(f.uri)
        for _ in range(20):
            a = rng.randint(0, f.n_ids)
            b = rng.randint(a, f.n_ids)
            assert reader.range(a, b).tolist() == whole[f.start + a : f.start + b]
        reader.close()


def test_files_of_lost_attempts_are_not_read(spark, odd):
    """Encoding twice into one folder leaves two sets of files; each manifest reads its own."""
    folder = Scratch(spark, "test-twice").path("ids")
    one = token_files.write_ids(odd.limit(5), folder, WORD_FILE)
    two = token_files.write_ids(odd, folder, WORD_FILE)
    assert token_files.read_ids(one).count() == 5 and token_files.read_ids(two).count() == len(odd_rows())


def check_pieces(pieces, wanted, window):
    """Every id in exactly one piece, sequences without gaps, padded to the window or a power of two."""
    found, sequences = defaultdict(dict), defaultdict(list)
    for key, p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        found[key].setdefault(p.doc_tokens, []).append((p.start, ids))
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    for key, texts in wanted.items():
        want = sorted(i for t in texts for i in t)
        got = sorted(i for parts in found[key].values() for _, ids in parts for i in ids)
        assert got == want
        if len(texts) == 1:
            at = 0
            for start, ids in sorted(found[key][len(texts[0])]):
                assert start == at and texts[0][start : start + len(ids)] == ids
                at += len(ids)
    fills = [sum(n for _, n in parts) for parts in sequences.values()]
    return sum(0 if n & (n - 1) == 0 else window - n for n in fills), sum(fills)


@pytest.mark.parametrize(("window", "max_open"), [(1024, 4096), (64, 5)])
def test_packing(odd, window, max_open):
    rows = packing.pack(odd, BYTE_FILE, window=window, max_open=max_open).collect()
    wanted = defaultdict(list)
    for r, ids in zip(odd_rows(), encoded(BYTE_FILE, [r[1] for r in odd_rows()], 0)):
        wanted[r[0]].append(ids)
    padding, total = check_pieces([(r.doc_id, r) for r in rows], wanted, window)
    assert padding <= 0.01 * total


def test_levels_follow_the_rule():
    """The chosen fill level is the one with the least sum of squares, by trying all."""
    rng = random.Random(6)
    levels = packing.SumOfSquares(16, 10_000)
    for _ in range(600):
        size = rng.choice([3, 5, 6, 7, 9, 15, 1])
        before = levels.count.copy()

        def squares(at):
            n = before.copy()
            n[at] -= at > 0
            if at + size < 16:
                n[at + size] += 1
            return int((n[1:16] ** 2).sum())

        allowed = [0] + [h for h in range(1, 16) if before[h] and h + size <= 16]
        assert squares(levels.level(size)) == min(squares(h) for h in allowed)
        for _ in levels.place((0, 0, np.zeros(size, "<u4"), size)):
            pass
    assert levels.n_open == levels.count.sum() == sum(map(len, levels.open.values()))


URLS = [
    "http://a.net/x", "http://NET/", "http://a.net", "https://www.example.net/en/1?q=/de/", "https://example.net/en", "http://m.example.com/de/x#y",
    "http://example.com/DE/x", "http://badexample.com/de/x", "ftp://x.org/fr/", "http://x.org/fr", "no scheme", None, "", "://", "http://", "http://a.net?x=/", "http://a.net#/",
    "x://y://net/", "http://a.net:80/", "http://" + "a." * 5000 + "net/" + "p/" * 5000, "http://.net/", "http://net./",
]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else (0, 0, None, "allow")
    return host, path, best[2], best[3]


@pytest.mark.parametrize("per_trie", [100, 1])
def test_url_rules(spark, per_trie, monkeypatch):
    monkeypatch.setattr(url_filter, "RULES_PER_TRIE", per_trie)
    more = [("a.net", "/x", "allow"), ("net", "/", "allow"), ("example.net", "/e", "block"), ("example.net", "/en/1", "block"), ("org", "", "block")]
    for rules in (RULES, RULES + more):
        pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
        got = url_filter.judge(pages, "url", [r[:2] for r in rules if r[2] == "block"], [r[:2] for r in rules if r[2] == "allow"]).collect()
        assert len(got) == 2 * len(URLS)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules), r.url
    assert url_filter.judge(pages.filter("false"), "url", [], []).collect() == []


def test_large_tries_are_halved(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "TRIE_BYTES", 200)
    pages = spark.createDataFrame([(1, "http://w.h3.net/a/"), (2, "http://q/")], "page_id long, url string")
    got = url_filter.judge(pages, "url", [(f"h{i}.net", "/a/") for i in range(20)], [("net", "/")]).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("h3.net/a/", "block"), (None, "allow")]


def test_pipeline(spark, sf, odd, empty):
    """Each stage against its own input, with brute force for what stays."""
    from tests.llm.test_dedup import alike, norm, shingles, union

    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    scratch, seen = Scratch(spark, "test-pipeline"), [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.stage(stage(spark, docs, sf), f"s{k}")
        assert k == 4 or out.columns == docs.columns, name
        docs = out
        seen.append(out.collect())
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.classify(spark.createDataFrame(seen[0], docs.sparkSession.read.parquet(scratch.path("s0")).schema), labels).filter("predicted = 1")
    assert judged.count() == len(seen[1])
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    groups = defaultdict(list)
    for r in seen[1]:
        groups[norm(r.text)].append(key(r))
    assert sorted((key(r), norm(r.text)) for r in seen[2]) == sorted((min(v), t) for t, v in groups.items())
    sets = [shingles(r.text or "") for r in seen[2]]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b])]
    root = union(len(sets), pairs)
    least = defaultdict(list)
    for i, r in zip(root, seen[2]):
        least[i].append(key(r))
    assert sorted(key(r) for r in seen[3]) == sorted(min(v) for v in least.values())
    texts = {(r.doc_id, r.source): r.text for r in seen[3]}
    assert {(r.doc_id, r.source) for r in seen[4]} <= set(texts) and all(texts[r.doc_id, r.source].startswith(r.text) for r in seen[4])
    ids = sum(len(e) for e in encoded(BYTE_FILE, [r.text for r in seen[4]], 0))
    assert ids == sum(r.length for r in seen[5])
    crc = {zlib.crc32(np.array(e[:1024], "<u4").tobytes()) for e in encoded(BYTE_FILE, [r.text for r in seen[4]], 0) if len(e) >= 1024}
    assert crc <= {r.ids_crc32 for r in seen[5]}


def test_stages_on_empty_documents(spark, sf, empty):
    none = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).collect() == [], name
    assert packing.pack(empty, BYTE_FILE).collect() == []
    folder = Scratch(spark, "none").path("ids")
    assert token_files.read_ids(token_files.write_ids(empty, folder, WORD_FILE)).select(F.crc32("ids")).collect() == []


def test_sequences_follow_the_training_order(spark, tmp_path):
    """Documents written in an order by many files: sequences of a single document each are numbered in it."""
    rows = [(i, ("w " * 1023).strip()) for i in random.Random(3).sample(range(400), 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id")
    docs.write.parquet(str(tmp_path / "docs"))
    pieces = corpus_pipeline.packing_stage(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    assert sorted(p.sequence_id for p in pieces) == list(range(400))
    assert [p.doc_id for p in sorted(pieces, key=lambda p: p.sequence_id)] == list(range(400))
    loose = corpus_pipeline.packing_stage(spark, spark.createDataFrame(rows[:5], "doc_id long, text string"), "").collect()
    assert len(loose) == 5
