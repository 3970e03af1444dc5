"""Periodic runs, conversation repair and BPE against brute force and the tokenizer."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import odd_rows
from tidegauge.llm import bpe, period_runs, queries, turn_repair

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_runs(w):
    """Every start and period tried, longest stretch, smaller periods ruled out."""
    n, out = len(w), []
    for s in range(n):
        for q in range(1, n // 4 + 1):
            if s > 0 and s - 1 + q < n and w[s - 1] == w[s - 1 + q]:
                continue
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            if length < max(6, 4 * q):
                continue
            if not any(all(w[i] == w[i + r] for i in range(s, s + length - r)) for r in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.6 and n > 8:
        for _ in range(rng.randint(1, 3)):
            a, p = rng.randrange(n), rng.randint(1, 6)
            for i in range(a, min(n, a + p * rng.randint(3, 9) + rng.randrange(p))):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs_equal_those_of_every_start_and_period():
    rng = random.Random(5)
    for _ in range(4000):
        w = periodic_words(rng)
        assert period_runs.runs_of(w) == plain_runs(w), w


def test_splitting_keeps_every_run_and_ends_stable():
    rng = random.Random(6)
    for _ in range(300):
        w = np.array(periodic_words(rng), np.int64)
        kept = list(period_runs.segments(w))
        for start, length, _ in plain_runs(w.tolist()):
            assert any(a <= start and start + length <= a + len(c) for a, c in kept)
        for _, c in kept:
            assert len(c) >= period_runs.SHORTEST and np.unique(c, return_counts=True)[1].min() >= period_runs.REPEATS


def test_long_periodic_texts():
    for w, want in (([1] * 20_000, [(0, 20_000, 1)]), (([1] * 99 + [2]) * 50, None), (list(range(3000)) * 5 + [0, 1], [(0, 15_002, 3000)])):
        got = period_runs.runs_of(w)
        assert got == want or (want is None and (0, 5000, 100) in got and len(got) == 51)


def test_strongest_run_and_ties():
    assert period_runs.strongest([]) is None
    assert period_runs.strongest([(5, 8, 2), (0, 12, 3), (20, 9, 2)]) == (20, 9, 2)
    assert period_runs.strongest([(5, 8, 2), (0, 12, 3)]) == (0, 12, 3)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_runs_of_odd_rows(spark, odd, empty):
    rows = [(r[0], "x y " * 5 + (r[1] or "") + " a b c" * 4) if r[1] else (r[0], r[1]) for r in odd_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, period_runs.find_runs(df).collect()), key=repr)
    want = []
    for key, text in rows:
        w = words_of(text)
        runs = plain_runs(w) if len(w) < 500 else period_runs.runs_of(w)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = period_runs.strongest(runs) or (None, None, None)
        want.append((key, len(w), runs, *best, " ".join(x for i, x in enumerate(w) if i not in dropped)))
    assert [(*g[:2], [tuple(r) for r in g[2]], *g[3:]) for g in got] == sorted(want, key=repr)
    assert period_runs.find_runs(odd).count() == len(odd_rows())
    assert period_runs.find_runs(empty).count() == 0


def test_run_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, None if i % 40 == 7 else " \t".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120)))) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_period_runs(spark, str(tmp_path)).collect()}
    some = 0
    for key, text in rows:
        w, h = words_of(text), zlib.crc32(str(key).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        r, best = got[key], period_runs.strongest(runs)
        some += len(runs)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in dropped))
    assert some > 20


# ---- conversations


def plain_repair(codes):
    """Least (cost, audit) over all edits, by recursion on turns and the last role."""
    n = len(codes)

    @functools.lru_cache(None)
    def f(i, s, inserted):
        out = [(0, "")] if i == n and s in (0, 3) else []
        wanted, then = ("a", 3) if s == 2 else ("u", 2)

        def add(cost, letter, rest):
            out.append((cost + rest[0], letter + rest[1]))

        if i < n:
            c, late = codes[i].lower(), 3 if codes[i].isupper() else 0
            add(4, "D", f(i + 1, s, 0))
            if c not in "bd":
                if c == "s" and s == 0:
                    add(late, "K", f(i + 1, 1, 0))
                add(late + (0 if c == wanted else 3), "K" if c == wanted else "R", f(i + 1, then, 0))
        if inserted < 4:
            add(3, "I", f(i, then, inserted + 1))
        return min(out) if out else (10**9, "")

    return f(0, 0, 0)


def in_blocks(codes, size):
    parts = [codes[i : i + size] for i in range(0, len(codes), size)]
    fold, rests = turn_repair.Rest(), []
    for b in reversed(parts):
        rests.append(fold({"conv": 0, "crossing": turn_repair.crossing(b)})[0])
    state, audit = turn_repair.START, ""
    for b, rest in zip(parts, reversed(rests)):
        audits, states = turn_repair._audits({"codes": b, "rest": rest})
        audit, state = audit + audits[state], states[state]
    return fold.rest[0] if parts else 0, audit + "I" * (turn_repair.AT_END[state] // 3)


@pytest.mark.parametrize("size", [1, 3, 64])
def test_least_cost_and_first_audit(size):
    rng = random.Random(size)
    for _ in range(2500):
        codes = "".join(rng.choice("bdssuuuaaaoSUAO") for _ in range(rng.randint(0, 13)))
        assert in_blocks(codes, size) == plain_repair(codes), codes


def test_every_string_of_edits_on_tiny_cases():
    """The recursion itself against all edit strings whose result is legal."""
    import itertools

    def legal(roles):
        return re.fullmatch("(s?(ua)+)?", roles)

    for codes in map("".join, itertools.product("bsuAo", repeat=3)):
        best = None
        for n in range(3, 7):
            for edits in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in edits) != 3:
                    continue
                for choice in itertools.product("ua", repeat=sum(e in "IR" for e in edits)):
                    turns, free, roles, cost = iter(codes), iter(choice), "", 0
                    for e in edits:
                        c = "" if e == "I" else next(turns)
                        if e == "D":
                            cost += 4
                            continue
                        if c == "b" or (e == "K" and c == "o"):
                            break
                        cost += (3 if e in "IR" else 0) + (3 if c.isupper() else 0)
                        roles += next(free) if e in "IR" else c.lower()
                    else:
                        if legal(roles):
                            best = min(best or (10**9, ""), (cost, "".join(edits)))
        assert best == plain_repair(codes) == in_blocks(codes, 2), codes


def chats(rng):
    rows = []
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 5, 8])):
            role = "system" if turn == 0 and conv % 4 == 0 else "user" if turn % 2 else rng.choice(["assistant", "user", "tool"])
            rows.append((conv, turn, role, rng.choice(["Yes.", "no", "ok!\n", " \t", "", "Why?", "b ", None])))
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" + "." * (t % 5 > 0)) for t in range(330)]
    rows += [(None, 0, "user", "hi."), (None, None, None, "x."), (101, None, "user", "a."), (101, None, "assistant", "b."), (102, 5, "", "c.")]
    rows += [(103, 7, "user", "same."), (103, 7, "user", "same."), (104, 10**12, "user", "far."), (104, -5, "assistant", "neg.")]
    return rows


def ordered(rows):
    def of(r):
        return (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())

    return sorted([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], key=of)


def wanted_reports(rows):
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = ordered([r for r in rows if r[0] == conv])
        codes, seen, faults = "", set(), dict.fromkeys("bdt", 0)
        for _, _, role, text in mine:
            full = re.findall(r"[^\x20\x09-\x0D]", text)
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not full:
                code = "b"
            elif (role, text) in seen:
                code = "d"
            else:
                code = first if full[-1] in ".!?" else first.upper()
            faults["t" if code.isupper() else code] = faults.get("t" if code.isupper() else code, 0) + 1
            seen.add((role, text))
            codes += code
        cost, audit = plain_repair(codes) if len(codes) < 50 else in_blocks(codes, 1000)
        lines, turns, state = [], iter(mine), 0
        for e in audit:
            role, text = ("", "") if e == "I" else next(turns)[2:]
            if e != "D":
                role = role if e == "K" else "assistant" if state == 2 else "user"
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                lines.append(f"{role}:{text}")
        t = [r[1] for r in mine if r[1] is not None]
        gaps = max(t) - min(t) + 1 - len(set(t)) if t else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, sha("\n".join(lines))), lines
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_reports_and_repaired_turns(spark):
    rows = chats(random.Random(8))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("codes", F.lit(1)).withColumn("kind", F.lit("x")).withColumn("conv", F.lit(2))
    want = wanted_reports(rows)
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.report(df).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    lines = {}
    for r in turn_repair.repaired(df).orderBy("place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {k: v[1] for k, v in want.items() if v[1]}
    assert turn_repair.report(df.limit(0)).count() == 0


def test_repair_query(spark, tmp_path):
    rows = chats(random.Random(9)) + [(200 + i, 0, "user", "alone") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_turn_repair(spark, str(tmp_path)).collect()}
    left = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", " " if text is None else text) if kind == 2 else text
        left += [] if kind == 0 else [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    want = {k: v[0] for k, v in wanted_reports(left).items()}
    want |= {r[0]: (0, 0, 0, 0, 0, 0, "", sha("")) for r in rows if r[0] not in want}
    assert got == want


# ---- BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def plain_merges(ids, merges):
    """Lowest rank, leftmost, one at a time."""
    ids = list(ids)
    while True:
        pairs = [(merges.rank.get((a << 32) | b, 10**9), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        if not pairs or min(pairs)[0] == 10**9:
            return ids
        rank, i = min(pairs)
        ids[i : i + 2] = [int(merges.result[rank])]


def test_trees_merge_as_the_plain_loop(codec):
    rng = random.Random(4)
    parts = ["".join(rng.choice("aeinst é") for _ in range(rng.randint(1, 31))) for _ in range(1500)]
    starts = [codec.byte_id[np.frombuffer(p.encode(), np.uint8)] for p in parts]
    want = [plain_merges(s.tolist(), codec.merges) for s in starts]
    assert [bpe.PairTree(s.tolist(), codec.merges).merged() for s in starts] == want
    assert [ids_of(x) for x in bpe.SharedTrees(starts, codec.merges).merged()] == want


def test_every_code_point_as_the_library(codec, library):
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for a in range(0, len(chars), 50_000):
        some = [f"a{c}1 {c}" for c in chars[a : a + 50_000]]
        for ours, theirs in zip(codec.encode(some), library.encode_batch_fast(some, add_special_tokens=False)):
            assert ids_of(ours) == theirs.ids


def test_odd_strings_as_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    codec = bpe.Codec(PATH)
    odd = "aBJ é\n\t 　\x1c'sT.,!12̌中​\r\x85İΣ<|>²ª  cdeXY"
    rng = random.Random(3)
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(8000)]
    texts += ["", "  ", "<|endoftext|> x <|STARTOFTEXT|>", "a  <|endoftext|>  b<|endoftext|><|endoftext|>", "x" * 5000 + " Y" * 100, "don't DON'T"]
    for a in range(0, len(texts), 500):
        some = texts[a : a + 500]
        for text, ours, theirs in zip(some, codec.encode(some), library.encode_batch_fast(some, add_special_tokens=False)):
            assert ids_of(ours) == theirs.ids, text
            assert codec.decode(ours) == library.decode(theirs.ids, skip_special_tokens=False)


def test_decoding_any_ids(codec, library):
    rng = random.Random(6)
    for _ in range(1000):
        ids = [rng.randrange(50_300) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, odd, empty, library):
    rows = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    want = sorted((repr(r[0]), r[1] or "") for r in odd_rows())
    assert sorted((repr(r.doc_id), r.text) for r in rows) == want
    assert all(ids_of(r.ids) == library.encode(r.text, add_special_tokens=False).ids for r in rows)
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
