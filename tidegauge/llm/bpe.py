"""Byte-level BPE: encoding by a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of the tree hold, for every two adjacent tokens of a part, the rank of their merge (with the
position behind it, so that equal ranks go by place); a node holds the least of its children. The root thus
yields the leftmost pair of lowest rank. A merge changes three leaves - its own, the one on its left and the
one that vanishes - and their ancestors, in logarithmic time, until the root holds no mergeable pair.

Parts are what the tokenizer's pattern cuts a text into, after the strings of special tokens are taken out.
Parts of up to ``SHORT`` bytes share one tree of arrays, a column for each part, and advance together; a longer
part has a tree of its own. A worker remembers the ids of words it has met, in two generations of bounded size.

The tokenizer's file is a parameter and must exist on every executor. Nothing is shuffled.

Defined cases: null and empty texts have no ids and decode to the empty text; rows that repeat are rows of their
own; null keys stay null; ids that the vocabulary lacks are left out in decoding and bytes that are no UTF-8 become
U+FFFD, as the tokenizer does it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import whole_text, worker_cache
from tidegauge.llm.tokens import LEADING_SPACE

#: The pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a part that shares a tree; parts of a shared tree; words remembered, and their longest.
SHORT = 32
SHARED = 4096
REMEMBERED = 300_000
LONGEST = 64
TEXTS_AT_ONCE = 256
NONE = np.int64(2**62)


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + rest.index(b)) for b in range(256)]


class Merges:
    """Ranks of pairs: ``merge(left, right)`` is a rank or -1; ``result[rank]`` the merged id."""

    def __init__(self, pairs: Sequence[tuple[int, int]], results: Sequence[int]):
        self.rank = {(a << 32) | b: i for i, (a, b) in reversed(list(enumerate(pairs)))}
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter(self.rank.values(), np.int64, len(self.rank))[order]
        self.result = np.array(results, np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of many pairs, -1 where a pair has none."""
        wanted = (left << 32) | right
        if not len(self.keys):
            return np.full(wanted.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], -1)


class PairTree:
    """Segment tree over the adjacent pairs of one part."""

    def __init__(self, ids: Sequence[int], merges: Merges):
        self.ids, self.merges = list(ids), merges
        n = len(self.ids)
        self.size = 1 << max(0, n - 2).bit_length()
        self.after, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        self.tree = [NONE] * (2 * self.size)
        find = merges.rank.get
        for i in range(n - 1):
            rank = find((self.ids[i] << 32) | self.ids[i + 1])
            if rank is not None:
                self.tree[self.size + i] = rank * self.size + i
        for node in range(self.size - 1, 0, -1):
            self.tree[node] = min(self.tree[2 * node], self.tree[2 * node + 1])

    def _set(self, at: int, value: int) -> None:
        tree, node = self.tree, self.size + at
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    def _pair(self, at: int) -> None:
        """Leaf of the pair that begins at ``at``."""
        right = self.after[at]
        rank = self.merges.rank.get((self.ids[at] << 32) | self.ids[right]) if right < len(self.ids) else None
        self._set(at, NONE if rank is None else rank * self.size + at)

    def merged(self) -> list[int]:
        n = len(self.ids)
        while n > 1 and self.tree[1] != NONE:
            rank, at = divmod(self.tree[1], self.size)
            gone = self.after[at]
            self.ids[at] = int(self.merges.result[rank])
            self.after[at] = self.after[gone]
            if self.after[at] < n:
                self.before[self.after[at]] = at
            if gone < self.size:
                self._set(gone, NONE)
            self._pair(at)
            if self.before[at] >= 0:
                self._pair(self.before[at])
        out, at = [], 0
        while at < n:
            out.append(self.ids[at])
            at = self.after[at]
        return out


class SharedTrees:
    """The same tree for many short parts at once: rows are nodes or places, columns are parts."""

    def __init__(self, parts: Sequence[np.ndarray], merges: Merges):
        self.merges = merges
        n, longest = len(parts), max(2, max(map(len, parts)))
        self.size = 1 << (longest - 2).bit_length()
        self.length = np.array([len(p) for p in parts])
        self.end = longest  # the place behind the last token
        self.ids = np.zeros((longest + 1, n), np.int64)
        for i, p in enumerate(parts):
            self.ids[: len(p), i] = p
        place = np.arange(longest + 1)[:, None]
        inside = place + 1 < self.length
        self.after = np.where(inside, place + 1, self.end)
        self.before = np.where(place < self.length, place - 1, 0)
        self.tree = np.full((2 * self.size, n), NONE)
        rank = merges.find(self.ids[:-1], self.ids[1:])
        ok = inside[:-1] & (rank >= 0)
        self.tree[self.size : self.size + longest - 1] = np.where(ok, rank * self.size + place[:-1], NONE)[: longest - 1]
        for node in range(self.size - 1, 0, -1):
            np.minimum(self.tree[2 * node], self.tree[2 * node + 1], out=self.tree[node])

    def _set(self, at: np.ndarray, value: np.ndarray, part: np.ndarray) -> None:
        node = at + self.size
        self.tree[node, part] = value
        level = self.size
        while level > 1:
            node, level = node >> 1, level >> 1
            self.tree[node, part] = np.minimum(self.tree[2 * node, part], self.tree[2 * node + 1, part])

    def _pair(self, at: np.ndarray, part: np.ndarray) -> None:
        right = self.after[at, part]
        rank = self.merges.find(self.ids[at, part], self.ids[right, part])
        some = (rank >= 0) & (right != self.end)
        self._set(at, np.where(some, rank * self.size + at, NONE), part)

    def merged(self) -> list[bytes]:
        part = np.flatnonzero(self.tree[1] != NONE)
        while len(part):
            rank, at = np.divmod(self.tree[1, part], self.size)
            gone = self.after[at, part]
            self.ids[at, part] = self.merges.result[rank]
            right = self.after[gone, part]
            self.after[at, part] = right
            more = right != self.end
            self.before[right[more], part[more]] = at[more]
            inner = gone < self.size
            self._set(gone[inner], np.full(int(inner.sum()), NONE), part[inner])
            self._pair(at, part)
            left = self.before[at, part]
            inner = left >= 0
            self._pair(left[inner], part[inner])
            part = part[self.tree[1, part] != NONE]
        kept = np.zeros(self.ids.shape, bool)
        every = np.arange(len(self.length))
        at = np.where(self.length > 0, 0, self.end)
        while (open_ := at != self.end).any():
            kept[at[open_], every[open_]] = True
            at = np.where(open_, self.after[at, every], self.end)
        flat = self.ids.T[kept.T]
        ends = np.cumsum(kept.sum(axis=0))
        raw = flat.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Codec:
    """Encodes and decodes as the byte-level tokenizer of ``path`` does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if odd or spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError(f"not a plain byte-level BPE: {path} {odd}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take their surroundings are not supported")
        vocab, letters = model["vocab"], byte_letters()
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        byte_of = {c: b for b, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token: list[bytes | None] = [None] * (1 + max([*vocab.values(), *special.values()]))
        for t, i in [*vocab.items(), *special.items()]:
            self.token[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        longest_first = sorted(map(regex.escape, special), key=len, reverse=True)
        self.at_special = regex.compile(f"({'|'.join(longest_first)})") if special else None
        self.exact = regex.compile(PATTERN)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def parts_ids(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Ids of parts that the pattern cuts no further."""
        out: dict[str, bytes] = {}
        short: list[tuple[str, np.ndarray]] = []
        for p in parts:
            ids = self.byte_id[np.frombuffer(p.encode(), np.uint8)]
            if len(ids) <= SHORT:
                short.append((p, ids))
            else:
                out[p] = np.array(PairTree(ids.tolist(), self.merges).merged(), "<u4").tobytes()
        short.sort(key=lambda x: len(x[1]))  # parts of like length share a tree
        for a in range(0, len(short), SHARED):
            some = short[a : a + SHARED]
            out.update(zip([p for p, _ in some], SharedTrees([i for _, i in some], self.merges).merged()))
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Enter new words; those too long to remember are returned."""
        once: dict[str, bytes] = {}
        new = []
        for w in words:
            hit = self.old.get(w)
            if hit is None:
                new.append((w, self.exact.findall(w)))
            else:
                self.young[w] = hit
        ids = self.parts_ids({p for _, parts in new for p in parts})
        for w, parts in new:
            (self.young if len(w) <= LONGEST else once)[w] = b"".join([ids[p] for p in parts])
        return once

    def _stretches(self, text: str) -> list[str]:
        """Special tokens' strings at odd places, what lies between them at even ones."""
        return self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        cut = [[s if i % 2 else LEADING_SPACE.findall(s) for i, s in enumerate(self._stretches(t))] for t in texts]
        known = self.young
        missing = {w for stretches in cut for words in stretches[::2] for w in words if w not in known}
        once = self._learn(missing) if missing else {}
        get = known.get
        out = []
        for stretches in cut:
            ids = []
            for i, words in enumerate(stretches):
                if i % 2:
                    ids.append(self.special[words])
                elif once:
                    ids += [once[w] if w in once else known[w] for w in words]
                else:
                    ids += map(get, words)
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        token, n = self.token, len(self.token)
        found = [token[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n]
        return b"".join([t for t in found if t is not None]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The worker's codec of that file, kept between tasks."""
    return worker_cache(("bpe", path), lambda: Codec(path))


def _by_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, TEXTS_AT_ONCE):
        yield batch.slice(a, TEXTS_AT_ONCE)


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, and ids of the whole text as little-endian unsigned 32-bit binary."""
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = codec(tokenizer)
        for batch in batches:
            for some in _by_batch(batch):
                ids = pa.array(ours.encode(some.column("text").to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("key"), ids], names=["key", "ids"])

    rows = df.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text"))
    return _keyed(rows.mapInArrow(run, "key bigint, ids binary"), key, key_type)


def decode(df: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: key, ids as they came, and the text they stand for, special tokens included."""
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = codec(tokenizer)
        for batch in batches:
            for some in _by_batch(batch):
                texts = pa.array([ours.decode(x) for x in some.column("ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([some.column("key"), some.column("ids"), texts], names=["key", "ids", "text"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    return _keyed(rows.mapInArrow(run, "key bigint, ids binary, text string"), key, key_type)


def _keyed(rows: DataFrame, key: str, key_type: T.DataType) -> DataFrame:
    return rows.withColumn("key", F.col("key").cast(key_type)).withColumnRenamed("key", key)
