"""Self join of documents on the Jaccard similarity of their word n-grams, by MinHash banding.

Words are the stretches between ASCII white space, A-Z lower-cased; the set of a text are its runs of five
words, that of a shorter text is the run of all its words. Two texts are linked when their sets' similarity
is at least the threshold. Texts with the same words are copies: they are collapsed to one item before the
search (map-side first, so a hot text costs little) and share everything that is found for it. See
``minhash`` for the search; candidates are verified on the full sets of the whole texts.

Defined cases: null and empty texts, and texts of white space, have no words, are copies of each other and
have no other links; keys that are null or repeat are allowed, the class is the smallest key that is not
null (null if there is none); only key and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import minhash
from tidegauge.llm.common import Scratch, whole_text, worker_cache
from tidegauge.session import hinted

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Candidate rows that are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_ITEMS = 200_000
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000
TEXTS_AT_ONCE = 256

_POWERS = minhash.mixed(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def ngrams(texts: list[list[bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all texts, and where each text's begin. Every text has words."""
    known = worker_cache("word hashes", WordHashes)
    if len(known) > REMEMBERED:
        known.clear()
    lengths = np.array([len(t) for t in texts], np.int64)
    words = np.fromiter((h for t in texts for h in map(known.__getitem__, t)), np.uint64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    total = len(words)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    runs = np.zeros(total, np.uint64)
    for k in range(n):
        runs += padded[k : k + total] * _POWERS[k]
    runs = minhash.mixed(runs)
    count = np.maximum(lengths - n + 1, 1)
    first = ends - lengths
    starts = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first - starts[:-1], count) + np.arange(starts[-1])
    out = runs[at]
    for i in np.flatnonzero(lengths < n).tolist():
        a, b = int(first[i]), int(ends[i])
        short = words[a:b] * _POWERS[n : n + b - a]
        out[starts[i]] = minhash.mixed(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)]))[0]
    return out, starts


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def signatures(df: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """Per document: row, id, tid (hash of the text as it is), words (hash of its words), weight, bands."""
    schema = "row long, id long, tid string, words binary, weight long, bands array<long>"
    arrow = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("tid", pa.string()), ("words", pa.binary()), ("weight", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(a, TEXTS_AT_ONCE)
                texts = [words_of(t) for t in part.column("text").to_pylist()]
                real = [i for i, t in enumerate(texts) if t]
                lists: list = [None] * len(texts)
                weights = [0] * len(texts)
                if real:
                    elements, starts = ngrams([texts[i] for i in real], n)
                    hashed = minhash.band_hashes(elements, starts, bands, rows).view(np.int64)
                    for i, b, w in zip(real, hashed, np.diff(starts).tolist()):
                        lists[i], weights[i] = b, w
                names = [hashlib.blake2b(b" ".join(t), digest_size=16).digest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), part.column("tid"), pa.array(names, pa.binary()), pa.array(weights, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    schema=arrow,
                )

    rows_ = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.md5(whole_text(text).cast("binary")).alias("tid"), whole_text(text).alias("text")
    )
    return rows_.mapInArrow(sign, schema)


def ngram_join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: key, class_id, n_links, n_text_links, class_size, and ``_tid`` and ``_keep``.

    ``n_text_links`` counts the other texts (distinct word sequences) it is linked to, ``n_links`` the other
    documents: those with such texts, and its own copies. ``class_id`` is the smallest key of all that links
    lead to, ``class_size`` their number. ``_keep`` marks one document of each class, ``_tid`` is the md5 of its
    text, which with the key tells documents apart.
    """
    scratch = Scratch(df.sparkSession, "ngram-join")
    bands, rows = minhash.choose_bands(threshold, recall)
    docs = scratch.stage(signatures(df, key, text, n, bands, rows), "signatures")

    # One item for each sequence of words, known by the row that comes first.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row")))
    items = scratch.stage(docs.groupBy("words").agg(F.min("row").alias("item"), F.count(F.lit(1)).alias("copies"), first.alias("first")), "items")
    signed = docs.select(F.col("row").alias("item"), "id", "tid", "weight", "bands").join(items.select("item", "copies"), "item")
    signed = scratch.stage(signed.filter("weight > 0"), "signed")
    led = minhash.leaders(signed.select("item", F.explode("bands").alias("h")))
    wanted = scratch.stage(signed.select("item", "id", "tid", "weight", "copies").join(led, "item"), "wanted")
    scratch.free("signed")

    named = df.select(F.col(key).cast("long").alias("id_"), F.md5(whole_text(text).cast("binary")).alias("tid_"), whole_text(text).alias("text"))
    near = hinted(wanted.select("item", "id", "tid"), BROADCAST_ITEMS)
    texts = named.join(near, (F.col("tid_") == F.col("tid")) & F.col("id_").eqNullSafe(F.col("id"))).select("item", "text")
    texts = texts.groupBy("item").agg(F.first("text").alias("text"))  # rows given twice
    candidates = scratch.stage(wanted.select("item", "leaders", "weight", "copies").join(texts, "item"), "candidates")

    def sets_of(texts: list[str]) -> list[np.ndarray]:
        elements, starts = ngrams([words_of(t) for t in texts], n)
        return [np.unique(elements[a:b]) for a, b in zip(starts[:-1], starts[1:])]

    links = scratch.stage(minhash.link_groups(candidates, sets_of, threshold, "text"), "links")
    degrees = links.filter("other is null").groupBy("item").agg(F.sum("links").alias("links"), F.sum("copies").alias("linked"))
    closed = minhash.components(links.filter("other is not null").select("item", "other"), scratch)
    member = (
        items.join(closed, "item", "left")
        .join(degrees, "item", "left")
        .select("words", "copies", "first", F.coalesce("class", "item").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked", F.lit(0)).alias("linked"))
    )
    classes = member.groupBy("class").agg(F.min("first").alias("keep"), F.sum("copies").alias("class_size"))
    member = member.join(classes, "class")
    out = docs.select("row", "id", "tid", "words").join(member, "words")
    return out.select(
        F.col("id").cast(df.schema[key].dataType).alias(key),
        F.col("keep.id").cast(df.schema[key].dataType).alias("class_id"),
        (F.col("linked") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.col("links").cast("long").alias("n_text_links"),
        F.col("class_size").cast("long").alias("class_size"),
        F.col("tid").alias("_tid"),
        (F.col("row") == F.col("keep.row")).alias("_keep"),
    )
