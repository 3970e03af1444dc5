"""Class-based language model: exchange clustering of words, class transitions, word emissions.

Words are the stretches between ASCII white space, A-Z lower-cased; every text ends with an end token. Every
word of the training texts is put into one of ``CLASSES`` classes by exchange: each round moves words to the
class that raises the class-bigram likelihood most, given counts of all other words. The exchange starts from
classes of types: the ``CLUSTERED`` most frequent words, and ``SHAPES`` types by the last bytes of all others,
which are exchanged first. Words that were never seen keep the class of their last bytes.

A round moves half of the words at once, then the likelihood is counted anew; rounds stop, and the best classes
stay, when it rises by less than ``RISE`` a token.

    P(text) = product over tokens of P(class | class before) * P(word | class)

Transitions and emissions are smoothed by adding ``ALPHA``; a class has one more slot for words that were
never seen, so probabilities of known words and of one unknown per class sum to 1. The first token
follows the end class.

What is gathered from the corpus grows with it and stays in Spark: stretches of texts as places in the
stretch's list of words, which are read once and kept in buckets, so that answers find them without moving them; the
lists of words that each part of the words has in each stretch; and the table of words with counts and classes.

In a round a stretch knows the classes of the clustered words (broadcast) and of its other words (answers). It adds up
class pairs and the neighbour classes of the clustered words, however frequent they are, in matrices of bounded size,
which are summed by task. Of every other word's occurrence it sends two bytes, the classes before and after it, to
the part that owns the word. The part chooses classes (for a word that occurs once, from a table of all three
classes) and answers each stretch a byte a word. What the driver and the tasks hold is bounded: a matrix of types
by classes, one of classes by classes, counts and classes of the ``COUNTED`` most frequent words, a stretch, and
one part of the words.

Defined cases: null and empty texts are the end token alone; an empty training set gives uniform
probabilities over an unknown word and the end token; null keys are in no training fold; rows that repeat
a key are scored one by one; only key and text are read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import Scratch, whole_text, worker_cache

CLUSTERED = 4096
#: Most frequent words whose counts and classes every task holds when scoring (16 bytes each).
COUNTED = 250_000
SHAPES = 512
CLASSES = 64
#: Most rounds of types, and of words, if the likelihood still rises; nats a token that count as a rise.
ROUNDS = 40
RISE = 1e-3
ALPHA = 0.5
#: Tokens of a stretch (a text is not cut), tokens for each part of the words, words a worker remembers.
TOKENS_AT_ONCE = 1_000_000
TOKENS_A_PART = 500_000
BYTES_A_BUCKET = 16 << 20
#: Occurrences in a stretch from which a word may be one of the most frequent ones.
OFTEN = 4
#: Occurrences of a word beside one class up to which the rise of the likelihood is looked up.
TABLED = 32
#: Clustered types whose neighbours are summed in one matrix, and the tasks that sum each of them.
TYPES_A_BLOCK = 256
SUMMING = 4
REMEMBERED = 400_000

#: Number that stands for the end token. A word's number is a hash of 63 bits, the last of which are its shape.
END = -1
SHAPE_BITS = 9


def training_fold(key: str = "doc_id", folds: int = 5, held_out: int = 1) -> Column:
    """True for rows to learn from: crc32 of the key as text, modulo ``folds``, is not ``held_out``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds != held_out, F.lit(False))


class Lexicon(dict):
    """A worker's places of the words it has met; ``numbers()`` holds the number of each, the end token's first."""

    def __init__(self):
        self.new: list[bytes] = []
        self.known = np.full(1, END, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self) + 1
        self.new.append(word)
        return place

    def numbers(self) -> np.ndarray:
        if self.new:
            mask = (1 << SHAPE_BITS) - 1
            of, shape = xxhash.xxh3_64_intdigest, zlib.crc32
            made = np.array([(of(w) >> 1) & ~mask | shape(w[-3:]) & mask for w in self.new], np.int64)
            self.known, self.new = np.concatenate([self.known, made]), []
        return self.known

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all tokens with the end token after each text, and the texts' numbers of tokens."""
        lists = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        lengths = np.array([len(x) for x in lists], np.int64)
        get = self.__getitem__
        found = np.fromiter(chain.from_iterable(map(get, x) for x in lists), np.int32, int(lengths.sum()))
        return np.insert(found, np.cumsum(lengths), 0), lengths + 1


def lexicon() -> Lexicon:
    """The worker's lexicon; a full one is given up."""
    words = worker_cache("lexicon", Lexicon)
    if len(words) > REMEMBERED:
        worker_cache(None, None)
        words = worker_cache("lexicon", Lexicon)
    return words


def ranks(parts: list[tuple[Lexicon, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of the words at some places, and the rank of each place's word among them."""
    if all(words is parts[0][0] for words, _ in parts):
        places, numbers = np.concatenate([p for _, p in parts]), parts[0][0].numbers()
        met = np.flatnonzero(np.bincount(places, minlength=len(numbers)))
        found, rank = np.unique(numbers[met], return_inverse=True)
        of = np.zeros(len(numbers), np.int32)
        of[met] = rank
        return found, of[places]
    found, rank = np.unique(np.concatenate([words.numbers()[p] for words, p in parts]), return_inverse=True)
    return found, rank.astype(np.int32)


def find(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Places of ``numbers`` in a sorted table, -1 where they are not in it."""
    if not len(table):
        return np.full(len(numbers), -1, np.int64)
    at = np.minimum(np.searchsorted(table, numbers), len(table) - 1)
    return np.where(table[at] == numbers, at, -1)


@dataclass
class Types:
    """Types of words: clustered ones by their sorted numbers, then shapes, then the end."""

    words: np.ndarray
    shapes: int

    @property
    def n(self) -> int:
        return len(self.words) + self.shapes + 1

    def of(self, numbers: np.ndarray) -> np.ndarray:
        at = find(self.words, numbers)
        out = np.where(at >= 0, at, len(self.words) + (numbers & ((1 << SHAPE_BITS) - 1)) % self.shapes)
        out[numbers == END] = self.n - 1
        return out


CODED = "s long, learn boolean, ids array<long>, lengths binary, words binary, tokens binary"


def coded(rows: DataFrame) -> DataFrame:
    """Rows (id, learn, text) as stretches of texts of one kind: the sorted numbers of their words, and the place of each
    token in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        held: dict[bool, list] = {True: [], False: []}

        def stretch(learn: bool) -> pa.RecordBatch:
            nonlocal k
            words, tokens = ranks([h[2] for h in held[learn]])
            ids = pa.array([[i for h in held[learn] for i in h[0]]], pa.list_(pa.int64()))
            lengths = np.concatenate([h[1] for h in held[learn]]).astype(np.int64)
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (lengths, words, tokens)]
            held[learn], k = [], k + 1
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | k]), pa.array([learn]), ids, *blobs], names=["s", "learn", "ids", "lengths", "words", "tokens"])

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                for learn in (True, False):
                    mine = part.filter(pa.compute.equal(part.column("learn"), learn))
                    if not mine.num_rows:
                        continue
                    words = lexicon()
                    places, lengths = words.places(mine.column("text").to_pylist())
                    held[learn].append((mine.column("id").to_pylist(), lengths, (words, places)))
                    if sum(len(h[2][1]) for h in held[learn]) >= TOKENS_AT_ONCE:
                        yield stretch(learn)
        for learn in (True, False):
            if held[learn]:
                yield stretch(learn)

    return rows.mapInArrow(run, CODED)


def bucketed(df: DataFrame, scratch: Scratch, name: str, by: str, n: int) -> DataFrame:
    """``df`` written in ``n`` buckets of ``by``, which joins and groups on ``by`` read where they are."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", scratch.path(name))
    writer.bucketBy(n, by).saveAsTable(table)
    return spark.table(table)


def stretches_of(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, learn, text) as stretches in buckets; as many buckets as Spark deals rows out to at least, since
    fewer would be dealt anew."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")) + 1, min(50_000, math.ceil(size / BYTES_A_BUCKET)))
    return bucketed(coded(texts), scratch, "stretches", "s", n)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of the batches, one at a time, binary columns as they are."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[k]) for name, k in (c.strip().split(" ") for c in ddl.split(","))])


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for k, x in zip(schema.types, zip(*rows))], schema=schema)


def _counted(found: np.ndarray, n: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=[name, "n"])


def word_counts(stretches: DataFrame) -> DataFrame:
    """Rows (word, n) of words, as often as they occur in stretches in which they occur ``OFTEN`` times.

    This chooses the words to cluster. Their exact counts come with their neighbours, those of all others with the lists.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, tokens = np.frombuffer(row["words"], np.int64), np.frombuffer(row["tokens"], np.int32)
            n = np.bincount(tokens, minlength=len(words))
            often = np.flatnonzero((n >= OFTEN) & (words != END))
            yield _counted(words[often], n[often], "word")

    return stretches.select("words", "tokens").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def type_pairs(stretches: DataFrame, types: Types) -> DataFrame:
    """Rows (one, two, n): how often a token of type ``two`` follows one of type ``one``."""
    shared = stretches.sparkSession.sparkContext.broadcast(types)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = shared.value
        for row in _rows(batches):
            now = kinds.of(np.frombuffer(row["words"], np.int64))[np.frombuffer(row["tokens"], np.int32)]
            before = np.concatenate([[kinds.n - 1], now[:-1]])  # a text's first token follows an end token
            yield _counted(*np.unique(before * kinds.n + now, return_counts=True), "pair")

    pairs = stretches.select("words", "tokens").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select(F.floor(F.col("pair") / types.n).cast("int").alias("one"), (F.col("pair") % types.n).cast("int").alias("two"), "n")


def first_classes(types: Types, totals: np.ndarray, classes: int) -> np.ndarray:
    """Types in turn by frequency; the end has the last class to itself."""
    order = np.argsort(-totals[:-1], kind="stable")
    out = np.zeros(types.n, np.int64)
    out[order] = np.arange(types.n - 1) % (classes - 1)
    out[-1] = classes - 1
    return out


def context(pairs: DataFrame, classes: np.ndarray, n_types: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, after): how often each type is preceded and followed by each class; bounded matrices."""
    spark = pairs.sparkSession
    table = spark.createDataFrame([(i, int(c)) for i, c in enumerate(classes)], "type int, class int")
    table = F.broadcast(table)  # one row per type, at most CLUSTERED + SHAPES + 1
    seen = []
    for own, other in (("two", "one"), ("one", "two")):
        counted = pairs.join(table, F.col(other) == F.col("type")).groupBy(F.col(own).alias("own"), "class").agg(F.sum("n").alias("n"))
        rows = counted.toArrow()
        found = np.zeros((n_types, n_classes))
        found[rows["own"].to_numpy(), rows["class"].to_numpy()] = rows["n"].to_numpy()
        seen.append(found)
    return seen[0], seen[1]


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(joint: np.ndarray) -> float:
    """Log likelihood of the class bigrams and of words within classes, up to a constant."""
    return float(_plogp(joint).sum() - _plogp(joint.sum(1)).sum() - _plogp(joint.sum(0)).sum())


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, movable: np.ndarray, joint: np.ndarray | None = None) -> np.ndarray:
    """New classes for the movable types, each the best one given the present classes of the others.

    The likelihood is sum N(c, d) log N(c, d) - 2 sum N(c) log N(c), up to constants. A type's counts are
    taken out of its class and put into every class in turn. ``joint``: class bigrams, if other words than the
    types have a share in them.
    """
    n_classes = before.shape[1]
    if joint is None:
        joint = np.zeros((n_classes, n_classes))
        np.add.at(joint, classes, after)  # joint[c, d]: class d after class c
    size = joint.sum(1)
    terms = _plogp(joint)
    out = classes.copy()
    for t in movable:
        own, left, right = classes[t], before[t], after[t]
        weight = right.sum()
        rest, rest_terms = joint.copy(), terms.copy()
        rest[own, :] = np.maximum(rest[own, :] - right, 0)
        rest[:, own] = np.maximum(rest[:, own] - left, 0)
        rest_terms[own, :], rest_terms[:, own] = _plogp(rest[own, :]), _plogp(rest[:, own])
        sizes = size.copy()
        sizes[own] = max(0.0, sizes[own] - weight)
        # Only classes that precede or follow the type change their terms.
        r, l = np.flatnonzero(right), np.flatnonzero(left)
        gain = (_plogp(rest[:, r] + right[r]) - rest_terms[:, r]).sum(1) + (_plogp(rest[l, :] + left[l, None]) - rest_terms[l, :]).sum(0)
        gain -= 2 * (_plogp(sizes + weight) - _plogp(sizes))
        gain[-1] = -np.inf  # the end's class
        best = int(np.argmax(gain))
        if gain[best] > gain[own] + 1e-9:
            out[t] = best
    return out


def cluster(pairs: DataFrame, types: Types, classes: int, rounds: int) -> np.ndarray:
    """Exchange rounds. Contexts are aggregated by Spark, and the types of a round are tried in parallel.

    Half of the types may move in a round, by turns, so that two do not only swap places.
    """
    spark = pairs.sparkSession
    totals = np.zeros(types.n)
    rows = pairs.groupBy("two").agg(F.sum("n").alias("n")).toArrow()
    totals[rows["two"].to_numpy()] = rows["n"].to_numpy()
    now = best = first_classes(types, totals, classes)
    reached, idle = -np.inf, 0
    for k in range(rounds + 1):
        before, after = context(pairs, now, types.n, classes)
        joint = np.zeros((classes, classes))
        np.add.at(joint, now, after)
        found = likelihood(joint)
        idle = 0 if found > reached + RISE * totals.sum() else idle + 1
        if found > reached:
            best, reached = now, found
        if k == rounds or idle == 2:  # neither half of the types rises
            break
        shared = spark.sparkContext.broadcast((before, after, now))
        half = np.array([t for t in range(types.n - 1) if totals[t] and (t + k) % 2 == 0], np.int64)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left, right, state = shared.value
            for batch in batches:
                some = batch.column("type").to_numpy(zero_copy_only=False)
                new = exchange(left, right, state, some)[some]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(new)], names=["type", "class"])

        tasks = max(1, min(len(half), 64))
        moved = spark.createDataFrame([(int(t),) for t in half], "type long").repartition(tasks).mapInArrow(move, "type long, class long").toArrow()
        now = now.copy()
        now[moved["type"].to_numpy()] = moved["class"].to_numpy()
        shared.unpersist()
    return best


CONTEXTS = "p long, s long, own binary, before binary, after binary"
LISTS = "p long, s long, words binary, sizes binary"
ANSWERS = "s long, p long, classes binary, counts binary"
TABLE = "word long, n long, class int"
WORD_BITS = 63


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of words, so a sorted list of words is in order of parts."""
    return (words >> (WORD_BITS - 31)) * parts >> 31


def answered(stretches: DataFrame, answers: DataFrame) -> DataFrame:
    """Stretches with the answers of all parts they asked, in ``got``."""
    got = answers.groupBy("s").agg(F.collect_list(F.struct("p", "classes", "counts")).alias("got"))
    return stretches.join(got, "s", "left")


def _parts(words: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of a sorted list of words."""
    found, first = np.unique(part_of(words, parts), return_index=True)
    yield from zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(words)])


def _others(row: dict, types: Types) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stretch's words, their types, and the places of those that are not clustered."""
    words = np.frombuffer(row["words"], np.int64)
    kinds = types.of(words)
    shape = (kinds >= len(types.words)) & (kinds < types.n - 1)
    return words, kinds, np.flatnonzero(shape)


def word_lists(stretches: DataFrame, types: Types, parts: int) -> DataFrame:
    """Per part and stretch the words that are not clustered, and how often each occurs."""
    shared = stretches.sparkSession.sparkContext.broadcast(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, _, others = _others(row, shared.value)
            sizes = np.bincount(np.frombuffer(row["tokens"], np.int32), minlength=len(words))[others].astype(np.int32)
            words = words[others]
            out = [(p, row["s"], words[a:b].tobytes(), sizes[a:b].tobytes()) for p, a, b in _parts(words, parts)]
            if out:
                yield _batch(LISTS, out)

    return stretches.select("s", "words", "tokens").mapInArrow(run, LISTS)


def neighbours(stretches: DataFrame, types: Types, by_type: np.ndarray, classes: int, parts: int, first: bool) -> DataFrame:
    """Per part and stretch: classes of the words that are not clustered, and those before and after each occurrence, in
    the words' order. Parts below 0 hold sums of the task: class pairs, then neighbour classes of blocks of types.

    Classes of words that are not clustered are those of ``got``, or of their types in the first round.
    """
    shared = stretches.sparkSession.sparkContext.broadcast((types, by_type))
    columns = ["s", "words", "tokens"] + ([] if first else ["got"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, by_type = shared.value
        joint, clustered = np.zeros(classes * classes, np.int64), np.zeros(types.n * 2 * classes, np.int64)
        some = False
        for row in _rows(batches):
            some = True
            words, kinds, others = _others(row, types)
            tokens = np.frombuffer(row["tokens"], np.int32)
            kind = by_type[kinds]
            if not first and len(others):
                got = sorted(row["got"], key=lambda g: g["p"])
                kind[others] = np.frombuffer(b"".join(g["classes"] for g in got), np.uint8)
            now = kind[tokens]
            before, after = np.roll(now, 1), np.roll(now, -1)  # a stretch ends with an end token, which its first token follows
            joint += np.bincount(before * classes + now, minlength=len(joint))
            is_other = np.zeros(len(words), bool)
            is_other[others] = True
            other = is_other[tokens]
            at = np.flatnonzero(~other)
            wide = kinds[tokens[at]] * (2 * classes)
            clustered += np.bincount(wide + before[at], minlength=len(clustered)) + np.bincount(wide + classes + after[at], minlength=len(clustered))
            at = np.flatnonzero(other)
            at = at[np.argsort(tokens[at], kind="stable")]
            own, left, right = kind[others].astype(np.uint8), before[at].astype(np.uint8), after[at].astype(np.uint8)
            ends = np.concatenate([[0], np.cumsum(np.bincount(tokens[at], minlength=len(words))[others])])
            out = [(p, row["s"], own[a:b].tobytes(), left[ends[a] : ends[b]].tobytes(), right[ends[a] : ends[b]].tobytes()) for p, a, b in _parts(words[others], parts)]
            if out:
                yield _batch(CONTEXTS, out)
        if some:
            size = TYPES_A_BLOCK * 2 * classes
            blocks = [joint, *[clustered[a : a + size] for a in range(0, len(clustered), size)]]
            yield _batch(CONTEXTS, [(-1 - i, 0, x.tobytes(), b"", b"") for i, x in enumerate(blocks)])

    return stretches.select(*columns).mapInArrow(run, CONTEXTS)


def class_counts(contexts: DataFrame, classes: int, n_types: int) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams of all stretches, and how often each type has each class before and after it.

    The tasks' sums are added up by task, then by block; the driver adds ``SUMMING`` of each block.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for row in _rows(batches):
            x = np.frombuffer(row["own"], np.int64)
            total[row["p"]] = total[row["p"]] + x if row["p"] in total else x
        if total:
            yield _batch("p long, own binary", [(p, x.tobytes()) for p, x in total.items()])

    rows = contexts.filter("p < 0").select("p", "own").mapInArrow(add, "p long, own binary")
    dealt = rows.repartition(SUMMING, F.pmod(F.monotonically_increasing_id(), F.lit(SUMMING))).mapInArrow(add, "p long, own binary")
    joint, flat = np.zeros(classes * classes, np.int64), np.zeros(n_types * 2 * classes, np.int64)
    size = TYPES_A_BLOCK * 2 * classes
    for p, own in zip(*[c.to_pylist() for c in dealt.toArrow().columns]):
        x = np.frombuffer(own, np.int64)
        if p == -1:
            joint += x
        else:
            flat[(-2 - p) * size : (-2 - p) * size + len(x)] += x
    return joint.reshape(classes, classes).astype(float), flat.reshape(n_types, 2 * classes).astype(float)


def _rise(joint: np.ndarray, m: np.ndarray) -> np.ndarray:
    return _plogp(joint + m) - _plogp(joint)


class Rises:
    """By how much N log N of a class pair rises if a word that occurs m times comes to it, for m up to ``TABLED``.

    ``of[side][m, c]`` is a vector over the word's classes, for neighbours of class c after (0) or before it (1).
    """

    def __init__(self, joint: np.ndarray):
        self.joint = joint
        m = np.arange(TABLED + 1, dtype=float)[:, None, None]
        self.of = [_rise(x.T[None], m) for x in (joint, joint.T)]
        self.sizes = joint.sum(1)


def best_classes(joint: np.ndarray | Rises, own: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best class of each word, as ``exchange`` finds it, for many words with few neighbour classes each.

    ``own`` has the words' classes; an entry says how often class ``code`` stands before a word, or class
    ``code`` less the number of classes after it. Entries are in order of words.
    """
    rises = joint if isinstance(joint, Rises) else Rises(joint)
    joint, k = rises.joint, len(rises.joint)
    left, right = np.zeros((len(own), k)), np.zeros((len(own), k))
    after = code >= k
    left[word[~after], code[~after]] = n[~after]
    right[word[after], code[after] - k] = n[after]
    gain = np.zeros((len(own), k))
    for matrix, table, side, other in ((joint, rises.of[0], after, left), (joint.T, rises.of[1], ~after, right)):
        w, c, m = word[side], code[side] % k, n[side].astype(np.int64)
        if not len(w):
            continue
        rise = table[np.minimum(m, TABLED), c]
        for i in np.flatnonzero(m > TABLED).tolist():
            rise[i] = _rise(matrix[:, c[i]], m[i])
        # The word's own pairs leave its class, and where a neighbour is of that class, on both sides.
        mine = own[w]
        rise[np.arange(len(w)), mine] = -_rise(matrix[mine, c], np.maximum(-m, -matrix[mine, c]))
        same = np.flatnonzero(c == mine)
        rest = matrix[:, c[same]].T - other[w[same]]
        rest[np.arange(len(same)), mine[same]] -= m[same]
        rise[same] = _rise(np.maximum(rest, 0), m[same][:, None])
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        gain[w[first]] += np.add.reduceat(rise, first, axis=0)
    weight = right.sum(1)
    sizes = np.repeat(rises.sizes[None, :], len(own), axis=0)
    at = np.arange(len(own))
    sizes[at, own] = np.maximum(0, sizes[at, own] - weight)
    gain -= 2 * (_plogp(sizes + weight[:, None]) - _plogp(sizes))
    gain[:, -1] = -np.inf  # the end's class
    best = gain.argmax(1)
    return np.where(gain[at, best] > gain[at, own] + 1e-9, best, own)


def best_of_single(rises: Rises) -> np.ndarray:
    """Best class of a word that occurs once, by the classes before and after it and its own."""
    k = len(rises.joint)
    out = np.zeros((k, k, k), np.uint8)
    for before in range(k):
        own = np.tile(np.arange(k), k)
        after = np.repeat(np.arange(k), k)
        word = np.repeat(np.arange(k * k), 2)
        code = np.stack([np.full(k * k, before), k + after], axis=1).ravel()
        out[before] = best_classes(rises, own, word, code, np.ones(2 * k * k)).reshape(k, k)
    return out


def _gathered(lists: pa.Table, contexts: pa.Table):
    """A part's words with their classes and, by occurrence, the word's place and the classes before and after; each
    stretch's places of its words."""
    lists, contexts = lists.sort_by("s"), contexts.sort_by("s")
    if lists["s"] != contexts["s"]:
        raise RuntimeError("a part has lists and contexts of different stretches")

    def read(table: pa.Table, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table[name].to_pylist()), kind)

    sizes = [len(x) // 8 for x in lists["words"].to_pylist()]
    words, first, places = np.unique(read(lists, "words", np.int64), return_index=True, return_inverse=True)
    own = read(contexts, "own", np.uint8)[first].astype(np.int64)
    owner = np.repeat(places, read(lists, "sizes", np.int32))
    return words, own, owner, read(contexts, "before", np.uint8), read(contexts, "after", np.uint8), np.split(places, np.cumsum(sizes)[:-1]), lists["s"]


def new_classes(may: np.ndarray, own: np.ndarray, owner: np.ndarray, before: np.ndarray, after: np.ndarray, rises: Rises, single: np.ndarray) -> np.ndarray:
    """Best class of each word of a part that may move, and the class of the others."""
    k, n = len(rises.joint), np.bincount(owner, minlength=len(own))
    new = own.copy()
    once = np.flatnonzero((n[owner] == 1) & may[owner])
    new[owner[once]] = single[before[once], after[once], own[owner[once]]]
    many = np.flatnonzero((n > 1) & may)
    number = np.full(len(own), -1, np.int64)
    number[many] = np.arange(len(many))
    often = np.flatnonzero(number[owner] >= 0)
    at = number[owner[often]] * (2 * k)
    keys, times = np.unique(np.concatenate([at + before[often], at + k + after[often]]), return_counts=True)
    word, code = keys // (2 * k), keys % (2 * k)
    for a in range(0, len(many), 8192):
        b = min(len(many), a + 8192)
        e = slice(*np.searchsorted(word, [a, b]))
        new[many[a:b]] = best_classes(rises, own[many[a:b]], word[e] - a, code[e], times[e])
    return new


def moved(lists: DataFrame, contexts: DataFrame, joint: np.ndarray, turn: int) -> DataFrame:
    """New classes of the words that are not clustered, answered to each stretch in its order; half of them may move."""
    rises = Rises(joint)
    shared = contexts.sparkSession.sparkContext.broadcast((rises, best_of_single(rises)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = left["p"][0].as_py()
        words, own, owner, before, after, places, stretches = _gathered(left, right)
        new = new_classes((words >> 40) % 2 == turn % 2, own, owner, before, after, *shared.value).astype(np.uint8)
        return pa.Table.from_batches([_batch(ANSWERS, [(s, p, new[at].tobytes(), b"") for s, at in zip(stretches.to_pylist(), places)])])

    return lists.groupBy("p").cogroup(contexts.filter("p >= 0").groupBy("p")).applyInArrow(run, ANSWERS)


def word_table(lists: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows (word, n, class) of all training words that are not clustered."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, own, owner, *_ = _gathered(left, right)
        n = np.bincount(owner, minlength=len(words)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(words), pa.array(n), pa.array(own.astype(np.int32))], names=["word", "n", "class"])

    return lists.groupBy("p").cogroup(contexts.filter("p >= 0").groupBy("p")).applyInArrow(run, TABLE)


def exchange_words(
    stretches: DataFrame, types: Types, by_type: np.ndarray, tokens: int, scratch: Scratch, classes: int, rounds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """Class bigrams, classes and counts of the types, and the table of the other training words after the exchange."""
    parts = max(1, math.ceil(tokens / TOKENS_A_PART))
    partitions = int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    buckets = max(partitions, math.ceil(parts / 4))
    lists = bucketed(word_lists(stretches, types, parts).repartition(buckets, "p"), scratch, "lists", "p", buckets)
    contexts = neighbours(stretches, types, by_type, classes, parts, True)
    reached, best, idle = -np.inf, None, 0
    for k in range(rounds + 1):
        name = f"contexts-{k}"
        contexts = scratch.stage(contexts, name)
        if k:
            scratch.free(f"answers-{k}")
        joint, sides = class_counts(contexts, classes, types.n)
        found = likelihood(joint)
        idle = 0 if found > reached + RISE * tokens else idle + 1
        if best is None or found > reached:
            if best:
                scratch.free(best[0])
            best, reached = (name, contexts, joint, sides, by_type), found
        else:
            scratch.free(name)
        if k == rounds or idle == 2:  # neither half of the words rises
            break
        _, contexts, joint, sides, by_type = best
        answers = scratch.stage(moved(lists, contexts, joint, k), f"answers-{k + 1}")
        half = np.array([t for t in range(len(types.words)) if t % 2 == k % 2 and sides[t].any()], np.int64)
        by_type = exchange(sides[:, :classes], sides[:, classes:], by_type, half, joint)
        contexts = neighbours(answered(stretches, answers), types, by_type, classes, parts, False)
    table = scratch.stage(word_table(lists, best[1]), "words")
    scratch.free(best[0], "lists")
    return best[2], best[4], best[3][:, :classes].sum(1), table


@dataclass
class Model:
    types: Types
    classes: np.ndarray  # of each type
    step: np.ndarray  # log10 P(class | class before)
    class_words: np.ndarray  # training tokens of each class
    class_kinds: np.ndarray  # distinct words of each class
    counted: np.ndarray  # sorted numbers of the words whose counts are at hand, the end token among them
    counts: np.ndarray
    tokens: int
    kinds: int

    def emission(self, count, n_class, kinds_class):
        return (count + ALPHA) / (n_class + ALPHA * (kinds_class + 1))


def train(texts: DataFrame, scratch: Scratch, **options) -> tuple[Model, DataFrame]:
    """The model of rows (text), and the staged table (word, n, class) of all training words."""
    rows = texts.select(F.lit(None).cast("long").alias("id"), F.lit(True).alias("learn"), "text")
    return learn(stretches_of(rows, scratch), scratch, **options)


def learn(
    stretches: DataFrame, scratch: Scratch, clustered: int = CLUSTERED, shapes: int = SHAPES, classes: int = CLASSES, rounds: int = ROUNDS, counted: int = COUNTED
) -> tuple[Model, DataFrame]:
    """The model of the stretches to learn from, and the staged table (word, n, class) of all their words."""
    spark = stretches.sparkSession
    stretches = stretches.filter("learn")
    counts = scratch.stage(word_counts(stretches), "counts")
    # Ties at the border are settled by the number, so reruns choose the same words.
    by_rank = [F.col("n").desc(), F.col("word")]
    top = counts.orderBy(*by_rank).limit(clustered).toArrow().sort_by("word")
    tokens = int(stretches.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)).alias("n")).first().n) // 4
    scratch.free("counts")
    types = Types(top["word"].to_numpy(), shapes)
    pairs = scratch.stage(type_pairs(stretches, types), "pairs")
    by_type = cluster(pairs, types, classes, rounds)
    scratch.free("pairs")
    joint, by_type, times, others = exchange_words(stretches, types, by_type, tokens, scratch, classes, rounds)
    step = np.log10((joint + ALPHA) / (joint.sum(1, keepdims=True) + ALPHA * classes))
    often = spark.createDataFrame([(w, int(n), int(c)) for w, n, c in zip(types.words.tolist(), times, by_type)], TABLE)
    table = others.unionByName(often)
    # Tokens and kinds of each class, the end token's among them.
    by_class = table.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    class_words, class_kinds = np.zeros(classes), np.zeros(classes)
    class_words[by_class["class"].to_numpy()] = by_class["n"].to_numpy()
    class_kinds[by_class["class"].to_numpy()] = by_class["v"].to_numpy()
    ends = int(joint[-1].sum())
    class_words[-1] += ends
    class_kinds[-1] += ends > 0
    top = table.orderBy(*by_rank).limit(max(clustered, counted)).toArrow().sort_by("word")
    numbers = top["word"].to_numpy()
    held = np.concatenate([top["class"].to_numpy().astype(np.int64), by_type[len(types.words) :]])
    known, times = np.append(END, numbers), np.append(ends, top["n"].to_numpy())
    return Model(Types(numbers, shapes), held, step, class_words, class_kinds, known, times, int(tokens), int(class_kinds.sum())), table


def asked(stretches: DataFrame, table: DataFrame, at_hand: np.ndarray, parts: int) -> DataFrame:
    """Counts and classes of the words that are not at hand, answered to each stretch; class -1 of unseen words."""
    shared = stretches.sparkSession.sparkContext.broadcast(at_hand)
    schema = "p long, s long, words binary, n binary, classes binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words = np.frombuffer(row["words"], np.int64)
            words = words[find(shared.value, words) < 0]
            out = [(p, row["s"], words[a:b].tobytes(), b"", b"") for p, a, b in _parts(words, parts)]
            if out:
                yield _batch(schema, out)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, kind = (batch.column(c).to_numpy() for c in ("word", "n", "class"))
            order = np.argsort(words, kind="stable")
            words, n, kind = words[order], n[order], kind[order].astype(np.int16)
            out = [(p, None, words[a:b].tobytes(), n[a:b].tobytes(), kind[a:b].tobytes()) for p, a, b in _parts(words, parts)]
            if out:
                yield _batch(schema, out)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        told, open_ = [r for r in rows if r["s"] is None], [r for r in rows if r["s"] is not None]
        join = lambda name, kind: np.frombuffer(b"".join(r[name] for r in told), kind)
        words, n, kind = join("words", np.int64), join("n", np.int64), join("classes", np.int16)
        order = np.argsort(words)
        words, n, kind = words[order], np.append(n[order], 0), np.append(kind[order], np.int16(-1))
        out = []
        for r in open_:
            at = find(words, np.frombuffer(r["words"], np.int64))  # -1 is the unseen words' place
            out.append((r["s"], r["p"], kind[at].tobytes(), n[at].astype(np.int64).tobytes()))
        return pa.Table.from_batches([_batch(ANSWERS, out)] if out else [], schema=_schema(ANSWERS))

    questions = stretches.select("s", "words").mapInArrow(ask, schema)
    known = table.select("word", "n", "class").mapInArrow(tell, schema)
    return questions.unionByName(known).groupBy("p").applyInArrow(run, ANSWERS)


def score(stretches: DataFrame, model: Model, table: DataFrame, key: str, key_type: T.DataType) -> DataFrame:
    """Per row of the stretches: key, n_tokens, n_known, train_tokens, base_score, score, and whether it was learned from.

    A task scores whole stretches. Words whose counts and classes it does not hold are asked of the parts of
    the table of training words.
    """
    shared = stretches.sparkSession.sparkContext.broadcast(model)
    schema = "id long, learned boolean, n_tokens long, known long, base double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for row in _rows(batches):
            words, tokens = np.frombuffer(row["words"], np.int64), np.frombuffer(row["tokens"], np.int32)
            lengths = np.frombuffer(row["lengths"], np.int64)
            kind, slots = m.classes[m.types.of(words)], find(m.counted, words)
            n = np.where(slots >= 0, m.counts[slots], 0)
            rest = np.flatnonzero(slots < 0)
            got = sorted(row["got"] or [], key=lambda g: g["p"])
            if got:
                told = np.concatenate([np.frombuffer(g["classes"], np.int16) for g in got])
                n[rest] = np.concatenate([np.frombuffer(g["counts"], np.int64) for g in got])
                kind[rest] = np.where(told >= 0, told, kind[rest])
            base = np.log10((n + 0.5) / (m.tokens + 0.5 * (m.kinds + 1)))
            emit = np.log10(m.emission(n, m.class_words[kind], m.class_kinds[kind]))
            k, doc, now = len(lengths), np.repeat(np.arange(len(lengths)), lengths), kind[tokens]
            before = np.concatenate([[len(m.class_words) - 1], now[:-1]])
            sums = [np.bincount(doc, x, k) for x in (n[tokens] > 0, base[tokens], m.step[before, now] + emit[tokens])]
            learned = pa.array(np.full(k, row["learn"]))
            columns = [pa.array(row["ids"], pa.int64()), learned, pa.array(lengths), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "learned", "n_tokens", "known", "base", "score"])

    parts = max(1, math.ceil(model.tokens / TOKENS_A_PART))
    answers = asked(stretches, table, model.counted, parts)
    out = answered(stretches, answers).select("learn", "ids", "lengths", "words", "tokens", "got").mapInArrow(run, schema)
    return out.select(
        F.col("id").cast(key_type).alias(key),
        (~F.col("learned")).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


def class_lm(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 1, **options) -> DataFrame:
    """Learn from the training folds of ``df`` and score all its rows; ``held_out`` says which were not learned from."""
    scratch = Scratch(df.sparkSession, "class-lm")
    fold = training_fold(key, folds, held_out)
    texts = df.select(F.col(key).cast("long").alias("id"), fold.alias("learn"), whole_text(text).alias("text"))
    stretches = stretches_of(texts, scratch)
    model, table = learn(stretches, scratch, **options)
    return score(stretches, model, table, key, df.schema[key].dataType)
