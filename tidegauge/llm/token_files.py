"""Token-id files: chunks of ids in bit or byte planes, each plane compressed with zstandard.

Documents in ascending key order are cut into blocks of neighbouring keys; a task writes one file per
block. A file holds

* a 8-byte magic,
* chunks of ``CHUNK_IDS`` ids (the last one shorter), each transposed into planes: byte plane k holds byte k
  of all ids, bit plane k bit k of all ids (packed); planes of zeros take no space,
* the documents: keys, lengths and null marks as compressed arrays,
* the chunk index (ids, and offset and size of each plane) as compressed JSON, its length and the magic.

A task that is run again writes a file of a new name; only files named in the manifest, which Spark commits
with the successful tasks, belong to the data set. Files of lost attempts are never read.

Defined cases: null and empty texts hold the end id alone; null keys come first; rows that repeat a key are
ordered by text; an empty table gives an empty manifest; only key and text columns are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import KeyBlocks, Scratch, prefix_sums, qualified, whole_text
from tidegauge.llm.tokens import WORDS, encoder

MAGIC = b"IDPLANE1"
CHUNK_IDS = 1 << 16
DOCS_PER_FILE = 5_000
LEVEL = 3
TEXTS_AT_ONCE = 256


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of little-endian unsigned 32-bit ids, empty where all bits are 0."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = raw.T
    else:
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = np.zeros((len(planes), n if kind == "byte" else -(-n // 8)), np.uint8)
    for row, plane in zip(rows, planes):
        if plane:
            row[:] = np.frombuffer(plane, np.uint8)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


class IdWriter:
    """One file; documents are added in order."""

    def __init__(self, uri: str, kind: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(path)
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.kind, self.chunks = kind, []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.at = 0
        self.keys: list = []
        self.lengths: list[int] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> int:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 4 * CHUNK_IDS:
            self._cut(last=False)

    def _cut(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        stop = len(ids) if last else len(ids) // CHUNK_IDS * CHUNK_IDS
        for a in range(0, stop, CHUNK_IDS):
            some = ids[a : min(a + CHUNK_IDS, stop)]
            planes = [self.zip.compress(p) if p else b"" for p in to_planes(some, self.kind)]
            self.chunks.append([len(some), [[self._write(p), len(p)] for p in planes]])
            self.n_ids += len(some)
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> int:
        self._cut(last=True)
        marks = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        sections = []
        for part in (keys, np.array(self.lengths, "<u4"), marks):
            data = self.zip.compress(part.tobytes())
            sections.append([self._write(data), len(data)])
        index = self.zip.compress(json.dumps({"kind": self.kind, "ids": self.n_ids, "docs": len(keys), "sections": sections, "chunks": self.chunks}).encode())
        self._write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.at


class IdReader:
    """Reads documents in order, or any range of ids by the chunk index."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a token-id file: {uri}")
        length = int.from_bytes(tail[:8], "little")
        self.unzip = zstandard.ZstdDecompressor()
        self.index = json.loads(self._section(size - 16 - length, length))
        self.firsts = np.cumsum([0] + [n for n, _ in self.index["chunks"]])

    def _section(self, at: int, size: int) -> bytes:
        return self.unzip.decompress(self.file.read_at(size, at))

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, lengths, and marks of null keys."""
        raw = [self._section(*s) for s in self.index["sections"]]
        return tuple(np.frombuffer(r, t) for r, t in zip(raw, ("<i8", "<u4", "u1")))

    def chunk(self, k: int) -> np.ndarray:
        n, planes = self.index["chunks"][k]
        return from_planes([self._section(at, size) if size else b"" for at, size in planes], n, self.index["kind"])

    def range(self, start: int, stop: int) -> np.ndarray:
        first = int(np.searchsorted(self.firsts, start, "right")) - 1
        last = int(np.searchsorted(self.firsts, stop, "left"))
        ids = [self.chunk(k) for k in range(first, last)]
        whole = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        return whole[start - self.firsts[first] : stop - self.firsts[first]]

    def texts(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, position of the first id, and ids of each document, a few chunks in memory at a time."""
        keys, lengths, marks = self.documents()
        held, k, at = np.zeros(0, "<u4"), 0, 0
        for key, n, null in zip(keys.tolist(), lengths.tolist(), marks.tolist()):
            if len(held) < n:
                more = [held]
                have = len(held)
                while have < n:
                    more.append(self.chunk(k))
                    have += len(more[-1])
                    k += 1
                held = np.concatenate(more)
            yield (None if null else key), at, held[:n]
            held, at = held[n:], at + n

    def close(self) -> None:
        self.file.close()


MANIFEST = T.StructType(
    [T.StructField("block", T.IntegerType()), T.StructField("uri", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("n_docs", "n_ids", "n_bytes")]
)


def write_ids(df: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, kind: str = "byte", docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Encode and write all documents below ``folder``; returns the manifest, one row per file.

    The manifest has ``start``, the number of ids in all earlier files. Of the tokenizer's file only the
    path is shipped. At most ``KeyBlocks.MAX_BLOCKS`` files are written, and their rows are what the driver
    sees.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "token-files")
    base = qualified(spark, folder)
    rows = df.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text"))
    blocks = KeyBlocks(rows, "key", docs_per_file)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, WORDS, folds=True)
        end = np.array([end_id], "<u4")
        done, writer, block, uri = [], None, None, ""

        def close():
            done.append((block, uri, len(writer.keys), sum(writer.lengths), writer.close()))

        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS_AT_ONCE):
                numbers, keys, texts = (batch.column(c).slice(a, TEXTS_AT_ONCE).to_pylist() for c in ("block", "key", "text"))
                for b, k, ids in zip(numbers, keys, encode.ids(texts)):
                    if b != block:
                        if writer is not None:
                            close()
                        block, uri = b, f"{base}/block-{b:06d}-{uuid.uuid4().hex}.ids"
                        writer = IdWriter(uri, kind)
                    writer.add(k, np.concatenate([ids, end]))
        if writer is not None:
            close()
        names = MANIFEST.fieldNames()
        yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema=pa.schema([("block", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    dealt = rows.withColumn("block", blocks.of()).repartition("block").sortWithinPartitions("block", "key", "text")
    manifest = scratch.stage(dealt.mapInArrow(files, MANIFEST), "manifest")
    starts = prefix_sums(manifest, "block", ["n_ids"])
    known = spark.createDataFrame([(b, s[0]) for b, s in starts.items()], "block int, start long")
    return manifest.join(F.broadcast(known), "block")


def read_ids(manifest: DataFrame, key_type: str = "long") -> DataFrame:
    """Documents of the files in a manifest: key, start, ids (little-endian unsigned 32-bit, as binary)."""
    schema = "key long, start long, ids binary"
    arrow = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                reader, rows, size = IdReader(uri), [], 0
                for key, at, ids in reader.texts():
                    rows.append((key, start + at, ids.tobytes()))
                    size += 4 * len(ids)
                    if size > 4 * 2**20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                        rows, size = [], 0
                reader.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    files = manifest.select("uri", "start", "block")
    n = max(1, min(files.count(), 100_000))
    return files.repartition(n, "uri").mapInArrow(documents, schema).withColumn("key", F.col("key").cast(key_type))
