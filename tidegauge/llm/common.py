"""Helpers the text operators share: table access, staged tables, blocks of ascending keys."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import staging_dir

# White space of the contracts: [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


class Scratch:
    """Staged tables of one operator call, in a folder of its own below ``spark.checkpoint.dir``.

    A table that later steps no longer read can be freed; what a returned DataFrame reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def free(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


class KeyBlocks:
    """Blocks of ascending integer keys with about ``rows_per_block`` rows.

    Edges are approximate quantiles of the key column alone; at most ``MAX_BLOCKS`` of them reach the
    driver, whatever the size of the table. Keys that repeat share a block, null keys are in block 0.
    """

    MAX_BLOCKS = 16_384

    def __init__(self, df: DataFrame, key: str, rows_per_block: int):
        rows = df.count()
        n = min(self.MAX_BLOCKS, math.ceil(rows / rows_per_block))
        edges: list[int] = []
        if n > 1:
            shares = [i / n for i in range(1, n)]
            found = df.agg(F.percentile_approx(key, shares, 4 * n).alias("e")).first().e or []
            edges = sorted(set(found))
        self.key, self.edges = key, edges
        self.n = len(edges) + 1

    def of(self) -> Column:
        """Number of edges at or below the key: coarse steps first, then the edges of one step."""
        if not self.edges:
            return F.lit(0)
        step = math.ceil(math.sqrt(len(self.edges)))
        runs = [self.edges[i : i + step] for i in range(0, len(self.edges), step)]
        key = F.coalesce(F.col(self.key).cast("long"), F.lit(-(2**63)))

        def below(edges: Column) -> Column:
            return F.size(F.filter(edges, lambda e: e <= key))

        heads = F.array(*[F.lit(r[0]).cast("long") for r in runs])
        nested = F.array(*[F.array(*[F.lit(e).cast("long") for e in r]) for r in runs])
        run = below(heads)
        inside = F.when(run == 0, F.lit(0)).otherwise(
            (run - 1) * F.lit(step) + below(F.get(nested, F.greatest(run - 1, F.lit(0))))
        )
        return inside.cast("int")


def prefix_sums(df: DataFrame, block: str, totals: Sequence[str]) -> dict[int, tuple]:
    """Sums over all earlier blocks, per block; one row per block reaches the driver."""
    rows = df.groupBy(block).agg(*[F.sum(t).alias(t) for t in totals]).orderBy(block).collect()
    before, out = [0] * len(totals), {}
    for row in rows:
        out[row[block]] = tuple(before)
        before = [b + (row[t] or 0) for b, t in zip(before, totals)]
    return out


def qualified(spark: SparkSession, path: str) -> str:
    """Path with scheme and authority of its file system, so that executors resolve it alike."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


_kept: list = [None, None]


def worker_cache(name: object, make):
    """What a Python worker keeps between tasks: one object at a time, so that operators that follow each
    other in one worker do not add up their caches."""
    if _kept[0] != name:
        _kept[:] = [None, None]
        if make is not None:
            _kept[:] = [name, make()]
    return _kept[1]
