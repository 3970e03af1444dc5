"""Session, staging tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a table may have to be broadcast; wider tables pass a lower limit.
BROADCAST_ROWS = 200_000

_local_dirs: dict[str, str] = {}


def local_session(cores: str = "8", app: str = "tidegauge", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(conf.pop("partitions", cores)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """Folder of this application's staged tables below the shared folder in ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and the master is local; it goes when
    Python ends. ``drop_staged`` deletes either.
    """
    app = spark.sparkContext.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return f"{configured.rstrip('/')}/tidegauge-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tidegauge-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables this application has staged; what reads them must be done."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(staging_dir(spark))
    path.getFileSystem(conf).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives executor loss, prunes columns."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A join side that should be small: computed once into a stored table, whose row count then
    decides about the broadcast hint."""
    return hinted(stage(df, "side"), limit)
