"""Spark session settings and the one place where lineage is cut."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Largest file, in bytes, that may be broadcast unmeasured.
SMALL_FILE = 256 * 1024
# Largest side, in bytes of its rows, that may be broadcast once it has been measured.
SMALL_ROWS = 1024 * 1024


def local_session(cores: str = "8", app: str = "spanforge", shared: str | None = None) -> SparkSession:
    """A session for tests and benches, with `shared` as spark.checkpoint.dir; on a cluster the caller
    brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores).replace("*", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Larger methods are not JIT-compiled; leave such stages to split projections.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Small test files: let every core read some of them.
        .config("spark.sql.files.openCostInBytes", str(256 * 1024))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def measured_broadcasts(spark: SparkSession) -> None:
    """Let only the smallest files be broadcast by their size; adaptive execution decides on the rest.

    Parquet packs span columns so well that a side estimated at 10 MB at most was a table of up to 151 MB
    in the driver. What has been shuffled is measured in rows; there SMALL_ROWS holds, as a parse has dozens of
    joins, and every table they broadcast passes through the driver. A measured threshold that the caller set stays.
    """
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    asked = spark.conf.get(static)
    size = 0 if asked.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(asked)
    if size <= SMALL_FILE:
        return
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, str(min(size, SMALL_ROWS)))
    spark.conf.set(static, str(SMALL_FILE))


def stage_dir(spark: SparkSession) -> str:
    """This run's folder for cut results, below `spark.checkpoint.dir` or, where that is unset, below the
    warehouse: both are shared by the driver and all executors. It goes when the session ends."""
    app = spark.sparkContext.applicationId
    if app not in _DIRS:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_stage"
        _DIRS[app] = f"{shared.rstrip('/')}/spanforge-{app}-{uuid.uuid4().hex[:8]}"
        where = spark._jvm.org.apache.hadoop.fs.Path(_DIRS[app])
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return _DIRS[app]


_DIRS: dict[str, str] = {}


def release(spark: SparkSession) -> None:
    """Delete all that this run has cut so far; results that still read it must be gone or written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_LOCAL = threading.local()


def _blocks() -> list[list[str]]:
    """The open `scratch` blocks of this thread, each with the tables cut in it."""
    if not hasattr(_LOCAL, "blocks"):
        _LOCAL.blocks = []
    return _LOCAL.blocks


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables cut in the block go when it ends, but for those cut by the function it gives.

    Whatever leaves the block must have been cut by that function, as it may read tables that go.
    """
    blocks = _blocks()
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = cut(df)
        kept.append(blocks[-1].pop())
        return out

    blocks.append([])
    try:
        yield keep
    finally:
        for path in blocks.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if blocks:
            blocks[-1].extend(kept)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once as a Parquet table in the shared folder and go on from there.

    An ordered operator reads its input twice (slice totals and rows). Cutting between such
    operators keeps a chain of them linear, makes a Python stage run once, lets later reads prune
    columns, and leaves nothing that dies with an executor.
    """
    spark = df.sparkSession
    measured_broadcasts(spark)
    path = f"{stage_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _blocks():
        _blocks()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
