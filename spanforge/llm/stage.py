"""Tables cut into the shared folder, and small helpers that several operators use."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; where that is unset, one below the warehouse.

    Both are places that the driver and all executors share, so nothing depends on the kind of master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm_stage"
    return named.rstrip("/")


def cut(df: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and go on from the files, so that lost executors cost no rerun.

    The path is added to `kept`; `release` deletes those tables once nothing reads them. Tables without
    `kept` go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    if kept is not None:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """A list for `cut` whose tables go at the end of the block."""
    paths: list[str] = []
    try:
        yield paths
    finally:
        release(spark, paths)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where `df` has a column of that name, so that helper columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo `folds`; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def one_row(df: DataFrame) -> dict:
    """The single row of a global aggregate."""
    return df.first().asDict()


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of `batch` whose `column` holds about `most` bytes at most (a longer row stands alone)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


MARKS = 1 << 20  # bits of a bitmap of keys, a fixed size


def marks(keys: DataFrame) -> Column:
    """From the column `key` (long), a literal for `marked`: a bit for each key modulo MARKS. Counted where
    the keys are; what comes to the driver is bounded by MARKS."""
    bit = f"cast(pmod(key, {MARKS}) as long)"
    words = keys.groupBy(F.expr(f"cast({bit} div 64 as int)").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({bit} % 64 as int))")).alias("v"))
    bitmap = [0] * (MARKS // 64)
    for r in words.collect():
        bitmap[r["w"]] = r["v"]
    return F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<long>")


def marked(bitmap: Column, key: Column) -> Column:
    """Whether `key` may be among the marked ones; true for all that are."""
    bit = F.pmod(key, F.lit(MARKS))
    word = F.get(bitmap, F.floor(bit / 64).cast("int"))
    return F.call_function("shiftright", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

