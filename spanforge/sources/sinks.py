"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ns_as_ms(df: DataFrame) -> DataFrame:
    """Nanosecond columns as milliseconds with three decimals."""
    times = [c for c in df.columns if c.endswith("_ns") or c in ("dur_self", "dur_total")]
    return df.withColumns({c: F.round(F.col(c) / 1_000_000, 3) for c in times})


def write_csv(df: DataFrame, path: str) -> None:
    """A grid as comma-separated files with a header; arrays and structs as JSON."""
    flat = ns_as_ms(df)
    nested = [f.name for f in flat.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    flat.withColumns({c: F.to_json(c) for c in nested}).write.option("header", True).csv(path)


def write_spans(spans: DataFrame, path: str, buckets: int = 256) -> None:
    """The span table as Parquet, in folders by a hash of the log, so a log is found by pruning.

    A bucket is written by several tasks when it is large: the rows are spread by slice as well.
    """
    bucket = F.pmod(F.xxhash64("log_id"), F.lit(buckets)).cast("int")
    keyed = spans.withColumn("bucket", bucket)
    keyed.repartition("bucket", F.expr("event_index div 1000000")).sortWithinPartitions(
        "log_id", "event_index"
    ).write.partitionBy("bucket").parquet(path)
