"""Flat views of self time: by category, by namespace, top n with a tail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.operators.tree import covered
from spanforge.schema import CATEGORIES


def self_time_by_category(spans: DataFrame) -> DataFrame:
    name = F.when(F.col("category") != "", F.col("category")).otherwise("Other")
    return (
        spans.groupBy("log_id", name.alias("category"))
        .agg(F.sum("dur_self").alias("self_ns"))
        .filter(F.col("self_ns") > 0)
    )


def category_legend(spans: DataFrame) -> DataFrame:
    """The seven categories in display order, 0 when a log has none of one."""
    sums = spans.groupBy("log_id").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("category") == c, F.col("dur_self"))), F.lit(0)).alias(c)
            for c in CATEGORIES
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("category"), F.col(c).alias("self_ns"))
            for i, c in enumerate(CATEGORIES)
        ]
    )
    return sums.select("log_id", F.explode(rows).alias("r")).select("log_id", "r.*")


def self_time_by_namespace(spans: DataFrame, selected: Column | None = None) -> DataFrame:
    """Self time per namespace over the selected subtrees, each event counted once."""
    scope = spans
    if selected is not None:
        scope = covered(spans, selected, "__in").filter("__in")
    name = F.when(F.col("namespace") != "", F.col("namespace")).otherwise("default")
    return (
        scope.groupBy("log_id", name.alias("namespace"))
        .agg(F.sum("dur_self").alias("self_ns"))
        .filter(F.col("self_ns") > 0)
    )


def top_n_with_tail(
    df: DataFrame, n: int, label: str, value: str, keys: Sequence[str] = ("log_id",)
) -> DataFrame:
    """The n largest rows and one row that sums the others, so the parts still total the whole.

    The top n are found with a pruned rank; the tail is the grand total minus the top, so the
    tail rows are never brought together.
    """
    ranked = W.partitionBy(*keys).orderBy(F.desc(value), F.asc(label))
    top = df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)
    top = top.select(*keys, "rank", F.col(label).alias("label"), F.col(value).alias("value"))
    all_rows = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(value).alias("all"))
    held = top.groupBy(*keys).agg(F.sum("value").alias("held"))
    tail = (
        all_rows.filter(F.col("rows") > n)
        .join(held, list(keys))
        .select(
            *keys,
            F.lit(n + 1).alias("rank"),
            F.concat((F.col("rows") - n).cast("string"), F.lit(" others")).alias("label"),
            (F.col("all") - F.col("held")).alias("value"),
        )
    )
    return top.unionByName(tail)


def top_k(df: DataFrame, k: int, *order: Column, keys: Sequence[str] = ("log_id",)) -> DataFrame:
    ranked = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
