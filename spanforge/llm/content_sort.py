"""Exact copies by a content sort: sampled splitters deal normalised texts out by ranges, every range is
sorted outside memory, and neighbours are compared whole.

Spark's range partitioning samples the splitters, its sort spills, and a window whose partition is the
normalised text closes a group where a row's full text differs from its neighbour's. The range key is bounded:
the first bytes of the text, then a hash of all of it, so that neither the sampled keys nor equal beginnings
shared by many texts grow with the corpus. A text with so many copies, or bytes of them, that it would fill
a task also gets a slice number, which the splitters may cut between; its slices are put together by their
best rows. There are SHARE such texts by rows and SHARE by bytes at most, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.llm.stage import cut, one_row, release, unused

HEAD = 48  # characters of the range key
SHARE = 1 << 16
ROWS = 256  # copies that are never sliced
BYTES = 8 << 20
SPACES = " \t\n\x0b\x0c\r"


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """`(id_col, keep_id, group_size, kept, text_sha256, text_hash)` for every row.

    Texts are equal if they are the same without the characters 0x20 and 0x09-0x0D; `text_sha256` is the
    digest of what is left, `text_hash` a hash of the text as it is. Of equal texts the row with the most
    code points stays, then the one with the smallest id. A null text is an empty one, and all empty ones
    are equal. Null ids come last; of rows equal in id and length exactly one is kept. Columns other than
    the two are not read, so their names cannot clash. An empty table gives no rows.

    A text is sliced from `rows` copies or `size` bytes of copies on, or beyond the share of all rows or bytes.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    norm = F.translate(text, SPACES, "")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.length(text).alias("n"), F.xxhash64(text).alias("own"), norm.alias("norm"))
    kept: list[str] = []
    source = cut(source.withColumn("same", F.xxhash64("norm")), kept)

    total = one_row(source.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("norm")), F.lit(0)).alias("b")))
    rows, size = max(rows, total["n"] // SHARE), max(size, total["b"] // SHARE)
    groups = source.groupBy("same").agg(F.count("*").alias("c"), F.sum(F.octet_length("norm")).alias("b"))
    sliced = groups.filter((F.col("c") > 1) & ((F.col("c") > rows) | (F.col("b") > size)))
    slices = F.least("c", F.greatest(F.ceil(F.col("c") / rows), F.ceil(F.col("b") / size))).alias("slices")
    marked = source.join(F.broadcast(sliced.select("same", slices)), "same", "left")
    part = F.when(F.col("slices") > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id()), "slices")).otherwise(F.lit(0))
    marked = marked.withColumns({"head": F.substring("norm", 1, HEAD), "part": part})

    best = [F.desc("n"), F.asc_nulls_last("id"), F.asc("own")]
    order = W.partitionBy("head", "same", "part", "norm").orderBy(*best)
    group = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    dealt = marked.repartitionByRange("head", "same", "part").select(
        "*", F.row_number().over(order).alias("rank"), F.count("*").over(group).alias("size"), F.first("id").over(group).alias("keep")
    )
    first = F.col("rank") == 1
    found = dealt.select(
        "id", "n", "own", "same", "part", "size", "keep", first.alias("first"), F.sha2("norm", 256).alias("sha"),
        F.when(first & (F.col("slices") > 1), F.col("norm")).alias("norm"),
    )
    found = cut(found)
    release(spark, kept)

    row = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("own").alias("own"), F.col("part").alias("part"))
    wholes = found.filter("norm is not null").groupBy("same", "sha", "norm").agg(F.sum("size").alias("all"), F.min(row).alias("best"))
    result = found.drop("norm").join(F.broadcast(wholes.select("same", "sha", "all", "best")), ["same", "sha"], "left")
    in_best = F.col("best").isNull() | (F.col("part") == F.col("best.part"))
    return result.select(
        F.col("id").alias(id_col), F.when(F.col("best").isNull(), F.col("keep")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("all", "size").alias("group_size"), (F.col("first") & in_best).alias("kept"), F.col("sha").alias("text_sha256"), F.col("own").alias("text_hash"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; see `copies` for nulls, empty texts and ties.

    Rows equal in id and text, whatever their other columns, leave one row, any of them.
    """
    a, b, k_id, k_own = unused(docs, "id", "own", "k_id", "k_own")
    own = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    keys = docs.withColumns({a: F.col(f"`{id_col}`"), b: own}).dropDuplicates([a, b])
    stay = copies(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(k_id), F.col("text_hash").alias(k_own))
    same = F.col(a).eqNullSafe(F.col(k_id)) & (F.col(b) == F.col(k_own))
    return keys.join(stay, same, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

