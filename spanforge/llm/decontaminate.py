"""Benchmark decontamination by templates.

Numbers, units and names become typed placeholders, so a benchmark question with other values has the same
template. Windows of a benchmark item's template are hashed and joined with those of every document; so are
its words themselves, case-folded, which finds copies in other case and items made of placeholders. A run of
template matches along one alignment counts only if its slots agree: wherever the item repeats a value, the
document repeats one as well. A document leaks an item if the windows that it holds make up `share` of the
item's, or if `run` words in a row stand in it. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.stage import MARKS, cut, marked, marks, unused

# Units that may follow a number.
UNITS = (
    "mm|cm|m|km|inch|inches|ft|feet|foot|yd|yards|mile|miles|g|kg|mg|lb|lbs|oz|pounds?|tons?|l|ml|litres?|liters?|"
    "s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|percent|degrees?|"
    "mph|kmh|kph|hz|khz|mhz|w|kw|v|volts?|watts?|j|joules?|n|pa|mol"
)


def template(text: Column) -> Column:
    """`text` with placeholders <n>, <u> and <p>; it has as many words as before."""
    t = F.regexp_replace(text, r"\p{N}+([.,:/]\p{N}+)*", "<n>")
    t = F.regexp_replace(t, rf"(?i)(<n>\s?)({UNITS})(?![\p{{L}}\p{{N}}])", "$1<u>")
    return F.lower(F.regexp_replace(t, r"(?<=[^.!?:\s]\s)\p{Lu}\p{Ll}+", "<p>"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(size: Column | int, n: Column) -> Column:
    """First words (from 1) of the windows of `size` among `n`; none if there are fewer words."""
    return F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))


def _hash(words: Column, at: Column, size: Column | int) -> Column:
    return F.xxhash64(F.slice(words, at, size))


def _may(bitmap: Column, h: Column) -> Column:
    """As `marked`, for every window of every text: bits instead of remainders, as MARKS is a power of two."""
    word = F.get(bitmap, F.call_function("shiftright", h, F.lit(6)).bitwiseAND(F.lit(MARKS // 64 - 1)).cast("int"))
    return F.call_function("shiftright", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, n_windows, n_open, at, size, open, exact, h, item_words, slots): every window by its case-folded
    words (`exact`), and by its template as well where that has placeholders in half of its words at most (more
    would match by chance). `n_open` counts the windows that are not mostly placeholders (`open`). Items shorter
    than the window are one window; null and empty ones have none."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), _words(template(text)).alias("t"), _words(F.lower(text)).alias("raw"))
    words = words.filter("size(t) > 0").dropDuplicates(["item_id", "t", "raw"]).withColumn("size", F.least(F.lit(window), F.size("t")))
    each = words.withColumn("at", F.explode(_windows(F.col("size"), F.size("t"))))
    part = F.slice("t", F.col("at"), F.col("size"))
    filled = F.size(F.filter(part, lambda w: w.rlike("<[nup]>")))
    each = each.select("item_id", "at", "size", (filled * 2 <= F.col("size")).alias("open"), (filled > 0).alias("typed"), F.slice("raw", F.col("at"), F.col("size")).alias("item_words"), part.alias("slots"))
    total = each.groupBy("item_id").agg(F.count_distinct("at").alias("n_windows"), F.count_distinct(F.when(F.col("open"), F.col("at"))).alias("n_open"))
    kinds = F.filter(F.array(F.lit(True), F.lit(False)), lambda exact: exact | (F.col("open") & F.col("typed")))
    each = each.select("*", F.explode(kinds).alias("exact")).drop("typed")
    return each.withColumn("h", F.when(F.col("exact"), F.xxhash64("item_words")).otherwise(F.xxhash64("slots"))).join(total, "item_id")


def _longest(ats: Column) -> Column:
    """How many of the numbers follow one another at most."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(s: Column, at: Column) -> Column:
        n = F.when(at == s["last"] + 1, s["n"] + 1).otherwise(1)
        return F.struct(at.alias("last"), n.alias("n"), F.greatest(s["best"], n).alias("best"))

    return F.aggregate(F.array_sort(ats), start, step, lambda s: s["best"])


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
    share: float = 0.6,
    run: int = 13,
    most_broadcast: int = 200_000,
    kept: list[str] | None = None,
) -> DataFrame:
    """`(id_col, text_hash, item_id, n_windows, found, share, longest, reparameterised)` for every document and
    the items it leaks. `share` is that of all windows, or of those that are not mostly placeholders if that is
    more; `longest` counts the words that stand in a row along one alignment; `reparameterised` tells that a
    slot's value differs.

    Documents are filtered by a bitmap of fixed size of the benchmark's window hashes before anything is
    exploded, so only hits are shuffled; the benchmark's windows are broadcast if they are no more than
    `most_broadcast`. A group holds the alignments of one document and item, at most the item's words.

    Null and empty texts and items leak nothing. A null id stays null, repeated rows give one finding,
    equal ids with different texts one each (`text_hash`). Empty tables give no rows; other columns are not
    read.
    """
    kept = [] if kept is None else kept
    items = cut(benchmark_windows(benchmark, item_col, item_text_col, window), kept)
    sizes = [r["size"] for r in items.select("size").distinct().orderBy("size").collect()]  # at most `window`
    bitmap = marks(items.select(F.col("h").alias("key")))

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), _words(template(text)).alias("t"), _words(F.lower(text)).alias("raw"))

    def hashes(size: int) -> Column:
        at = lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), _hash(F.col("t"), i, size).alias("h"), _hash(F.col("raw"), i, size).alias("own"))
        return F.transform(_windows(size, F.size("t")), at)

    near = [F.filter(hashes(n), lambda s: _may(bitmap, s["h"]) | ((s["own"] != s["h"]) & _may(bitmap, s["own"]))) for n in sizes]
    hits = F.flatten(F.array(*near)) if near else F.array().cast("array<struct<at:int,size:int,h:long,own:long>>")
    rows = words.select("id", "text_hash", F.explode(F.transform(hits, lambda s: F.struct(s["at"].alias("doc_at"), s["size"].alias("size"), s["h"].alias("h"), s["own"].alias("own"), F.slice("raw", s["at"], s["size"]).alias("doc_words")))).alias("s"))
    keys = F.array(F.struct(F.lit(True).alias("exact"), F.col("s.own").alias("h")), F.struct(F.lit(False).alias("exact"), F.col("s.h").alias("h")))
    rows = rows.select("id", "text_hash", "s.doc_at", "s.size", "s.doc_words", F.explode(keys).alias("k")).select("*", "k.*").drop("k")
    small = items.count() <= most_broadcast
    met = rows.join(F.broadcast(items) if small else items, ["h", "size", "exact"])
    pairs = F.filter(
        F.zip_with(
            F.arrays_zip("slots", "item_words"), "doc_words",
            lambda a, b: F.struct(a["slots"].rlike("<[nup]>").alias("slot"), a["item_words"].alias("i"), b.alias("d")),
        ),
        lambda p: p["slot"],
    )
    lines = met.groupBy("id", "text_hash", "item_id", "n_windows", "n_open", "size", (F.col("doc_at") - F.col("at")).alias("shift")).agg(
        F.collect_set(F.when(F.col("exact"), F.col("at"))).alias("copied"),
        F.collect_set("at").alias("ats"),
        F.collect_set(F.when(F.col("open"), F.col("at"))).alias("open"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"),
    )
    names = F.array_distinct(F.transform("slots", lambda p: p["i"]))
    agree = F.size(names) == F.size("slots")
    other = agree & F.exists("slots", lambda p: p["i"] != p["d"])
    lines = lines.withColumn("ats", F.when(agree, F.col("ats")).otherwise(F.col("copied"))).filter("size(ats) > 0")
    found = lines.select(
        "id", "text_hash", "item_id", "n_windows", "n_open", other.alias("other"), (_longest(F.col("ats")) + F.col("size") - 1).alias("longest"),
        F.explode(F.transform("ats", lambda i: F.struct(i.alias("at"), F.array_contains("open", i).alias("open")))).alias("w"),
    )
    found = found.groupBy("id", "text_hash", "item_id", "n_windows", "n_open").agg(
        F.count_distinct("w.at").alias("found"),
        F.count_distinct(F.when(F.col("w.open"), F.col("w.at"))).alias("found_open"),
        F.max("longest").alias("longest"),
        F.max("other").alias("reparameterised"),
    )
    part = F.greatest(F.col("found") / F.col("n_windows"), F.try_divide("found_open", "n_open"))
    return found.filter((part >= share) | (F.col("longest") >= run)).select(
        F.col("id").alias(id_col), "text_hash", "item_id", "n_windows", "found", part.alias("share"), "longest", "reparameterised"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: list[str] | None = None) -> DataFrame:
    """`docs`, all columns, without the rows that leak an item.

    A row goes if its id and text leak, so rows repeated as a whole go together; null ids and texts are as in
    `leaks`, rows with null or empty texts stay, an empty table stays empty.
    """
    kept = [] if kept is None else kept
    f_id, f_same, may = unused(docs, "__id", "__same", "__may")
    found = leaks(docs, benchmark, id_col, text_col, kept=kept).select(F.col(id_col).alias(f_id), F.col("text_hash").alias(f_same)).distinct()
    same = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    found = cut(found, kept)
    bitmap = marks(found.select(F.xxhash64(f_id, f_same).alias("key")))
    here = docs.withColumn(may, marked(bitmap, F.xxhash64(F.col(f"`{id_col}`"), same)))
    match = F.col(f"`{id_col}`").eqNullSafe(F.col(f_id)) & (same == F.col(f_same))
    stay = here.filter(~F.col(may)).unionByName(here.filter(F.col(may)).join(found, match, "left_anti"))
    return stay.drop(may)
