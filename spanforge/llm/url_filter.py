"""URL rules, and for the URLs that no rule fits, the ratio of two character models.

The models are variable-order Markov models of host and path, one of URLs that a rule allows and one of
those that a rule blocks: contexts of up to three characters, each smoothed with the next shorter one by
its number of different followers (Witten-Bell). Which contexts are long depends on the data: a sequence is
kept if it makes up at least one in `share` of all positions, so a model has at most `share` sequences of a
length, whatever the input, and may be broadcast. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.stage import cut, one_row

ORDER = 3  # longest context
BEGIN, END = "\u0001", "\u0002"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, "^([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; rules are (verdict, host/path prefix)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _grams(judged: DataFrame, keep: list[str]) -> DataFrame:
    """A row per character of host and path and one for their end: g0..g3, the character behind 0..3 others."""
    padded = F.concat(F.lit(BEGIN * ORDER), "host", "path", F.lit(END))
    each = judged.select(*keep, padded.alias("t"), F.explode(F.sequence(F.lit(1), F.length("host") + F.length("path") + 1)).alias("i"))
    grams = [F.substring("t", F.col("i") + (ORDER - k), F.lit(k + 1)).alias(f"g{k}") for k in range(ORDER + 1)]
    return each.select(*keep, *grams)


def _milli(ratio: Column) -> Column:
    return F.round(F.log(ratio) * 1000).cast("long")


def train(judged: DataFrame, share: int, kept: list[str]) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Log ratios in thousandths: by sequence and by context for each length, and for an unknown character."""
    rows = _grams(judged.select("host", "path", (F.col("verdict") == "allow").cast("long").alias("good")), ["good"])
    stacked = rows.select("good", F.posexplode(F.array(*[f"g{k}" for k in range(ORDER + 1)])).alias("k", "g"))
    counts = cut(stacked.groupBy("k", "g").agg(F.sum("good").alias("a"), F.sum(1 - F.col("good")).alias("r")), kept)
    total = one_row(counts.filter("k = 0").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.count("*").alias("v")))
    n, unseen = total["a"] + total["r"], [0.5 / (total[c] + 0.5 * (total["v"] + 1)) for c in "ar"]
    frequent = (F.col("a") + F.col("r")) * share >= n
    context = (
        counts.filter("k > 0")
        .groupBy("k", F.expr("left(g, k)").alias("c"))
        .agg(*[f(x).alias(name) for x in "ar" for f, name in ((F.sum, f"n{x}"), (lambda x: F.count_if(F.col(x) > 0), f"t{x}"))])
        .filter(f"(na + nr) * {share} >= {n}")
    )
    context = cut(context, kept)
    level = counts.filter("k = 0").filter(frequent)
    level = level.select("g", *[((F.col(x) + 0.5) * 2 * u).alias(f"p{x}") for x, u in zip("ar", unseen, strict=True)])
    levels = [cut(level, kept)]
    for k in range(1, ORDER + 1):
        shorter = levels[-1].select(F.col("g").alias("s"), F.col("pa").alias("sa"), F.col("pr").alias("sr"))
        own = counts.filter((F.col("k") == k) & frequent).withColumn("c", F.expr("left(g, k)")).withColumn("s", F.expr("substring(g, 2)"))
        joined = own.drop("k").join(context.filter(F.col("k") == k).drop("k"), "c").join(shorter, "s")
        smooth = [
            F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"s{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.col(f"s{x}")).alias(f"p{x}")
            for x in "ar"
        ]
        levels.append(cut(joined.select("g", *smooth), kept))
    back = [F.when(F.col(f"n{x}") > 0, F.col(f"t{x}") / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.lit(1.0)) for x in "ar"]
    contexts = [cut(context.filter(F.col("k") == k).select(F.col("c").alias(f"c{k}"), _milli(back[0] / back[1]).alias(f"b{k}")), kept) for k in range(1, ORDER + 1)]
    ratios = [cut(p.select(F.col("g").alias(f"g{k}"), _milli(F.col("pa") / F.col("pr")).alias(f"d{k}")), kept) for k, p in enumerate(levels)]
    return ratios, contexts, int(one_row(counts.sparkSession.range(1).select(_milli(F.lit(unseen[0] / unseen[1])).alias("x")))["x"])


def score(judged: DataFrame, model: tuple[list[DataFrame], list[DataFrame], int], keep: list[str]) -> DataFrame:
    """`keep`, how often the row occurs, and the length-normalised log ratio in whole thousandths."""
    ratios, contexts, unknown = model
    rows = _grams(judged, keep)
    for k, ratio in enumerate(ratios):
        rows = rows.join(F.broadcast(ratio), f"g{k}", "left")
    for k, context in enumerate(contexts, 1):
        rows = rows.withColumn(f"c{k}", F.expr(f"left(g{k}, {k})")).join(F.broadcast(context), f"c{k}", "left")
    back, value = F.lit(0).cast("long"), []
    for k in range(ORDER, -1, -1):
        value.append(F.col(f"d{k}") + back)
        back = back + F.coalesce(F.col(f"b{k}"), F.lit(0)) if k else back
    last = F.col("g0") == END
    sums = rows.groupBy(*keep).agg(F.sum(F.coalesce(*value, F.lit(unknown) + back)).alias("sum"), F.count("*").alias("chars"), F.count_if(last).alias("copies"))
    return sums.select(*keep, "copies", F.floor(F.col("sum") / F.col("chars")).alias("ratio"))


def threshold(scored: DataFrame) -> int:
    """The ratio from which on URLs are allowed that best parts the given judged ones (mean of both
    classes' shares judged right; of equal ones the nearest to 0). Without one of the classes: 0."""
    by = scored.groupBy("ratio").agg(*[F.sum(F.when(F.col("verdict") == v, F.col("copies")).otherwise(0)).alias(x) for v, x in (("allow", "a"), ("block", "r"))])
    upto = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)  # one row for each whole ratio
    every = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = by.select(
        "ratio",
        (F.sum("a").over(every) - F.coalesce(F.sum("a").over(upto), F.lit(0))).alias("right_a"),
        F.coalesce(F.sum("r").over(upto), F.lit(0)).alias("right_r"),
        F.sum("a").over(every).alias("all_a"),
        F.sum("r").over(every).alias("all_r"),
    ).filter("all_a > 0 AND all_r > 0")
    best = seen.orderBy((F.col("right_a") * F.col("all_r") + F.col("right_r") * F.col("all_a")).desc(), F.abs("ratio"), "ratio").first()
    return int(best["ratio"]) if best else 0


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", share: int = 1 << 16, kept: list[str] | None = None
) -> DataFrame:
    """`(id_col, host, path, rule, verdict, ratio)` for every row.

    The verdict is that of the longest fitting rule, else of the models: allow where the ratio reaches a
    threshold fitted on the fifth of the judged rows that the models are not trained on (id divisible by 5,
    or null). `ratio` is the log-likelihood difference by character, in thousandths, rounded down.

    Null urls and those without `://` have empty host and path and are judged by the models like any other.
    Repeated rows and ids give a row each, null ids stay null, an empty table gives no rows, and other
    columns are not read. Long urls only add characters. Equal urls of an id are summed up before the one
    shuffle, which moves a row per page.
    """
    kept = [] if kept is None else kept
    host, path = split_url(F.col("url"))
    named = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")).select("id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = named.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    by_rule, tuned = judged.filter("rule IS NOT NULL"), F.coalesce(F.col("id") % 5, F.lit(0)) == 0
    model = train(by_rule.filter(~tuned), share, kept)
    scored = cut(score(judged, model, ["id", "host", "path", "rule", "verdict"]), kept)
    least = threshold(scored.filter(F.col("rule").isNotNull() & tuned))
    found = F.coalesce("verdict", F.when(F.col("ratio") >= least, "allow").otherwise("block"))
    rows = scored.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", found.alias("verdict"), "ratio")


def judge_sql(rules: list[tuple[str, str]], share: int = 1 << 16) -> str:
    """`judge_urls` over `pages` in plain SQL."""
    longest = sorted(rules, key=lambda r: -len(r[1]))
    fits = lambda t: f"(host = '{t.partition('/')[0]}' OR host LIKE '%.{t.partition('/')[0]}') AND starts_with(path, '/{t.partition('/')[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{t}' THEN '{v}'" for v, t in longest) + " END"
    stacked = " UNION ALL ".join(f"SELECT good, {k} AS k, g{k} AS g FROM grams WHERE id % 5 <> 0 AND rule IS NOT NULL" for k in range(ORDER + 1))
    milli = "CAST(round(ln({}) * 1000) AS BIGINT)"
    levels = ["p0 AS (SELECT g, (a + 0.5) * 2 * ua AS pa, (r + 0.5) * 2 * ur AS pr FROM counts, total WHERE k = 0 AND (a + r) * %d >= n)" % share]
    for k in range(1, ORDER + 1):
        levels.append(
            f"p{k} AS (SELECT o.g, CASE WHEN c.na > 0 THEN (o.a + c.ta * s.pa) / (c.na + c.ta) ELSE s.pa END AS pa,"
            f" CASE WHEN c.nr > 0 THEN (o.r + c.tr * s.pr) / (c.nr + c.tr) ELSE s.pr END AS pr FROM counts o JOIN context c ON c.k = {k} AND c.c = left(o.g, {k})"
            f" JOIN p{k - 1} s ON s.g = substr(o.g, 2), total WHERE o.k = {k} AND (o.a + o.r) * {share} >= n)"
        )
    levels += [f"d{k} AS (SELECT g, {milli.format('pa / pr')} AS d FROM p{k})" for k in range(ORDER + 1)]
    bow = lambda x: f"(CASE WHEN n{x} > 0 THEN t{x} / (n{x} + t{x}) ELSE 1.0 END)"
    levels += [f"b{k} AS (SELECT c, {milli.format(bow('a') + ' / ' + bow('r'))} AS b FROM context WHERE k = {k})" for k in range(1, ORDER + 1)]
    back = [" + ".join(["0", *[f"coalesce(b{j}.b, 0)" for j in range(k + 1, ORDER + 1)]]) for k in range(ORDER + 1)]
    value = "coalesce(" + ", ".join(f"d{k}.d + {back[k]}" for k in range(ORDER, -1, -1)) + f", {milli.format('ua / ur')} + {back[0]})"
    joins = reduce(lambda s, k: s + f" LEFT JOIN d{k} ON d{k}.g = g{k}", range(ORDER + 1), "")
    joins = reduce(lambda s, k: s + f" LEFT JOIN b{k} ON b{k}.c = left(g{k}, {k})", range(1, ORDER + 1), joins)
    return f"""
WITH rest AS (SELECT page_id AS id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
named AS (SELECT id, translate(regexp_extract(x, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(substr(x, length(regexp_extract(x, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, {rule} AS rule FROM named),
judged AS (SELECT *, {verdict} AS verdict, row_number() OVER () AS row_no FROM ruled),
grams AS (SELECT row_no, id, rule, CASE WHEN verdict = 'allow' THEN 1 ELSE 0 END AS good,
  {", ".join(f"substr(t, CAST(i AS BIGINT) + {ORDER - k}, {k + 1}) AS g{k}" for k in range(ORDER + 1))}
  FROM (SELECT *, repeat(chr(1), {ORDER}) || host || path || chr(2) AS t, unnest(range(1, length(host) + length(path) + 2)) AS i FROM judged)),
counts AS (SELECT k, g, sum(good) AS a, sum(1 - good) AS r FROM ({stacked}) GROUP BY k, g),
total AS (SELECT sum(a) + sum(r) AS n, 0.5 / (sum(a) + 0.5 * (count(*) + 1)) AS ua, 0.5 / (sum(r) + 0.5 * (count(*) + 1)) AS ur FROM counts WHERE k = 0),
context AS (SELECT k, left(g, k) AS c, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr
  FROM counts, total WHERE k > 0 GROUP BY k, left(g, k), n HAVING (sum(a) + sum(r)) * {share} >= n),
{", ".join(levels)},
scored AS (SELECT row_no, CAST(floor(sum({value}) / count(*)) AS BIGINT) AS ratio FROM grams{joins}, total GROUP BY row_no),
full_rows AS (SELECT j.*, s.ratio FROM judged j JOIN scored s USING (row_no)),
tuned AS (SELECT ratio, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS r
  FROM full_rows WHERE rule IS NOT NULL AND id % 5 = 0 GROUP BY ratio),
cum AS (SELECT ratio, sum(a) OVER () - coalesce(sum(a) OVER w, 0) AS ra, coalesce(sum(r) OVER w, 0) AS rr, sum(a) OVER () AS aa, sum(r) OVER () AS ar
  FROM tuned WINDOW w AS (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
least AS (SELECT coalesce((SELECT ratio FROM cum WHERE aa > 0 AND ar > 0 ORDER BY ra * ar + rr * aa DESC, abs(ratio), ratio LIMIT 1), 0) AS least)
SELECT id AS page_id, host, path, rule, coalesce(verdict, CASE WHEN ratio >= least THEN 'allow' ELSE 'block' END) AS verdict, ratio FROM full_rows, least
"""
