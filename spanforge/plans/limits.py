"""Limit-series queries: user activity read as changes and reports of a governed metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import limits as lim
from spanforge.plans.registry import TRACE, TREE, query
from spanforge.session import cut
from spanforge.sources.tables import order_tree, user_traces

# Activity spreads over weeks, so its slices are days.
DAY = 86_400_000_000_000
# So that even the test tables make several slices.
ROWS = 2_000

OBSERVED = (
    TRACE.replace("WITH trace", "WITH RECURSIVE trace")
    + """, obs AS (
  SELECT log_id, event_index, ts_ns, 'n' || CAST(cents % 2 AS VARCHAR) AS namespace, 'dmlRows' AS metric,
    CASE type WHEN 'error' THEN 'cumulative' WHEN 'signup' THEN 'scoped' ELSE 'delta' END AS kind,
    CASE type WHEN 'error' THEN cents % 500 WHEN 'signup' THEN cents % 700 WHEN 'click' THEN cents
      WHEN 'purchase' THEN cents % 7 ELSE -(cents % 30) END AS value
  FROM trace),
o AS (SELECT *, row_number() OVER (PARTITION BY log_id, namespace ORDER BY ts_ns, event_index) AS n,
    lead(kind) OVER (PARTITION BY log_id, namespace ORDER BY ts_ns, event_index) AS next_kind,
    coalesce(max(CASE kind WHEN 'cumulative' THEN value END) OVER (PARTITION BY log_id, namespace), 1000000000000) AS cap
  FROM obs WHERE NOT (kind = 'delta' AND value = 0)),
rec AS (
  SELECT log_id, namespace, 0 AS n, CAST(0 AS BIGINT) AS pending, FALSE AS released, CAST(0 AS BIGINT) AS x,
    CAST(0 AS BIGINT) AS tracked, FALSE AS saw FROM o WHERE n = 1
  UNION ALL
  SELECT r.log_id, r.namespace, r.n + 1,
    CASE WHEN o.kind <> 'delta' OR abs(r.pending + o.value) >= 20 THEN 0 ELSE r.pending + o.value END,
    o.kind = 'delta' AND abs(r.pending + o.value) >= 20,
    CASE o.kind WHEN 'delta' THEN r.x + o.value WHEN 'cumulative' THEN o.value ELSE greatest(o.value, least(r.x, o.cap)) END,
    CASE o.kind WHEN 'delta' THEN r.tracked + o.value ELSE r.tracked END, r.saw OR o.kind = 'delta'
  FROM rec r JOIN o ON o.log_id = r.log_id AND o.namespace = r.namespace AND o.n = r.n + 1),
shown AS (
  SELECT o.*, least(r.x, o.cap) AS used, r.tracked, r.saw,
    o.kind <> 'delta' OR r.released OR (coalesce(o.next_kind, 'end') <> 'delta' AND r.pending <> 0) AS shown
  FROM rec r JOIN o USING (log_id, namespace, n)),
grid AS (
  SELECT t.log_id, t.ts_ns, k.namespace FROM (SELECT DISTINCT log_id, ts_ns FROM shown WHERE shown) t
  JOIN (SELECT DISTINCT log_id, namespace FROM shown WHERE shown) k USING (log_id)),
filled AS (
  SELECT g.log_id, g.ts_ns, last_value(s.used IGNORE NULLS) OVER w AS used,
    last_value(CASE WHEN s.saw THEN s.tracked ELSE s.used END IGNORE NULLS) OVER w AS counted,
    last_value(CASE WHEN s.used IS NULL THEN NULL ELSE CAST(s.saw AS INT) END IGNORE NULLS) OVER w AS saw
  FROM grid g LEFT JOIN (SELECT * FROM shown WHERE shown) s USING (log_id, namespace, ts_ns)
  WINDOW w AS (PARTITION BY g.log_id, g.namespace ORDER BY g.ts_ns ROWS UNBOUNDED PRECEDING)),
series AS (
  SELECT log_id, ts_ns, 'dmlRows' AS metric, CAST(sum(used) AS BIGINT) AS used, 10000 AS "limit",
    CASE WHEN max(saw) = 1 AND sum(counted) < sum(used) THEN CAST(sum(counted) AS BIGINT) END AS tracked
  FROM filled WHERE used IS NOT NULL GROUP BY log_id, ts_ns)
"""
)


def observed(spark, sf):
    t = user_traces(spark, sf)
    kind = F.when(F.col("type") == "error", "cumulative").when(F.col("type") == "signup", "scoped").otherwise("delta")
    value = (
        F.when(F.col("type") == "error", F.col("cents") % 500)
        .when(F.col("type") == "signup", F.col("cents") % 700)
        .when(F.col("type") == "click", F.col("cents"))
        .when(F.col("type") == "purchase", F.col("cents") % 7)
        .otherwise(-(F.col("cents") % 30))
    )
    rows = t.select(
        "log_id", "event_index", "ts_ns",
        F.concat(F.lit("n"), (F.col("cents") % 2).cast("string")).alias("namespace"),
        F.lit("dmlRows").alias("metric"), kind.alias("kind"), value.alias("value"), F.lit(1).alias("rank"),
    )
    return rows.filter(~((F.col("kind") == "delta") & (F.col("value") == 0)))


_SERIES: dict = {}


def series_of(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SERIES:
        _SERIES[key] = cut(lim.limit_series(observed(spark, sf), size=ROWS))
    return _SERIES[key]


@query(
    "l1_limit_observations",
    TREE
    + """SELECT log_id, event_index, metric, value FROM (
  SELECT log_id, event_index, 'soqlQueries' AS metric, 1 AS value FROM tree WHERE type = 'SOQL_EXECUTE_BEGIN'
  UNION ALL SELECT log_id, event_index, 'queryRows', soql_rows_self FROM tree WHERE type = 'SOQL_EXECUTE_BEGIN'
  UNION ALL SELECT log_id, event_index, 'soslQueries', 1 FROM tree WHERE type = 'SOSL_EXECUTE_BEGIN'
  UNION ALL SELECT log_id, event_index, 'dmlStatements', 1 FROM tree WHERE type = 'DML_BEGIN'
  UNION ALL SELECT log_id, event_index, 'dmlRows', dml_rows_self FROM tree WHERE type = 'DML_BEGIN'
  UNION ALL SELECT log_id, event_index, 'heapSize', heap_net_self FROM tree WHERE type = 'HEAP_ALLOCATE')
WHERE value <> 0""",
)
def _(spark, sf):
    return lim.limit_observations(order_tree(spark, sf)).select("log_id", "event_index", "metric", "value")


@query(
    "l2_effective_limits",
    OBSERVED
    + """SELECT log_id, metric, greatest(max(value) * 30, 10000) AS "limit" FROM obs WHERE kind = 'cumulative' AND value > 0 GROUP BY ALL""",
)
def _(spark, sf):
    reports = observed(spark, sf).filter(F.col("kind") == "cumulative")
    return lim.effective_limits(reports.withColumn("limit", F.col("value") * 30))


@query(
    "l3_coalesce_deltas",
    OBSERVED + "SELECT log_id, namespace, event_index, shown FROM shown",
)
def _(spark, sf):
    gathered = lim.coalesce_deltas(lim.with_limit(observed(spark, sf), None), ROWS)
    return gathered.select("log_id", "namespace", "event_index", "shown")


@query(
    "l4_reported_caps",
    OBSERVED
    + "SELECT log_id, namespace, metric, max(value) AS cap FROM obs WHERE kind = 'cumulative' GROUP BY ALL",
)
def _(spark, sf):
    return lim.reported_caps(observed(spark, sf))


@query("l5_fold_limits", OBSERVED + "SELECT log_id, namespace, event_index, used, tracked FROM shown")
def _(spark, sf):
    folded = lim.fold_limits(lim.with_limit(observed(spark, sf), None), ROWS)
    return folded.select("log_id", "namespace", "event_index", "used", "tracked")


@query("l6_limit_series", OBSERVED + "SELECT * FROM series")
def _(spark, sf):
    return series_of(spark, sf)


_TOTALS = """SELECT log_id, metric, greatest(max(used), 0) AS used, 10000 AS "limit" FROM series GROUP BY ALL"""


@query("l7_limit_totals", OBSERVED + _TOTALS)
def _(spark, sf):
    return lim.limit_totals(series_of(spark, sf)).drop("has_limits")


@query(
    "l8_ranked_limits",
    TREE.replace("WITH place", "WITH RECURSIVE place")
    + """, o AS (SELECT log_id, event_index, ts_ns, unnest(['soqlQueries', 'queryRows', 'soslQueries', 'dmlStatements', 'dmlRows', 'heapSize']) AS metric,
  unnest([0, 1, 2, 3, 5, 7]) AS pos, unnest([100, 50000, 20, 150, 10000, 6000000]) AS "limit",
  unnest([soql_count_self, soql_rows_self, sosl_count_self, dml_count_self, dml_rows_self, CASE WHEN type = 'HEAP_ALLOCATE' THEN hn ELSE 0 END]) AS value,
  namespace FROM (SELECT t.*, CASE WHEN t.type = 'HEAP_ALLOCATE' THEN t.heap_net_self ELSE 0 END AS hn FROM tree t)),
per_ts AS (SELECT log_id, metric, pos, "limit", ts_ns, CAST(sum(value) AS BIGINT) AS v FROM o WHERE value <> 0 GROUP BY ALL),
run AS (SELECT *, CAST(sum(v) OVER (PARTITION BY log_id, metric ORDER BY ts_ns) AS BIGINT) AS total FROM per_ts),
u AS (SELECT log_id, metric, pos, "limit", greatest(max(total), 0) AS used FROM run WHERE metric <> 'heapSize' GROUP BY ALL),
-- Heap is gathered to a 500th of its limit: what shows is the sum at releases and at the end.
hv AS (SELECT log_id, event_index, ts_ns, value, row_number() OVER (PARTITION BY log_id ORDER BY ts_ns, event_index) AS n FROM o WHERE metric = 'heapSize' AND value <> 0),
hs AS (SELECT *, CAST(sum(value) OVER (PARTITION BY log_id ORDER BY n) AS BIGINT) AS total, max(n) OVER (PARTITION BY log_id) AS last FROM hv),
walk AS (SELECT log_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS shown FROM (SELECT DISTINCT log_id FROM hs)
  UNION ALL SELECT walk.log_id, hs.n, CASE WHEN abs(hs.total - walk.shown) >= 12000 OR hs.n = hs.last THEN hs.total ELSE walk.shown END
  FROM walk JOIN hs ON hs.log_id = walk.log_id AND hs.n = walk.n + 1),
held AS (SELECT walk.log_id, ts_ns, arg_max(shown, walk.n) AS shown FROM walk JOIN hs ON hs.log_id = walk.log_id AND hs.n = walk.n GROUP BY ALL),
allu AS (SELECT * FROM u UNION ALL SELECT log_id, 'heapSize', 7, 6000000, greatest(max(shown), 0) FROM held GROUP BY log_id)
SELECT log_id, metric, used, "limit", round(used * 100.0 / "limit", 6) AS ratio,
  row_number() OVER (PARTITION BY log_id ORDER BY used * 100.0 / "limit" DESC, pos) AS rank FROM allu WHERE used > 0 QUALIFY rank <= 6""",
)
def _(spark, sf):
    series = lim.limit_series(lim.limit_observations(order_tree(spark, sf)))
    out = lim.ranked_limits(lim.limit_totals(series).drop("has_limits"), 6)
    return out.withColumn("ratio", F.round("ratio", 6))


_TREND = """, tot AS (SELECT log_id FROM series GROUP BY log_id HAVING max(used) > 0),
trend AS (
  SELECT log_id, metric, 1 AS rank, ts_ns, used, used / 10000.0 * 100 AS ratio FROM series WHERE log_id IN (SELECT log_id FROM tot)
  UNION ALL SELECT log_id, 'dmlRows', 1, 0, 0, 0 FROM tot)
"""


@query(
    "l9_limit_trends",
    OBSERVED + _TREND + "SELECT log_id, metric, rank, ts_ns, used, round(ratio, 6) AS ratio FROM trend",
)
def _(spark, sf):
    series = series_of(spark, sf)
    return lim.limit_trends(series, lim.limit_totals(series)).withColumn("ratio", F.round("ratio", 6))


def probes(spark, sf):
    """Times of views, half a second on."""
    views = user_traces(spark, sf).filter(F.col("type") == "view")
    return views.select("log_id", F.lit("dmlRows").alias("metric"), (F.col("ts_ns") + 500_000_000).alias("ts_ns"))


_PROBE = """, probe AS (SELECT log_id, ts_ns + 500000000 AS ts_ns FROM trace WHERE type = 'view')
"""


@query(
    "l10_limit_at",
    OBSERVED
    + _TREND
    + _PROBE
    + """, b AS (
  SELECT p.log_id, p.ts_ns, (SELECT max(t.ts_ns) FROM trend t WHERE t.log_id = p.log_id AND t.ts_ns < p.ts_ns) AS a,
    (SELECT min(t.ts_ns) FROM trend t WHERE t.log_id = p.log_id AND t.ts_ns >= p.ts_ns) AS z
  FROM probe p WHERE p.log_id IN (SELECT log_id FROM tot))
SELECT b.log_id, 'dmlRows' AS metric, b.ts_ns, round(CASE WHEN z IS NULL THEN x.used
    ELSE x.used + CAST(b.ts_ns - a AS DOUBLE) / (z - a) * (y.used - x.used) END, 4) AS used
FROM b JOIN trend x ON x.log_id = b.log_id AND x.ts_ns = b.a LEFT JOIN trend y ON y.log_id = b.log_id AND y.ts_ns = b.z""",
)
def _(spark, sf):
    series = series_of(spark, sf)
    trends = lim.limit_trends(series, lim.limit_totals(series))
    shown = probes(spark, sf).join(trends.select("log_id").distinct(), "log_id", "left_semi")
    return lim.limit_at(trends, shown, DAY).select("log_id", "metric", "ts_ns", F.round("used", 4).alias("used"))


@query(
    "l11_limit_step_at",
    OBSERVED
    + _PROBE
    + """SELECT p.log_id, 'dmlRows' AS metric, p.ts_ns, s.ts_ns AS point_ns, s.used, s."limit"
FROM probe p LEFT JOIN series s ON s.log_id = p.log_id AND s.ts_ns = (
  SELECT max(t.ts_ns) FROM series t WHERE t.log_id = p.log_id AND t.ts_ns <= p.ts_ns)""",
)
def _(spark, sf):
    return lim.limit_step_at(series_of(spark, sf), probes(spark, sf), DAY)


_TIERS = """, m AS (SELECT * FROM (VALUES (0, 'soqlQueries'), (1, 'queryRows'), (2, 'soslQueries'), (3, 'dmlStatements'),
    (4, 'publishImmediateDml'), (5, 'dmlRows'), (6, 'cpuTime'), (7, 'heapSize'), (8, 'callouts'), (9, 'emailInvocations'),
    (10, 'futureCalls'), (11, 'queueableJobsAddedToQueue'), (12, 'mobileApexPushCalls')) v(pos, metric)),
pk AS (SELECT l.log_id, m.metric, m.pos, greatest(coalesce(max(CASE WHEN s.metric = m.metric THEN s.used / 10000.0 END), 0), 0) AS peak
  FROM (SELECT DISTINCT log_id FROM series) l CROSS JOIN m JOIN series s ON s.log_id = l.log_id GROUP BY ALL),
tiers AS (SELECT log_id, metric, peak, row_number() OVER (PARTITION BY log_id ORDER BY peak DESC, pos) AS rank FROM pk)
"""


@query(
    "l12_limit_tiers",
    OBSERVED
    + _TIERS
    + "SELECT log_id, metric, round(peak, 6) AS peak, rank, CASE WHEN rank <= 3 THEN 1 WHEN peak >= 0.8 THEN 2 ELSE 3 END AS tier FROM tiers",
)
def _(spark, sf):
    return lim.limit_tiers(series_of(spark, sf)).withColumn("peak", F.round("peak", 6))


@query(
    "l13_limit_points",
    TREE
    + """, o AS (SELECT log_id, ts_ns, unnest(['soqlQueries', 'soslQueries', 'dmlStatements']) AS metric, unnest([0, 2, 3]) AS pos, unnest([100, 20, 150]) AS "limit",
  unnest([soql_count_self, sosl_count_self, dml_count_self]) AS value FROM tree
  UNION ALL SELECT log_id, ts_ns, 'callouts', 8, 100, 1 FROM tree WHERE depth = 1 AND event_index % 3 = 0
  UNION ALL SELECT log_id, ts_ns, 'futureCalls', 10, 50, 1 FROM tree WHERE depth = 0),
d AS (SELECT log_id, metric, pos, "limit", ts_ns, CAST(sum(value) AS BIGINT) AS v FROM o WHERE value <> 0 GROUP BY ALL),
t AS (SELECT DISTINCT log_id, ts_ns FROM d), m AS (SELECT log_id, metric, pos, "limit", min(ts_ns) AS since FROM d GROUP BY ALL),
s AS (SELECT t.log_id, t.ts_ns, m.metric, m.pos, CAST(sum(coalesce(d.v, 0)) OVER (PARTITION BY t.log_id, m.metric ORDER BY t.ts_ns) AS BIGINT) / m."limit" AS share
  FROM t JOIN m ON m.log_id = t.log_id AND m.since <= t.ts_ns LEFT JOIN d ON d.log_id = t.log_id AND d.ts_ns = t.ts_ns AND d.metric = m.metric),
tier AS (SELECT log_id, metric, row_number() OVER (PARTITION BY log_id ORDER BY max(share) DESC, pos) AS rank, max(share) AS peak FROM s GROUP BY log_id, metric, pos)
SELECT s.log_id, s.ts_ns, round(max(share), 6) AS max_share, round(coalesce(max(CASE WHEN rank > 3 AND peak < 0.8 THEN share END), 0), 6) AS tier3_max
FROM s JOIN tier USING (log_id, metric) GROUP BY s.log_id, s.ts_ns""",
)
def _(spark, sf):
    # Statements lead, calls come second, and jobs, one per code unit, stay in the third tier.
    tree = order_tree(spark, sf)
    counts = lim.limit_observations(tree).filter(F.col("metric").isin("soqlQueries", "soslQueries", "dmlStatements"))
    extra = F.when((F.col("depth") == 1) & (F.col("event_index") % 3 == 0), "callouts").when(F.col("depth") == 0, "futureCalls")
    more = tree.select(
        "log_id", "event_index", "ts_ns", F.lit("default").alias("namespace"), extra.alias("metric"), F.lit("delta").alias("kind"),
        F.lit(1).cast("long").alias("value"), F.lit(1).alias("rank"),
    )
    series = cut(lim.limit_series(counts.unionByName(more.filter("metric is not null"))))
    points = lim.limit_points(series, lim.limit_tiers(series))
    return points.withColumns({c: F.round(c, 6) for c in ("max_share", "tier3_max")})


@query(
    "l14_limit_band",
    OBSERVED
    + """SELECT log_id, ts_ns, CASE WHEN used / 100.0 >= 100 THEN 'danger' WHEN used / 100.0 >= 80 THEN 'warn' ELSE 'safe' END AS band FROM series""",
)
def _(spark, sf):
    band = lim.limit_band(F.col("used") / F.col("limit") * 100)
    return series_of(spark, sf).select("log_id", "ts_ns", band.alias("band"))
