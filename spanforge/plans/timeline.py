"""Timeline queries over the order tree and the user traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import issues as iss
from spanforge.operators import timeline as tl
from spanforge.plans.logs import _HOSTED, user_parsed
from spanforge.plans.registry import TRACE, TREE, query
from spanforge.sources.tables import order_tree, user_traces

# A frame of the tree has time, and so have all frames above it or it would not count.
FRAMES = (
    TREE
    + """, timed AS (SELECT *, ts_ns + dur_total AS exit_ns FROM tree WHERE dur_total > 0),
fr AS (SELECT log_id, event_index, parent_index, depth, category, ts_ns AS start_ns, exit_ns AS end_ns,
  dur_self AS self_ns, dur_total AS total_ns FROM timed WHERE category <> '')
"""
)
N = 50


@query("x1_frames", FRAMES + "SELECT * EXCLUDE (parent_index) FROM fr")
def _(spark, sf):
    return tl.frames(order_tree(spark, sf)).drop("parent_index", "last_index")


@query(
    "x2_frame_stats",
    FRAMES + "SELECT log_id, max(depth) AS max_depth, max(exit_ns) AS total_ns FROM timed GROUP BY log_id",
)
def _(spark, sf):
    return tl.frame_stats(order_tree(spark, sf))


_PRIO = "CASE category WHEN 'DML' THEN 0 WHEN 'SOQL' THEN 1 WHEN 'Callout' THEN 2 WHEN 'Apex' THEN 3 WHEN 'Code Unit' THEN 4 ELSE 5 END"


@query(
    "x3_bucket_frames",
    FRAMES
    + f""", c AS (SELECT log_id, depth, start_ns // 1000000 AS bucket, category, count(*) AS n, sum(total_ns) AS t FROM fr WHERE total_ns <= 1000000 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY log_id, depth, bucket ORDER BY {_PRIO}, t DESC, n DESC) AS rn FROM c)
SELECT log_id, depth, bucket, CAST(sum(n) AS BIGINT) AS events, CAST(sum(t) AS BIGINT) AS time_ns,
  max(CASE WHEN rn = 1 THEN category END) AS dominant FROM r GROUP BY ALL""",
)
def _(spark, sf):
    return tl.bucket_frames(tl.frames(order_tree(spark, sf)), 1_000_000)


@query(
    "x3_bucket_categories",
    FRAMES
    + """SELECT log_id, depth, start_ns // 1000000 AS bucket, category, count(*) AS events, CAST(sum(total_ns) AS BIGINT) AS time_ns
FROM fr WHERE total_ns <= 1000000 GROUP BY ALL""",
)
def _(spark, sf):
    return tl.bucket_categories(tl.frames(order_tree(spark, sf)), 1_000_000)


@query("x3_wide_frames", FRAMES + "SELECT log_id, event_index, depth, category FROM fr WHERE total_ns > 1000000")
def _(spark, sf):
    frames = tl.frames(order_tree(spark, sf))
    return tl.wide_frames(frames, 1_000_000).select("log_id", "event_index", "depth", "category")


@query(
    "x4_frames_in_region",
    FRAMES + "SELECT log_id, event_index FROM fr WHERE end_ns > 5000000 AND start_ns < 90000000 AND depth BETWEEN 1 AND 2",
)
def _(spark, sf):
    frames = tl.frames(order_tree(spark, sf))
    return tl.frames_in(frames, 5_000_000, 90_000_000, 1, 2).select("log_id", "event_index")


_SPREAD = f""", w AS (SELECT log_id, CAST(max(end_ns) AS DOUBLE) / {N} AS width FROM fr GROUP BY log_id),
sp AS (SELECT f.*, width, unnest(range(CAST(greatest(0, floor(start_ns / width)) AS BIGINT),
    CAST(least({N - 1}, floor(end_ns / width)) AS BIGINT) + 1)) AS bucket FROM fr f JOIN w USING (log_id)),
ov AS (SELECT *, greatest(least(CAST(end_ns AS DOUBLE), (bucket + 1) * width) - greatest(CAST(start_ns AS DOUBLE), bucket * width), 0) AS overlap FROM sp)
"""

_EVERY = f", every AS (SELECT log_id, unnest(range({N})) AS bucket FROM (SELECT DISTINCT log_id FROM fr)) "


@query(
    "x5_density",
    FRAMES
    + _SPREAD
    + _EVERY
    + """SELECT log_id, bucket, coalesce(max(depth), 0) AS max_depth, count(depth) AS events,
  coalesce(round(sum(self_ns * (overlap / (end_ns - start_ns))), 2), 0.0) AS self_ns
FROM every LEFT JOIN ov USING (log_id, bucket) GROUP BY ALL""",
)
def _(spark, sf):
    return tl.density(tl.frames(order_tree(spark, sf)), N).withColumn("self_ns", F.round("self_ns", 2))


@query(
    "x6_skyline",
    FRAMES
    + _SPREAD
    + """, child AS (SELECT log_id, bucket, parent_index AS event_index, sum(overlap) AS inner_t FROM ov GROUP BY ALL),
top AS (SELECT o.log_id, o.bucket, o.category, sum(o.overlap - coalesce(c.inner_t, 0)) AS t FROM ov o
  LEFT JOIN child c USING (log_id, bucket, event_index) GROUP BY ALL),
sc AS (SELECT *, round(t * CASE category WHEN 'DML' THEN 2.5 WHEN 'SOQL' THEN 2.5 ELSE 1 END, 3) AS score FROM top),
seen AS (SELECT log_id, bucket, category FROM sc
QUALIFY row_number() OVER (PARTITION BY log_id, bucket ORDER BY score DESC) = 1)
"""
    + _EVERY
    + "SELECT log_id, bucket, coalesce(category, 'Apex') AS category FROM every LEFT JOIN seen USING (log_id, bucket)",
)
def _(spark, sf):
    return tl.skyline(tl.frames(order_tree(spark, sf)), N)


@query(
    "x7_event_at",
    TREE
    + """, probe AS (SELECT DISTINCT log_id, ts_ns + 7 AS t FROM tree WHERE depth = 2),
last_begun AS (SELECT p.log_id, p.t, max(e.event_index) AS near FROM probe p JOIN tree e ON e.log_id = p.log_id AND e.ts_ns <= p.t GROUP BY ALL),
line AS (SELECT l.log_id, l.t, n.event_index AS a, n.nk, n.ck, n.ok, n.depth AS d FROM last_begun l JOIN tree n ON n.log_id = l.log_id AND n.event_index = l.near),
cand AS (SELECT l.log_id, l.t, e.event_index, e.depth, e.ts_ns = l.t AS exact FROM line l JOIN tree e ON e.log_id = l.log_id
    AND (e.event_index = l.a OR (e.depth = 0 AND e.nk = l.nk AND l.d > 0) OR (e.depth = 1 AND e.ck = l.ck AND l.d > 1) OR (e.depth = 2 AND e.ok = l.ok AND l.d > 2))
  WHERE e.ts_ns <= l.t AND e.ts_ns + e.dur_total >= l.t)
SELECT log_id, t, event_index, depth FROM cand
QUALIFY row_number() OVER (PARTITION BY log_id, t ORDER BY exact DESC, CASE WHEN exact THEN depth ELSE -depth END) = 1""",
)
def _(spark, sf):
    spans = order_tree(spark, sf)
    probes = spans.filter(F.col("depth") == 2).select("log_id", (F.col("ts_ns") + 7).alias("t"))
    return tl.event_at(spans, probes, slice_ns=50_000_000)


@query(
    "x8_markers",
    _HOSTED
    + """, e AS (SELECT log_id, idx, type, cents, ts_ns FROM ev WHERE is_event),
last AS (SELECT log_id, max(ts_ns) AS last_ts FROM e GROUP BY log_id),
skips AS (SELECT log_id, min(idx) AS host FROM ev WHERE type = 'view' AND cents % 2 = 0 AND idx > 0 AND NOT is_text GROUP BY log_id)
SELECT log_id, idx AS event_index, 'exception' AS kind, ts_ns AS start_ns, 3 AS severity, 0 AS width_ns FROM e WHERE type = 'error'
UNION ALL SELECT e.log_id, max(idx), 'unexpected', any_value(last_ts), 2, 0 FROM e JOIN last USING (log_id) WHERE type = 'signup' GROUP BY e.log_id
UNION ALL SELECT s.log_id, s.host, 'skip', h.ts_ns, 1, coalesce((SELECT min(n.ts_ns) FROM e n WHERE n.log_id = s.log_id
    AND n.type = 'signup' AND n.idx > s.host), l.last_ts) - h.ts_ns
  FROM skips s JOIN e h ON h.log_id = s.log_id AND h.idx = s.host JOIN last l ON l.log_id = s.log_id""",
)
def _(spark, sf):
    p = user_parsed(spark, sf)
    return tl.markers(p.issues, iss.exceptions(p.events)).drop("summary", "end_ns")


@query(
    "x9_search",
    TREE + "SELECT log_id, event_index FROM tree WHERE contains(lower(text), 'order_1') OR contains(lower(type), 'order_1')",
)
def _(spark, sf):
    return tl.search(order_tree(spark, sf), "ORDER_1").select("log_id", "event_index")


@query("x9_search_match_case", TRACE + "SELECT log_id, event_index FROM trace WHERE contains(text, 'sign')")
def _(spark, sf):
    return tl.search(user_traces(spark, sf), "sign", match_case=True).select("log_id", "event_index")
