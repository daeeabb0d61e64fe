"""Cut tables: what is broadcast is measured in rows, not guessed from packed files; tables on the way go."""

import os

from pyspark.sql import functions as F

from spanforge.session import SMALL_FILE, SMALL_ROWS, cut, measured_broadcasts, scratch


def test_packed_files_are_not_broadcast_unmeasured(spark):
    n = 400_000
    spans = cut(spark.range(1, n + 1, 1, 4).select(F.lit("a").alias("log_id"), F.col("id").alias("event_index"), (F.col("id") % 7).alias("v")))
    joined = spans.join(spans.select("log_id", "event_index", F.col("v").alias("w")), ["log_id", "event_index"])
    size = int(str(spans._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size > SMALL_FILE
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert joined.filter("v = w").count() == n


def test_a_lower_threshold_of_the_caller_stays(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        for value in ("-1", "1000"):
            spark.conf.set(key, value)
            measured_broadcasts(spark)
            assert spark.conf.get(key) == value
    finally:
        spark.conf.set(key, before)


def test_only_small_measured_sides_are_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(k, None) for k in keys]
    try:
        spark.conf.set(keys[0], "10MB")
        spark.conf.unset(keys[1])
        measured_broadcasts(spark)
        assert spark.conf.get(keys[1]) == str(SMALL_ROWS)
        rows = cut(spark.range(0, 600_000, 1, 4).select(F.col("id").cast("string").alias("log_id"), F.col("id").alias("event_index")))
        # Both sides have an estimate of megabytes; the rows that are left are 100 here, and 100,000 (3 MB) there.
        for most, joins in ((100, True), (100_000, False)):
            some = rows.filter(F.pmod(F.hash("event_index"), F.lit(600_000)) < most)
            joined = rows.join(some, ["log_id", "event_index"])
            assert joined.count() == some.count()
            found = joined.groupBy().count()
            found.collect()
            assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]) == joins
        spark.conf.set(keys[0], "10MB")
        spark.conf.set(keys[1], "5MB")
        measured_broadcasts(spark)
        assert spark.conf.get(keys[1]) == "5MB"
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _there(df):
    return [os.path.exists(f.removeprefix("file://")) for f in df.inputFiles()]


def test_tables_on_the_way_go_and_results_stay(spark):
    with scratch(spark) as keep:
        with scratch(spark) as keep_inner:
            inner = cut(spark.range(5))
            passed_on = keep_inner(inner.filter("id > 1"))
        gone = [inner, passed_on]
        files = [f.removeprefix("file://") for df in gone for f in df.inputFiles()]
        assert not all(_there(inner)) and all(_there(passed_on))
        result = keep(passed_on.filter("id > 2"))
    assert not any(map(os.path.exists, files))
    assert sorted(r.id for r in result.collect()) == [3, 4]


def test_a_built_tree_leaves_one_table_and_a_parse_no_unread_fields(spark, parse):
    from spanforge.session import stage_dir

    before = set(os.listdir(stage_dir(spark).removeprefix("file://")))
    p = parse({"a": "10:00:00.0 (1)|METHOD_ENTRY|[1]|01p|Foo.bar()\n10:00:00.0 (2)|METHOD_EXIT|[1]|01p|Foo.bar()"})
    after = set(os.listdir(stage_dir(spark).removeprefix("file://"))) - before
    # The lines, the tagged lines, the events, the spans and the issues of the structure.
    assert len(after) == 5
    assert [r.text for r in p.spans.collect()] == ["Foo.bar()"]
    assert p.issues.count() == 0
