"""The content sort against a brute-force grouping, whatever the slicing."""

import hashlib
import re

import pytest

from spanforge.llm import content_sort


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", text or ""), []).append((i, text or ""))
    out = []
    for norm, group in groups.items():
        keep = min(group, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep[0], len(group), sha) for i, _ in group]
    return sorted(out, key=str)


def found(docs, **how):
    got = content_sort.copies(docs, **how).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str), got


@pytest.mark.parametrize("rows", [256, 2, 1])
def test_groups_equal_brute_force(spark, docs, corpus, rows):
    want = brute([(i, t) for i, t, _ in corpus])
    got, raw = found(docs, rows=rows)
    assert got == want
    by = {}
    for r in raw:
        by.setdefault(r.text_sha256, []).append(r)
    for group in by.values():  # exactly one row of each group stays, with the group's id
        assert [r.doc_id for r in group if r.kept] == [group[0].keep_id]


def test_hot_text_is_sliced(spark):
    texts = [("same  text" if i % 9 == 4 else "same text") if i % 3 else f"text {i % 50}" for i in range(3000)]
    rows = [(i % 2900, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, raw = found(docs, rows=64, size=1000)
    assert got == brute(rows)
    assert sum(r.kept for r in raw) == len({r.text_sha256 for r in raw})


def test_equal_rows_keep_one(spark):
    docs = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "ab"), (5, "a\tb")] * 40 + [(None, None), (None, ""), (1, " \n")], "doc_id long, text string")
    for rows in (1, 256):
        raw = content_sort.copies(docs, rows=rows).collect()
        assert [(r.keep_id, r.group_size) for r in raw if r.kept and r.group_size > 3] == [(5, 160)]
        assert [(r.doc_id, r.group_size) for r in raw if r.kept and r.group_size < 4] == [(1, 3)]


def test_without_copies_keeps_columns(spark, docs, corpus, none):
    named = docs.withColumnsRenamed({"key": "own", "node": "id"})
    left = content_sort.without_copies(named)
    assert left.columns == named.columns
    assert left.count() == len({re.sub(r"\s", "", t or "") for _, t, _ in corpus})
    assert content_sort.copies(none).count() == 0 and content_sort.without_copies(none).count() == 0


def test_plan_has_no_python(spark, docs):
    plan = content_sort.copies(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
