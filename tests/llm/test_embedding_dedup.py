"""Links against brute force: recall, none wrong, and every kind of odd row."""

import math

import numpy as np

from spanforge.llm import embedding_dedup as E


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, node int, v string")


def brute(rows, least=0.98):
    good = [v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    links, part = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                part[root(i)] = root(j)
    least_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least_id[root(i)] = min(least_id.get(root(i), r[0]), r[0])
    return links, [least_id.get(root(i)) if good[i] else rows[i][0] for i in range(len(rows))]


def test_recall_and_no_wrong_links(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(700):
        v = rng.standard_normal(16)
        if rows and rng.random() < 0.5:
            v = np.array(rows[int(rng.integers(len(rows)))][1]) + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.1, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    got = {r.vec_id: r for r in E.near_duplicates(table(spark, rows).repartition(3), leaf=30).collect()}
    links, comps = brute(rows)
    found = [got[i].n_links for i in range(700)]
    assert all(a <= b for a, b in zip(found, links, strict=True))
    assert sum(found) >= 0.97 * sum(links) > 100
    assert sum(got[i].component_id == c for i, c in enumerate(comps)) >= 690
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_one_large_cluster_and_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, [float(np.float32(x)) for x in base + rng.standard_normal(8) * 0.01], 1) for i in range(150)]
    rows += [(200 + i, rows[0][1], 1) for i in range(100)]
    got = {r.vec_id: r for r in E.near_duplicates(table(spark, rows), leaf=20).collect()}
    links, _ = brute(rows)
    assert {r.component_id for r in got.values()} == {0}
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(links)
    assert all(got[i].n_links <= n for (i, *_), n in zip(rows, links, strict=True))


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
        (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (None, [1.0, 0.01], 1), (1, [1.0, 0.0], 1), (12, [0.0, 1.0], 2), (13, [1.0, 0.0], 2),
    ]
    got = sorted(((str(r.vec_id), r.n_links, r.component_id) for r in E.near_duplicates(table(spark, rows)).collect()), key=str)
    links, comps = brute(rows)
    assert got == sorted(((str(i), n, c) for (i, *_), n, c in zip(rows, links, comps, strict=True)), key=str)


def test_empty_table(spark):
    assert E.near_duplicates(table(spark, [])).count() == 0
    assert E.near_duplicates(table(spark, [(1, None, None)])).count() == 1
