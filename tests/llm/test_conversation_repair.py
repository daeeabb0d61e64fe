"""Repairs against a search over all edits, any cutting into blocks, and exact outputs."""

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from spanforge.llm import conversation_repair as R
from spanforge.llm.queries import damaged

WANTED = re.compile(r"(s?(ua)+)?")


def classes(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, "b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t"))
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit, repaired) by a best-first search over edits, without the grammar's states."""
    kinds = classes(rows)
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in roles)
        if i == len(rows) and WANTED.fullmatch(initials):
            return cost, audit, [(r, rows[k][2] if k is not None else "") for r, k in roles]
        key = (i, initials[-1:], initials == "s")
        if not re.fullmatch(r"(s?(ua)*u?)?", initials) or key in seen:
            continue
        seen.add(key)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*roles, (role, None))))
        if i < len(rows):
            role, fault = kinds[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if fault not in "bd":
                more = 3 * (fault == "t")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*roles, (role, i))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*roles, (new, i))))


def messy(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "u", " "]
    texts = ["Yes.", "No!", "What", "", " \n", "Ends. ", "é?", " "]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"text {rng.random()}.") for _ in range(n)]


def test_cells_equal_search():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(k, *r) for k, r in enumerate(messy(rng, rng.choice([0, 1, 2, 3, 5, 9])))]
        got = R._solved(rows)
        cost, audit, repaired = cheapest(rows)
        assert (got["cost"], got["audit"]) == (cost, audit), rows
        assert [(t["role"], t["text"]) for t in got["repaired"]] == repaired


def test_all_splits_give_the_same_cell():
    rng = random.Random(2)
    for _ in range(100):
        cells = [R.TURN[rng.choice([*R.TURN])] for _ in range(6)]
        chart = {(i, i + 1): c for i, c in enumerate(cells)}
        for size in range(2, 7):
            for i in range(7 - size):
                every = {R.joined(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)}
                assert len(every) == 1
                chart[i, i + size] = every.pop()
        assert R.chart(cells)[-1][0] == chart[0, 6]


def table(spark, seed=3, long=900):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        turn = 0
        for role, text in messy(rng, rng.choice([1, 2, 4, 8, 30])):
            turn += rng.choice([1, 1, 1, 2, 40])
            rows.append((conv, turn, role, text))
    rows += [(77, k, *r) for k, r in enumerate(messy(rng, long))]  # one conversation with a third of all rows
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (80, None, "user", "Hm."), (80, 3, None, None), (81, 1, "user", None)]
    rows += [(82, 5, "user", "Twice.")] * 3
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, part int")


def want(rows, there=None):
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " "))
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        kinds = "".join(k for _, k in classes(mine))
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, repaired = cheapest(mine)
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[conv] = (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, sha)
    return out


@pytest.mark.parametrize("most", [2048, 7, 1])
def test_any_blocks(spark, most):
    rows, turns = table(spark)
    expected = want(rows)
    found = R.repair(turns.repartition(4), most=most)
    sha = {r.conv_id: r.repaired_sha256 for r in R.digests(found).collect()}
    got = {r.conv_id: (*tuple(r)[1:], sha[r.conv_id]) for r in found.conversations.collect()}
    assert got == expected
    edits = {}
    for t in found.turns().orderBy("block", "place").collect():
        edits[t.conv_id] = edits.get(t.conv_id, "") + t.edit
    assert edits == {c: a for c, r in expected.items() if (a := r[6].replace("D", ""))}


def test_no_rows_left(spark):
    turns = spark.createDataFrame([(1, 1, "user", "Hi."), (2, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    found = R.repair(turns, F.col("conv_id") == 1)
    sha = {r.conv_id: r.repaired_sha256 for r in R.digests(found).collect()}
    got = {r.conv_id: tuple(r)[1:] for r in found.conversations.collect()}
    assert got == {1: (0, 0, 0, 0, 0, 3, "KI"), 2: (0, 0, 0, 0, 0, 0, "")}
    assert sha[2] == hashlib.sha256(b"").hexdigest()
    empty = R.repair(turns.limit(0))
    assert empty.conversations.count() == 0 and R.digests(empty).count() == 0 and empty.turns().count() == 0


def test_damage(spark):
    import zlib

    rows, turns = table(spark, 4, 50)
    kind = lambda r: zlib.crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20
    expected = []
    for r in rows:
        k, role, text = kind(r), r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " "
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        expected += [(r[0], r[1], "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = [tuple(r)[:4] for r in damaged(turns).filter("there").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert {r.conv_id for r in damaged(turns).collect()} == {r[0] for r in rows}
