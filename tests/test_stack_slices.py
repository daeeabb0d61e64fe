"""The sliced stack must give what one pass over the whole log gives, however messy the log."""

import random

import pyarrow as pa
import pytest

from spanforge.operators import stack

TYPES = [
    ("METHOD_ENTRY", 6), ("METHOD_EXIT", 6), ("CODE_UNIT_STARTED", 2), ("CODE_UNIT_FINISHED", 2),
    ("USER_DEBUG", 4), ("EXCEPTION_THROWN", 1), ("WF_FORMULA", 2), ("WF_RULE_INVOCATION", 1),
    ("SOQL_EXECUTE_BEGIN", 2), ("SOQL_EXECUTE_END", 2), ("ENTERING_MANAGED_PKG", 1), ("FATAL_ERROR", 1),
]


OPENING = {"METHOD_ENTRY", "CODE_UNIT_STARTED", "WF_FORMULA", "WF_RULE_INVOCATION", "SOQL_EXECUTE_BEGIN", "ENTERING_MANAGED_PKG"}
TRUE_EXITS = {"METHOD_EXIT", "CODE_UNIT_FINISHED", "SOQL_EXECUTE_END"}


def random_log(seed, n, with_marker, steps=(0, 1, 1, 2, 5), back=0.0, thrown=1):
    rng = random.Random(seed)
    names = [t for t, w in TYPES for _ in range(w * (thrown if t in ("EXCEPTION_THROWN", "FATAL_ERROR") else 1))]
    rows, ts = [], 100
    marks = set()
    for i in range(1, n + 1):
        ts += rng.choice(steps) if rng.random() >= back else -rng.randint(0, 9)
        line = rng.choice([0, 0, 1, 2, 3, -1])
        rows.append((i, ts, rng.choice(names), line, rng.choice(["", "", "", "a", "b"])))
    if with_marker:
        marks = {rng.randrange(2, n) for _ in range(rng.choice([1, 2]))}
    return rows, marks


def sliced(rows, marks, size):
    """(slice, past, strict, floor) of every event, as spans._sliced numbers them; without size one exact slice."""
    if size is None:
        return [(0, False, False, None)] * len(rows)
    first = min(marks, default=None)
    out, top, own, low, begun = [], None, None, None, set()
    for i, ts, kind, _, _ in rows:
        plain, floor = i // size * 2, top
        late = first is not None and plain >= first // size * 2
        strict = late and (floor is None or ts > floor)
        if strict and i > first and kind not in TRUE_EXITS and plain not in begun:
            begun.add(plain)
            own, low = plain + 1, floor
        out.append((own if own is not None else plain, late and own is None and plain > first // size * 2, strict, low))
        top = ts if top is None else max(top, ts)
    return out


def batch_of(rows, types):
    columns = [*zip(*rows, strict=True)] if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[str(k) for k in range(len(types))])


def bins(ops, most):
    """{slice: group} as spans._groups deals them."""
    counts = {}
    for r in ops:
        counts[r["slice"]] = counts.get(r["slice"], 0) + 1
    before, found, group = 0, {}, {}
    for s in sorted(counts):
        found[s] = group.setdefault((s % 2, before // most), s)
        before += counts[s]
    return found


def run(rows, marks, size, most=10**9, tally=None):
    items = []
    for (i, ts, kind, line, ns), (number, past, strict, floor) in zip(rows, sliced(rows, marks, size), strict=True):
        items.append(("L", number, i, False, ts, kind, False, line, ns, past, strict, floor))
        if i in marks:
            items.append(("L", number, i, True, None, None, None, None, None, past, None, None))
    long, text, flag = pa.int64(), pa.string(), pa.bool_()
    batch = batch_of(items, [text, long, long, flag, long, text, flag, pa.int32(), text, flag, flag, long])
    levels = [[r for b in stack.run_slices(iter([batch])) for r in b.to_pylist()]]
    ops_of = lambda level: sorted((r for r in level if r["kind"] == "op"), key=lambda r: (r["slice"], r["seq"], r["variant"]))
    op_types = [long, long, text, long, stack.OP]
    keys = ["slice", "seq", "variant", "event_index", "op"]
    ops = ops_of(levels[0])
    while len(ops) > most:
        group = bins(ops, most)
        dealt = sorted((("L", group[r["slice"]], *[r[k] for k in keys]) for r in ops), key=lambda r: r[1:5])
        if tally is not None:
            tally.append(max(sum(r[1] == g for r in dealt) for g in {r[1] for r in dealt}))
        levels.append([r for b in stack.merge_groups(iter([batch_of(dealt, [text, long, *op_types])])) for r in b.to_pylist()])
        before, ops = len(ops), ops_of(levels[-1])
        if len(ops) > 0.9 * before:
            break
    if tally is not None:
        tally.append(len(ops))
    last = batch_of([("L", *[r[k] for k in keys]) for r in ops], [text, *op_types])
    levels.append([r for b in stack.replay(iter([last])) for r in b.to_pylist()])

    kinds = {i: kind for i, _, kind, _, _ in rows}
    anchors, choice, placed, closes, issues = {}, {}, {}, {}, []
    for level in reversed(levels):
        held = [r for r in level if r["kind"] != "op" and (not r["variant"] or choice[r["slice"]].startswith(r["variant"]))]
        upper = anchors
        anchors, choice = {}, {}
        for r in held:
            path, ns = upper.get((r["slice"], r["anchor"]), ([], None)) if r["anchor"] is not None else ([], None)
            path, ns = path + (r["path"] or []), r["ns"] or ns
            if r["kind"] == "anchor":
                anchors[r["inner"], r["inner_anchor"]] = path, ns
            elif r["kind"] == "choice":
                choice[r["inner"]] = max(choice.get(r["inner"], ""), r["chosen"])
            elif r["kind"] == "event":
                assert r["event_index"] not in placed
                placed[r["event_index"]] = path, ns or ("default" if path or kinds[r["event_index"]] in OPENING else "")
            elif r["kind"] == "close":
                assert r["event_index"] not in closes
                closes[r["event_index"]] = (r["ts"], r["closer"], r["last"], r["truncated"])
            else:
                issues.append((r["issue"], r["event_index"], r["ts"], -1 if r["closer"] is None else r["closer"]))
    return placed, closes, sorted(issues)


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("with_marker", [False, True])
def test_slices_equal_whole(seed, with_marker):
    rows, marks = random_log(seed, 90, with_marker)
    whole = run(rows, marks, None)
    for size in (3, 7, 25, 200):
        for most in (10**9, 20, 5):
            got = run(rows, marks, size, most)
            assert got[0] == whole[0]
            assert got[1] == whole[1]
            assert got[2] == whole[2]


@pytest.mark.parametrize("seed", range(50))
def test_cut_off_logs(seed):
    """Times that stand still or go back, many exceptions, early markers."""
    rows, marks = random_log(seed, 120, True, [(1, 2), (0, 1), (0, 0, 1)][seed % 3], 0.05 if seed % 2 else 0.0, 1 + seed % 4)
    whole = run(rows, marks, None)
    for size in (4, 11, 30):
        for most in (10**9, 25):
            got = run(rows, marks, size, most)
            assert got == whole


def calls(rng, n, ts=0):
    """A log of nested calls that return, with an exception now and then and some exits too many."""
    rows, depth = [], 0
    for i in range(1, n + 1):
        ts += rng.choice([1, 2, 5])
        kind = rng.choice(["METHOD_ENTRY", "METHOD_EXIT", "USER_DEBUG", "USER_DEBUG"])
        if depth > 8:
            kind = "METHOD_EXIT"
        if rng.random() < 0.002:
            kind = "EXCEPTION_THROWN"
        if rng.random() < 0.001:
            kind = "CODE_UNIT_FINISHED"
        if kind == "METHOD_EXIT" and not depth:
            kind = "USER_DEBUG"
        depth += (kind == "METHOD_ENTRY") - (kind == "METHOD_EXIT")
        rows.append((i, ts, kind, 0, ""))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_rows_of_a_task_are_bounded(seed):
    """50 slices behind a size marker: neither a group nor the replay gets more than a few times `most`."""
    size, most = 400, 60
    rows = calls(random.Random(seed), 51 * size)
    marks = {size // 2}
    tally = []
    got = run(rows, marks, size, most, tally)
    assert got == run(rows, marks, None)
    assert len(tally) > 1 and max(tally) < 3 * most
    quiet = [(i, 2 * i, "USER_DEBUG" if i != 150 else "METHOD_ENTRY", 0, "") for i in range(1, 50 * size)]
    quiet[160] = (161, 322, "EXCEPTION_THROWN", 0, "")  # unwinding from here to the end
    tally = []
    assert run(quiet, marks, size, most, tally) == run(quiet, marks, None) and max(tally) < 3 * most


def test_frames_closed_in_columns():
    """Closed frames are collected and columns read without a Python object per row beside the value."""
    for column in (pa.array([3, 1], pa.int64()), pa.array([True, False]), pa.array(["b", "a"]), pa.array([None, 2], pa.int32()),
                   pa.array([None, None], pa.string()), pa.array([["x"], []]), pa.array([], pa.string())):
        assert stack._values(column) == column.to_pylist()
    out = stack.Writer()
    machine = stack.FirstSlice(out, "log")
    entry = (1, 10, "METHOD_ENTRY", ["METHOD_EXIT"], 0, False, False, True, False, "", False)
    machine.step(entry)
    assert machine.step((2, 15, "METHOD_EXIT", [], 0, True, False, False, False, "", False))
    assert not out.rows
    rows = [r for b in out.drain(force=True) for r in b.to_pylist()]
    assert [r["kind"] for r in rows] == ["event", "close"]
    assert {k: v for k, v in rows[1].items() if v is not None} == {
        "log_id": "log", "slice": 0, "variant": "", "kind": "close", "event_index": 1, "ts": 15, "closer": 2, "last": 1, "truncated": False,
    }
