"""Conversations repaired at least cost, by interval parsing bottom-up over spans of turns.

The repaired roles must read `(s?(ua)+)?`. The grammar in Chomsky normal form has a symbol for each pair of
states (p, q) of that pattern: `[p q] -> [p r] [r q]`, and `[p q]` becomes a turn kept, given another role or
deleted, with insertions on either side (the closure of the rules that span no turn). A cell holds for each symbol
the least (cost, audit) of its span, the audit being the initials of the edits. All splits of a span give the
same cell, because a symbol names the states at both its ends, so the chart needs spans of 1, 2, 4, ...
turns only. Of one span, audits of equal cost are never prefixes of each other (a longer one has more
insertions, which cost), so the least parts make the least whole.

Rows are dealt out by sampled ranges of conversation and turn and sorted there. A conversation that lies inside one
range and has few turns is finished there and then. Others come out in blocks of bounded size; blocks get
their cells in parallel, the cells of a conversation are combined (an audit is one character a turn), and
every block then applies its own part of the audit. No task holds the texts of a long conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.stage import cut

TURNS = 2048  # of a block
CHARS = 4 << 20
SPACES = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # initials that may follow
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
PAIRS = [(p, q) for p in range(4) for q in range(4) if q != START or p == START if q != SYSTEM or p in (START, SYSTEM)]
AT = {pair: i for i, pair in enumerate(PAIRS)}
SPLITS = [[(AT[p, r], AT[r, q]) for r in range(4) if (p, r) in AT and (r, q) in AT] for p, q in PAIRS]
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
Cell = tuple  # for each of PAIRS (cost, audit), or None


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for splits in SPLITS:
        best = None
        for i, j in splits:
            a, b = left[i], right[j]
            if a and b:
                made = (a[0] + b[0], a[1] + b[1])
                if best is None or made < best:
                    best = made
        out.append(best)
    return tuple(out)


def _closure() -> Cell:
    """No turn at all: insertions of users and assistants."""
    step = [None] * len(PAIRS)
    for p in range(4):
        step[AT[p, p]] = (0, "")
        for initial in AFTER[p].replace("s", ""):
            step[AT[p, STATE[initial]]] = (INSERT, "I")
    cell = tuple(step)
    while (longer := joined(cell, tuple(step))) != cell:
        cell = longer
    return cell


NONE = _closure()


def _turn(initial: str, fault: str) -> Cell:
    """The cell of one turn; fault: "-", or t for truncated, x for one that has to go."""
    cell = [None] * len(PAIRS)
    extra = TRUNCATED * (fault == "t")
    for p, q in PAIRS:
        edits = [(DELETE, "D")] * (p == q)
        if fault != "x":
            edits += [(KEEP + extra, "K") for x in AFTER[p] if x == initial and STATE[x] == q]
            edits += [(REROLE + extra, "R") for x in AFTER[p] if x != "s" and STATE[x] == q]
        cell[AT[p, q]] = min(edits, default=None)
    return joined(joined(NONE, tuple(cell)), NONE)


TURN = {i + f: _turn(i, f) for i in "sua-" for f in "-tx"}


def chart(cells: list[Cell]) -> list[list[Cell]]:
    """Cells of spans of 1, 2, 4, ... neighbours, the last of all."""
    levels = [cells or [NONE]]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([joined(*low[i : i + 2]) if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    return levels


def cheapest(cell: Cell) -> tuple[tuple[int, str], int]:
    """(cost, audit) of a whole conversation, and the state it ends in."""
    return min((cell[AT[START, q]], q) for q in (START, ASSISTANT) if cell[AT[START, q]])


def states(levels: list[list[Cell]]) -> list[tuple[int, int]]:
    """The states at the ends of each span of the lowest level, in the cheapest parse; top-down."""
    ends = [(START, cheapest(levels[-1][0])[1])]
    for k in range(len(levels) - 1, 0, -1):
        low, lower = levels[k - 1], []
        for i, (p, q) in enumerate(ends):
            if 2 * i + 1 == len(low):
                lower.append((p, q))
                continue
            a, b = low[2 * i], low[2 * i + 1]
            whole = levels[k][i][AT[p, q]]
            r = next(
                r for r in range(4)
                if (p, r) in AT and (r, q) in AT and (x := a[AT[p, r]]) and (y := b[AT[r, q]]) and (x[0] + y[0], x[1] + y[1]) == whole
            )
            lower += [(p, r), (r, q)]
        ends = lower
    return ends


def faults(rows: list[tuple], first: list[bool]) -> str:
    """For each (turn, role, text) b blank, d seen before, t truncated or -."""
    out = []
    for (_, _, text), new in zip(rows, first, strict=True):
        body = text.rstrip(SPACES)
        out.append("b" if not body else "d" if not new else "t" if body[-1] not in ".!?" else "-")
    return "".join(out)


def first_seen(rows: list[tuple]) -> list[bool]:
    seen: set[tuple[str, str]] = set()
    out = []
    for _, role, text in rows:
        out.append((role, text) not in seen)
        seen.add((role, text))
    return out


def leaves(rows: list[tuple], marks: str) -> list[Cell]:
    return [TURN[(role[:1] if role[:1] in ("s", "u", "a") else "-") + ("x" if mark in "bd" else mark)] for (_, role, _), mark in zip(rows, marks, strict=True)]


def applied(rows: list[tuple], audit: str, state: int = START) -> list[dict]:
    """The repaired turns of an audit that begins in `state`."""
    out, left = [], iter(rows)
    for edit in audit:
        turn, role, text = next(left) if edit != "I" else (None, "", "")
        if edit == "D":
            continue
        if edit in "IR":
            role = "assistant" if state == USER else "user"
        state = STATE[role[0]]
        out.append({"turn": turn, "role": role, "text": text, "edit": edit})
    return out


def figures(rows: list[tuple], marks: str) -> dict:
    """Counts over consecutive turns; those of neighbouring spans are put together by `merged`."""
    initials = [role[:1] for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "blank": marks.count("b"), "duplicate": marks.count("d"), "truncated": marks.count("t"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "head": initials[0] if rows else None, "tail": initials[-1] if rows else None,
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len({*turns}),
    }


def merged(parts: list[dict]) -> dict:
    """The counts of a conversation from those of its blocks in order."""
    total = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    ends = [p for p in parts if p["head"] is not None]
    total["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(ends, ends[1:], strict=False))
    numbered = [p for p in parts if p["turns"]]
    shared = sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:], strict=False))
    total["gaps"] = numbered[-1]["high"] - numbered[0]["low"] + 1 - sum(p["turns"] for p in numbered) + shared if numbered else 0
    return total


FIGURES = "blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROW = "turn: long, role: string, text: string"
REPAIRED = "array<struct<turn: long, role: string, text: string, edit: string>>"
RUNS = f"conv_id long, block long, whole boolean, rows array<struct<{ROW}>>, {RESULT}, repaired {REPAIRED}"
_RUN_KEYS = [c.split()[0] for c in RESULT.split(", ")]


def _solved(rows: list[tuple]) -> dict:
    marks = faults(rows, first_seen(rows))
    (cost, audit), _ = cheapest(chart(leaves(rows, marks))[-1][0])
    return merged([figures(rows, marks)]) | {"cost": cost, "audit": audit, "repaired": applied(rows, audit)}


def _runs(most: int, chars: int):
    """Of sorted rows (conv_id, turn, role, text, there): whole conversations with their result, and blocks of others."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv_id, rows, whether the conversation surely begins here, whether it ends here)"""
        key, rows, size, begun, fresh = None, [], 0, False, False
        for batch in batches:
            for conv, turn, role, text, there in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there")), strict=True):
                if begun and conv != key:
                    yield key, rows, fresh, True
                    rows, size, fresh = [], 0, True
                elif len(rows) >= most or size >= chars:
                    yield key, rows, False, False
                    rows, size, fresh = [], 0, False
                key, begun = conv, True
                if there:
                    rows.append((turn, role, text))
                    size += len(text)
        if begun:
            yield key, rows, False, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("conv_id", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("rows", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))]
            + [(k, pa.string() if k == "audit" else pa.int64()) for k in _RUN_KEYS]
            + [("repaired", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])))]
        )
        part, out, size = TaskContext.get().partitionId(), [], 0
        for k, (key, rows, begins, ends) in enumerate(blocks(batches)):
            row = {"conv_id": key, "block": (part << 32) + k, "whole": begins and ends}
            row |= _solved(rows) if begins and ends else {"rows": [dict(zip(("turn", "role", "text"), r, strict=True)) for r in rows]}
            out.append(row)
            size += sum(len(r[2]) for r in rows) + 100
            if size >= chars:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _tuples(rows) -> list[tuple]:
    return [(r["turn"], r["role"], r["text"]) for r in rows]


def _block_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            b = batch.slice(i, 1).to_pylist()[0]
            rows, new = _tuples(b["rows"]), {*(b["new"] or [])}
            marks = faults(rows, [k in new for k in range(len(rows))])
            cell = chart(leaves(rows, marks))[-1][0]
            row = {"conv_id": b["conv_id"], "block": b["block"], "costs": [x and x[0] for x in cell], "audits": [x and x[1] for x in cell]} | figures(rows, marks)
            yield pa.RecordBatch.from_pylist([row], pa.schema(_CELL_SCHEMA))


_CELL_SCHEMA = [("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))] + [
    (c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in FIGURES.split(", ")
]
PARTS = f"conv_id long, block long, last boolean, state long, part string, {RESULT}"


def _chained(table: pa.Table) -> pa.Table:
    """The blocks of one conversation: the state each begins in and its part of the audit; the result with the last one."""
    parts = sorted(table.to_pylist(), key=lambda b: b["block"])
    cells = [tuple((c, a) if a is not None else None for c, a in zip(b["costs"], b["audits"], strict=True)) for b in parts]
    levels = chart(cells)
    (cost, audit), _ = cheapest(levels[-1][0])
    total = merged(parts) | {"cost": cost, "audit": audit}
    rows = []
    for k, (b, cell, (p, q)) in enumerate(zip(parts, cells, states(levels), strict=True)):
        last = k + 1 == len(parts)
        rows.append({"conv_id": b["conv_id"], "block": b["block"], "last": last, "state": p, "part": cell[AT[p, q]][1]} | (total if last else {}))
    types = {"last": pa.bool_(), "part": pa.string(), "audit": pa.string()}
    return pa.Table.from_pylist(rows, pa.schema([(c.split()[0], types.get(c.split()[0], pa.int64())) for c in PARTS.split(", ")]))


def _apply(rows: pa.Array, part: pa.Array, state: pa.Array) -> pa.Array:
    out = [applied(_tuples(r.as_py()), a.as_py(), s.as_py()) for r, a, s in zip(rows, part, state, strict=True)]
    return pa.array(out, pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])))


class Repair(NamedTuple):
    """conversations: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, blocks), a row each.

    blocks: (conv_id, block, single, repaired), repaired turns (turn, role, text, edit) in the order of `block`;
    turn is null where one was inserted.
    """

    conversations: DataFrame
    blocks: DataFrame

    def turns(self) -> DataFrame:
        """(conv_id, block, place, turn, role, text, edit): the repaired turns."""
        return self.blocks.select("conv_id", "block", F.posexplode("repaired").alias("place", "t")).select("conv_id", "block", "place", "t.*")


def repair(turns: DataFrame, there: Column | None = None, most: int = TURNS, chars: int = CHARS) -> Repair:
    """Repair all conversations of `turns` (conv_id, turn, role, text); see `Repair` for what is returned.

    A conversation's rows are taken by turn, null turns first; rows of one turn by a hash of role and text.
    Null roles and texts count as one space, a null conv_id is a conversation of its own. Rows repeated as a
    whole are duplicates of the first. Rows where `there` is false only name their conversation; one without
    other rows has zeros and an empty audit. Empty roles and those beginning with other letters than s, u and a are never
    kept. Other columns are not read. An empty table gives no rows. Blocks end after `most` turns or `chars`
    characters (a longer turn stands alone).
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    source = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (F.lit(True) if there is None else F.coalesce(there, F.lit(False))).alias("there"),
    )
    source = source.withColumns({"tie": F.xxhash64("role", "text"), "spread": F.xxhash64(F.monotonically_increasing_id())})
    order = ["conv_id", "turn", "tie", "spread"]  # equal rows may stand on both sides of a splitter
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "spread")
    runs = cut(dealt.mapInArrow(_runs(most, chars), RUNS))

    whole, opened = runs.filter("whole"), runs.filter("not whole")
    keys = opened.select("conv_id", "block", F.posexplode("rows").alias("at", "r"))
    firsts = keys.groupBy("conv_id", F.col("r.role").alias("role"), F.sha2(F.col("r.text"), 256).alias("sha")).agg(F.min(F.struct("block", "at")).alias("b"))
    firsts = firsts.groupBy(F.col("b.block").alias("block")).agg(F.collect_list("b.at").alias("new"))  # block numbers are unique
    cells = opened.select("conv_id", "block", "rows").join(firsts, "block", "left").select("conv_id", "block", "rows", "new")
    cells = cells.mapInArrow(_block_cells, f"conv_id long, block long, costs array<long>, audits array<string>, {FIGURES}")
    parts = cut(cells.groupBy("conv_id").applyInArrow(_chained, PARTS))

    columns = ["conv_id", *_RUN_KEYS]
    conversations = whole.select(*columns).unionByName(parts.filter("last").select(*columns))
    of_blocks = opened.select("block", "rows").join(parts.select("conv_id", "block", "state", "part"), "block")
    of_blocks = of_blocks.select("conv_id", "block", F.lit(False).alias("single"), F.arrow_udf(_apply, REPAIRED)("rows", "part", "state").alias("repaired"))
    return Repair(conversations, whole.select("conv_id", "block", F.lit(True).alias("single"), "repaired").unionByName(of_blocks))


def digests(repaired: Repair) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired `role:text`, joined by line ends.

    A digest runs through a conversation from its first to its last byte; texts in several blocks pass
    through a task in order, one block at a time.
    """
    line = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    lines = repaired.blocks.select("conv_id", "block", "single", F.when(F.size("repaired") > 0, F.array_join(line, "\n")).alias("body"))
    one = lines.filter("single").select("conv_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("repaired_sha256"))
    many = lines.filter("not single").select("conv_id", "block", "body").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return one.unionByName(many.mapInArrow(_hashed, one.schema))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    def row(key, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([key], pa.int64()), "repaired_sha256": [digest.hexdigest()]})

    key, digest, begun, some = None, None, False, False
    for batch in batches:
        for conv, body in zip(batch.column("conv_id"), batch.column("body"), strict=True):
            conv, body = conv.as_py(), body.as_py()
            if not begun or conv != key:
                if begun:
                    yield row(key, digest)
                key, digest, begun, some = conv, hashlib.sha256(), True, False
            if body is not None:
                digest.update((("\n" if some else "") + body).encode())
                some = True
    if begun:
        yield row(key, digest)
