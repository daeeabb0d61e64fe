"""Pairing entries with exits, in parallel over slices of a log.

Spans nest, so pairing needs a stack that is read in log order. A whole log may not fit a task,
so it works on slices of at most `CHUNK` events, and on groups of slices, level by level:

1. Each slice runs on its own, from an empty stack. An exit that matches a frame opened in the
   slice is settled there, whatever came before, because the search goes from the top down. Only
   what depends on earlier slices is left over: exits with no match in the slice, frames still
   open when one of those comes or when the slice ends, and the first event that could end a
   frame waiting for "the next line". For code that returns normally that is about the depth of
   the stack per slice. The first slice of a log starts from a known empty stack and leaves only
   its open frames.
2. What slices leave over is again something to run on an unknown stack. While a log has more of it
   than a task should get, neighbouring slices are grouped and each group settles what it can; it leaves over what
   depends on earlier groups (`merge_groups`).
3. The last left-over operations of a log are replayed in order on the real stack. Every event of the
   slices then gets its outer path from the operation before it (its anchor), anchors of lower
   levels from those of the level above.

After a size marker truncation depends on time and on whether an exception is being unwound. There
slices begin at an event later than all before it that is no exit. Such a slice has two outcomes:
while unwinding its first event cuts off all that is open, so it begins with an empty stack (variant T); else
nothing is cut off before the next exception, which then cuts off everything (F). If that exception meets
nothing open in the slice, it matters whether anything is open below (FN) or not (FE). All variants are settled
in the slice; the replay says which one holds, and only its rows are read on.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import pyarrow as pa

from spanforge.functions import event_types

OP = pa.struct(
    [
        ("op", pa.string()),
        ("ts", pa.int64()),
        ("type", pa.string()),
        ("ends", pa.list_(pa.string())),
        ("line", pa.int32()),
        ("is_exit", pa.bool_()),
        ("next", pa.bool_()),
        ("parent", pa.bool_()),
        ("unwinds", pa.bool_()),
        ("ns", pa.string()),
        ("flag", pa.string()),
        ("sure", pa.int64()),
        ("maybe", pa.int64()),
        ("marker", pa.int64()),
        ("strict", pa.bool_()),
    ]
)
OUT = pa.schema(
    [
        ("log_id", pa.string()),
        ("slice", pa.int64()),
        ("variant", pa.string()),
        ("kind", pa.string()),
        ("seq", pa.int64()),
        ("event_index", pa.int64()),
        ("anchor", pa.int64()),
        ("path", pa.list_(pa.int64())),
        ("ns", pa.string()),
        ("ts", pa.int64()),
        ("closer", pa.int64()),
        ("last", pa.int64()),
        ("truncated", pa.bool_()),
        ("issue", pa.string()),
        ("inner", pa.int64()),
        ("inner_anchor", pa.int64()),
        ("chosen", pa.string()),
        ("op", OP),
    ]
)
OUT_DDL = (
    "log_id string, slice long, variant string, kind string, seq long, event_index long, anchor long, "
    "path array<long>, ns string, ts long, closer long, last long, truncated boolean, issue string, "
    "inner long, inner_anchor long, chosen string, "
    "op struct<op:string,ts:long,type:string,ends:array<string>,line:int,is_exit:boolean,"
    "next:boolean,parent:boolean,unwinds:boolean,ns:string,flag:string,sure:long,maybe:long,marker:long,strict:boolean>"
)
EMIT_ROWS = 20_000
_EVENT_COLUMNS = ["log_id", "slice", "variant", "event_index", "anchor", "path", "ns"]
_CLOSE_COLUMNS = ["log_id", "slice", "variant", "event_index", "ts", "closer", "last", "truncated"]

# Frame and event fields, as tuples for speed:
# event: (index, ts, type, ends, line, is_exit, next, parent, unwinds, ns, later than all before)
IDX, TS, TYPE, ENDS, LINE, IS_EXIT, NEXT, PARENT, UNWINDS, NS, STRICT = range(11)
NOTHING = (0, 0, "", [], 0, False, False, False, False, "", False)


class Writer:
    """Collects output rows and turns them into Arrow batches, placed events and closed frames column by column."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.events: list[tuple] = []
        self.closes: list[tuple] = []

    def add(self, **row) -> None:
        self.rows.append(row)

    def event(self, *values) -> None:
        self.events.append(values)

    def closed(self, *values) -> None:
        self.closes.append(values)

    def full(self) -> bool:
        return len(self.events) >= EMIT_ROWS or len(self.closes) >= EMIT_ROWS or len(self.rows) >= EMIT_ROWS

    def drain(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if force or len(self.events) >= EMIT_ROWS:
            held, self.events = self.events, []
            yield from _batch("event", _EVENT_COLUMNS, held)
        if force or len(self.closes) >= EMIT_ROWS:
            held, self.closes = self.closes, []
            yield from _batch("close", _CLOSE_COLUMNS, held)
        if self.rows and (force or len(self.rows) >= EMIT_ROWS):
            columns = [pa.array([r.get(f.name) for r in self.rows], f.type) for f in OUT]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, schema=OUT)


def _batch(kind: str, names: list[str], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of one kind that have the columns `names` and no others."""
    if rows:
        given = dict(zip(names, zip(*rows, strict=True), strict=True)) | {"kind": [kind] * len(rows)}
        columns = [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(rows), f.type) for f in OUT]
        yield pa.RecordBatch.from_arrays(columns, schema=OUT)


def _values(column: pa.Array) -> list:
    """The values of a column, as `to_pylist` gives them but without an Arrow scalar for each."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count:
        return column.to_pylist()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        coded = column.dictionary_encode()
        names = coded.dictionary.to_pylist()
        return [names[i] for i in coded.indices.to_numpy().tolist()]
    if pa.types.is_integer(column.type) or pa.types.is_boolean(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def matches(frame, event) -> bool:
    """The frame lists this exit type, and the line numbers agree or one is missing."""
    if event[TYPE] not in frame[ENDS]:
        return False
    return frame[LINE] == event[LINE] or not event[LINE] or not frame[LINE]


def is_true_exit(event) -> bool:
    return event[IS_EXIT] and not event[ENDS] and not event[NEXT]


def is_closing(event) -> bool:
    """Whether the event ends a frame that waits for the next line."""
    return event[IS_EXIT] or event[NEXT] or bool(event[ENDS])


class Machine:
    """The stack of one log: unwinding, orphan exits, next-line ends and truncation."""

    variant = ""

    def __init__(self, out: Writer, log_id: str) -> None:
        self.out = out
        self.log_id = log_id
        self.stack: list = []
        self.unwinding = False
        self.max_size_ts: int | None = None
        self.last_ts: int | None = None
        self.slice = 0

    def close(self, event, ts, truncated=False, at=None) -> None:
        frame = self.stack.pop()
        closer, last = None if truncated else event[IDX], at if event is None else event[IDX] - 1
        self.out.closed(self.log_id, self.slice, self.variant, frame[IDX], ts, closer, last, truncated)
        if truncated:
            self.issue(frame[IDX], ts, "Unexpected-End", event)

    def issue(self, index, ts, name, event) -> None:
        self.out.add(
            log_id=self.log_id, slice=self.slice, variant=self.variant, kind="issue", event_index=index, ts=ts,
            issue=name, closer=None if event is None else event[IDX],
        )

    def cut_off(self, event) -> None:
        """The top frame ends because the log reached its size."""
        top = self.stack[-1]
        at = self.last_ts if self.last_ts is not None else top[TS]
        self.close(event, at, truncated=True)
        self.issue(top[IDX], at, "Max-Size-reached", event)
        self.max_size_ts = at

    def step(self, event) -> bool:
        """Process one event on the real stack; True when it was consumed as an exit."""
        if self.stack and event[UNWINDS]:
            self.unwinding = True
        if self.settle(event):
            return True
        self.place(event)
        return False

    def settle(self, event) -> bool:
        """End the frames that the event ends; True when it was consumed as an exit."""
        stack = self.stack
        ts = event[TS]
        true_exit, closing = is_true_exit(event), is_closing(event)
        while stack:
            top = stack[-1]
            if top[NEXT]:
                if closing:
                    self.close(event, ts)
                    continue
            elif true_exit:
                if matches(top, event):
                    self.close(event, ts)
                    self.unwinding = False
                    return True
                if self.unwinding or any(matches(f, event) for f in stack):
                    self.close(event, ts)
                    continue
                self.issue(event[IDX], ts, "Unexpected-Exit", event)
                break
            if self.unwinding and self.max_size_ts is not None and ts > self.max_size_ts:
                self.cut_off(event)
                continue
            break
        return False

    def place(self, event) -> None:
        stack = self.stack
        ns = event[NS]
        if not ns:
            ns = (stack[-1][NS] or "default") if stack else ("default" if event[PARENT] else "")
        self.placed(event, ns)
        if stack or event[PARENT]:
            self.last_ts = event[TS]
        if event[ENDS]:
            stack.append((*event[:NS], ns))

    def placed(self, event, ns) -> None:
        self.out.event(self.log_id, self.slice, self.variant, event[IDX], None, [f[IDX] for f in self.stack], ns)

    def mark(self, ts) -> None:
        """The log's size marker stood here."""
        self.max_size_ts = ts


class Slice(Machine):
    """A slice, or a group of slices, that is not the first of its log: the stack below it is unknown."""

    def __init__(self, out: Writer, log_id: str, number: int, floor: int = 0) -> None:
        super().__init__(out, log_id)
        self.slice = number
        self.seq = 0
        self.touched = False
        self.raw = False
        self.flag = ""  # what exceptions and matches did since the last operation
        self.sure: int | None = None
        self.maybe: int | None = None
        self.marker: int | None = None
        self.op("start", (0, floor, *NOTHING[2:]))

    def op(self, name, event) -> None:
        """Leave an operation over, with the state changes since the one before."""
        self.out.add(
            log_id=self.log_id, slice=self.slice, variant=self.variant, kind="op", seq=self.seq, event_index=event[IDX],
            op={
                "op": name, "ts": event[TS], "type": event[TYPE], "ends": event[ENDS],
                "line": event[LINE], "is_exit": event[IS_EXIT], "next": event[NEXT],
                "parent": event[PARENT], "unwinds": event[UNWINDS], "ns": event[NS],
                "flag": self.flag, "sure": self.sure, "maybe": self.maybe, "marker": self.marker,
                "strict": len(event) > STRICT and event[STRICT],
            },
        )
        self.seq += 1
        self.flag, self.sure, self.maybe, self.marker = "", None, None, None

    def leave_open(self) -> None:
        for frame in self.stack:
            self.op("open", frame)
        self.stack = []

    def step_raw(self, event) -> None:
        if not self.raw:
            self.leave_open()
            self.raw = True
        self.op("raw", event)

    def mark(self, ts) -> None:
        self.marker = ts

    def thrown(self) -> None:
        """With a frame of the slice open the flag is set for sure, else if one is below."""
        if self.stack:
            self.flag = "set"
        elif self.flag in ("", "if"):
            self.flag = "if"
        elif self.flag in ("reset", "reset-if"):
            self.flag = "reset-if"

    def step(self, event) -> bool:
        if event[UNWINDS]:
            self.thrown()
        true_exit, closing = is_true_exit(event), is_closing(event)
        while self.stack:
            top = self.stack[-1]
            if top[NEXT] and closing:
                self.close(event, event[TS])
            elif true_exit:
                if matches(top, event):
                    self.close(event, event[TS])
                    self.flag = "reset"
                    return True
                if not any(matches(f, event) for f in self.stack):
                    break
                self.close(event, event[TS])
            else:
                break
        if true_exit:
            self.leave_open()
            self.op("exit", event)
            self.touched = True
            return False
        self.touch(event)
        self.place(event)
        return False

    def touch(self, event) -> None:
        if not self.stack and is_closing(event) and not self.touched:
            self.op("touch", event)
            self.touched = True

    def place(self, event) -> None:
        ns = event[NS] or (self.stack[-1][NS] if self.stack else "")
        path = [f[IDX] for f in self.stack]
        self.out.event(self.log_id, self.slice, self.variant, event[IDX], self.seq - 1, path, ns)
        if self.stack or event[PARENT]:
            self.sure, self.maybe = event[TS], None
        else:
            self.maybe = event[TS]
        if event[ENDS]:
            self.stack.append((*event[:NS], ns))

    def finish(self, last_event) -> None:
        self.leave_open()
        self.op("end", last_event)

    # What an operation of an inner slice does to a group of slices.

    def state(self, op) -> None:
        """Take over the state changes that come with an operation."""
        if op["flag"] in ("set", "reset"):
            self.flag = op["flag"]
        elif op["flag"]:
            if op["flag"] == "reset-if":
                self.flag = "reset"
            self.thrown()
        if op["maybe"] is not None and self.stack:
            self.sure, self.maybe = op["maybe"], None
        elif op["maybe"] is not None:
            self.sure, self.maybe = op["sure"] if op["sure"] is not None else self.sure, op["maybe"]
        elif op["sure"] is not None:
            self.sure, self.maybe = op["sure"], None
        if op["marker"] is not None:
            self.mark(op["marker"])

    def apply(self, number, seq, event, op) -> None:
        self.state(op)
        name = op["op"]
        if name == "open":
            ns = event[NS] or (self.stack[-1][NS] if self.stack else "")
            self.stack.append((*event[:NS], ns))
        elif name == "touch":
            while self.stack and self.stack[-1][NEXT]:
                self.close(event, event[TS])
            self.touch(event)
        elif name == "exit":
            self.step(event)
        elif name == "raw":
            self.leave_open()
            self.op("raw", event)
        self.anchor(number, seq, name)

    def anchor(self, number, seq, name) -> None:
        if name in ANCHORS:
            self.out.add(
                log_id=self.log_id, slice=self.slice, variant=self.variant, kind="anchor", anchor=self.seq - 1,
                inner=number, inner_anchor=seq, path=[f[IDX] for f in self.stack], ns=self.stack[-1][NS] if self.stack else "",
            )


ANCHORS = ("start", "touch", "exit", "flush", "fork")


class Lost(Exception):
    """A group cannot tell what comes next without the stack below it."""


class Timed(Slice):
    """One variant of a slice, or group of slices, behind a size marker."""

    def __init__(self, out: Writer, log_id: str, number: int, floor: int, variant: str, grouped: bool = False) -> None:
        self.variant = variant
        super().__init__(out, log_id, number, floor)
        self.unwinding = variant == "T"
        self.bottom = False  # whether nothing is open below
        self.floor = floor  # while max_size_ts is not known it is at most this
        self.grouped = grouped
        self.born: Timed | None = None  # the variant that split off at this event

    def mark(self, ts) -> None:
        self.max_size_ts = self.marker = ts

    def cut_off(self, event) -> None:
        super().cut_off(event)
        self.marker = self.max_size_ts

    def lost(self, event) -> bool:
        """From here on the outcome depends on the stack below: leave the rest of the slice over."""
        if self.grouped:
            raise Lost
        self.leave_open()
        self.raw = True
        self.op("raw", event)
        return True

    def too_late(self, event) -> bool | None:
        """Whether the event is later than the size allows; None if that is not known."""
        if self.max_size_ts is not None:
            return event[TS] > self.max_size_ts
        return True if event[TS] > self.floor else None

    def thrown(self, event=None) -> None:
        if self.unwinding:
            return
        if self.stack:
            self.unwinding, self.flag = True, "set"
        elif not self.bottom:
            self.op("fork", event)
            twin = copy.copy(self)
            twin.variant, twin.bottom, twin.touched, twin.stack = "FE", True, True, []
            self.variant, self.unwinding, self.born = "FN", True, twin

    def step(self, event) -> bool:
        if self.raw:
            self.op("raw", event)
            return False
        if event[UNWINDS]:
            self.thrown(event)
            if self.born:
                self.born.rest(event)
        return self.rest(event)

    def rest(self, event) -> bool:
        done = self.settle(event)
        if not done:
            self.place(event)
        return done

    def settle(self, event) -> bool:
        """As on a real stack; True when the event was consumed or left over."""
        ts = event[TS]
        true_exit, closing = is_true_exit(event), is_closing(event)
        while self.stack:
            top = self.stack[-1]
            if top[NEXT]:
                if closing:
                    self.close(event, ts)
                    continue
            elif true_exit:
                if matches(top, event):
                    self.close(event, ts)
                    self.unwinding, self.flag = False, "reset"
                    return True
                if self.unwinding or any(matches(f, event) for f in self.stack):
                    self.close(event, ts)
                    continue
                if self.bottom:
                    self.issue(event[IDX], ts, "Unexpected-Exit", event)
                    return False
                break
            if self.unwinding:
                late = self.too_late(event)
                if late is None:
                    return self.lost(event)
                if late:
                    self.cut_off(event)
                    continue
            return False
        if self.bottom:
            return False
        if true_exit:
            if self.unwinding:
                return self.lost(event)
            self.leave_open()
            self.op("exit", event)
            self.touched, self.last_ts = True, None  # without a match it stays, and is the last event
            return True
        if self.unwinding:
            late = self.too_late(event)
            # All that is open below goes too, unless the last event was no earlier than this one.
            if late is None or late and not (event[STRICT] or self.last_ts is not None and ts > self.last_ts):
                return self.lost(event)
            if late:
                self.op("flush", event)
                self.touched = self.bottom = True
                self.floor = ts - 1
                return False
        self.touch(event)
        return False

    def place(self, event) -> None:
        below = not self.stack and not event[PARENT]
        sure, maybe = self.sure, self.maybe
        super().place(event)
        if not below:
            self.last_ts = event[TS]
        elif self.bottom:
            self.sure, self.maybe = sure, maybe
        else:
            self.last_ts = None

    def state(self, op) -> None:
        if op["flag"] in ("set", "reset"):
            self.unwinding = op["flag"] == "set"
        super().state(op)
        if op["maybe"] is not None:
            self.last_ts = op["maybe"] if self.stack else None if not self.bottom else op["sure"] if op["sure"] is not None else self.last_ts
            if self.bottom and not self.stack:
                self.maybe = None
        elif op["sure"] is not None:
            self.last_ts = op["sure"]

    def apply(self, number, seq, event, op) -> None:
        name = op["op"]
        if name not in ("flush", "fork", "raw"):
            super().apply(number, seq, event, op)
            return
        self.state(op)
        if name == "fork":
            self.thrown(event)
            if self.born:
                self.born.anchor(number, seq, name)
        elif name == "flush":
            self.settle(event)
        else:
            self.step(event)
        self.anchor(number, seq, name)


class FirstSlice(Machine):
    """The first slice, or group of slices, of a log: the stack starts empty, so everything is exact."""

    def finish(self, last_event) -> None:
        state = {
            "flag": "set" if self.unwinding else "reset",
            "sure": self.last_ts,
            "maybe": None,
            "marker": self.max_size_ts,
        }
        for seq, frame in enumerate([*self.stack, None]):
            e = frame or last_event
            self.out.add(
                log_id=self.log_id, slice=0, variant="", kind="op", seq=seq, event_index=e[IDX],
                op={
                    "op": "open" if frame else "end", "ts": e[TS], "type": e[TYPE],
                    "ends": e[ENDS], "line": e[LINE], "is_exit": e[IS_EXIT], "next": e[NEXT],
                    "parent": e[PARENT], "unwinds": e[UNWINDS], "ns": e[NS], "strict": False,
                    **(state if frame is None else {"flag": ""}),
                },
            )


def _kinds() -> dict[str, tuple]:
    """type -> (ends, is_exit, next, parent, unwinds)."""
    return {r[0]: (r[2], r[10], r[11], r[1] == "span", r[12]) for r in event_types.rows()}


def is_timed(number: int) -> bool:
    """Slices with odd numbers begin behind a size marker at an event that is no exit and later than all before."""
    return number % 2 == 1


def run_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest level. Input is sorted by log, slice, event index and mark; state never spans a slice.

    A row with `mark` is not an event: the size marker after the event of the same index. `past` marks
    slices behind a marker that are not timed; `floor` is the latest time before the event's slice.
    """
    kinds = _kinds()
    out = Writer()
    key = last = None
    machines: list = []
    marked = False
    for batch in batches:
        cols = [_values(batch.column(i)) for i in range(batch.num_columns)]
        for log_id, number, idx, mark, ts, kind, endless, line, ns, past, strict, floor in zip(*cols, strict=True):
            if (log_id, number) != key:
                for m in machines:
                    m.finish(last)
                key, marked = (log_id, number), bool(past)
                if number == 0:
                    machines = [FirstSlice(out, log_id)]
                elif is_timed(number):
                    machines = [Timed(out, log_id, number, floor or 0, v) for v in ("F", "T")]
                else:
                    machines = [Slice(out, log_id, number)]
            if mark:
                marked = True
                for m in machines:
                    m.mark(last[TS])
                continue
            ends, is_exit, nxt, parent, unwinds = kinds[kind]
            event = (idx, ts, kind, [] if endless else ends, line, is_exit, nxt, parent, unwinds, ns or "", bool(strict))
            if marked and number and not is_timed(number):
                machines[0].step_raw(event)
            elif not is_timed(number):
                machines[0].step(event)
            else:
                _each(machines, lambda m, event=event: m.step(event))
            last = event
            if out.full():
                yield from out.drain()
    for m in machines:
        m.finish(last)
    yield from out.drain(force=True)


def _each(machines: list, act) -> None:
    """Let all variants act, and those that split off meanwhile join them."""
    for m in [*machines]:
        act(m)
        twin = getattr(m, "born", None)
        if twin:
            m.born = None
            machines.append(twin)


def _event(index, op) -> tuple:
    return (
        index, op["ts"], op["type"], op["ends"] or [], op["line"], op["is_exit"], op["next"],
        op["parent"], op["unwinds"], op["ns"] or "", op["strict"],
    )


class Replay(FirstSlice):
    """Left-over operations on the real stack."""

    chosen = ""

    def anchor(self, number, seq, name) -> None:
        if number and name in ANCHORS:
            self.out.add(
                log_id=self.log_id, slice=self.slice, variant="", kind="anchor", inner=number, inner_anchor=seq,
                path=[f[IDX] for f in self.stack], ns=(self.stack[-1][NS] or "default") if self.stack else None,
            )

    def begin(self, variant) -> None:
        """Choose the variant of a slice that begins now."""
        self.chosen = "" if not variant else "T" if self.unwinding else "F"

    def apply(self, number, seq, event, op) -> None:
        flag = op["flag"]
        if flag == "set":
            self.unwinding = True
        elif flag in ("reset", "reset-if"):
            self.unwinding = False
        if flag in ("if", "reset-if") and self.stack:
            self.unwinding = True
        if op["maybe"] is not None and self.stack:
            self.last_ts = op["maybe"]
        elif op["sure"] is not None:
            self.last_ts = op["sure"]
        if op["marker"] is not None:
            self.max_size_ts = op["marker"]
        name = op["op"]
        if name == "open":
            ns = event[NS] or (self.stack[-1][NS] if self.stack else "") or "default"
            self.stack.append((*event[:NS], ns))
        elif name == "touch":
            while self.stack and self.stack[-1][NEXT]:
                self.close(event, event[TS])
        elif name == "fork":
            self.unwinding = bool(self.stack)
            self.chosen = "FN" if self.stack else "FE"
        elif name == "flush":
            self.settle(event)
        elif name in ("exit", "raw"):
            self.step(event)
        self.anchor(number, seq, name)
        if name == "end" and self.chosen:
            self.out.add(log_id=self.log_id, slice=self.slice, variant="", kind="choice", inner=number, chosen=self.chosen)
        self.end_index = event[IDX]

    def finish_log(self) -> None:
        while self.stack:
            ts = self.last_ts if self.last_ts is not None else self.stack[-1][TS]
            self.close(None, ts, truncated=True, at=self.end_index)


def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input is sorted by log, slice, sequence and variant; one stack is held at a time."""
    out = Writer()
    machine: Replay | None = None
    current = None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for log_id, number, seq, variant, index, op in zip(*cols, strict=True):
            if machine is None or machine.log_id != log_id:
                if machine is not None:
                    machine.finish_log()
                machine, current = Replay(out, log_id), None
            if number != current:
                machine.begin(variant)
                current = number
            if variant == machine.chosen:
                machine.apply(number, seq, _event(index, op), op)
                if out.full():
                    yield from out.drain()
    if machine is not None:
        machine.finish_log()
    yield from out.drain(force=True)


def merge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One level up: each group of neighbouring slices settles what its operations can tell.

    Input is sorted by log, group, slice, sequence and variant. A group has the number of its first slice, is
    timed if its slices are, and its rows fit a task (see spans.pair).
    """
    key, rows = None, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for log_id, group, *row in zip(*cols, strict=True):
            if (log_id, group) != key:
                yield from _merged_group(key, rows)
                key, rows = (log_id, group), []
            rows.append(row)
    yield from _merged_group(key, rows)


def _merged_group(key, rows) -> Iterator[pa.RecordBatch]:
    if not rows:
        return
    log_id, group = key
    out = Writer()
    try:
        _run_group(out, log_id, group, rows)
    except Lost:
        out = Writer()
        _pass_on(out, log_id, rows)
    yield from out.drain(force=True)


def _run_group(out: Writer, log_id: str, group: int, rows: list) -> None:
    last = _event(rows[-1][3], rows[-1][4])
    if not is_timed(group):
        machine = Slice(out, log_id, group) if group else Replay(out, log_id)
        for number, seq, _, index, op in rows:
            machine.apply(number, seq, _event(index, op), op)
        machine.finish(last)
        return
    floor = rows[0][4]["ts"]
    machines = [Timed(out, log_id, group, floor, v, grouped=True) for v in ("F", "T")]
    current = None
    for number, seq, variant, index, op in rows:
        event = _event(index, op)
        if number != current:
            current = number
            for m in machines:
                m.chosen = "T" if m.unwinding else "F"

        def act(m, number=number, seq=seq, variant=variant, event=event, op=op) -> None:
            if variant != m.chosen:
                return
            m.apply(number, seq, event, op)
            if op["op"] == "fork":
                m.chosen = "FN" if m.unwinding else "FE"
                if m.born:
                    m.born.chosen = "FE"
            if op["op"] == "end":
                out.add(log_id=log_id, slice=group, variant=m.variant, kind="choice", inner=number, chosen=m.chosen)

        _each(machines, act)
    for m in machines:
        m.finish(last)


def _pass_on(out: Writer, log_id: str, rows: list) -> None:
    """Leave the slices of a group as they are."""
    for number, seq, variant, index, op in rows:
        out.add(log_id=log_id, slice=number, variant=variant, kind="op", seq=seq, event_index=index, op=op)
        if op["op"] in ANCHORS:
            out.add(log_id=log_id, slice=number, variant=variant, kind="anchor", anchor=seq, inner=number, inner_anchor=seq, path=[], ns="")
    for number in {r[0] for r in rows}:
        for variant in ("T", "F", "FN", "FE"):
            out.add(log_id=log_id, slice=number, variant=variant, kind="choice", inner=number, chosen=variant)
