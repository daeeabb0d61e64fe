"""Fill-in-the-middle texts: every text cut at two lines, which an indexable skip list finds.

The lines of a text are the bottom lane of a skip list. Of each lane about one node in SPAN goes up to the
express lane above it, where its widths are the units and the code points down to the next node there. A rank
in units is reached by going along the top lane while the widths add up to no more than it, then down a lane,
and so on; the code points passed on the way are the place of the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.stage import slices
from spanforge.llm.tokens import U, mix, raw

SPAN = 4
MARKS = ("<P>", "<S>", "<M>")
PLACES = "struct<units: long, first: long, second: long>"


class SkipList:
    """Express lanes over consecutive units of given code-point widths."""

    def __init__(self, points: np.ndarray):
        self.lanes = [(np.ones(len(points), dtype=np.int64), points, None)]
        while len(self.lanes[-1][0]) > SPAN:
            units, points, _ = self.lanes[-1]
            up = mix(np.arange(len(units), dtype=U), len(self.lanes)) % U(SPAN) == 0
            up[0] = True  # every lane begins at the first unit
            nodes = np.flatnonzero(up)
            self.lanes.append((np.add.reduceat(units, nodes), np.add.reduceat(points, nodes), nodes))

    def seek(self, rank: int) -> int:
        """Code points before the unit of number `rank`; of all units for their number."""
        at = units = points = 0
        for lane_units, lane_points, below in reversed(self.lanes):
            while at < len(lane_units) and units + lane_units[at] <= rank:
                units += int(lane_units[at])
                points += int(lane_points[at])
                at += 1
            if units == rank:
                break
            at = int(below[at])  # a rank beyond this lane's last node never gets here: all units would be passed
        return points


def _places(texts: pa.Array, one: pa.Array, two: pa.Array) -> Iterator[tuple[int, int, int]]:
    """For each text its lines, and the code points before the lower and the higher rank."""
    data, offsets = raw(texts)
    starts = np.zeros(len(data) + 1, dtype=bool)
    starts[1:] = data == 10
    starts[offsets[:-1]] = True
    starts = np.flatnonzero(starts[: len(data)])
    points = np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    first = np.searchsorted(starts, offsets)
    for i, (a, b) in enumerate(zip(one.to_pylist(), two.to_pylist(), strict=True)):
        lines = points[first[i] : first[i + 1]]
        low, high = sorted((a % (len(lines) + 1), b % (len(lines) + 1)))
        lanes = SkipList(lines)
        yield len(lines), lanes.seek(low), lanes.seek(high)


def places(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    found: list[tuple[int, int, int]] = []
    batch = pa.record_batch([texts, one, two], ["text", "one", "two"])
    for part in slices(batch, "text"):
        found += _places(part.column("text"), part.column("one"), part.column("two"))
    names = ["units", "first", "second"]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=names)


def draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row, from its id and the seed; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """`(id_col, n, form, prefix_chars, middle_chars, output)` for every row.

    A text's n units are its lines, each with its line end. Of `rate` texts in a hundred, the prefix ends
    before one of two drawn units and the middle before the other; `spm` in a hundred of those put the
    suffix first. Texts that are null (taken as empty), empty or hold a mark, and the others, stay plain, without prefix_chars and
    middle_chars. Draws depend on id and seed only, so repeated ids draw alike and a rerun gives the same.
    Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    one, two, three, four = draws(id_col, seed)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), one.alias("one"), two.alias("two"), three.alias("three"), four.alias("four"))
    rows = rows.select("*", F.arrow_udf(places, PLACES)("text", "one", "two").alias("cut"))
    plain = (F.col("text") == "") | (F.col("three") % 100 >= rate)
    for mark in marks:
        plain = plain | F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(F.col("four") % 100 < spm, "spm").otherwise("psm")
    first, second = F.col("cut.first"), F.col("cut.second")
    piece = lambda a, n: F.substring("text", a.cast("int") + 1, n.cast("int"))
    prefix, middle, suffix = piece(F.lit(0), first), piece(first, second - first), piece(second, F.length("text"))
    p, s, m = map(F.lit, marks)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return rows.withColumn("form", form).select(
        F.col("id").alias(id_col), F.col("cut.units").alias("n"), "form", chars(first).alias("prefix_chars"), chars(second - first).alias("middle_chars"), output.alias("output")
    )


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an output: no piece holds a mark, so each mark stands there once."""
    p, s, m = map(F.lit, marks)
    part = lambda text, mark, k: F.split_part(text, mark, F.lit(k))
    psm, spm = (F.substring(output, F.length(x) + 1, F.length(output)) for x in (p, s))
    after_s, after_p = part(psm, s, 2), part(spm, p, 2)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part(psm, s, 1), part(after_s, m, 2), part(after_s, m, 1)))
        .otherwise(F.concat(part(after_p, m, 1), part(after_p, m, 2), part(spm, p, 1)))
    )
