"""Repeated paragraphs and passages by MinHash banding.

Units are lines of some length and, for passages inside lines or across them, windows of a few words that
begin at the smallest shingle hash of their surroundings: a shared passage has such windows at the same
places in every document, whatever stands around it. The distinct word shingles of a unit have a MinHash
signature, whose bands are tuned so that lines at the similarity are found with a given chance; windows
need one band. Units that collide in a band are verified by the exact Jaccard similarity, linked ones form
components, and of each component the first unit stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.jaccard_join import SETS, distinct, filter_bits, in_filter, meet, nodes, resolve, set_rows
from spanforge.llm.stage import cut, slices
from spanforge.llm.tokens import U, chain, mix, owners, raw, signed, unsigned, words


class Shape(NamedTuple):
    """Words of a shingle, least words of a line, words of a window, and shingles among which a window's
    first is the smallest. A repeated passage of span + window - 1 words or more has a whole window."""

    shingle: int = 5
    line: int = 50
    window: int = 20
    span: int = 26


def tune(similarity: float, recall: float, most: int = 12) -> tuple[int, int]:
    """(bands, rows): as many rows a band as reach `recall` at `similarity` with `most` bands at most."""
    best = (most, 1)
    for rows in range(1, 20):
        bands = next((b for b in range(1, most + 1) if 1 - (1 - similarity**rows) ** b >= recall), None)
        if bands:
            best = (bands, rows)
    return best


class Units(NamedTuple):
    """Text, first and last word in the text, first byte and byte behind the last, per unit; lines first."""

    doc: np.ndarray
    first_word: np.ndarray
    last_word: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    node: np.ndarray
    keys: np.ndarray  # of the lines: sorted shingles from at[i] to at[i + 1]
    at: np.ndarray
    windows: np.ndarray  # (windows, shingles) sorted; repetitions within a window are the largest number


LAST = ~U(0)


def units(texts: pa.Array, shape: Shape) -> Units:
    w = words(texts)
    data, begins = raw(texts)
    doc, m = owners(w.offsets), len(w.hashes)
    lines = np.cumsum(np.concatenate([[0], data == 10]))
    line = lines[w.starts]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])][:m])
    size = np.diff(np.append(head, m))
    head, size = head[size >= shape.line], size[size >= shape.line]
    ends = np.cumsum(size)
    chosen = np.repeat(head - (ends - size), size) + np.arange(size.sum())
    keys, at = distinct(w.hashes[chosen], np.concatenate([[0], ends]), shape.shingle)

    gram = w.hashes.copy()
    for k in range(1, shape.shingle):
        gram[: m - k] = chain(gram[: m - k], w.hashes[k:])
    left = w.offsets[doc + 1] - np.arange(m)
    fits = left >= shape.window
    value = np.where(fits, mix(gram, 71), LAST)
    if m >= shape.span:
        low = np.lib.stride_tricks.sliding_window_view(value, shape.span).argmin(axis=1) + np.arange(m - shape.span + 1)
    else:
        low = np.array([value.argmin()]) if m else np.zeros(0, np.int64)
    # texts shorter than that have one window, at their smallest
    few = np.flatnonzero((np.diff(w.offsets) < shape.span + shape.window) & (np.diff(w.offsets) >= shape.window))
    low = np.unique(np.concatenate([low, *[[w.offsets[i] + value[w.offsets[i] : w.offsets[i + 1]].argmin()] for i in few]]).astype(np.int64))
    low = low[fits[low]]
    if len(low):  # of a run of one word, one window is enough
        same = np.r_[False, (gram[low[1:]] == gram[low[:-1]]) & (np.diff(low) < shape.span)]
        low = low[~same]
    sets = np.sort(gram[low[:, None] + np.arange(shape.window - shape.shingle + 1)], axis=1)
    twice = np.zeros(sets.shape, dtype=bool)
    twice[:, 1:] = sets[:, 1:] == sets[:, :-1]
    sets[twice] = LAST
    node = mix(np.where(twice, U(0), mix(sets, 5)).sum(axis=1, dtype=U) + (~twice).sum(axis=1).astype(U), 6)
    first = np.concatenate([head, low])
    last = np.concatenate([head + size - 1, low + shape.window - 1])
    of, base = doc[first], begins[:-1][doc[first]]
    return Units(of, first - w.offsets[of], last - w.offsets[of], w.starts[first] - base, w.ends[last] - base, np.concatenate([nodes(keys, at), node]), keys, at, sets)


UNITS = "id long, same long, first_word int, last_word int, start long, stop long, node long, keys array<long>"


def _units(shape: Shape, bands: int, rows: int):
    """UNITS of every text: `keys` are the bands of a line, and the one of a window."""
    factors = mix(np.arange(1, bands * rows + 1, dtype=U), 61) | U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                u = units(part.column("text"), shape)
                n, m = len(u.at) - 1, len(u.windows)
                of_lines = np.empty((n, bands), dtype=U)
                for b in range(bands if n else 0):
                    key = np.full(n, b + 1, dtype=U)
                    for f in factors[b * rows : (b + 1) * rows]:
                        key = chain(key, np.minimum.reduceat(u.keys * f, u.at[:-1]))
                    of_lines[:, b] = key
                key = np.zeros(m, dtype=U)
                for f in factors[:rows] if m else ():
                    key = chain(key, np.where(u.windows == LAST, LAST, u.windows * f).min(axis=1))
                ends = np.concatenate([np.arange(n + 1) * bands, n * bands + np.arange(1, m + 1)]).astype(np.int32)
                doc = pa.array(u.doc)
                columns = [
                    part.column("id").take(doc), part.column("same").take(doc),
                    *(pa.array(x.astype(np.int32)) for x in (u.first_word, u.last_word)), *(pa.array(x.astype(np.int64)) for x in (u.start, u.stop)),
                    pa.array(signed(u.node)), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate([of_lines.ravel(), key])))),
                ]
                yield pa.record_batch(columns, [c.split()[0] for c in UNITS.split(", ")])

    return run


def _among(bits: np.ndarray):
    """The rows whose `node` is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(unsigned(np.asarray(batch.column("node"))), bits)))

    return run


def _sets(shape: Shape, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                u = units(part.column("text"), shape)
                n = len(u.at) - 1
                yield set_rows(u.keys, u.at, u.node[:n], bits)
                hit = in_filter(u.node[n:], bits)
                some = u.windows[hit]
                size = (some != LAST).sum(axis=1)
                yield set_rows(some[some != LAST], np.concatenate([[0], np.cumsum(size)]), u.node[n:][hit], bits)

    return run


def repeated_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shape: Shape = Shape(),
    percent: int = 80,
    recall: float = 0.998,
    kept: list[str] | None = None,
) -> DataFrame:
    """`(id_col, start, stop, n_words, removed)`: stretches of text that occur in several documents.

    Stretches are units (see the module) alike to one of another document, overlapping ones put together;
    `start` and `stop` are byte offsets. Units are alike if their sets of shingles have a Jaccard similarity
    of `percent` or more; `recall` is the least chance that such lines share a band. The unit of a component
    with the smallest id, text hash and place is not removed, all others are.

    Null and empty texts have no units, a null id sorts last, rows that repeat id and text are one document,
    ids with different texts several; an empty table gives no rows, other columns are not read. Equal units
    are one node of the joins, so a passage in a third of all documents is one row there.
    """
    kept = [] if kept is None else kept
    bands, rows = tune(percent / 100, recall)
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("same"), text.alias("text"))
    each = cut(source.mapInArrow(_units(shape, bands, rows), UNITS), kept)
    met = meet(each.select(F.explode("keys").alias("key"), "node", F.lit(0).alias("extra")), kept)
    label = resolve(met, lambda bits: source.select("text").mapInArrow(_sets(shape, bits), SETS), percent, kept)
    places = each.drop("keys")
    named = places.mapInArrow(_among(filter_bits(met.select("node"))), places.schema).join(label.toDF("node", "part"), "node", "left")
    named = cut(named.withColumn("cluster", F.coalesce("part", "node")).drop("node", "part"), kept)
    doc = F.struct(F.col("id").isNull().alias("none"), "id", "same")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "same", "start")
    several = named.groupBy("cluster").agg(F.min(doc).alias("a"), F.max(doc).alias("b"), F.min(place).alias("first")).filter("a <> b")
    found = named.join(cut(several.select("cluster", "first"), kept), "cluster").withColumn("removed", place != F.col("first")).drop("first", "cluster").distinct()
    by = Window.partitionBy("id", "same", "removed").orderBy("start", "stop")
    upto = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum((F.coalesce(upto, F.lit(-1)) < F.col("start")).cast("int")).over(by)
    stretch = found.withColumn("run", run).groupBy("id", "same", "removed", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("last_word") - F.min("first_word") + 1).cast("long").alias("n_words")
    )
    return stretch.select(F.col("id").alias(id_col), "start", "stop", "n_words", "removed")
