"""N-gram Jaccard join of whole documents by parity sketches.

Every shingle of a document toggles one bit of a wide sketch, so the number of differing bits, and even
the number of differing *parts* of the sketch, is at most the size of the symmetric difference. A size band
bounds that difference for all linked pairs of its documents by some `d`; its sketches are split into
d + 1 + S parts, so a linked pair shares at least 1 + S of them. Documents meet where a part is equal.

Nodes are sets of shingles (by a 64-bit hash), not documents, so copies cost nothing beyond their own
rows. The steps, none of which lists all pairs of a group:

1. rows (part key, node) are shuffled and sorted; runs of a key are streamed and each node is paired with
   the first of its run and two others before it only,
2. these pairs are compared by a folded sketch and then exactly, and linked nodes form components,
3. keys whose nodes are in several components are what is left. Since pairs share 1 + S keys, each node may
   leave out its S most common keys (in one global order) and still meet every partner, which removes
   parts made of widespread passages. In the keys that remain, the folded sketches of nodes outside the
   key's main component are compared with those of other components, block by block inside tasks; only
   pairs that may link become rows, and are verified like the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.components import components
from spanforge.llm.stage import cut, marked, marks, slices, unused
from spanforge.llm.tokens import U, chain, mix, owners, signed, unsigned, words

BITS = 1 << 20  # sketch bits a part
FOLDED = 2048  # bits of the folded sketch
SHORT = 256  # bits of it folded again
BLOCK = 2048  # nodes of a key compared in one task
HELD = 256  # nodes of either side whose sets are held at once to check their pairs
BLOOM = 1 << 25  # bits of the filter of nodes whose sets are fetched; a fixed size


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct shingles of `n` words, and where each text's begin. Fewer
    words make one shingle of all of them; no words make none."""
    w = words(texts)
    return distinct(w.hashes, w.offsets, n)


def distinct(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for words that are at hand: those from offsets[i] to offsets[i + 1] are one text's."""
    own, m = owners(offsets), len(hashes)
    left = offsets[own + 1] - np.arange(m)
    out = hashes.copy()
    for k in range(1, n):
        inside = np.flatnonzero(left > k)
        out[inside] = chain(out[inside], hashes[inside + k])
    short = (np.diff(offsets) < n)[own] & (np.arange(m) == offsets[own])
    out[short] = mix(out[short], 3)
    keep = (left >= n) | short
    out, own = out[keep], own[keep]
    begin = np.searchsorted(own, np.arange(len(offsets)))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
    return out[new], np.searchsorted(own[new], np.arange(len(offsets)))


def nodes(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set."""
    sums = np.zeros(len(keys) + 1, dtype=U)
    np.cumsum(mix(keys, 5), out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U), 6)


def bands(percent: int) -> np.ndarray:
    """Lower ends of the size bands: a set's partners are in its own band or a neighbouring one."""
    ends, top = [], 1
    while top < 1 << 40:
        ends.append(top)
        top = max(top + 1, -(-top * 100 // percent))
    return np.array(ends, dtype=np.int64)


def plan(band: int, low: np.ndarray, percent: int) -> tuple[int, int]:
    """(d, S) for pairs whose smaller set is in `band`."""
    most = int(low[band + 1]) - 1
    d = (most + most * 100 // percent) * (100 - percent) // (100 + percent)
    return d, 4 + d // 24


def sketch(keys: np.ndarray, band: int, low: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Part keys of a set in a band, and how many of them it may leave out."""
    d, spare = plan(band, low, percent)
    if not d:
        return keys[:0], 0  # only equal sets link
    parts = d + 1 + spare
    bit = np.sort(mix(keys, 13) % U(parts * BITS))
    part = bit // U(BITS)
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    value = np.bitwise_xor.reduceat(mix(bit, 14), edge)  # toggled twice cancels: a hash of the parity bits
    named, live = part[edge], value != 0
    value, named = value[live], named[live]
    empty = parts - len(value)
    if empty > spare:
        full = np.zeros(parts, dtype=U)
        full[named.astype(np.int64)] = value
        value, named = full, np.arange(parts, dtype=U)
    return chain(mix(named + U(band << 40), 15), value), max(spare - empty, 0)


def folds(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The folded sketch of each set, FOLDED / 8 bytes one after another."""
    bit = (keys & U(FOLDED - 1)).astype(np.int64)
    out = np.zeros((len(at) - 1) * FOLDED // 8, dtype=np.uint8)
    np.bitwise_xor.at(out, owners(at) * (FOLDED // 8) + (bit >> 3), np.uint8(1) << (bit & 7).astype(np.uint8))
    return out


def in_filter(node: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    bit = node % U(BLOOM)
    return bloom[(bit >> U(6)).astype(np.int64)] >> (bit & U(63)) & U(1) == 1


SETS = "node long, size long, folded binary, set binary"


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def set_rows(keys: np.ndarray, at: np.ndarray, node: np.ndarray, bloom: np.ndarray) -> pa.RecordBatch:
    """SETS of the non-empty sets whose node is in the filter."""
    size = np.diff(at)
    hit = (size > 0) & in_filter(node, bloom)
    node, keys, size = node[hit], keys[np.repeat(hit, size)], size[hit]
    at = np.concatenate([[0], np.cumsum(size)])
    each = np.arange(len(node) + 1) * (FOLDED // 8)
    columns = [pa.array(signed(node)), pa.array(size), _binary(folds(keys, at), each), _binary(keys, at * 8)]
    return pa.record_batch(columns, ["node", "size", "folded", "set"])


def _sets(n: int, with_id: bool, bloom: np.ndarray | None):
    """Per document (id, same, node, size); or, for nodes in the filter, (node, size, folded sketch, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, at = shingles(part.column("text"), n)
                node, size = nodes(keys, at), np.diff(at)
                if with_id:
                    yield pa.record_batch([part.column("id"), part.column("same"), pa.array(signed(node)), pa.array(size)], ["id", "same", "node", "size"])
                    continue
                yield set_rows(keys, at, node, bloom)

    return run


def _parts(n: int, percent: int):
    low = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, at = shingles(part.column("text"), n)
                node, found, lengths, rest, who, where = nodes(keys, at), [], [], [], [], []
                for i in np.flatnonzero(np.diff(at)):
                    mine = keys[at[i] : at[i + 1]]
                    own = int(np.searchsorted(low, len(mine), side="right")) - 1
                    for band in (own, own - 1) if own and -(-len(mine) * percent // 100) < low[own] else (own,):
                        got, spare = sketch(mine, band, low, percent)
                        found.append(got)
                        lengths.append(len(got))
                        rest.append(spare)
                        who.append(node[i])
                        where.append(band)
                if found:
                    yield pa.record_batch(
                        [
                            pa.array(signed(np.concatenate(found))),
                            pa.array(signed(np.repeat(np.array(who, dtype=U), lengths))),
                            # band and spare in one column: most rows are dropped right after the shuffle
                            pa.array(np.repeat(np.array(where) * 4096 + np.minimum(rest, 4095), lengths).astype(np.int32)),
                        ],
                        ["key", "node", "extra"],
                    )

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, node): every distinct node of a run of two or more, beside the first of the
    run and two before it; and once, with extra -1, a node that a key has more than once."""
    last = None  # (key, node, extra, first node of the run, node before, node long before, is that row given, is it a repetition)
    for batch in batches:
        key, node, extra = (np.asarray(batch.column(c)) for c in ("key", "node", "extra"))
        if not len(key):
            continue
        again = np.zeros(len(key), dtype=bool)
        again[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
        again[0] = last is not None and key[0] == last[0] and node[0] == last[1]
        second = again.copy()
        second[1:] &= ~again[:-1]
        second[0] &= last is None or not last[7]
        rows = [(key[second], node[second], np.full(second.sum(), -1, dtype=np.int32), node[second], node[second], node[second])]
        ended_again = bool(again[-1])
        key, node, extra = key[~again], node[~again], extra[~again]
        if len(key):
            head = np.ones(len(key), dtype=bool)
            head[1:] = key[1:] != key[:-1]
            carried = last is not None and key[0] == last[0]
            head[0] = not carried
            place = np.maximum.accumulate(np.where(head, np.arange(len(key)), -1))
            first = np.where(place >= 0, node[np.maximum(place, 0)], last[3] if last else 0)
            before = np.where(head, node, np.concatenate([[last[1] if carried else 0], node[:-1]]))
            # one more, eight places before in the run where there are so many
            far = np.arange(len(node)) - 8
            earlier = np.where((far >= 0) & (far >= place), node[np.maximum(far, 0)], node)
            give = ~head
            give[:-1] |= ~head[1:]  # another node follows in the run
            if carried and not last[6]:
                rows.append(tuple(np.array([x]) for x in last[:6]))
            rows.append((key[give], node[give], extra[give], first[give], before[give], earlier[give]))
            last = (key[-1], node[-1], extra[-1], first[-1], before[-1], earlier[-1], bool(give[-1]), ended_again)
        else:
            last = (*last[:7], ended_again)
        key, node, extra, first, before, earlier = (np.concatenate(c) for c in zip(*rows, strict=True))
        if len(key):
            yield pa.record_batch([pa.array(x) for x in (key, node, extra.astype(np.int32), first, before, earlier)], ["key", "node", "extra", "first", "before", "earlier"])


def _near(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Do sizes and folded sketches (along the last axis) allow a link?"""
    apart = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)
    return (apart <= (nx + ny) * (100 - percent) // (100 + percent)) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))


def _unfold(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=U).reshape(-1, FOLDED // 64)


def _close(percent: int):
    """Keep pairs that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = _near(_unfold(batch.column("fa")), _unfold(batch.column("fb")), np.asarray(batch.column("na")), np.asarray(batch.column("nb")), percent)
                yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    return run


def _across(half: np.ndarray, node: np.ndarray, part: np.ndarray, size: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of one group that are in different components and may link, as rows (a, b)."""
    names, counts = np.unique(part, return_counts=True)
    main = part == names[counts.argmax()]
    if half[0] == 2:
        jobs = [(np.flatnonzero(~main), np.arange(len(node)))]
    else:
        jobs = [(np.flatnonzero((half == 0) & ~main), np.flatnonzero(half == 1)), (np.flatnonzero((half == 0) & main), np.flatnonzero((half == 1) & ~main))]
    # folded once more: distances only shrink, and of small sets few pairs are left to compare in full
    short = np.bitwise_xor.reduce(bits.reshape(len(bits), -1, SHORT // 64), axis=1)
    out = [np.zeros((0, 2), dtype=np.int64)]
    for left, right in jobs:
        for at in range(0, len(left), 16):
            x = left[at : at + 16]
            ok = _near(short[x][:, None], short[right][None], size[x][:, None], size[right][None], percent)
            ok &= part[x][:, None] != part[right][None]
            i, j = np.nonzero(ok)
            i, j = x[i], right[j]
            full = _near(bits[i], bits[j], size[i], size[j], percent)
            i, j = i[full], j[full]
            out.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _compare(percent: int):
    """Over rows sorted by group: the pairs of `_across`. A group has at most two blocks of nodes."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(c)) for c in ("g", "half", "node", "part", "size")] + [_unfold(batch.column("folded"))]
            edges = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if held and held[-1][0][0] != columns[0][a]:
                    yield [np.concatenate(c) for c in zip(*held, strict=True)]
                    held = []
                held.append([c[a:b] for c in columns])
        if held:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, half, node, part, size, bits in groups(batches):
            if (part != part[0]).any():
                got = _across(half, node, part, size, bits, percent)
                if len(got):
                    yield pa.record_batch([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    return run


def _verify(percent: int):
    """Over rows (g, a, b, set) sorted by g and with the sets of a group, those of nodes a, before its pairs: the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            out = []
            for g, a, b, found in zip(*(batch.column(c).to_pylist() for c in ("g", "a", "b")), batch.column("set"), strict=True):
                if g != group:
                    group, held = g, {}
                if found.is_valid:
                    held[a] = np.frombuffer(found.as_py(), dtype=U)
                    continue
                x, y = held[a], held[b]
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def filter_bits(found: DataFrame) -> np.ndarray:
    """A bit for every node, as words; what reaches the driver is bounded by BLOOM."""
    bit = F.expr(f"cast(pmod(node, {BLOOM}) as long)")
    word = found.select((bit / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(node, {BLOOM}) % 64 as int))").alias("v"))
    rows = word.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    bits = np.zeros(BLOOM // 64, dtype=U)
    bits[np.asarray(rows["w"].combine_chunks())] = unsigned(np.asarray(rows["v"].combine_chunks()))
    return bits


def _needed(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """`sets` without those whose node is surely none of the column `node` of `nodes`, so that they need not move."""
    shared = sets.sparkSession.sparkContext.broadcast(filter_bits(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for batch in batches:
            yield batch.filter(pa.array(in_filter(unsigned(np.asarray(batch.column("node"))), bloom)))

    return sets.mapInArrow(run, sets.schema)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, kept: list[str]) -> DataFrame:
    """The linked ones of distinct pairs (a, b)."""
    thin = sets.select("node", "size", "folded")
    near = (
        pairs.join(thin.toDF("a", "na", "fa"), "a")
        .join(thin.toDF("b", "nb", "fb"), "b")
        .mapInArrow(_close(percent), "a long, b long")
    )
    near = cut(near, kept)
    # a pair is checked where its group is, so that a set moves once for all its pairs there
    label = components(near, kept).toDF("node", "part")
    blocks = F.ceil(F.col("many") / HELD).cast("int")
    placed = label.join(label.groupBy("part").agg(F.count("*").alias("many")), "part")
    placed = cut(placed.select("node", "part", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")), kept)
    dealt = near.join(placed.toDF("a", "part", "i"), "a").join(placed.select(F.col("node").alias("b"), F.col("own").alias("j")), "b")
    dealt = cut(dealt.select(F.xxhash64("part", "i", "j").alias("g"), "a", "b"), kept)
    asked = dealt.select("g", F.explode(F.array("a", "b")).alias("node")).distinct()
    there = asked.join(_needed(sets.select("node", "set"), placed), "node").select("g", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "set")
    rows = there.unionByName(dealt.withColumn("set", F.lit(None).cast("binary")))
    rows = rows.repartition("g").sortWithinPartitions("g", F.col("b").asc_nulls_first())
    linked = cut(rows.mapInArrow(_verify(percent), "a long, b long"), kept)
    return linked


def meet(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Rows (key, node, extra) of keys with two nodes or more, each beside the first of its key and two before; and,
    with extra -1, nodes that a key has several times."""
    met = rows.repartition("key").sortWithinPartitions("key", "node")
    met = cut(met.mapInArrow(_meetings, "key long, node long, extra int, first long, before long, earlier long"), kept)
    return met


def resolve(met: DataFrame, fetch: Callable[[np.ndarray], DataFrame], percent: int, kept: list[str]) -> DataFrame:
    """(node, component_id) of the nodes that link with another they share a key with. `met` comes from
    `meet`; extra % 4096 of a node's keys in band extra div 4096 may be left out. `fetch` gives SETS for the
    nodes in a filter."""
    met = met.filter("extra >= 0")
    sets = fetch(filter_bits(met.select("node")))
    sets = cut(sets.groupBy("node").agg(F.first("size").alias("size"), F.first("folded").alias("folded"), F.first("set").alias("set")), kept)

    pair = [F.least("other", "node").alias("a"), F.greatest("other", "node").alias("b")]
    stars = met.select("node", F.col("first").alias("other")).filter("other <> node").select(*pair).distinct()
    links = _linked(cut(stars, kept), sets, percent, kept)
    label = components(links, kept)
    # the other partners matter, and their sets move, only where that left them in different components
    more = met.select("node", F.explode(F.array("before", "earlier")).alias("other")).filter("other <> node").select(*pair).distinct()
    more = more.join(label.toDF("a", "pa"), "a", "left").join(label.toDF("b", "pb"), "b", "left")
    more = cut(more.filter("coalesce(pa, a) <> coalesce(pb, b)").select("a", "b"), kept)
    links = cut(links.union(_linked(more, sets, percent, kept)), kept)
    label = components(links, kept)

    member = met.join(label.toDF("node", "part"), "node", "left")
    member = cut(member.select("key", "node", "extra", F.coalesce("part", "node").alias("part")), kept)
    per_key = member.groupBy("key").agg(F.count("*").alias("many"), F.min("part").alias("low"), F.max("part").alias("high"))
    rank = Window.partitionBy("node", "band").orderBy(F.col("many").desc(), F.col("key").desc())
    rest = (
        member.join(cut(per_key, kept), "key")
        .withColumn("band", F.expr("cast(extra div 4096 as int)"))
        .withColumn("place", F.row_number().over(rank))
        .filter("place > extra % 4096 AND low <> high")
        .select("key", "node", "part", "many")
    )
    # keys of many nodes are dealt out as pairs of blocks of about BLOCK nodes
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", "key"), blocks).cast("int")
    dealt = rest.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    half = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = cut(dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), half.alias("half"), "node", "part"), kept)
    sided = dealt.join(sets.select("node", "size", "folded"), "node").select("g", "half", "node", "part", "size", "folded")
    pairs = sided.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(percent), "a long, b long").distinct()
    pairs = cut(pairs, kept)
    return components(links.union(_linked(pairs, sets, percent, kept)), kept)


def linked_rows(docs: DataFrame, id_col: str, text_col: str, words_each: int, percent: int, kept: list[str]) -> DataFrame:
    """(id, same, node, size, part) of every row: a hash of its text, one of its set, the size of that, and
    what rows of a component share."""
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("same"), text.alias("text"))
    own = cut(source.mapInArrow(_sets(words_each, True, None), "id long, same long, node long, size long"), kept)
    met = meet(source.select("text").mapInArrow(_parts(words_each, percent), "key long, node long, extra int"), kept)
    label = resolve(met, lambda bits: source.select("text").mapInArrow(_sets(words_each, False, bits), SETS), percent, kept)
    named = own.join(label.toDF("node", "part"), "node", "left")
    return cut(named.select("id", "same", "node", "size", F.coalesce("part", "node").alias("part")), kept)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4, percent: int = 85, kept: list[str] | None = None
) -> DataFrame:
    """`(id_col, n_shingles, component_id)` for every row of `docs`.

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets. Rows with a null,
    empty or blank text have an empty set and link with nothing: their component is their own id. A null
    id takes part; it is named only if no id of the component is known. Repeated rows and ids give a row
    each. Other columns are not read; an empty table gives no rows.
    """
    kept = [] if kept is None else kept
    named = linked_rows(docs, id_col, text_col, words_each, percent, kept)
    least = cut(named.filter("size > 0").groupBy("part").agg(F.min("id").alias("least")), kept)
    full = named.filter("size > 0").join(least, "part").select("id", "size", F.col("least").alias("component_id"))
    none = named.filter("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return full.union(none).toDF(id_col, "n_shingles", "component_id")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, percent: int = 80, kept: list[str] | None = None
) -> DataFrame:
    """`docs`, all columns, with one row of each component: that with the smallest id (a null one last),
    then text hash; of rows that repeat both, any one. Rows without words all stay. An empty table stays
    empty."""
    kept = [] if kept is None else kept
    named = linked_rows(docs, id_col, text_col, words_each, percent, kept).filter("size > 0")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "same")
    chosen = cut(named.groupBy("part").agg(F.min(place).alias("chosen")), kept)
    names = unused(docs, "__id", "__same", "__rows", "__stays", "__text", "__may")
    r_id, r_same, rows, stays, text, may_be = names
    judged = named.join(chosen, "part").groupBy("id", "same").agg(F.count("*").alias("rows"), F.bool_or(place == F.col("chosen")).alias("stays"))
    judged = cut(judged.filter("rows > 1 OR NOT stays").toDF(*names[:4]), kept)
    # only rows that may be judged move; the others are kept where they are read
    same = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    bitmap, key = marks(judged.select(F.xxhash64(r_id, r_same).alias("key"))), F.xxhash64(F.col(f"`{id_col}`"), F.col(text))
    here = docs.withColumn(text, same).withColumn(may_be, marked(bitmap, key))
    may = here.filter(F.col(may_be))
    match = F.col(f"`{id_col}`").eqNullSafe(F.col(r_id)) & (F.col(text) == F.col(r_same))
    stay = here.filter(~F.col(may_be)).unionByName(may.join(judged, match, "left_anti"))
    again = judged.filter(F.col(stays))
    if again.limit(1).count():
        once = may.join(again, match, "left_semi").dropDuplicates([id_col, text])
        stay = stay.unionByName(once)
    return stay.drop(text, may_be)
