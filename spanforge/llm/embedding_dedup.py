"""Near-duplicates among embeddings by a forest of random-projection trees.

A tree splits a cell near the median of a random projection; vectors close to the split go to both sides
(spill). Cells of more than `leaf` vectors are split again, whatever the number of vectors, but for cells
that are mostly one cluster narrower than the spill: no split helps there, and they are compared as pairs of
blocks. Only vectors of one leaf are compared, exactly; links of all trees are counted once and joined into
components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.components import components
from spanforge.llm.stage import cut, one_row

CHILD = 0.75  # a cell is split only if each side, with its spill, has this part of it at most


def _project(trees: int, levels: int, seed: int):
    """Rows (node, tree, ps): projections of the unit vector on one direction for each level of a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, np.ndarray] = {}
        for batch in batches:
            node = np.asarray(batch.column("node"))
            dim = np.asarray(batch.column("dim"))
            for d in np.unique(dim):
                if d not in axes:
                    a = np.random.default_rng([seed, int(d)]).standard_normal((trees * levels, int(d)))
                    axes[d] = a / np.linalg.norm(a, axis=1, keepdims=True)
                here = np.flatnonzero(dim == d)
                x = batch.column("v").take(pa.array(here)).flatten().to_numpy().astype(np.float64).reshape(len(here), -1)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                ps = x @ axes[d].T
                # equal projections of different vectors are told apart, far below any margin
                noise = np.random.default_rng([seed, 1]).integers(1, 2**63, trees * levels) | 1
                ps += 1e-9 * ((node[here][:, None] * noise >> 33) / 2**31)
                n = len(here)
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(node[here], trees)),
                        pa.array(np.tile(np.arange(trees, dtype=np.int32), n)),
                        pa.ListArray.from_arrays(np.arange(0, n * trees * levels + 1, levels, dtype=np.int32), pa.array(ps.ravel())),
                    ],
                    ["node", "tree", "ps"],
                )

    return run


def grow(vectors: DataFrame, trees: int, leaf: int, margin: float, levels: int, seed: int, kept: list[str]) -> DataFrame:
    """(node, leaf) of every leaf that each of `vectors(node, grp, dim, v)` falls into."""
    projected = vectors.select("node", "dim", "v").mapInArrow(_project(trees, levels, seed), "node long, tree int, ps array<double>")
    active = projected.join(vectors.select("node", "grp"), "node").select("node", F.xxhash64("grp", "tree").alias("cell"), "ps")
    active, done = cut(active, kept), []
    for level in range(levels):
        p = F.get("ps", F.lit(level))
        big = active.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx(p, [1 - CHILD, 0.5, CHILD], 500).alias("q"))
        low, mid, high = (F.get("q", F.lit(k)) for k in range(3))
        big = big.filter((F.col("n") > leaf) & (mid + margin <= high) & (mid - margin >= low))
        big = cut(big.select("cell", mid.alias("mid")), kept)
        if not big.limit(1).count():
            break
        sides = F.array_compact(
            F.array(F.when(p <= F.col("mid") + margin, F.xxhash64("cell", F.lit(1))), F.when(p > F.col("mid") - margin, F.xxhash64("cell", F.lit(2))))
        )
        both = active.join(big, "cell", "left")
        done.append(cut(both.filter("mid IS NULL").select("node", "cell"), kept))
        active = cut(both.filter("mid IS NOT NULL").select("node", F.explode(sides).alias("cell"), "ps"), kept)
    leaves = active.select("node", "cell")
    for part in done:
        leaves = leaves.union(part)
    return leaves.withColumnRenamed("cell", "leaf")


def _links(cells: np.ndarray, mine: np.ndarray, node: np.ndarray, weight: np.ndarray, x: np.ndarray, half: np.ndarray, least: float):
    """Of one leaf: per node the weight of linked nodes whose smallest common leaf it is, and a root."""
    norm = np.sqrt((x * x).sum(axis=1))
    near = (x @ x.T) / (norm[:, None] * norm[None]) >= least
    np.fill_diagonal(near, False)
    if half[0] != 2:
        near &= half[:, None] != half[None]
    some = np.flatnonzero(near.any(axis=1))
    near, node, weight, cells = near[some][:, some], node[some], weight[some], cells[some]
    n = len(some)
    label = np.arange(n)
    while n:
        low = np.minimum(label, np.where(near, label[None], n).min(axis=1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    # pairs that share a smaller leaf are counted there
    smaller = np.unique(cells[(cells != -1) & (cells < mine)])
    held = np.zeros((n, len(smaller)), dtype=np.float32)
    i, j = np.nonzero((cells != -1) & (cells < mine))
    held[i, np.searchsorted(smaller, cells[i, j])] = 1
    first = near & (held @ held.T == 0)
    return node, first @ weight, node[label]


def _compare(least: float):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.asarray(batch.column("g"))
            edges = np.flatnonzero(g[1:] != g[:-1]) + 1
            for a, b in zip([0, *edges], [*edges, len(g)], strict=True):
                if held and held[-1].column("g")[0].as_py() != g[a]:
                    yield held
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            t = pa.Table.from_batches(held)
            if t.num_rows < 2:
                continue
            lists = t["leaves"].combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy()
            cells = np.full((len(sizes), sizes.max()), -1, dtype=np.int64)
            cells[np.arange(sizes.max())[None] < sizes[:, None]] = lists.flatten().to_numpy()
            x = t["v"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(sizes), -1)
            node, half = t["node"].to_numpy(), t["half"].to_numpy()
            # two nodes' shared leaf is compared in one task or one pair of blocks: count it there
            out = _links(cells, t["leaf"][0].as_py(), node, t["weight"].to_numpy(), x, half, least)
            if len(out[0]):
                yield pa.record_batch([pa.array(c.astype(np.int64)) for c in out], ["node", "links", "root"])

    return run


def near_duplicates(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    least: float = 0.98,
    trees: int = 8,
    leaf: int = 400,
    seed: int = 11,
    kept: list[str] | None = None,
) -> DataFrame:
    """`(id_col, n_links, component_id, kept)` for every row.

    Vectors link if their labels are equal and not null (without `label_col` all are compared), they have
    the same dimension, and their cosine in double precision is `least` or more. Equal vectors are one node
    with a weight. Null or zero vectors and those with null or non-finite components link with nothing.
    Leaves that cannot be split below twice `leaf` vectors are compared by pairs of blocks, so no task gets
    an unbounded group. Repeated rows and ids are vectors of their own; a null id stays null, is never a
    component's name unless no other is there, and is not kept. An empty table gives no rows; other columns
    are not read.
    """
    kept = [] if kept is None else kept
    label = F.col(f"`{label_col}`") if label_col else F.lit(0)
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), F.col(f"`{vector_col}`").alias("v"))
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(wrong, F.lit(False)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(good, F.xxhash64("label", F.size("v"), "v")))
    named = cut(rows.select("id", "node"), kept)
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.any_value(F.xxhash64("label", F.size("v"))).alias("grp"), F.any_value("v").alias("v"), F.count("*").alias("weight")
    )
    nodes = cut(nodes.withColumn("dim", F.size("v")), kept)
    sizes = one_row(nodes.groupBy("grp").agg(F.count("*").alias("n"), F.any_value("dim").alias("d")).agg(F.max("n").alias("n"), F.min("d").alias("d")))
    levels = 1 if not sizes["n"] else 3 + max(0, math.ceil(math.log(sizes["n"] / leaf) / math.log(1 / CHILD)))
    # a linked pair's difference in a projection has about this deviation
    margin = 1.25 * math.sqrt(max(2 - 2 * least, 0) / (sizes["d"] or 1))
    leaves = cut(grow(nodes.select("node", "grp", "dim", "v"), trees, leaf, margin, levels, seed, kept), kept)
    lists = cut(leaves.groupBy("node").agg(F.collect_set("leaf").alias("leaves")), kept)
    counts = cut(leaves.groupBy("leaf").agg(F.count("*").alias("many")).filter("many > 1"), kept)
    blocks = F.ceil(F.col("many") / (2 * leaf)).cast("int")
    own = F.pmod(F.xxhash64("node", "leaf"), blocks).cast("int")
    dealt = leaves.join(counts, "leaf").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    half = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = cut(dealt.select(F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "leaf", half.alias("half"), "node"), kept)
    full = dealt.join(nodes.select("node", "v", "weight").join(lists, "node"), "node").select("g", "leaf", "half", "node", "v", "weight", "leaves")
    found = full.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(least), "node long, links long, root long")
    found = cut(found.groupBy("node", "root").agg(F.sum("links").alias("links")), kept)
    part = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), kept)
    links = cut(found.groupBy("node").agg(F.sum("links").alias("links")), kept)
    state = nodes.select("node", "weight").join(links, "node", "left").join(part.toDF("node", "part"), "node", "left")
    state = cut(state.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("part", "node").alias("part")), kept)
    joined = cut(named.join(state, "node", "left"), kept)
    first = cut(joined.filter("part IS NOT NULL").groupBy("part").agg(F.min("id").alias("first")), kept)
    linked = joined.filter("part IS NOT NULL").join(first, "part").select("id", "n_links", F.col("first").alias("component_id"))
    alone = joined.filter("part IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
