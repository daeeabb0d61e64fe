"""Links and components against brute force, and the bound that the sketches rest on."""

import random

import numpy as np
import pytest

from spanforge.llm import jaccard_join as J
from spanforge.llm.tokens import U, mix


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def roots(rows, n, percent):
    sets = [shingle_set(t, n) for _, t, *_ in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                part[root(i)] = root(j)
    return sets, [root(i) for i in range(len(rows))]


def brute(rows, n, percent):
    sets, part = roots(rows, n, percent)
    groups = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups.setdefault(part[i], []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        out.append((r[0], len(sets[i]), min(groups.get(part[i], [None])) if sets[i] else r[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 50)])
def test_components_equal_brute_force(docs, corpus, n, percent):
    got = J.jaccard_components(docs, words_each=n, percent=percent).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(corpus, n, percent)


def test_one_row_of_each_component_stays(docs, corpus):
    got = J.one_of_each(docs)
    assert got.columns == docs.columns
    sets, part = roots(corpus, 5, 80)
    least = {}
    for (i, *_), words, p in zip(corpus, sets, part, strict=True):
        if words:
            least[p] = min(least.get(p, (True, 0)), (i is None, i or 0))
    stay = [r for r in got.collect() if (r.text or "").split()]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in stay) == sorted(least.values())
    assert len([r for r in got.collect() if not (r.text or "").split()]) == 4


def test_empty_table(none):
    assert J.jaccard_components(none).count() == 0
    assert J.one_of_each(none).count() == 0


def test_differing_parts_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    low = J.bands(85)
    for _ in range(200):
        n = int(rng.integers(6, 400))
        base = mix(rng.integers(0, 2**62, n).astype(U))
        drop, add = int(rng.integers(0, 1 + n // 10)), int(rng.integers(0, 1 + n // 10))
        other = np.unique(np.concatenate([base[drop:], mix(rng.integers(0, 2**62, add).astype(U))]))
        base = np.unique(base)
        both = len(np.intersect1d(base, other))
        if 100 * both < 85 * (len(base) + len(other) - both):
            continue
        band = int(np.searchsorted(low, min(len(base), len(other)), side="right")) - 1
        (x, spare_x), (y, spare_y) = J.sketch(base, band, low, 85), J.sketch(other, band, low, 85)
        if len(x):
            shared = len(np.intersect1d(x, y))
            assert shared > max(spare_x, spare_y)


def test_hot_keys_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "l"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted([tuple(r) for r in J.jaccard_components(docs).collect()], key=str) == brute(rows, 4, 85)


@pytest.mark.parametrize("held", [256, 16])
def test_a_set_moves_once_for_all_its_pairs_in_a_group(spark, monkeypatch, held):
    rng, base = np.random.default_rng(3), np.arange(1, 201, dtype=U)
    sets = {i: np.unique(np.concatenate([base[: 200 - 3 * (i % 20)], mix(rng.integers(1, 1 << 60, i % 7).astype(U))])) for i in range(60)}
    rows = [(i, len(s), bytes(J.folds(s, np.array([0, len(s)]))), s.tobytes()) for i, s in sets.items()]
    pairs = [(a, b) for b in range(60) for a in range(b)]
    moved, real = spark.sparkContext.accumulator(0), J._verify

    def counting(percent):
        def run(batches):
            def seen():
                for batch in batches:
                    moved.add(batch.num_rows - batch.column("set").null_count)
                    yield batch

            yield from real(percent)(seen())

        return run

    monkeypatch.setattr(J, "_verify", counting)
    monkeypatch.setattr(J, "HELD", held)
    got = J._linked(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, J.SETS), 85, [])
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    linked = [(a, b) for a, b in pairs if 100 * both(a, b) >= 85 * (len(sets[a]) + len(sets[b]) - both(a, b))]
    assert 0 < len(linked) < len(pairs)
    assert sorted(map(tuple, got.collect())) == sorted(linked)
    # 1,700 pairs or so: one set row for each node and group it is in
    assert 0 < moved.value <= 60 * (1 if held == 256 else 8)
