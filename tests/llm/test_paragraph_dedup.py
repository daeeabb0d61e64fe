"""Repeated passages against brute force, near copies of lines, odd rows."""

import random

import pyarrow as pa

from spanforge.llm import paragraph_dedup as P


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_every_long_repeated_passage_is_found(spark):
    rng = random.Random(1)
    passages = [say(rng, n) for n in (51, 67, 80)]
    rows, planted = [], set()
    for i in range(60):
        text = say(rng, rng.randint(5, 200))
        if i % 3 == 0:
            words = text.split(" ")
            at = rng.randrange(len(words) + 1)
            text = rng.choice([" ", "\n"]).join([" ".join(words[:at]), passages[i // 3 % 3].replace(" ", "\n", i % 2), " ".join(words[at:])])
            planted.add(i)
        rows.append((i, text))
    near = say(rng, 120).split(" ")
    rows.append((100, " ".join(near)))
    near[60] = "changed"
    rows.append((101, "Start.\n" + " ".join(near).upper()))
    rows += [(200, None), (201, ""), (202, rows[1][1]), (202, rows[1][1]), (None, rows[2][1]), (203, "word " * 3000), (204, "short\nshort\nshort"), (205, say(rng, 20_000))]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, start int, node string, part string").repartition(3)
    got = P.repeated_paragraphs(docs).collect()
    found = {r.doc_id for r in got}
    copies = {1, 202} | ({2, None} if len(rows[2][1].split()) >= 50 else set())
    assert planted | {100, 101} <= found
    assert found <= planted | {100, 101, 1, 2, 202, None} and (copies <= found or len(rows[1][1].split()) < 50)
    text = dict(rows)
    for r in got:
        if r.doc_id in planted:
            part = text[r.doc_id].encode()[r.start : r.stop].decode()
            assert len(part.split()) == r.n_words
    # the first of each passage stays
    for k in range(3):
        removed = sorted(r.doc_id for r in got if r.removed and r.doc_id in planted and r.doc_id // 3 % 3 == k)
        stays = sorted(r.doc_id for r in got if not r.removed and r.doc_id in planted and r.doc_id // 3 % 3 == k)
        assert stays and stays[0] == 3 * k and removed


def test_short_lines_against_all_pairs(spark):
    rng = random.Random(4)
    lines: dict[int, list[str]] = {i: [say(rng, rng.randint(5, 40)) for _ in range(3)] for i in range(160)}
    for i in range(0, 160, 2):  # a line of the next document: as it is, or with its middle word changed
        n = (7, 15, 30, 49)[i // 2 % 4]
        one = say(rng, n).split(" ")
        two = [*one[: n // 2], "changed", *one[n // 2 + 1 :]] if n == 49 and i % 16 == 6 else one
        lines[i].insert(1, " ".join(one))
        lines[i + 1].insert(rng.randrange(3), " ".join(two).upper())
    grams = [
        (i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, some in lines.items() for w in (x.lower().split(" ") for x in some)
    ]
    expected = {i for a, (i, x) in enumerate(grams) for b, (j, y) in enumerate(grams) if i != j and 100 * len(x & y) >= 80 * len(x | y)}
    assert len(expected) == 160
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in lines.items()], "doc_id long, text string").repartition(4)
    found = {r.doc_id for r in P.repeated_paragraphs(docs, shape=P.Shape(line=5)).collect()}
    assert found <= expected and len(found) >= 0.95 * len(expected)


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.998), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = P.tune(s, recall)
        assert bands <= 12 and 1 - (1 - s**rows) ** bands >= recall


def test_each_passage_has_a_window_at_the_same_place():
    rng = random.Random(2)
    shape = P.Shape()
    for _ in range(50):
        passage = say(rng, shape.span + shape.window - 1)
        one, two = (P.units(pa.array([f"{say(rng, rng.randint(0, 40))} {passage} {say(rng, rng.randint(0, 40))}".strip()]), shape) for _ in range(2))
        assert set(one.node.tolist()) & set(two.node.tolist())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.repeated_paragraphs(docs).count() == 0
