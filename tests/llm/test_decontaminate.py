"""Leaks against brute force over templates, and slots."""

import random
import re

from spanforge.llm import decontaminate as D

ITEMS = [
    (0, "A train with 5 cars goes 30 km and 5 more cars join it before it goes 40 km to the next town"),
    (1, "the cat sat on the mat while the dog ran after Anna Smith through the long green garden"),
    (2, "short one here"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10"), (6, "the cat sat on the mat while the dog ran after Anna Smith through the long green garden"),
    (7, "every morning the old baker opened his small shop before sunrise and carried 20 warm loaves to the market where people from all over the valley waited for him with 3 coins each"),
]


def templates(text):
    t = re.sub(r"\d+(?:[.,:/]\d+)*", "<n>", text or "")
    t = re.sub(rf"(<n>\s?)({D.UNITS})(?![^\W_])", r"\1<u>", t, flags=re.I)
    t = re.sub(r"(?<=[^.!?:\s]\s)[A-ZÄÖÜÉ][a-zäöüß]+", "<p>", t)
    return t.lower().split(), (text or "").split()


def brute(docs, items, window=8, share=0.6, run=13):
    out = set()
    filled = lambda words: sum(bool(re.search("<[nup]>", w)) for w in words)
    for i, text in docs:
        t, raw = templates(text)
        raw = [w.lower() for w in raw]
        for item, other in items:
            u, own = templates(other)
            own = [w.lower() for w in own]
            size = min(window, len(u))
            if not size:
                continue
            starts = range(len(u) - size + 1)
            opened = {k for k in starts if 2 * filled(u[k : k + size]) <= size}
            found, changed, longest = set(), False, 0
            by = {}
            for k in starts:
                for j in range(len(t) - size + 1):
                    exact = raw[j : j + size] == own[k : k + size]
                    if exact or k in opened and t[j : j + size] == u[k : k + size]:
                        by.setdefault(j - k, {})[k] = exact
            for shift, ks in by.items():
                slots = {(own[k + d], raw[k + shift + d]) for k in ks for d in range(size) if re.search("<[nup]>", u[k + d])}
                agree = len({a for a, _ in slots}) == len(slots)
                here = {k for k, exact in ks.items() if agree or exact}
                if here:
                    found |= here
                    changed |= agree and any(a != b for a, b in slots)
                    n = max(next(n for n in range(1, len(u) + 2) if k + n not in here) for k in here)
                    longest = max(longest, n + size - 1)
            part = max(len(found) / len(starts), len(found & opened) / len(opened) if opened else 0)
            if found and (part >= share or longest >= run):
                out.add((i, item, len(starts), len(found), longest, changed))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    words = ["red", "blue", "sun", "Moon", "7", "12", "km", "walks."]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    train = ITEMS[0][1]
    docs = [
        (1, f"{say(20)} {train} {say(9)}"),
        (2, train.replace("5", "8").replace("30", "55")),
        (3, train.replace("5 more", "6 more")),  # one value, two in the document
        (4, ITEMS[1][1].replace("Anna", "Berta")), (5, " ".join(ITEMS[1][1].split()[:9])), (6, say(300)), (7, None), (8, ""), (9, "A short one here now"),
        (10, ITEMS[1][1].upper()), (None, f"{say(5)} {train}"), (12, f"{train} {say(4)} {train.replace('5', '9')}"), (13, "9 9 9 9 9 9 9 9 9 9"),
        (14, f"{say(5000)} {ITEMS[1][1]} {say(5000)}"),
        (15, f"{say(30)} {ITEMS[5][1]} {say(30)}"),  # an item of numbers, word for word
        (16, f"{say(30)} {' '.join(ITEMS[7][1].split()[:13])} {say(30)}"), (17, " ".join(ITEMS[7][1].split()[:12])),  # 13 words of many, and 12
        (18, ITEMS[0][1].replace("5 more", "6 more").replace("town", "city").upper()),
    ]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, h string, at int")
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, h string, size int").repartition(2)
    for most in (200_000, 0):  # broadcast or shuffled
        got = D.leaks(table, bench, most_broadcast=most)
        assert {(r.doc_id, r.item_id, r.n_windows, r.found, r.longest, r.reparameterised) for r in got.collect()} == brute(docs, ITEMS)
    found = {(i, k) for i, k, *_ in brute(docs, ITEMS)}
    assert {(1, 0), (2, 0), (4, 1), (9, 2), (14, 6), (10, 1), (15, 5), (16, 7)} <= found and not {(13, 5), (17, 7)} & found and 6 not in {i for i, _ in found}
    clean = D.without_leaks(table, bench)
    assert clean.columns == table.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in found}


def test_repeated_rows_and_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEMS[0][1]), (1, ITEMS[0][1]), (1, "other text")], "doc_id long, text string")
    assert D.leaks(docs, bench).count() == 1
    assert D.without_leaks(docs, bench).count() == 1
    assert D.leaks(docs.limit(0), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0
