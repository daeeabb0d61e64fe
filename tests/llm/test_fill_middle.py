"""The skip list against plain sums, and fill-in-middle texts against slicing and exact round trips."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import fill_middle


def test_skip_list_equals_sums():
    rng = random.Random(1)
    for n in [0, 1, 2, 4, 5, 17, 300, 5000]:
        widths = np.array([rng.randint(0, 90) for _ in range(n)], dtype=np.int64)
        lanes = fill_middle.SkipList(widths)
        assert n < 300 or len(lanes.lanes) > 3
        for rank in {0, n, n // 2, *(rng.randint(0, n) for _ in range(60))}:
            assert lanes.seek(rank) == widths[:rank].sum()


def brute(i, text, seed, rate, spm):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return i, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return i, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_outputs_and_round_trip(spark, corpus):
    rng = random.Random(2)
    pieces = ["a", "é", "日本", "😀", "\n", "\n\n", "<", "P>", "<S", ">", "M", "x y", "\r\n", "\t", " ", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice([1, 3, 30, 400]))) for _ in range(300)]
    texts += [None, "", "\n", "a<P>b", "<S>", "x<M>", "<P\n>", "long\n" * 60_000] + [t for _, t, _ in corpus]
    rows = [(None if k == 4 else k // 2, t, "c", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, cut int").repartition(3)
    for seed, rate, spm in [(7, 100, 50), (3, 60, 0)]:
        made = fill_middle.fill_in_middle(docs, seed=seed, rate=rate, spm=spm)
        got = made.withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
        want = sorted((brute(i, t, seed, rate, spm) for i, t, *_ in rows), key=str)
        assert sorted((tuple(r)[:-1] for r in got), key=str) == want
        assert sorted(r.back for r in got) == sorted(t or "" for _, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm"}


def test_empty(spark, none):
    assert fill_middle.fill_in_middle(none).count() == 0
