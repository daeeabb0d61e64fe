"""Packing against a brute-force program and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from spanforge.llm import packing

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def cost_of(size, length, short):
    return min(length - size, short) if size < length and size & (size - 1) == 0 else length - size


def brute(ends, pen, length, hard, short):
    pos, pen = [0, *ends], [0, *pen]
    best = [0] + [10**9] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            d = pos[j] - pos[i]
            if d <= length:
                best[j] = min(best[j], best[i] + cost_of(d, length, short) + pen[j])
            elif d <= 2 * length:
                best[j] = min(best[j], best[i] + 2 * length - d + hard + pen[j])
    return best[-1]


def test_windows_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        length = rng.choice([8, 16, 64])
        gaps = [rng.randint(1, length if rng.random() < 0.3 else max(2, length // 5)) for _ in range(rng.randint(1, 60))]
        ends = np.cumsum(gaps)
        pen = np.array([rng.choice([0, 2, 8]) for _ in gaps])
        found = packing.windows(ends, pen, length, 8, 4)
        assert found[0][0] == 0 and found[-1][1] == ends[-1]
        assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
        known = dict(zip(ends.tolist(), pen.tolist(), strict=True))
        cost = sum(cost_of(b - a, length, 4) + known.get(b, 8) for a, b in found)
        assert all(0 < b - a <= length for a, b in found)
        assert cost <= brute(ends.tolist(), pen.tolist(), length, 8, 4)


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_pieces_rebuild_every_document(spark, ranks):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "cat.", "sat", "naïve", "42\n", "été!"]) for _ in range(rng.choice([0, 1, 30, 700, 5000]))) for _ in range(40)]
    texts += [None, "", "a<|endoftext|>b", "x" * 9000, texts[3], texts[3]]
    ids = [*range(len(texts) - 3), 7, 7, None]
    docs = spark.createDataFrame([(i, t, 1, "o") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, start int, offset string")
    got = packing.pack(docs.coalesce(1), JSON, ranks, P.PATTERN, block=4000).toPandas()
    tok = Tokenizer.from_file(JSON)
    at = 0
    rows = got.to_dict("records")
    for name, text in zip(ids, texts, strict=True):
        want = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        done = 0
        while done < len(want):
            r = rows[at]
            assert r["doc_id"] == name or name is None and r["doc_id"] != r["doc_id"]
            assert (r["start"], r["doc_tokens"]) == (done, len(want))
            part = np.array(want[done : done + r["length"]], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            done += r["length"]
            at += 1
        assert done == len(want)
    assert at == len(rows)
    padding = total = 0
    for _, g in got.groupby("sequence_id", sort=False):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        size = g["length"].sum()
        assert size <= 1024 and (g["sequence_tokens"] == size).all()
        padding += 0 if size & (size - 1) == 0 else 1024 - size
        total += size
    assert padding < 0.02 * total


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, JSON).count() == 0
