"""Counts and base scores against brute force; the model's probabilities as a model."""

import collections
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanforge.llm import lm_score as L
from spanforge.llm.stage import fold
from spanforge.llm.tokens import END


def split(text):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return (text or "").encode().translate(low).split()


def test_base_score_equals_brute_force(docs, corpus):
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for share in (1 << 21, 40):  # also with few frequent words
        count = collections.Counter(w for i, t, _ in corpus if not held(i) for w in [*split(t), None])
        n, v = sum(count.values()), len(count)
        want = sorted(
            (str(i), len(split(t)) + 1, sum(count[w] > 0 for w in [*split(t), None]), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*split(t), None]), 6))
            for i, t, _ in corpus
        )
        got = L.score(docs, ~(fold(F.col("doc_id"), 5) == 1), share=share).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert {r.train_tokens for r in got} == {n}
        assert all(r.score <= 0 for r in got)


def test_empty_and_nothing_to_learn(docs, none):
    assert L.score(none, F.lit(True)).count() == 0
    rows = L.score(docs, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows)


def test_probabilities_sum_to_one_at_most(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{min(int(x), 25)}" for x in rng.geometric(0.2, 60)) for _ in range(80)]
    model, _ = L.train(spark.createDataFrame([(t,) for t in texts], "text string"), [], grams=300)
    vocabulary = sorted({w for t in texts for w in t.split()})
    for context in (["w1"], ["w2", "w1"], ["w1", "w1"], ["w9", "w3"], ["w20", "w2"]):
        total = 0.0
        for word in [*vocabulary, None]:
            t, offsets = L.tokens(pa.array([" ".join([*context, word] if word else context)]))
            _, _, own = L.token_scores(model, t, offsets)
            total += 10 ** own[len(context)]
        unseen = 0.5 / model.unseen()
        assert 0.75 < total <= 1.0 + 0.02 + unseen, (context, total)


def test_filter_gives_back_levels():
    keys = np.random.default_rng(3).integers(1, 2**62, 2000).astype(np.uint64)
    levels = np.arange(2000) % 7
    held = L.Filter(int(levels.sum()))
    held.add(keys, levels)
    got = held.levels(keys, 10)
    assert (got >= levels).all() and (got == levels).mean() > 0.99
    assert (held.levels(keys + np.uint64(1), 10) > 0).mean() < 0.01


def test_repeated_text_scores_better(spark):
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 400, n))
    known, fresh = say(60), say(60)
    rows = [(i, known) for i in range(30)] + [(100 + i, say(60)) for i in range(60)] + [(1000, known), (1001, fresh)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score - r.base_score for r in L.score(docs, F.col("doc_id") < 1000, grams=2000).collect()}
    assert got[1000] > got[1001] + 20


def test_end_token(spark):
    assert L.tokens(pa.array(["", None, "a"]))[0].tolist().count(int(END)) == 3


def interpolated(texts, unseen):
    """Brute force over all n-grams: absolute discounting of three orders."""
    one, two, three, after1, after2 = (collections.Counter() for _ in range(5))
    for text in texts:
        w = [None, *split(text), None]
        one.update(w[1:])
        two.update(zip(w, w[1:], strict=False))
        three.update(zip(w, w[1:], w[2:], strict=False))
    after1.update(a for a, _ in two)
    after2.update((a, b) for a, b, _ in three)
    d = L.DISCOUNT

    def prob(a, b, w):
        p = (one[w] + 0.5) / unseen
        if one[b]:
            p = max(two[b, w] - d, 0) / one[b] + d * after1[b] / one[b] * p
        if a != "first" and two[a, b]:
            p = max(three[a, b, w] - d, 0) / two[a, b] + d * after2[a, b] / two[a, b] * p
        return p

    return prob, len(three)


def test_every_ngram_counts(spark):
    """Also those seen once, and however few are broadcast."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(x), 60)}" for x in rng.geometric(0.08, 50)) for _ in range(60)] + ["", None]
    docs = spark.createDataFrame([*enumerate(texts), (500, texts[0]), (500, texts[0]), (None, "w1 new w2"), (501, None)], "doc_id long, text string")
    learn = F.col("doc_id") < 50
    n, v = sum(len(split(t)) + 1 for t in texts[:50]), len({w for t in texts[:50] for w in [*split(t), None]})
    prob, _ = interpolated(texts[:50], n + 0.5 * (v + 1))

    def want(text):
        w = ["first", None, *split(text), None]
        return sum(math.log10(prob(*x)) for x in zip(w, w[1:], w[2:], strict=False))

    wanted = {i: want(t) for i, t in [*enumerate(texts), (500, texts[0]), (None, "w1 new w2"), (501, None)]}
    for r in L.score(docs, learn, share=1, grams=1).collect():  # all by the join
        assert abs(r.score - wanted[r.doc_id]) < 1e-6, r
    for share, grams in ((1 << 21, 300), (30, 1 << 18)):  # the filter's levels are half powers of two
        for r in L.score(docs, learn, share=share, grams=grams).collect():
            assert abs(r.score - wanted[r.doc_id]) < 0.15 * r.n_tokens, (share, grams, r, wanted[r.doc_id])


def test_what_is_held_grows_and_improves_held_out_scores(spark):
    rng = np.random.default_rng(6)
    follow = rng.integers(0, 3000, (3000, 3))

    def say():
        at, out = int(rng.integers(3000)), []
        for _ in range(60):
            at = int(follow[at, rng.integers(3)])
            out.append(f"w{at}")
        return " ".join(out)

    texts = [(i, say()) for i in range(900)]
    held, gain = [], []
    for n in (200, 800):
        model, table = L.train(spark.createDataFrame(texts[:n], "doc_id long, text string").select("text"), [], grams=300, whole=True)
        held.append(table.filter("n IS NULL").count())
        data = spark.createDataFrame([*texts[:n], *texts[800:]], "doc_id long, text string")
        got = L.score(data, F.col("doc_id") < 800, grams=300).filter("doc_id >= 800").agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()[0]
        gain.append(got)
    assert held[1] > 1.5 * held[0] and gain[1] > gain[0] + 0.3 and gain[1] > 1, (held, gain)
