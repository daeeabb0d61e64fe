"""Probabilities against the textbook formulas, and thresholds."""

import collections
import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from spanforge.llm import kn_quality as K
from spanforge.llm.lm_score import tokens


def corpus(n, seed):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(60)]
    return [" ".join(rng.choices(lexicon, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(1, 40))) for _ in range(n)]


def reference(texts):
    pairs = collections.Counter()
    for t in texts:
        w = [None, *t.lower().split(), None]
        pairs.update(zip(w, w[1:], strict=False))
    follow = collections.Counter(b for _, b in pairs)
    uses = collections.Counter()
    for (a, _), n in pairs.items():
        uses[a] += n
    cc = lambda c: [sum(v == k for v in c.values()) for k in range(1, 5)]
    d2, d1 = K.discounts(*cc(pairs)), K.discounts(*cc(follow))
    total = sum(follow.values())
    free = sum(d1[min(n, 3) - 1] for n in follow.values())
    low = lambda w: ((follow[w] - d1[min(follow[w], 3) - 1]) / total if follow[w] else 0) + free / total / (len(follow) + 1)

    def prob(a, b):
        if not uses[a]:
            return low(b)
        gamma = sum(d2[min(n, 3) - 1] for (x, _), n in pairs.items() if x == a) / uses[a]
        own = pairs[a, b]
        return ((own - d2[min(own, 3) - 1]) / uses[a] if own else 0) + gamma * low(b)

    return prob


def test_equals_textbook_model(spark):
    texts = corpus(150, 1)
    rows = [*[(i, t) for i, t in enumerate(texts)], (900, "w1 unknown w2"), (901, None), (902, ""), (None, "w1"), (3, texts[3]), (903, "w5 " * 20_000)]
    data = spark.createDataFrame([(i, t, "l", i is not None and i < 150, 1, 2.0) for i, t in rows], "doc_id long, text string, lang string, good boolean, n int, log double")
    # training leaves a fifth out, by hash
    prob = reference([r.text for r in data.filter("good AND pmod(xxhash64(text), 5) <> 0").collect()])
    for share in (1 << 22, 60):
        got = K.judge(data, F.col("good"), share=share, pairs=1 << 30).select("doc_id", "n_tokens", F.log10("perplexity").alias("x")).collect()
        assert len(got) == len(rows)
        if share == 60:
            continue  # pairs of words that are not frequent are left to the lowest order
        by = collections.defaultdict(list)
        for r in got:
            by[r.doc_id].append(r)
        for i, t in rows:
            w = [None, *(t or "").lower().split(), None]
            want = -sum(math.log10(prob(a, b)) for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1)
            assert any(abs(r.x - want) < 1e-6 and r.n_tokens == len(w) - 1 for r in by[i]), (i, want, by[i])


def test_probabilities_sum_to_one(spark):
    texts = corpus(200, 2)
    model, lowest, unknown = K.train(spark.createDataFrame([(t,) for t in texts], "text string"), [], pairs=400)
    words = sorted({w for t in texts for w in t.split()})
    for first in ("w0", "w7", "w59"):
        total = 10**unknown * model.weight[model.words.find(tokens(pa.array([first]))[0][:1])[0]]
        for w in [*words, None]:
            t, offsets = tokens(pa.array([f"{first} {w}" if w else first]))
            total += 10 ** K.token_scores(model, t, offsets)[1][1]
        assert abs(total - 1) < 1e-6


def test_thresholds_by_language_keep_the_clean(spark):
    rng = random.Random(3)
    good = [(i, t, "a" if i % 2 else None, True) for i, t in enumerate(corpus(400, 4))]
    junk = [(1000 + i, " ".join(f"#{rng.randrange(10**9)}" for _ in range(30)), "a", False) for i in range(20)]
    got = K.judge(spark.createDataFrame(good + junk, "doc_id long, text string, lang string, good boolean"), F.col("good")).collect()
    assert sum(r.kept for r in got if r.doc_id < 1000) >= 392 and not any(r.kept for r in got if r.doc_id >= 1000)


def test_nothing_trusted_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "l"), (2, None, None)], "doc_id long, text string, lang string")
    assert all(r.kept for r in K.judge(docs, F.lit(None).cast("boolean")).collect())
    assert K.judge(docs.limit(0), F.lit(True)).count() == 0


def test_rare_pairs_count_whatever_is_broadcast(spark):
    """Pairs below the broadcast share, and pairs with words below it."""
    texts = corpus(150, 6)
    rows = [*enumerate(texts), (900, "w1 unknown w2"), (901, None), (902, " ".join(reversed(texts[0].split()))), (None, "w59 w58 w59")]
    data = spark.createDataFrame([(i, t, "l", i is not None and i < 150) for i, t in rows], "doc_id long, text string, lang string, good boolean")
    prob = reference([r.text for r in data.filter("good AND pmod(xxhash64(text), 5) <> 0").collect()])
    for share, pairs in ((1 << 22, 100), (60, 1 << 19), (1, 1)):
        got = {r.doc_id: r.x for r in K.judge(data, F.col("good"), share=share, pairs=pairs).select("doc_id", F.log10("perplexity").alias("x")).collect()}
        for i, t in rows:
            w = [None, *(t or "").split(), None]
            want = -sum(math.log10(prob(a, b)) for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1)
            assert abs(got[i] - want) < 1e-6, (share, pairs, i, want, got[i])
