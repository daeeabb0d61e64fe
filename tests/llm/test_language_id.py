"""Paths against brute force, accuracy on held-out texts, spans of mixed text, odd rows."""

import itertools
import random

import numpy as np
import pytest

from spanforge.llm import language_id as L

PARTS = {"en": ["the", "th", "ing", "er", "and", "of"], "de": ["sch", "ung", "ein", "ö", "ich", "der"], "ru": ["ост", "при", "ени", "ать"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_path_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(0, 6, 5)
        words = np.concatenate([[0], np.cumsum(sizes)])
        scores = rng.normal(0, 4, (words[-1], 3)).astype(np.float32)
        got = L.viterbi(scores, words, 3.0)
        for a, b in zip(words[:-1], words[1:], strict=True):
            def value(path, a=a):
                return sum(scores[a + k, s] for k, s in enumerate(path)) - 3.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))

            if b > a:
                best = max(value(p) for p in itertools.product(range(3), repeat=b - a))
                assert abs(value(tuple(got[a:b])) - best) < 1e-3


def model_of(spark):
    rng = random.Random(1)
    rows = [(i, say(rng, lang, 60), lang, 1.0, "x") for i, lang in enumerate(["en", "de", "ru"] * 60)] + [(999, "no language", None, 1.0, "x"), (998, None, "en", 1.0, "x")]
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, spans string"), sample=50)


def test_held_out_accuracy_and_spans(spark):
    rng = random.Random(2)
    model = model_of(spark)
    assert model.langs == ["de", "en", "ru"]
    rows = [(i, say(rng, lang, 25), lang) for i, lang in enumerate(["en", "de", "ru"] * 30)]
    rows.append((500, say(rng, "en", 30) + " 12 -- " + say(rng, "de", 10) + "\n" + say(rng, "ru", 8), "en"))
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 88
    mixed = got[500]
    assert [s.lang for s in mixed.spans] == ["en", "de", "ru"] and 0.4 < mixed.score < 1
    text = rows[-1][1].lower()
    assert text[mixed.spans[2].start : mixed.spans[2].stop] == text.split("\n")[1]


def test_odd_rows(spark):
    model = model_of(spark)
    long = say(random.Random(3), "de", 30_000)
    rows = [(1, None), (2, ""), (3, "12 ### -- 5"), (None, "the thing"), (5, "the thing"), (5, "the thing"), (6, long), (7, "漢字"), (8, "İİ the ﬁ")]
    docs = spark.createDataFrame([(i, t, "zz", 0.0, "s") for i, t in rows], "doc_id long, text string, lang_pred string, score double, id string")
    got = {(r.doc_id, r.lang_pred) for r in L.identify(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "en"), (6, "de")} <= got
    assert L.identify(docs, model).count() == len(rows)
    assert all(0 <= r.score <= 1 for r in L.identify(docs, model).collect())
    stay = L.keep_identified(docs, model)
    assert stay.columns == docs.columns and {1, 2, 3}.isdisjoint({r.doc_id for r in stay.collect()})
    assert L.identify(docs.limit(0), model).count() == 0
    nothing = L.fit(docs.withColumnRenamed("lang_pred", "lang").limit(0))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}


def test_script_rules_out_languages(spark):
    model = model_of(spark)
    scores = L.word_scores(L.read(["при the"]), model)
    assert scores[0].argmax() == 2 and scores[0][0] < -1e5 and scores[1][2] < -1e5


def test_many_languages_are_all_learned_or_refused(spark):
    rows = [(i, f"w{i}", " ".join(chr(97 + (i * 7 + k * k) % 26) + chr(97 + i % 26) + chr(97 + i // 26 % 26) for k in range(12))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    with pytest.raises(ValueError, match="languages"):
        L.fit(docs)
    assert L.fit(docs, most_languages=300).langs == sorted(r[1] for r in rows)
