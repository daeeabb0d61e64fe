"""Each stage of the pipeline against a brute-force version of its task, and the registration."""

import random
import zlib

import numpy as np
from test_decontaminate import brute as leaks
from test_jaccard_join import roots
from tokenizers import Tokenizer

import corpus_pipeline as C
from spanforge.llm.queries import ORACLE, QUERIES, TOKENIZER

PARTS = {"en": ["the", "th", "ing", "er", "and", "of"], "de": ["sch", "ung", "ein", "zu", "ich", "der"]}


def make(spark, path):
    rng = random.Random(1)
    say = lambda lang, n: " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [(k, say("en", 30)) for k in range(4)]
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "de"])
        words = say(lang, rng.randint(30, 150)).split(" ")
        if i % 9 == 0 and rows:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            words[len(words) // 2] = "other"
        if i % 11 == 5:
            words[5:5] = items[i % 4][1].split(" ")
        if i % 7 == 3:
            words[9:9] = ["token", "=", '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"']
        rows.append((i, " ".join(words), lang))
    rows += [(100, "123 ###", "en"), (101, None, "de"), (102, "", None), (103, rows[4][1], "en"), rows[6], (None, say("de", 50), "de")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1.0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, part double")
    docs.repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    text = {}
    for name, stage in C.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            break
        assert docs.columns == columns
        after = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        if name == "language_id":
            want = [x for x in before if any(c.isalpha() for c in x[1] or "")]
        elif name == "ngram_jaccard_join":
            _, part = roots(before, 5, 80)
            best = {}
            for x, p in zip(before, part, strict=True):
                best[p] = min(best.get(p, x), x, key=lambda x: (x[0] is None, x[0] or 0))
            want = list(best.values())
            assert len(want) < len(before)
        elif name == "benchmark_decontamination":
            bad = {i for i, *_ in leaks(before, items)}
            want = [x for x in before if x[0] not in bad]
            assert bad
        else:
            import re

            want = [(i, re.sub('(?<=")[0-9a-f]{40}(?=")', "<secret>", t)) for i, t in before]
            assert want != before
        assert after == sorted(want, key=str), name
    tok = Tokenizer.from_file(TOKENIZER)
    text = dict(before)
    pieces = {}
    for r in docs.collect():
        ids = np.array([*tok.encode(text[r.doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == len(ids)
    assert pieces == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in before}
    assert C.run(spark, str(tmp_path)).count() == docs.count()


def test_every_operator_is_registered():
    import __spark_entry__ as e

    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
    assert [n for n, _ in C.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "packing"]


def test_helper_names_of_the_stages_do_not_clash(spark, tmp_path):
    from spanforge.llm import content_sort, decontaminate, jaccard_join, secret_scan

    taken = ["__id", "__same", "__rows", "__stays", "__text", "__may", "__hash", "__runs", "id", "own", "k_id", "k_own"]
    secret = "a1b2c3d4e5" * 4
    say = lambda k: " ".join("abcdefghij"[(i * 3 + k) % 10] + "klmnopq"[(i + 2 * k) % 7] + "rstuv"[i % 5] for i in range(60))
    rows = [(i, say(i // 2) + (f' token = "{secret}"' if i == 5 else "")) for i in range(8)] + [(None, None), (9, "")]
    docs = spark.createDataFrame([(*r, *range(len(taken))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in taken))
    items = spark.createDataFrame([(1, say(3))], "item_id long, text string")
    for name, left, fewer in [
        ("join", jaccard_join.one_of_each(docs), True),
        ("leaks", decontaminate.without_leaks(docs, items), True),
        ("secrets", secret_scan.redact(docs), False),
        ("copies", content_sort.without_copies(docs), True),
    ]:
        got = left.collect()
        assert left.columns == docs.columns and all(list(r)[2:] == [*range(len(taken))] for r in got)
        assert (len(got) < len(rows)) == fewer, name
