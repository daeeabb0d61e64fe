import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, key string, node int, part string, n string, label double"


def clash(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", "k", 1, "p", "n", 0.5) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """Random documents with copies, edits, shared passages, nulls, repeated rows and ids, and a long text."""
    rng = random.Random(5)
    lexicon = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    passage = say(67)
    rows = []
    for i in range(120):
        text = say(rng.choice([1, 2, 3, 5, 8, 40, 120, 200]))
        if rows and rng.random() < 0.4:
            words = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(lexicon)
            text = " ".join(words)
        if rng.random() < 0.1:
            words = text.split(" ")
            at = rng.randrange(len(words))
            text = " ".join([*words[:at], passage, *words[at:]])
        if rng.random() < 0.2:
            text = text.upper().replace(" ", "\n", 3)
        rows.append((i, text, rng.choice(["aa", "bb", None])))
    rows += [(200, None, "aa"), (201, "", None), (202, " \n\t ", "bb"), (None, rows[3][1], "aa"), (None, None, None), (7, rows[9][1], "aa"), rows[4], rows[4]]
    rows.append((300, say(20_000), "aa"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return clash(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return clash(spark, []) if False else spark.createDataFrame([], SCHEMA)
