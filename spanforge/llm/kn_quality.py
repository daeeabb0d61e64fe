"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Words and word pairs of the trusted documents are counted in tables dealt out by hash. A document meets
the counts of its words and pairs in a join on their hash; only the frequent words, of which there are
`share` at most because each makes up one in `share` tokens, and the pairs of them that make up one in
`pairs`, are broadcast instead, so that no key of the join is hot. A pair of share s of its context, whose
weight is w, has the probability s + w q with q of the lowest order, so it adds log(1 + s / (w q)) to what its
words add by themselves, and a text's log probability is a sum over its words and pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.jaccard_join import filter_bits, in_filter
from spanforge.llm.lm_score import ROWS, _shifted, flagged, frequent, gram_rows, tallied, tally, text_rows, tokens
from spanforge.llm.stage import cut, one_row, slices
from spanforge.llm.tokens import END, U, Table, chain, mix, owners, signed, unsigned

WORDS = 1 << 22
PAIRS = 1 << 19
PLACE = U(22)
RARE = U(1 << 63)  # tells hashes of pairs from those made of places
PAIR = 59  # tells keys of pairs from those of words
LEAST = 1e-200  # of a weight


class Model(NamedTuple):
    words: Table  # frequent words and the log10 of their lowest-order probability
    uses: np.ndarray  # how often each is a context
    weight: np.ndarray  # interpolation weight of each as a context of `pairs` alone
    free: np.ndarray  # what is discounted of all pairs of each as a context
    pairs: Table  # frequent pairs and their discounted share of the context


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """For counts 1, 2 and more, from how many have count 1 to 4; fixed ones where too few are there."""
    if min(n1, n2, n3) == 0:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [max(0.0, 1 - 2 * y * n2 / n1), max(0.0, 2 - 3 * y * n3 / n2), min(max(0.0, 3 - 4 * y * n4 / n3), 3.0)]


def _counts_of_counts(counts: DataFrame, column: str) -> dict:
    some = [F.count_if(F.col(column) == k).alias(f"n{k}") for k in range(1, 5)]
    return one_row(counts.agg(*some, F.count_if(F.col(column) >= 3).alias("more"), F.coalesce(F.sum(column), F.lit(0)).alias("sum"), F.count("*").alias("kinds")))


def train(texts: DataFrame, kept: list[str], share: int = WORDS, pairs: int = PAIRS) -> tuple[Model, DataFrame, float]:
    """The model, the table (key, value) of what words and all pairs that it does not hold add to a log10
    probability, and that of an unknown word."""
    seen = tally(texts, lambda t: tokens(t)[0], kept)
    n = one_row(seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))["n"]
    names, uses = frequent(seen, max(1, -(-n // share)))
    table = Table(names, uses)
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pair, first, word, n); a pair of frequent words is their places, and its words are not given."""
        table = shared.value
        end = int(table.find(np.array([END]))[0])

        def rows(part: pa.RecordBatch, plain: bool) -> np.ndarray:
            t, offsets = tokens(part.column("text"))
            found, before = table.find(t), _shifted(t, offsets, END)
            first = _shifted(found, offsets, end)
            both = (found >= 0) & (first >= 0)
            if plain:
                return (first[both].astype(U) << PLACE) | found[both].astype(U)
            rest = ~both
            return np.stack([chain(before[rest], t[rest]), before[rest], t[rest]], axis=1)

        for batch in batches:
            for part in slices(batch, "text"):
                some = rows(part, False)
                if len(some):
                    some, times = np.unique(some, axis=0, return_counts=True)
                    key, first, word = (pa.array(signed(np.ascontiguousarray(x))) for x in (some[:, 0] | RARE, some[:, 1], some[:, 2]))
                    yield pa.record_batch([key, first, word, pa.array(times)], ["pair", "first", "word", "n"])
                for k, times in tallied(iter([rows(part, True)])):
                    none = pa.array(np.zeros(len(k), np.int64))
                    yield pa.record_batch([pa.array(signed(k)), none, none, pa.array(times)], ["pair", "first", "word", "n"])

    counts = texts.mapInArrow(run, "pair long, first long, word long, n long").groupBy("pair", "first", "word").agg(F.sum("n").alias("n"))
    counts = cut(counts, kept)
    d2 = discounts(*[_counts_of_counts(counts, "n")[f"n{k}"] for k in range(1, 5)])
    less = F.when(F.col("n") == 1, d2[0]).when(F.col("n") == 2, d2[1]).otherwise(d2[2])
    # lowest order: of how many different pairs a word is the second; and what is discounted of those it leads
    by_place = counts.filter("pair >= 0").groupBy((F.col("pair") % (1 << 22)).alias("place")).agg(F.count("*").alias("m")).toArrow()
    heavy = np.zeros(len(names), dtype=np.int64)
    heavy[by_place["place"].to_numpy()] = by_place["m"].to_numpy()
    by_first = counts.filter("pair >= 0").groupBy(F.shiftright("pair", int(PLACE)).alias("place")).agg(F.sum(less).alias("free")).toArrow()
    led = np.zeros(len(names))
    led[by_first["place"].to_numpy()] = by_first["free"].to_numpy()
    rest = counts.filter("pair < 0")
    second = rest.groupBy(F.col("word").alias("key")).agg(F.count("*").alias("m")).select("key", "m", F.lit(0.0).alias("free"), F.lit(0).cast("long").alias("uses"))
    first = rest.groupBy(F.col("first").alias("key")).agg(F.sum(less).alias("free"), F.sum("n").alias("uses")).select("key", F.lit(0).cast("long").alias("m"), "free", "uses")
    own = pa.table({"key": pa.array(signed(names)), "m": pa.array(heavy), "free": pa.array(led), "uses": pa.array(np.zeros(len(names), np.int64))}).to_pandas()  # `share` rows at most
    m = second.unionByName(first).unionByName(texts.sparkSession.createDataFrame(own, "key long, m long, free double, uses long"))
    m = cut(m.groupBy("key").agg(*[F.sum(x).alias(x) for x in ("m", "free", "uses")]).filter("m > 0"), kept)
    c = _counts_of_counts(m, "m")
    d1 = discounts(*[c[f"n{k}"] for k in range(1, 5)])
    free = d1[0] * c["n1"] + d1[1] * c["n2"] + d1[2] * c["more"]
    even = free / max(c["sum"], 1) / (c["kinds"] + 1) if c["sum"] else 1.0
    taken = F.when(F.col("m") == 1, d1[0]).when(F.col("m") == 2, d1[1]).otherwise(d1[2])
    lowest = cut(m.select("key", F.log10((F.col("m") - taken) / max(c["sum"], 1) + even).alias("lowest"), F.greatest("free", F.lit(LEAST)).alias("free"), "uses"), kept)

    least = max(1, -(-n // pairs))
    keys, times = frequent(counts.filter("pair >= 0").select(F.col("pair").alias("key"), "n"), least)
    first = (keys >> PLACE).astype(np.int64)
    part = (times - np.choose(np.minimum(times, 3) - 1, d2)) / uses[first] if len(keys) else np.zeros(0)
    weight = 1 - np.bincount(first, weights=part, minlength=len(names))
    logs = np.full(len(names), np.log10(even))
    # frequent words' rows of the table; `share` at most
    got = lowest.join(texts.sparkSession.createDataFrame(own[["key"]], "key long"), "key").toArrow()
    at = table.find(got["key"].to_numpy().view(U))
    logs[at] = got["lowest"].to_numpy()
    free = uses.astype(float)
    free[at] = got["free"].to_numpy()
    model = Model(Table(names, logs), uses, weight, free, Table(keys, part))
    return model, _rest(model, counts.filter((F.col("pair") < 0) | (F.col("n") < least)), lowest, F.col("n") - less, kept), float(np.log10(even))


def _rest(model: Model, pairs: DataFrame, lowest: DataFrame, own: Column, kept: list[str]) -> DataFrame:
    """(key, value) of words and of `pairs`. What is known of frequent words is in the model; a pair takes its
    own key instead of theirs to the joins, so that no key is hot."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            pair, first, word = (unsigned(batch.column(c).to_numpy()) for c in ("pair", "first", "word"))
            plain = pair < RARE
            left = np.where(plain, (pair >> PLACE).astype(np.int64), model.words.find(first))
            right = np.where(plain, (pair & U((1 << int(PLACE)) - 1)).astype(np.int64), model.words.find(word))
            key = mix(pair, PAIR)
            some = model.free if len(model.free) else np.zeros(1)
            logs = model.words.values if len(model.free) else np.zeros(1)
            columns = [
                pa.array(signed(key)), batch.column("own"),
                pa.array(signed(np.where(left >= 0, key, first))), pa.array(some[left], mask=left < 0),
                pa.array(signed(np.where(right >= 0, key, word))), pa.array(logs[right], mask=right < 0),
            ]
            yield pa.record_batch(columns, ["key", "own", "first", "free", "word", "lowest"])

    rows = pairs.select("pair", "first", "word", own.alias("own")).mapInArrow(run, "key long, own double, first long, free double, word long, lowest double")
    known = F.col("free").isNotNull() & F.col("lowest").isNotNull()
    met = rows.filter(~known).join(lowest.select(F.col("key").alias("first"), F.col("free").alias("rare_free")), "first", "left")
    met = met.join(lowest.select(F.col("key").alias("word"), F.col("lowest").alias("rare_lowest")), "word", "left")
    met = met.select("key", "own", F.coalesce("free", "rare_free").alias("free"), F.coalesce("lowest", "rare_lowest").alias("lowest"))
    rows = rows.filter(known).select("key", "own", "free", "lowest").unionByName(met)
    share = F.col("own") / F.col("free") / F.pow(F.lit(10.0), F.col("lowest"))
    context = F.when(F.col("uses") > 0, F.log10(F.col("free") / F.col("uses"))).otherwise(0.0)
    words = lowest.select("key", (F.col("lowest") + context).alias("value"), F.lit(False).alias("pair"))
    return cut(words.unionByName(rows.select("key", F.log10(1 + share).alias("value"), F.lit(True).alias("pair"))), kept)


def token_scores(model: Model, t: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each token among the frequent words or -1, its log10 probability if there are no pairs but the
    model's; without the lowest order's for words that are not frequent)."""
    return _token_scores(model, model.weight, t, offsets)[:2]


def _token_scores(model: Model, weight: np.ndarray, t: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`token_scores` with the weights of contexts given, and the tokens whose pair the model does not hold
    with its key."""
    found, before = model.words.find(t), _shifted(t, offsets, END)
    first = _shifted(found, offsets, int(model.words.find(np.array([END]))[0]))
    both = (found >= 0) & (first >= 0)
    pair = np.where(both, (first.astype(U) << PLACE) | found.astype(U), chain(before, t) | RARE)
    if not len(model.uses):
        return found, np.zeros(len(t)), np.arange(len(t)), mix(pair, PAIR)
    prob = np.where(found >= 0, 10.0 ** model.words.values[found], 1.0) * np.where(first >= 0, weight[first], 1.0)
    place = np.full(len(t), -1)
    place[both] = model.pairs.find(pair[both])
    hit = np.flatnonzero(place >= 0)
    prob[hit] += model.pairs.values[place[hit]]
    left = np.flatnonzero(place < 0)
    return found, np.log10(np.maximum(prob, 1e-300)), left, mix(pair[left], PAIR)


def judge(
    docs: DataFrame,
    trusted: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = 0.99,
    slack: float = 0.4,
    enough: int = 20,
    share: int = WORDS,
    pairs: int = PAIRS,
    kept: list[str] | None = None,
) -> DataFrame:
    """`(id_col, lang, n_tokens, perplexity, threshold, kept)` for every row.

    `trusted` tells the documents to learn from; a fifth of them, by a hash of the text, is left out of
    training and sets the thresholds instead: a language's is the `quantile` of their log perplexity plus
    `slack`, that of all languages together where there are fewer than `enough` of one, none if there are
    fewer of all. A document is kept if its perplexity is no more than its language's threshold.

    Null and empty texts are the end alone; a null language is a language. Null ids stay null, repeated rows
    and ids give a row each, an empty table gives no rows, a null `trusted` counts as false, other columns
    are not read.
    """
    kept = [] if kept is None else kept
    text = F.col(f"`{text_col}`")
    same = F.xxhash64(F.coalesce(text, F.lit("")))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), same.alias("same"), text.alias("text"), F.coalesce(trusted, F.lit(False)).alias("trusted"), F.col(f"`{lang_col}`").alias("lang"))
    tuned = F.pmod("same", F.lit(5)) == 0
    model, table, unknown = train(source.filter(F.col("trusted") & ~tuned).select("text"), kept, share, pairs)
    weight = model.free / np.maximum(model.uses, 1)
    # pairs that no trusted text has add nothing, and need not move
    shared = docs.sparkSession.sparkContext.broadcast((model, weight, filter_bits(table.filter("pair").select(F.col("key").alias("node")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weight, bits = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                t, offsets = tokens(part.column("text"))
                found, own, left, key = _token_scores(model, weight, t, offsets)
                yield flagged(text_rows(part, t, offsets, found, np.zeros(len(t)), own), False)
                some = in_filter(key, bits)
                yield flagged(gram_rows(part, owners(offsets)[left[some]], key[some]), True)

    rows = source.select("id", "same", "text").mapInArrow(run, f"{ROWS}, gram boolean").join(table.select("key", "value"), "key", "left")
    value = F.col("own") + F.col("times") * F.coalesce("value", F.when(F.col("gram"), 0.0).otherwise(unknown))
    sums = rows.groupBy("id", "same").agg(F.sum(value).alias("log"), F.sum("n_tokens").alias("n"), F.count_if(F.col("times") == 0).alias("copies"))
    own = sums.select("id", "same", (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), (-F.col("log") / F.col("n")).alias("log"))
    plain = source.select("id", "same", "trusted", "lang").alias("d")
    found = plain.join(own.alias("o"), F.col("d.id").eqNullSafe(F.col("o.id")) & (F.col("d.same") == F.col("o.same"))).select("d.*", "n_tokens", "log")
    found = cut(found, kept)
    tuning = found.filter(F.col("trusted") & tuned)
    cutoff = F.percentile_approx("log", quantile, 10_000) + slack
    overall = one_row(tuning.agg(F.count("*").alias("n"), cutoff.alias("t")))
    general = overall["t"] if overall["n"] >= enough else float("inf")
    by_lang = tuning.groupBy("lang").agg(F.count("*").alias("n"), cutoff.alias("t")).filter(F.col("n") >= enough)
    limits = cut(by_lang.select(F.col("lang").alias("of"), "t"), kept)
    joined = found.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("t", F.coalesce("t", F.lit(general)))
    power = lambda x: F.pow(F.lit(10.0), x)
    return joined.select(F.col("id").alias(id_col), "lang", "n_tokens", power(F.col("log")).alias("perplexity"), power(F.col("t")).alias("threshold"), (F.col("log") <= F.col("t")).alias("kept"))
