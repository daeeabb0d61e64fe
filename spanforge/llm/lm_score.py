"""Language-model scores from a log-frequency Bloom filter, and a join for what is not in it.

The filter holds the quantised counts of the corpus' frequent n-grams: of count c it has the n-gram with
each of the levels 1..1 + log_b(c / T), so a count is read by probing rising levels until one is missing. A
context's interpolation weight is held the same way. Probabilities interpolate orders by absolute
discounting, down to the exact smoothed word frequencies.

What is broadcast is bounded whatever the corpus: an n-gram is frequent if it makes up one in `share` of
all tokens, so there are `share` of an order at most. All other words and n-grams, down to those seen once,
are in a table dealt out by their hash that grows with the corpus. A log probability is a sum of what each
of a text's n-grams adds to it (`rest`), so a text meets that table in one join on the n-gram, in which no
key can be hot, because hot ones are the broadcast ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.stage import cut, one_row, slices
from spanforge.llm.tokens import END, U, Table, chain, counted, mix, owners, signed, unsigned, words

WORDS = 1 << 21  # share of frequent words
GRAMS = 1 << 18  # share of frequent n-grams of each higher order
HOT = 1 << 18  # share of the keys that joins while training broadcast
BASE = 2**0.5  # of the count levels
FADE = 1.25  # of the weight levels
FADES = 32
DISCOUNT = 0.75
HASHES = 10
FLUSH = 1 << 20


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end behind each text, and where each text's begin."""
    w = words(texts)
    return np.insert(w.hashes, w.offsets[1:], END), w.offsets + np.arange(len(w.offsets))


def tallied(parts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and counts; keys are given out whenever many have come together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(counted(part))
        size += len(held[-1][0])
        if size > FLUSH:
            merged = _merged(held)
            held, size = [merged], len(merged[0])
            if size > FLUSH // 2:
                yield merged
                held, size = [], 0
    if size:
        yield _merged(held)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)


def tally(texts: DataFrame, keys, kept: list[str]) -> DataFrame:
    """(key, n): how often keys(texts) gives each key, over the column `text` of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (keys(part.column("text")) for batch in batches for part in slices(batch, "text"))
        for k, n in tallied(found):
            yield pa.record_batch([pa.array(signed(k)), pa.array(n)], ["key", "n"])

    return cut(texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), kept)


def frequent(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of at least `least`; at most the share of them."""
    rows = counts.filter(F.col("n") >= least).toArrow()
    keys, n = unsigned(rows["key"].to_numpy()), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


class Filter:
    """A Bloom filter of (key, level), a bit each."""

    def __init__(self, entries: int):
        self.size = 1 << max(10, int(entries * HASHES * 1.44).bit_length())
        self.bits = np.zeros(self.size // 8, dtype=np.uint8)

    def _at(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        first, step = mix(keys, 31 + level), mix(keys, 131 + level) | U(1)
        for k in range(HASHES):
            yield (first + U(k) * step) & U(self.size - 1)

    def add(self, keys: np.ndarray, levels: np.ndarray) -> None:
        for level in range(1, int(levels.max(initial=0)) + 1):
            for at in self._at(keys[levels >= level], level):
                np.bitwise_or.at(self.bits, (at >> U(3)).astype(np.int64), np.uint8(1) << (at & U(7)).astype(np.uint8))

    def levels(self, keys: np.ndarray, most: int) -> np.ndarray:
        """Probe rising levels of each key until one is missing."""
        out = np.zeros(len(keys), dtype=np.int32)
        todo = np.arange(len(keys))
        for level in range(1, most + 1):
            first, step = mix(keys[todo], 31 + level), mix(keys[todo], 131 + level) | U(1)
            for k in range(HASHES):
                at = (first + U(k) * step) & U(self.size - 1)
                hit = self.bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & np.uint8(1) == 1
                todo, first, step = todo[hit], first[hit], step[hit]
            if not len(todo):
                break
            out[todo] = level
        return out


class Model(NamedTuple):
    words: Table  # frequent words and their counts
    held: Filter | None
    least: int  # count of level 1
    most: int  # highest level
    tokens: int
    kinds: int

    def unseen(self) -> float:
        return self.tokens + 0.5 * (self.kinds + 1)


TWO, THREE, WEIGHT = 43, 47, 17  # tell counts of pairs, counts of triples and weights of contexts apart


def _shifted(found: np.ndarray, offsets: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; the end before the first of a text."""
    before = np.empty_like(found)
    before[1:] = found[:-1]
    before[offsets[:-1]] = end
    return before


def grams_of(t: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pair and of the triple that end at each token, and where triples are: not at first tokens."""
    two = chain(_shifted(t, offsets, END), t)
    inner = np.ones(len(t), dtype=bool)
    inner[offsets[:-1]] = False
    return two, chain(mix(_shifted(two, offsets, U(0)), 41), t), inner


def _gram_counts(texts: DataFrame, order: int, kept: list[str]) -> DataFrame:
    """(key, left, right, n) of all pairs or triples; left and right are the keys without the last word and
    without the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                t, offsets = tokens(part.column("text"))
                two, three, inner = grams_of(t, offsets)
                if order == 2:
                    key, left, right = two, _shifted(t, offsets, END), t
                else:
                    key, left, right = three[inner], _shifted(two, offsets, U(0))[inner], two[inner]
                key, at, n = np.unique(key, return_index=True, return_counts=True)
                yield pa.record_batch([*(pa.array(signed(x)) for x in (key, left[at], right[at])), pa.array(n)], ["key", "left", "right", "n"])

    each = texts.mapInArrow(run, "key long, left long, right long, n long")
    return cut(each.groupBy("key").agg(F.min("left").alias("left"), F.min("right").alias("right"), F.sum("n").alias("n")), kept)


def train(texts: DataFrame, kept: list[str], share: int = WORDS, grams: int = GRAMS, whole: bool = False) -> tuple[Model, DataFrame]:
    """The model of the column `text`, and the exact counts (key, n) of all words.

    Without `whole` the model is one by itself: what its n-grams leave over goes to the lower order. With
    `whole` its weights are those among all n-grams, and the table is (key, n, value) of `rest`.
    """
    vocabulary = tally(texts, lambda t: tokens(t)[0], kept)
    total = one_row(vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")))
    n = total["n"]
    heavy = max(1, -(-n // share))
    table = Table(*frequent(vocabulary, heavy))
    least = max(heavy, -(-n // grams))  # words of a frequent n-gram are frequent
    two, three = _gram_counts(texts, 2, kept), _gram_counts(texts, 3, kept)
    model = Model(table, None, least, 0, n, total["v"])
    top2, top3 = (x.filter(F.col("n") >= least).toArrow() for x in (two, three))
    key2, left2, key3, left3 = (unsigned(x.to_numpy()) for x in (top2["key"], top2["left"], top3["key"], top3["left"]))
    n2, n3 = top2["n"].to_numpy(), top3["n"].to_numpy()
    q2, q3 = level_of(n2, least), level_of(n3, least)
    among = Table(key2, n2)
    if whole:
        words, pairs, vocabulary = rest(model, heavy, vocabulary, two, three, kept)
        own1, own2 = (x.toArrow() for x in (words.filter(F.col("n") >= heavy).select("key", "weight"), pairs.filter(F.col("n") >= least).select("key", "weight")))
        weight1, weight2 = np.ones(len(table.keys)), np.ones(len(key2))
        weight1[table.find(unsigned(own1["key"].to_numpy()))] = own1["weight"].to_numpy()
        weight2[among.find(unsigned(own2["key"].to_numpy()))] = own2["weight"].to_numpy()
    else:
        # mass of the kept successors of each context, by the counts that will be read
        kept2 = np.bincount(table.find(left2), weights=np.maximum(count_of(q2, least) - DISCOUNT, 0), minlength=len(table.keys))
        weight1 = 1 - kept2 / np.maximum(table.values, 1)
        kept3 = np.bincount(among.find(left3), weights=np.maximum(count_of(q3, least) - DISCOUNT, 0), minlength=len(key2))
        weight2 = 1 - kept3 / count_of(q2 + 1, least)
    keys = [mix(key2, TWO), mix(key3, THREE), mix(table.keys, WEIGHT), mix(key2, WEIGHT + 1)]
    levels = [q2, q3, fade(weight1), fade(weight2)]
    held = Filter(int(sum(x.sum() for x in levels)))
    for k, x in zip(keys, levels, strict=True):
        held.add(k, x)
    return model._replace(held=held, most=int(max(q2.max(initial=0), q3.max(initial=0)))), vocabulary


def _look(rows: DataFrame, column: str, table: DataFrame, hot: int, names: dict[str, str]) -> DataFrame:
    """`rows` with columns of the row of `table` whose key is in `column`, renamed. Rows of a key counted `hot`
    times or more meet a broadcast; they take their own key to the other join, where it matches nothing."""
    some = lambda where, tag: table.filter(where).select(F.col("key").alias(f"{tag}_key"), *[F.col(c).alias(f"{tag}_{c}") for c in names])
    rows = rows.join(F.broadcast(some(F.col("n") >= hot, "hot")), F.col(column) == F.col("hot_key"), "left")
    at = F.when(F.col("hot_key").isNotNull(), F.col("key")).otherwise(F.col(column))
    rows = rows.withColumn("at", at).join(some(F.col("n") < hot, "cold"), F.col("at") == F.col("cold_key"), "left")
    found = [F.coalesce(f"hot_{c}", f"cold_{c}").alias(new) for c, new in names.items()]
    return rows.select(*[c for c in rows.columns if not c.startswith(("hot_", "cold_")) and c != "at"], *found)


def rest(model: Model, heavy: int, vocabulary: DataFrame, two: DataFrame, three: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, n, weight) of words and of pairs, and (key, n, value) of all words and n-grams that the model does
    not hold; n is null for n-grams.

    An n-gram of count n, whose context has count c and weight w, has the probability p = (n - d) / c + w q
    with q that of its lower order. So log p is log w, which the context adds, and log q, which the lower
    order adds, and log(1 + (n - d) / (c w q)), which it adds itself. Weights and probabilities of what the
    model holds are those that are read from its filter.
    """
    least, hot = model.least, max(1, -(-model.tokens // HOT))
    shown = lambda w: F.pow(F.lit(FADE), -F.least(F.ceil(-F.log(w) / float(np.log(FADE))), F.lit(FADES)))
    level = F.floor(F.log(F.col("n") / least) / float(np.log(BASE)) + 1e-9)
    count = F.when(F.col("n") >= least, least * F.pow(F.lit(BASE), level)).otherwise(F.col("n"))
    own = F.log10(1 + (F.col("n") - DISCOUNT) / (F.col("c") * F.col("w") * F.col("q")))

    def weighed(rows: DataFrame, longer: DataFrame, held: int) -> DataFrame:
        """With the weight as a context, and as read; pairs with the end last are no context."""
        kinds = longer.groupBy(F.col("left").alias("key")).agg(F.count("*").alias("kinds"))
        rows = rows.join(kinds, "key", "left").withColumn("weight", F.coalesce(F.col("kinds") * DISCOUNT / F.col("n"), F.lit(1.0)))
        return rows.drop("kinds").withColumn("as_read", F.when(F.col("n") >= held, shown(F.col("weight"))).otherwise(F.col("weight")))

    words = cut(weighed(vocabulary, two, heavy).withColumn("p", (F.col("n") + 0.5) / F.lit(model.unseen())), kept)
    pairs = _look(_look(two, "left", words, hot, {"n": "c", "as_read": "w"}), "right", words, hot, {"p": "q"})
    pairs = pairs.select("key", "n", own.alias("own"), ((count - DISCOUNT) / F.col("c") + F.col("w") * F.col("q")).alias("p"))
    pairs = cut(weighed(pairs, three, least), kept)
    triples = _look(_look(three.filter(F.col("n") < least), "left", pairs, hot, {"n": "c", "as_read": "w"}), "right", pairs, hot, {"p": "q"})
    no_n = F.lit(None).cast("long").alias("n")
    each = words.filter(F.col("n") < heavy).select("key", "n", F.log10("weight").alias("value"))
    each = each.unionByName(pairs.filter(F.col("n") < least).select("key", no_n, (F.col("own") + F.log10("weight")).alias("value")))
    return words, pairs, cut(each.unionByName(triples.select("key", no_n, own.alias("value"))), kept)


def level_of(n: np.ndarray, least: int) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(n, least) / least) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray, least: int) -> np.ndarray:
    return least * BASE ** (level - 1.0)


def fade(weight: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(-np.log(np.clip(weight, 1e-9, 1)) / np.log(FADE)), 0, FADES).astype(np.int64)


def token_scores(model: Model, t: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among the frequent words or -1, base log10 or 0 where it is -1, model log10 less the base of
    words that are not frequent)."""
    return _token_scores(model, t, offsets)[:3]


def _token_scores(model: Model, t: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """`token_scores`, and (text, key) of all pairs and triples that the model does not hold."""
    found = model.words.find(t)
    heavy = found >= 0
    base = np.where(heavy, np.log10((model.words.values[found] + 0.5) / model.unseen()) if len(model.words.keys) else 0, 0)
    prob = 10.0**base
    end = int(model.words.find(np.array([END]))[0])
    before = _shifted(found, offsets, end)
    two, three, inner = grams_of(t, offsets)
    # two words
    after = np.flatnonzero(before >= 0)
    kinds, at = np.unique(before[after], return_inverse=True)
    weight = np.ones(len(t))
    weight[after] = (FADE ** -model.held.levels(mix(model.words.keys[kinds], WEIGHT), FADES).astype(float))[at]
    prob = prob * weight
    both = np.flatnonzero((before >= 0) & heavy)
    keys, at = np.unique(two[both], return_inverse=True)
    level = np.zeros(len(t), dtype=np.int32)
    level[both] = model.held.levels(mix(keys, TWO), model.most)[at]
    some = np.flatnonzero(level)
    prob[some] += np.maximum(count_of(level[some], model.least) - DISCOUNT, 0) / np.maximum(model.words.values[before[some]], 1)
    # three words, where the first two are a known pair
    led = _shifted(level, offsets, 0)
    after = np.flatnonzero(led)
    weight = FADE ** -model.held.levels(mix(_shifted(two, offsets, U(0))[after], WEIGHT + 1), FADES).astype(float)
    prob[after] *= weight
    last = after[level[after] > 0]
    level3 = np.zeros(len(t), dtype=np.int32)
    level3[last] = model.held.levels(mix(three[last], THREE), model.most)
    hit = np.flatnonzero(level3)
    prob[hit] += np.maximum(count_of(level3[hit], model.least) - DISCOUNT, 0) / count_of(led[hit] + 1, model.least)
    doc = owners(offsets)
    left2, left3 = level == 0, inner & (level3 == 0)
    return found, base, np.log10(np.minimum(prob, 1.0)), np.concatenate([doc[left2], doc[left3]]), np.concatenate([two[left2], three[left3]])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, offsets[:-1]) if len(values) else np.zeros(len(offsets) - 1)


ROWS = "id long, same long, key long, times int, n_tokens long, known long, base double, own double"


def _different(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (doc, key), and how often each is there."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    return doc[head], key[head], np.diff(np.append(head, len(key)))


def gram_rows(part: pa.RecordBatch, doc: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """ROWS of the different n-grams of each text, without sums."""
    doc, key, times = _different(doc, key)
    who, none = pa.array(doc), np.zeros(len(key))
    zero = pa.array(none.astype(np.int64))
    columns = [part.column("id").take(who), part.column("same").take(who), pa.array(signed(key)), pa.array(times.astype(np.int32)), zero, zero, pa.array(none), pa.array(none)]
    return pa.record_batch(columns, [c.split()[0] for c in ROWS.split(", ")])


def flagged(rows: pa.RecordBatch, gram: bool) -> pa.RecordBatch:
    return rows.append_column("gram", pa.array(np.full(rows.num_rows, gram)))


def text_rows(part: pa.RecordBatch, t: np.ndarray, offsets: np.ndarray, found: np.ndarray, base: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """ROWS of a part with columns id and same (a hash of the text): one of each text with its sums, `times`
    0, and one of each different word of it that is not frequent. A text's own row has a random key, so such
    rows spread over all partitions of a join on words and match nothing."""
    rare = np.flatnonzero(found < 0)
    doc, key, times = _different(owners(offsets)[rare], t[rare])
    n, m = part.num_rows, len(key)
    who = np.concatenate([np.arange(n), doc])
    same, none = np.asarray(part.column("same")), np.zeros(m)
    known = _sums((found >= 0).astype(np.int64), offsets)
    columns = [
        part.column("id").take(pa.array(who)),
        pa.array(same[who]),
        pa.array(signed(np.concatenate([mix(unsigned(same), 53), key]))),
        pa.array(np.concatenate([np.zeros(n, np.int32), times.astype(np.int32)])),
        pa.array(np.concatenate([np.diff(offsets), none.astype(np.int64)])),
        pa.array(np.concatenate([known, none]).astype(np.int64)),
        pa.array(np.concatenate([_sums(base, offsets), none])),
        pa.array(np.concatenate([_sums(own, offsets), none])),
    ]
    return pa.record_batch(columns, [c.split()[0] for c in ROWS.split(", ")])


def score(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", share: int = WORDS, grams: int = GRAMS, kept: list[str] | None = None
) -> DataFrame:
    """`(id_col, n_tokens, n_known, train_tokens, base_score, score)` for every row.

    The model learns from rows where `learn` is true. Tokens are words and one end of each text; n_known
    counts those seen in training. base_score is the log10 probability by smoothed word frequencies, score
    that of the model, to which every n-gram seen in training adds; both sum over all tokens of the text.

    Null and empty texts are the end alone. Null ids stay null; repeated rows and ids give a row each. With
    no training rows every token has probability 1. Other columns are not read. An empty table gives no rows.
    """
    kept = [] if kept is None else kept
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("same"), text.alias("text"), learn.alias("learn"))
    model, table = train(source.filter("learn").select("text"), kept, share, grams, whole=True)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                t, offsets = tokens(part.column("text"))
                found, base, own, doc, key = _token_scores(model, t, offsets)
                yield flagged(text_rows(part, t, offsets, found, base, own), False)
                if model.tokens:
                    yield flagged(gram_rows(part, doc, key), True)

    rows = source.drop("learn").mapInArrow(run, f"{ROWS}, gram boolean").join(table, "key", "left")
    rare = F.when(F.col("gram"), 0.0).otherwise(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(model.unseen())))
    sums = rows.groupBy("id", "same").agg(
        F.count_if(F.col("times") == 0).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + rare).alias("base_score"),
        F.sum(F.col("own") + rare + F.col("times") * F.coalesce("value", F.lit(0.0))).alias("score"),
    )
    each = [(F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("n_tokens", "n_known")]
    result = sums.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return result.select(
        F.col("id").alias(id_col), *each, F.lit(model.tokens).cast("long").alias("train_tokens"),
        *[(F.col(c) / F.col("copies")).alias(c) for c in ("base_score", "score")],
    )
