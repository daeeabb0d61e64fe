"""Language identification of words, spans and documents.

A word is a run of letters. Its script, read off code point ranges, leaves the languages that are written
in it; each of those scores the word by the log probabilities of its letter triples. A Viterbi path over
the words of a document, with a penalty for every change of language, labels its spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.stage import slices

BUCKETS = 1 << 15  # of hashed letter triples
# First code points of script ranges (Unicode blocks), with the script's name.
RANGES = [
    (0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"),
    (0x700, "Other"), (0x750, "Arabic"), (0x780, "Other"), (0x8A0, "Arabic"), (0x900, "Devanagari"), (0x980, "Bengali"),
    (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Other"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"),
    (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1780, "Khmer"), (0x1800, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"),
    (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
SCRIPTS = sorted({name for _, name in RANGES})
_STARTS = np.array([a for a, _ in RANGES])
_NAMES = np.array([SCRIPTS.index(name) for _, name in RANGES], dtype=np.int8)


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages): log probabilities of triples
    written: np.ndarray  # (scripts, languages): may a word of the script be of the language


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


class Text(NamedTuple):
    """Words of a few texts: hashed triples of all letters, first letter of each word, script and size of
    each word, words of text i from words[i] to words[i + 1], and where each word begins in its text."""

    triples: np.ndarray
    first: np.ndarray
    script: np.ndarray
    size: np.ndarray
    words: np.ndarray
    begins: np.ndarray


def read(texts: list[str | None]) -> Text:
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    gap = np.zeros(1, dtype=np.uint32)
    c = np.concatenate([gap, *[x for t in codes for x in (t, gap)]])
    at = np.cumsum([1, *[len(t) + 1 for t in codes]])
    letter = _letters()[c]
    c = np.where(letter, c, 0)
    where = np.flatnonzero(letter)
    mixed = c[where - 1] * np.uint32(0x9E3779B1) ^ c[where] * np.uint32(0x85EBCA77) ^ c[where + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    triples = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(17)
    first = np.flatnonzero(~letter[where - 1])
    place = where[first]
    script = _NAMES[np.searchsorted(_STARTS, c[place], side="right") - 1]
    size = np.diff(np.append(first, len(where)))
    words = np.searchsorted(place, at)
    return Text(triples, first, script, size, words, place - np.repeat(at[:-1], np.diff(words)))


def word_scores(text: Text, model: Model) -> np.ndarray:
    """(words, languages); far below all others where the script rules a language out."""
    out = np.empty((len(text.first), len(model.langs)), dtype=np.float32)
    for k in range(len(model.langs)):
        out[:, k] = np.add.reduceat(model.table[k][text.triples], text.first) if len(text.first) else 0
    barred = ~model.written[text.script]
    barred[barred.all(axis=1)] = False
    out[barred] = -1e6
    return out


def viterbi(scores: np.ndarray, words: np.ndarray, switch: float) -> np.ndarray:
    """Language index of each word on the best path of its text. Texts are worked on side by side, the
    longest first, so that a step is one operation on all that are not yet over."""
    sizes = np.diff(words)
    order = np.argsort(-sizes, kind="stable")
    sizes, begin = sizes[order], words[:-1][order]
    path = np.zeros(len(scores), dtype=np.int16)
    if not len(sizes) or not sizes[0]:
        return path
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    value = scores[begin[: active[0]]].copy()
    came = np.empty(scores.shape, dtype=np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(1, sizes[0]):
        n = active[t]
        value_n = value[:n]
        top = value_n.argmax(axis=1).astype(np.int16)
        other = (value_n.max(axis=1) - np.float32(switch))[:, None]
        change = other > value_n
        rows = begin[:n] + t
        came[rows] = np.where(change, top[:, None], own)
        value[:n] = np.where(change, other, value_n) + scores[rows]
    state = np.zeros(active[0], dtype=np.int16)
    for t in range(sizes[0] - 1, -1, -1):
        n, m = active[t], active[t + 1] if t + 1 < sizes[0] else 0
        state[m:n] = value[m:n].argmax(axis=1)
        rows = begin[:n] + t
        path[rows] = state[:n]
        if t:
            state[:n] = came[rows, state[:n]]
    return path


def _table(schema: str, fn):
    """mapInArrow over parts of at most a few MB; fn(part) -> record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield fn(part)

    return run


def fit(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample: int = 20_000, most_languages: int = 256, smooth: float = 0.2
) -> Model:
    """A model from the rows with a language, at most about `sample` rows of each. Which rows is settled by a
    hash of the text; whole texts count. Null languages and texts are passed over, repeated rows count each
    time, an empty table gives a model that knows no language, other columns are not read.

    The model holds a row of scores a language, and so does each task while it counts; with more than
    `most_languages` languages this raises ValueError instead of leaving any out.
    """
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().limit(most_languages + 1).collect()  # one more tells that there are too many
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages: give fit a larger most_languages")
    langs = sorted(r["lang"] for r in sizes)
    table = np.full((len(langs), BUCKETS), smooth, dtype=np.float64)
    seen = np.zeros((len(SCRIPTS), len(langs)))
    if langs:
        part = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
        wanted = [F.when(F.col("lang") == r["lang"], part * r["count"] < sample) for r in sizes]
        place = {x: i for i, x in enumerate(langs)}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # the last SCRIPTS buckets count words by script
            sums = np.zeros((len(langs), BUCKETS + len(SCRIPTS)), dtype=np.int64)
            for batch in batches:
                for some in slices(batch, "text", 4 << 20):
                    text = read(some.column("text").to_pylist())
                    lang = np.array([place[x] for x in some.column("lang").to_pylist()])
                    of_word = np.repeat(lang, np.diff(text.words))
                    of_letter = np.repeat(of_word, text.size)
                    width = BUCKETS + len(SCRIPTS)
                    keys = np.concatenate([of_letter * width + text.triples, of_word * width + BUCKETS + text.script])
                    sums += np.bincount(keys, minlength=sums.size).reshape(sums.shape)
            at = np.flatnonzero(sums)
            yield pa.record_batch([pa.array(at), pa.array(sums.ravel()[at])], ["k", "n"])

        got = rows.filter(F.coalesce(*wanted, F.lit(False))).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        k, n = np.asarray(got["k"].combine_chunks()), np.asarray(got["n"].combine_chunks())
        lang, bucket = k // (BUCKETS + len(SCRIPTS)), k % (BUCKETS + len(SCRIPTS))
        word = bucket >= BUCKETS
        table[lang[~word], bucket[~word]] += n[~word]
        seen[bucket[word] - BUCKETS, lang[word]] = n[word]
    table = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(langs, table, seen >= 0.01 * np.maximum(seen.sum(axis=0), 1))


def labelled(texts: list[str | None], model: Model, switch: float) -> tuple[Text, np.ndarray, list[str], np.ndarray]:
    """Words, their languages, and each text's main language with its share of the letters."""
    text = read(texts)
    if not model.langs or not len(text.first):
        return text, np.full(len(text.first), -1), ["und"] * len(texts), np.zeros(len(texts))
    path = viterbi(word_scores(text, model), text.words, switch)
    doc = np.repeat(np.arange(len(texts)), np.diff(text.words))
    share = np.bincount(doc * len(model.langs) + path, weights=text.size, minlength=len(texts) * len(model.langs)).reshape(len(texts), -1)
    total = share.sum(axis=1)
    best = share.argmax(axis=1)
    return text, path, [model.langs[b] if n else "und" for b, n in zip(best, total, strict=True)], share.max(axis=1) / np.maximum(total, 1)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = 6.0) -> DataFrame:
    """`(id_col, lang_pred, score, spans)` for every row; score is the language's share of the letters, a
    span is (start, stop, lang) with character places in the lower-cased text from the first to behind the
    last letter of words of one language in a row.

    `und`, 0 and no spans for null and empty texts and those without letters, or if the model knows no
    language. Ties go to the first language by name. Repeated rows give a row each, null ids stay null, an
    empty table gives no rows, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        text, path, langs, score = labelled(part.column("text").to_pylist(), model, switch)
        doc = np.repeat(np.arange(part.num_rows), np.diff(text.words))
        new = np.ones(len(path), dtype=bool)
        new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new) if len(path) and path[0] >= 0 else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(path))[: len(head)] - 1
        start, stop = text.begins[head], text.begins[tail] + text.size[tail]
        name = [model.langs[k] for k in path[head]] if len(head) else []
        values = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(name, pa.string())], fields=list(spans.value_type))
        offsets = pa.array(np.searchsorted(doc[head] if len(head) else np.zeros(0), np.arange(part.num_rows + 1)), pa.int32())
        return pa.record_batch([part.column("id"), pa.array(langs), pa.array(score), pa.ListArray.from_arrays(offsets, values, type=spans)], ["id", "lang_pred", "score", "spans"])

    schema = "id long, lang_pred string, score double, spans array<struct<start: long, stop: long, lang: string>>"
    source = docs.selectExpr(f"cast(`{id_col}` as long) AS id", f"`{text_col}` AS text")
    return source.mapInArrow(_table(schema, run), schema).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5, switch: float = 6.0) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose main language has at least `least` of the letters;
    texts without a letter go. Rows are judged where they are read, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col))
            plain = pa.record_batch([texts, pa.array(np.arange(batch.num_rows))], ["text", "row"])
            keep = []
            for part in slices(plain, "text", 4 << 20):
                _, _, langs, score = labelled(part.column("text").to_pylist(), shared.value, switch)
                keep += [lang != "und" and s >= least for lang, s in zip(langs, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
