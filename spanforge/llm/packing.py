"""Packing of tokenised documents into fixed-length sequences by order-preserving dynamic programming."""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spanforge.llm.stage import slices

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " sequence_tokens long"
)
END_ID = 0


def windows(ends: np.ndarray, penalty: np.ndarray, length: int = 1024, hard: int = 8, short: int = 4) -> list[tuple[int, int]]:
    """Cheapest cut of the tokens 0..ends[-1] into windows of at most `length` tokens, in order.

    `ends` are rising positions where a window may end (documents, sentences), `penalty` what ending there
    costs. A window costs its padding: `length` less its tokens, or `short` if it has a smaller power of two
    of them. Besides one window from boundary to boundary, two may follow each other of which the first is
    full and cut inside a sentence, for `hard`. For each of the two a monotone queue holds the starts in
    reach by cost, so a boundary takes constant time.
    """
    pos, pen = [0, *ends.tolist()], [0, *penalty.tolist()]
    find = {p: i for i, p in enumerate(pos)}.get
    powers = [1 << k for k in range((length - 1).bit_length())]
    best, value, back, twice = [0], [0], [0], [False]
    one, two, entered = deque(), deque(), 0
    for j in range(1, len(pos)):
        p = pos[j]
        new = value[j - 1]
        while one and value[one[-1]] >= new:
            one.pop()
        one.append(j - 1)
        near = p - length
        while pos[one[0]] < near:
            one.popleft()
        while pos[entered] < near:
            new = value[entered]
            while two and value[two[-1]] >= new:
                two.pop()
            two.append(entered)
            entered += 1
        at = one[0]
        low, full = value[at] - near, False
        if two:
            far = near - length
            while two and pos[two[0]] < far:
                two.popleft()
            if two and value[two[0]] - far + hard < low:
                at, full = two[0], True
                low = value[at] - far + hard
        for size in powers:
            i = find(p - size)
            if i is not None and best[i] + short < low:
                low, at, full = best[i] + short, i, False
        low += pen[j]
        best.append(low)
        value.append(low + p)
        back.append(at)
        twice.append(full)
    out, j = [], len(pos) - 1
    while j:
        i = back[j]
        middle = pos[i] + length if twice[j] else pos[i]
        out.append((middle, pos[j]))
        if twice[j]:
            out.append((pos[i], middle))
        j = i
    return out[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray, length: int, soft: int, hard: int):
    """Positions behind the ends of sentences and documents with their penalties; stretches without any
    get one each `length` tokens, at the price of a hard cut."""
    ends = np.union1d(np.flatnonzero(stops[ids]) + 1, doc_ends)
    gaps = np.diff(ends, prepend=0)
    wide = np.flatnonzero(gaps > length)
    extra = [np.arange(e - g + length, e, length) for e, g in zip(ends[wide], gaps[wide], strict=True)]
    forced = np.concatenate([np.zeros(0, np.int64), *extra]).astype(np.int64)
    both = np.union1d(ends, forced)
    cost = np.full(len(both), soft, dtype=np.int64)
    cost[np.isin(both, forced)] = hard
    cost[np.isin(both, doc_ends)] = 0
    return both, cost


class Encoder:
    """Token ids of texts. `ranks` may name a file with the same vocabulary that a faster library reads;
    texts that spell a special token go to the tokenizer itself."""

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        size = self.slow.get_vocab_size()
        self.stops = np.zeros(size, dtype=bool)
        for token, i in self.slow.get_vocab().items():
            self.stops[i] = token[-1:] in ".!?Ċ" and token != ""  # U+010A stands for a line end
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            found = self.slow.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        found.append(END_ID)
        return np.frombuffer(array("I", found), dtype=np.uint32)


def _rows(docs: list, length: int, soft: int, hard: int, stops: np.ndarray, first: int) -> tuple[pa.RecordBatch, int]:
    names = [d[0] for d in docs]
    sizes = np.array([len(d[1]) for d in docs])
    ids = np.concatenate([d[1] for d in docs])
    doc_ends = np.cumsum(sizes)
    ends, cost = boundaries(ids, doc_ends, stops, length, soft, hard)
    cuts = np.array(windows(ends, cost, length, hard), dtype=np.int64)
    begin = np.union1d(doc_ends - sizes, cuts[:, 0])
    stop = np.append(begin[1:], doc_ends[-1])
    doc = np.searchsorted(doc_ends, begin, side="right")
    seq = np.searchsorted(cuts[:, 0], begin, side="right") - 1
    little = ids.astype("<u4")
    crc = [zlib.crc32(little[a:b].tobytes()) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
    columns = [
        pa.array([names[i] for i in doc], pa.int64()),
        pa.array(begin - (doc_ends - sizes)[doc]),
        pa.array(stop - begin),
        pa.array(crc, pa.int64()),
        pa.array(sizes[doc]),
        pa.array(seq + first),
        pa.array(begin - cuts[seq, 0]),
        pa.array((cuts[:, 1] - cuts[:, 0])[seq]),
    ]
    return pa.record_batch([c.cast(pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")]), first + len(cuts)


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 1024,
    soft: int = 2,
    hard: int = 8,
    block: int = 1 << 17,
) -> DataFrame:
    """One row per piece of a document in a sequence.

    Documents keep the order in which the input is read. Each task runs the dynamic program over blocks of
    whole documents with about `block` tokens; the last windows of a block are powers of two where that
    saves padding. There is no shuffle and no group, so one source or key with most of the rows changes
    nothing; memory holds one block or the longest document.

    Null and empty texts give one piece with the end id alone. A null id stays null, repeated rows are
    packed each, an empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, ranks, pattern)
        number = TaskContext.get().partitionId() << 40
        waiting, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for name, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encode(text or "")
                    waiting.append((name, ids))
                    size += len(ids)
                    if size >= block:
                        rows, number = _rows(waiting, length, soft, hard, encode.stops, number)
                        waiting, size = [], 0
                        yield rows
        if waiting:
            yield _rows(waiting, length, soft, hard, encode.stops, number)[0]

    return docs.selectExpr(f"cast(`{id_col}` as long) AS id", f"`{text_col}` AS text").mapInArrow(run, SCHEMA)
