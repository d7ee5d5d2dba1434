"""Encoding with a public byte-level BPE tokenizer (problem 8) by merge replay.

Texts are cut into words by the tokenizer's pattern, and a task keeps its texts as
numbers of words until HELD_WORDS are held or its share of the corpus ends. Then
all distinct words that are new are laid into one array of tokens with links
between neighbours; an inverted index leads from each token pair to its positions
over all words. The merges are applied in rank order: each takes its positions
from the index, joins them, and files the pairs of the touched neighbours only.
No word is looked at again that a merge doesn't touch, and a word is encoded once
a task however often it occurs; texts get their ids by a gather over the words'.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: the word pattern of byte_bpe_50k.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of texts that a task holds at most as numbers (four bytes each) before it replays the merges.
HELD_WORDS = 20_000_000
#: A task forgets its words' ids beyond so many distinct ones, to bound memory; they are encoded again when they recur.
MEMO_WORDS = 500_000
#: Rows that are handed on at once.
SLICE_ROWS = 2000


def byte_alphabet() -> dict[str, int]:
    """The printable character that the vocabulary file writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]]]:
    """(id of each byte, (left id, right id) -> (rank, id of the merged token)) of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    byte_id = [0] * 256
    for ch, b in byte_alphabet().items():
        byte_id[b] = vocab[ch]
    merges = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return byte_id, merges


def replay(words: list[str], byte_id: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """Token ids of each word, all merged together in rank order."""
    tok: list[int] = []
    ends = []
    for w in words:
        tok += [byte_id[b] for b in w.encode("utf-8", "surrogatepass")]
        ends.append(len(tok))
    n = len(tok)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    lo = 0
    for hi in ends:
        if hi > lo:
            nxt[hi - 1], prv[lo] = n, -1
        lo = hi
    index: dict[tuple[int, int], list[int]] = {}
    for i in range(n):
        if nxt[i] < n:
            pair = (tok[i], tok[i + 1])
            if pair in merges:
                index.setdefault(pair, []).append(i)
    queue = [(merges[p][0], p) for p in index]
    heapify(queue)
    while queue:
        _, pair = heappop(queue)
        at = index.pop(pair, None)
        if at is None:
            continue
        a, b = pair
        new = merges[pair][1]
        at.sort()
        for i in at:
            j = nxt[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                p = (new, tok[k])
                if p in merges:
                    if p not in index:
                        index[p] = []
                        heappush(queue, (merges[p][0], p))
                    index[p].append(i)
            h = prv[i]
            if h >= 0:
                p = (tok[h], new)
                if p in merges:
                    if p not in index:
                        index[p] = []
                        heappush(queue, (merges[p][0], p))
                    index[p].append(h)
    out, lo = [], 0
    for hi in ends:
        out.append([t for t in tok[lo:hi] if t >= 0])
        lo = hi
    return out


class _Numbers(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts; keeps the ids of the words it has met."""

    def __init__(self, byte_id: list[int], merges: dict, pattern: str = PATTERN):
        self.byte_id, self.merges, self.find = byte_id, merges, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.tokens, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def cut(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, end of each text's); null and empty texts have none."""
        number, find = self.number, self.find
        words: list[int] = []
        ends = []
        for t in texts:
            if t:
                words += [number[w] for w in find(t)]
            ends.append(len(words))
        return np.array(words, np.int32), np.array(ends, np.int64)

    def replay(self) -> None:
        """Encode all words met since the last time, all merged together."""
        done = len(self.start) - 1
        new = list(self.number)[done:]
        if new:
            ids = replay(new, self.byte_id, self.merges)
            size = np.array([len(x) for x in ids], np.int64)
            self.tokens = np.r_[self.tokens, np.array([t for x in ids for t in x], np.int32)]
            self.start = np.r_[self.start, self.start[-1] + np.cumsum(size)]

    def sizes(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many ids the texts up to each end have."""
        return np.r_[0, np.cumsum(np.diff(self.start)[words])][ends]

    def ids(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids)."""
        size = np.diff(self.start)[words]
        after = np.cumsum(size)
        at = np.repeat(self.start[words] - (after - size), size) + np.arange(int(size.sum()))
        return self.tokens[at], np.r_[0, after][ends]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        held = self.cut(texts)
        self.replay()
        return self.ids(*held)

    def through(self, batches: Iterator[pa.RecordBatch], column: int, make) -> Iterator[pa.RecordBatch]:
        """``make(rows, words, ends)`` for slices of all batches, once their words are encoded."""
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            self.replay()
            for rows, words, ends in held:
                yield make(rows, words, ends)
            held.clear()
            if len(self.number) > MEMO_WORDS:
                self._forget()

        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                words, ends = self.cut(part.column(column).to_pylist())
                # the other columns are copied, so that the text itself is not held
                rows = part.select([i for i in range(b.num_columns) if i != column]).take(pa.array(np.arange(part.num_rows)))
                held.append((rows, words, ends))
                n += len(words)
                if n > HELD_WORDS:
                    yield from flush()
                    n = 0
        yield from flush()


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocab_path: str) -> DataFrame:
    """id_col, ids (array of int): the ids of each text without special tokens,
    whose strings count as ordinary text. Null and empty texts give an empty list;
    every row gives one, repeated rows too. Texts are taken whole. Further columns
    have no influence; an empty table gives none.
    """
    spec = df.sparkSession.sparkContext.broadcast(load_merges(vocab_path))
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(*spec.value)

        def make(rows: pa.RecordBatch, words: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            flat, after = enc.ids(words, ends)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, after].astype(np.int32)), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays([rows.column(0), ids], names=[id_col, "ids"])

        yield from enc.through(batches, 1, make)

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(df: DataFrame, columns: list[str], text_col: str, vocab_path: str) -> DataFrame:
    """``columns`` and n_tokens, the number of token ids of each text (0 for null and empty ones)."""
    spec = df.sparkSession.sparkContext.broadcast(load_merges(vocab_path))
    src = df.select(*columns, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(*spec.value)

        def make(rows: pa.RecordBatch, words: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(np.r_[0, enc.sizes(words, ends)]))], names=[*columns, "n_tokens"])

        yield from enc.through(batches, len(columns), make)

    return src.mapInArrow(run, T.StructType([*src.schema.fields[: len(columns)], T.StructField("n_tokens", T.LongType())]))
