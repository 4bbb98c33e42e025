"""Token counts of a piece vocabulary, by heap-and-linked-list byte-pair merging.

A word's characters are a linked list; a heap holds the adjacent pairs that the vocabulary can merge, best rank first,
leftmost first among equals. Popping and merging until the heap is empty leaves symbols, whose number is the initial number
less the merges. Symbols outside the vocabulary count as their UTF-8 bytes (byte fallback). No identifiers are made.

No merge crosses a border between two characters that stand side by side in no piece (the start of a word is one), so the
segments between borders are counted one by one.

Nulls and ties: a null or empty text has no tokens; ties of rank go to the left pair; repeated rows give repeated rows; an
empty table gives none. Only doc_id and text are read.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import pairwise
from operator import add

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
#: Segments whose counts a task remembers at most, and their longest; then it forgets them and goes on.
MEMO, MEMO_CHARS = 500_000, 64


@dataclass
class Pieces:
    ranks: dict[str, int]     # what is merged first has the smaller rank; equal scores share one
    joined: set[str]          # the pairs of characters that stand side by side in some piece


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at:at + n]
            at += n


def load_pieces(path: str) -> Pieces:
    """The mergeable pieces of a piece model file, read on the driver (a vocabulary file has a fixed size)."""
    with open(path, "rb") as f:
        data = f.read()
    scores = {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) in (1, 4):      # normal and user-defined
                scores[piece[1].decode("utf-8")] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
    places = {score: i for i, score in enumerate(sorted(set(scores.values()), reverse=True))}
    ranks = {piece: places[score] for piece, score in scores.items()}
    return Pieces(ranks, {pair for p in ranks for pair in map(add, p, p[1:])})


def count_word(word: str, ranks: dict[str, int]) -> int:
    """Tokens of a segment, spaces already marked. A heap entry is rank and position of a pair in one integer."""
    n = len(word)
    symbols, rank_of, heap = list(word), ranks.get, []
    for i, pair in enumerate(map(add, word, word[1:])):
        rank = rank_of(pair)
        if rank is not None:
            heap.append(rank << 32 | i)
    heapify(heap)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tokens = n
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        left, j = symbols[i], following[i]
        if not left or j >= n:
            continue                      # merged since
        pair = left + symbols[j]
        if rank_of(pair) != top >> 32:
            continue                      # one of the two has grown since
        symbols[i], symbols[j] = pair, ""
        tokens -= 1
        k = following[i] = following[j]
        if k < n:
            before[k] = i
            rank = rank_of(pair + symbols[k])
            if rank is not None:
                heappush(heap, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = rank_of(symbols[h] + pair)
            if rank is not None:
                heappush(heap, rank << 32 | h)
    for s in symbols:
        if s and s not in ranks:          # only single characters can be unknown
            tokens += len(s.encode("utf-8", "surrogatepass")) - 1
    return tokens


class Counter:
    """Counts texts. Two characters that stand side by side in no piece are a border that no merge crosses; what lies
    between borders is counted once and remembered, up to a bounded number of segments."""

    def __init__(self, pieces: Pieces):
        self.ranks, self.known = pieces.ranks, {}
        chars = sorted({c for pair in pieces.joined for c in pair})
        numbers = {c: i for i, c in enumerate(chars, 1)}            # 0: any other character
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in chars]] = list(numbers.values())
        self.width = len(chars) + 1
        self.border = np.ones(self.width * self.width, bool)
        self.border[[numbers[a] * self.width + numbers[b] for a, b in pieces.joined]] = False

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        known = self.known
        if len(known) > MEMO:
            known.clear()
        marked = SPACE + text.replace(" ", SPACE)
        of = self.classes[np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = (np.flatnonzero(self.border[of[:-1] * self.width + of[1:]]) + 1).tolist()
        segments = [marked[a:b] for a, b in pairwise([0, *cuts, len(marked)])]
        new = set(segments).difference(known)
        known.update({s: count_word(s, self.ranks) for s in new})
        total = sum(map(known.__getitem__, segments))
        for s in new:
            if len(s) > MEMO_CHARS:
                del known[s]
        return total


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """op7: doc_id, n_bytes, n_tokens and whether the tokens are more than ``limit``. Map-only."""
    pieces = docs.sparkSession.sparkContext.broadcast(vars(load_pieces(path)))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = Counter(Pieces(**pieces.value))
        for batch in batches:
            yield batch[["doc_id", "n_bytes"]].assign(
                n_tokens=[count(t) if isinstance(t, str) else 0 for t in batch["text"]])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text",
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return (rows.mapInPandas(task, "doc_id string, n_bytes bigint, n_tokens bigint")
            .select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit")))
