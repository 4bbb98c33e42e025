"""Byte-level BPE encoding and decoding by replaying the merges over a block of distinct pieces.

A task splits its texts into pieces by the vocabulary's pattern, numbers the distinct pieces of a block of texts, and lays
their bytes out in one array. An inverted index leads from each mergeable pair (by the rank of its merged token) to
its positions in all pieces. The least rank present is applied to all its positions at once; only the neighbours
of those positions are looked up anew and filed under their new ranks. That is the order in which one piece alone would
be merged, as ranks are taken in increasing order and pieces don't touch each other. A piece that is itself a
token is not merged at all, as in the public library.

Decoding turns the identifiers back into bytes. Both directions are map-only: nothing is shuffled, and a block is bounded
by ``BLOCK_BYTES`` of text (a longer text is a block of its own).

Nulls and ties: a null text is empty and has no tokens; equal ranks in one piece go to the left; repeated rows give
repeated rows; an empty table gives none. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 12 << 20
NONE = np.int32(2**31 - 1)   # no merge


class Vocabulary:
    """Ranks of byte strings, the merges they allow, and their bytes for decoding."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        ranks, size = self.ranks, max(self.ranks.values()) + 1
        self.size = size
        self.bytes_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        by_rank = sorted((rank, token) for token, rank in ranks.items())
        self.token_length = np.zeros(size, np.int64)
        self.token_length[[r for r, _ in by_rank]] = [len(t) for _, t in by_rank]
        self.token_start = np.concatenate([[0], np.cumsum(self.token_length)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.merged[at], NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[_ranges(self.token_start[ids], self.token_length[ids])].tobytes()


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def distinct(positions: np.ndarray) -> np.ndarray:
    positions = np.sort(positions)
    return positions[np.concatenate([[True], positions[1:] != positions[:-1]])] if len(positions) > 1 else positions


def replay(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all pieces, one after another, and how many each piece has."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    n = int(sizes.sum())
    token = vocabulary.bytes_rank[np.frombuffer(b"".join(pieces), np.uint8)]
    following = np.arange(1, n + 1, dtype=np.int32)
    following[np.cumsum(sizes) - 1] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[np.cumsum(sizes) - sizes] = -1
    rank = np.full(n, NONE, np.int32)          # of the pair that starts here
    heads = np.flatnonzero(following >= 0)
    rank[heads] = vocabulary.pair_rank(token[heads], token[heads + 1])
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}    # rank: positions of its pairs
    heap: list[int] = []

    def file(positions: np.ndarray) -> None:
        positions = positions[rank[positions] != NONE]
        if not len(positions):
            return
        ranks = rank[positions]
        if len(positions) > 1:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    file(heads)
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        at = distinct(np.concatenate(parts) if len(parts) > 1 else parts[0])
        at = at[rank[at] == r]
        if not len(at):
            continue
        if len(at) > 1:      # of overlapping pairs every second one, from the left
            chained = np.concatenate([[False], at[1:] == following[at[:-1]]])
            if chained.any():
                number = np.arange(len(at))
                at = at[(number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0]
        gone = following[at]
        after = following[gone]
        token[at] = r
        alive[gone] = False
        rank[gone] = NONE
        following[at] = after
        has = after >= 0
        before[after[has]] = at[has]
        left = before[at]
        touched = distinct(np.concatenate([at, left[left >= 0]]))
        right = following[touched]
        rank[touched] = np.where(right >= 0, vocabulary.pair_rank(token[touched], token[right]), NONE)
        file(touched)
    counts = np.add.reduceat(alive, np.cumsum(sizes) - sizes, dtype=np.int64) if n else np.zeros(0, np.int64)
    return token[alive], counts


class Encoder:
    """Encodes blocks of texts."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        self.vocabulary = Vocabulary(data)
        self.split = regex.compile(pattern).findall

    def block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The identifiers of each text."""
        numbers: dict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        used = [np.fromiter(map(numbers.__getitem__, self.split(t)), np.int32) for t in texts]
        pieces = [p.encode("utf-8", "surrogatepass") for p in numbers]
        del numbers
        known = self.vocabulary.ranks
        whole = np.array([known.get(p, -1) for p in pieces], np.int64)
        rest = np.flatnonzero(whole < 0)
        merged, counts = replay([pieces[i] for i in rest], self.vocabulary)
        flat = np.concatenate([merged, whole[whole >= 0]]).astype(np.uint32)
        lengths = np.ones(len(pieces), np.int64)
        lengths[rest] = counts
        starts = np.zeros(len(pieces), np.int64)
        starts[rest] = np.cumsum(counts) - counts
        starts[whole >= 0] = len(merged) + np.arange(len(pieces) - len(rest))
        for u in used:
            yield flat[_ranges(starts[u], lengths[u])] if len(u) else np.zeros(0, np.uint32)


def text_blocks(texts: list, limit: int) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if block and size + len(t) > limit:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode each text and decode it again: doc_id, n_tokens, the SHA-256 of identifiers and of decoded bytes.

    ``keep_ids`` adds the identifiers (``ids``) and the decoded bytes (``decoded``) themselves. The vocabulary file is read on
    the driver and sent to tasks; its size is fixed.
    """
    bounded_batches(docs.sparkSession)
    with open(path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(data.value, pattern)
        for batch in batches:
            keys, at = batch["doc_id"].tolist(), 0
            for block in text_blocks(batch["text"].tolist(), BLOCK_BYTES):
                rows = []
                for ids in encoder.block(block):
                    decoded = encoder.vocabulary.decode(ids)
                    row = [keys[at], len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                           hashlib.sha256(decoded).hexdigest()]
                    rows.append(row + [ids.astype(np.int32), decoded] * keep_ids)
                    at += 1
                yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256",
                                                  *["ids", "decoded"] * keep_ids])

    schema = "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(task, schema + ", ids array<int>, decoded binary" * keep_ids)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
