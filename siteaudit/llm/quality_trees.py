"""Text quality from document statistics, by histogram gradient-boosted trees written in numpy.

Each whole text becomes a row of statistics (``statistics``): sizes, shares of kinds of bytes, entropy, how often words, word pairs
and lines repeat, shapes of words. They are counted with numpy for many texts at once, on bytes and word hashes.

Training: on the driver, from the statistics of a bounded sample, at most ``rows`` labelled documents, the first by a hash of the
key (20,000 by default; some five megabytes). Statistics are cut into at most ``BINS`` bins at quantiles; each tree is grown level by
level from sums of gradients by bin, and is complete, so that a forest is three arrays: statistic and threshold of each
inner node, value of each leaf. Scoring is map-only: all trees of all rows of a block go down one level at a time.

Nulls and others: a null text counts as an empty one and is scored too; a null key is never labelled. Labels other than 0 and 1 are
left out; repeated labels or documents count as rows of their own. With labels of one kind, or none, all scores are the
smoothed share of label 1. Ties between splits go to the first statistic and the lowest threshold. Repeated rows give repeated
rows; an empty table gives none. Only doc_id, text, and of the labels doc_id and quality, are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import WordScanner, blocks, mix64, word_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS, BINS = 20_000, 64
TREES, DEPTH, RATE, LEAST_WEIGHT, SHRINK = 120, 4, 0.1, 1.0, 1.0

#: Kinds of bytes whose shares are statistics; 128 and above are letters of other alphabets.
KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!?",
         b";:", b"'\"", b"()[]{}<>", b"-_", b"/\\|", b"#$%&*@^~+=`", bytes(range(128, 256)))
KIND = np.full(256, len(KINDS), np.uint8)
for _i, _kind in enumerate(KINDS):
    KIND[list(_kind)] = _i
WORDS, LINES = WordScanner(word_bytes(b" \t\n\x0b\x0c\r")), WordScanner(word_bytes(b"\n\r"))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeats(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of n texts: distinct hashes, hashes that stand once, the count of the commonest; and the count of each item."""
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(t)))
    owner = t[start]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, count)
    of_item = np.empty(len(t), np.int64)
    of_item[order] = np.repeat(count, count)
    return np.bincount(owner, minlength=n), np.bincount(owner[count == 1], minlength=n), most, of_item


def _items(scanner: WordScanner, buf: np.ndarray, offsets: np.ndarray):
    """Lengths, hashes, text and place in the buffer of the words (or lines) of a block."""
    starts, ends, hashes = scanner.scan(buf)
    return ends - starts, hashes, np.searchsorted(offsets, starts, side="right") - 1, ends


def block_statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a block."""
    n, sizes = len(offsets) - 1, np.diff(offsets) - 1
    text = np.repeat(np.arange(n), sizes + 1)
    inside = np.ones(len(buf), bool)
    inside[offsets[1:] - 1] = False
    text, body = text[inside], buf[inside]
    kinds = np.bincount(text * (len(KINDS) + 1) + KIND[body], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    histogram = np.bincount(text * 256 + body, minlength=n * 256).reshape(n, 256)
    p = _share(histogram, sizes[:, None])
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    letters = kinds[:, 0] + kinds[:, 1] + kinds[:, -2]

    length, word, owner, ends = _items(WORDS, buf, offsets)
    words = np.bincount(owner, minlength=n)
    mean = _share(np.bincount(owner, length, minlength=n), words)
    spread = np.sqrt(_share(np.bincount(owner, (length - mean[owner]) ** 2, minlength=n), words))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, length)
    distinct, once, most, _ = _repeats(owner, word, n)
    next_to = owner[1:] == owner[:-1]
    same = np.bincount(owner[1:][next_to & (word[1:] == word[:-1])], minlength=n)
    with np.errstate(over="ignore"):
        pair = mix64(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])[next_to]
    pairs = np.bincount(owner[1:][next_to], minlength=n)
    distinct_pairs, _, most_pair, _ = _repeats(owner[1:][next_to], pair, n)
    last = KIND[buf[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    closed = np.bincount(owner[np.isin(last, (6, 7, 8, 9))], minlength=n)
    odd = np.bincount(owner[np.isin(last, (10, 11, 12, 13, 14))], minlength=n)

    line_length, line, line_owner, _ = _items(LINES, buf, offsets)
    lines = np.bincount(line_owner, minlength=n)
    distinct_lines, _, _, line_count = _repeats(line_owner, line, n)
    repeated = np.bincount(line_owner[line_count > 1], line_length[line_count > 1], minlength=n)
    return np.column_stack([
        np.log1p(sizes), np.log1p(words), np.log1p(lines), _share(kinds[:, :-1], sizes[:, None]), entropy, _share(kinds[:, 1], letters),
        mean, spread, longest, _share(distinct, words), _share(once, words), _share(most, words), _share(same, words),
        _share(distinct_pairs, pairs), _share(most_pair, pairs), _share(closed, words), _share(odd, words),
        _share(sizes, lines), _share(words, lines), _share(distinct_lines, lines), _share(repeated, sizes)])


def statistics(texts: list) -> np.ndarray:
    """One row of statistics for each text; null counts as empty."""
    parts = [block_statistics(buf, offsets) for _, buf, offsets in blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, 0))


@dataclass
class Forest:
    """Complete trees: a row at node i goes to 2i + 1, or to 2i + 2 if its statistic is above the threshold."""

    base: float
    statistic: np.ndarray   # trees x inner nodes
    threshold: np.ndarray   # trees x inner nodes
    value: np.ndarray       # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The likelihood of label 1 for each row."""
        margin = np.full(len(x), self.base)
        trees, inner = self.statistic.shape
        every, row = np.arange(trees), np.arange(len(x))[:, None]
        if trees:
            node = np.zeros((len(x), trees), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[row, self.statistic[every, node]] > self.threshold[every, node])
            margin += self.value[every, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def cuts_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """The thresholds of each statistic: at most ``bins`` - 1, between values that occur."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
            out.append(values)
        else:
            out.append((values[1:] + values[:-1]) / 2)
    return out


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boost complete trees on the logistic loss; each level looks at sums of gradients by node, statistic and bin."""
    share = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(share / (1 - share))), 2 ** depth - 1
    if not 0 < y.sum() < len(y):
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = cuts_of(x)
    width = max(len(c) for c in cuts) + 1
    binned = np.column_stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T, strict=True)])
    n, columns = binned.shape
    place = binned + np.arange(columns) * width
    forest = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    margin = np.full(n, base)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, here = 2 ** level - 1, 2 ** level
            flat = ((node - first)[:, None] * (columns * width) + place).ravel()
            g, h = (np.bincount(flat, np.repeat(w, columns), minlength=here * columns * width)
                    .reshape(here, columns, width).cumsum(axis=2) for w in (gradient, curve))
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g ** 2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g ** 2 / (all_h + SHRINK)
            gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT)] = 0
            for column, c in enumerate(cuts):
                gain[:, column, len(c):] = 0
            best = gain.reshape(here, -1).argmax(axis=1)
            for i, at in enumerate(best.tolist()):
                column, b = divmod(at, width)
                if gain[i, column, b] > 1e-9:      # else all rows go left
                    forest.statistic[tree, first + i], forest.threshold[tree, first + i] = column, cuts[column][b]
            its, limit = forest.statistic[tree, node], forest.threshold[tree, node]
            node = 2 * node + 1 + (x[np.arange(n), its] > limit)
        leaf = node - inner
        g, h = (np.bincount(leaf, w, minlength=inner + 1) for w in (gradient, curve))
        forest.value[tree] = -rate * g / (h + SHRINK)
        margin += forest.value[tree][leaf]
    return forest


# ---------------------------------------------------------------- Spark jobs
def held_out(rows: DataFrame) -> DataFrame:
    """With ``held_out``: the rows that no model learns from."""
    return rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))


def measured(rows: DataFrame) -> DataFrame:
    """(doc_id, label, x): statistics in place of the text."""
    kinds = dict(rows.dtypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text").to_pylist())
            ends = pa.array(np.arange(len(x) + 1) * (x.shape[1] if len(x) else 0), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"),
                                              pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "label", "x"])

    return rows.select("doc_id", "label", "text").mapInArrow(
        task, f"doc_id {kinds['doc_id']}, label {kinds['label']}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest | None:
    """Train on at most ``rows`` of the (doc_id, label) ``labels``, and no more rows of documents; None without any."""
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    sample = labels.where("doc_id is not null and label in (0, 1)").orderBy(*order).limit(rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")      # 16 bytes a row, at most ``rows``
    found = measured(chosen).orderBy(*order, "x").limit(rows).collect()
    if not found:
        return None
    return train(np.array([r["x"] for r in found]), np.array([r["label"] for r in found], float))


def score(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """``docs`` (doc_id, text) with ``score`` in place of the text."""
    kind = dict(docs.dtypes)["doc_id"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [forest.scores(block_statistics(buf, offsets)) if forest else np.full(len(offsets) - 1, 0.5)
                     for _, buf, offsets in blocks(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([*parts, np.zeros(0)]))],
                                             ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op13: learn from the labelled rows that aren't held out, score all documents."""
    marked = held_out(labels.select("doc_id", F.col("quality").alias("label"))).where(~F.col("held_out"))
    scored = held_out(score(docs, fit(docs, marked.select("doc_id", "label"))))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
