"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most ``PASSAGE_WORDS`` words. Their TF-IDF matrix, with document frequencies counted
over all documents, is factored by a randomised singular value decomposition: Spark tasks multiply their rows with a thin
matrix and its transpose, sums over rows are taken by feature, and only the thin matrices (words of the benchmark block times
``RANK``) reach the driver. The windows of every document are projected into the same space. A window is a candidate for a
passage if their latent cosine is at least ``COSINE`` and its projection covers at least ``COVER`` of the passage's latent length.

A candidate is confirmed by the longest common subsequence of words between the passage and the text around the window: at least
``COPIED`` of the passage, or at least ``PARAPHRASED`` if also the answer, the passage's last ``ANSWER_WORDS`` words, stands there
word for word.

Words are runs of letters, digits and non-ASCII, lower-cased, compared by 64-bit hashes. Windows begin at a text's own first word
and end with the text, so a document's rows depend on no other document. Items under ``LEAST_WORDS`` words have too few
words for a latent direction: they are looked up exactly, word for word, where ``short`` asks for them; a filter shouldn't, as
any text may hold them. The benchmark is a query set; it is taken in blocks of ``BLOCK_WORDS`` words, and each block is compared
with all documents.

Nulls and others: a null or empty text matches nothing; a null item text or item_id is left out; rows that repeat an item give
its rows once; rows that repeat a doc_id give one row with their best score. Empty tables give no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import WordScanner, blocks, bounded_batches, mix64, word_bytes, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PASSAGE_WORDS, LEAST_WORDS, BLOCK_WORDS = 64, 4, 1 << 16
RANK, POWERS, SEED = 64, 2, 17
WINDOW, STRIDE = 32, 8
COSINE, COVER = 0.35, 0.4
COPIED, PARAPHRASED, ANSWER_WORDS = 0.7, 0.5, 6
#: Products of windows and passages that a task holds at once.
CELLS = 1 << 22

SEPARATORS = bytes(i for i in range(128) if not chr(i).isalnum())

MATCHES = "item_id bigint, score double, cosine double, answer boolean"


def scanner() -> WordScanner:
    return WordScanner(word_bytes(SEPARATORS))


def folded(texts: list) -> list:
    """Texts with all letters lower-cased, so that copies in capitals are met too."""
    return [t.lower() if isinstance(t, str) else None for t in texts]


def passages(items: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    """(item_id, word hashes) of the passages of all items."""
    out, scan = [], scanner()
    for first, buf, offsets in blocks(folded([t for _, t in items])):
        starts, _, hashes = scan.scan(buf)
        bounds = np.searchsorted(starts, offsets)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            parts = max(1, round((b - a) / PASSAGE_WORDS))
            for part in np.array_split(hashes[a:b], parts):
                if len(part):
                    out.append((items[first + i][0], part))
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one machine word of state per word of ``a`` (bit-parallel)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def contains(text: np.ndarray, phrase: np.ndarray) -> bool:
    return any(np.array_equal(text[i:i + len(phrase)], phrase) for i in np.flatnonzero(text == phrase[0]))


def phrase_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """One key for each run of ``n`` consecutive words; the order of the words counts."""
    out = hashes[:len(hashes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out = mix64(out) + hashes[i:len(hashes) - n + 1 + i]
    return out


class ShortItems:
    """Items under ``LEAST_WORDS`` words, found where their words stand one after another."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.by_words: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(q) for _, q in items}:
            mine = [(phrase_keys(q, n)[0], i) for i, q in items if len(q) == n]
            keys, ids = np.array([k for k, _ in mine], np.uint64), np.array([i for _, i in mine], np.int64)
            order = np.argsort(keys, kind="stable")
            self.by_words[n] = keys[order], ids[order]

    def found(self, text: np.ndarray) -> set[int]:
        out: set[int] = set()
        for n, (keys, ids) in self.by_words.items():
            if len(text) >= n:
                seen = np.unique(phrase_keys(text, n))
                low, high = np.searchsorted(keys, seen, "left"), np.searchsorted(keys, seen, "right")
                for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    out.update(ids[a:b].tolist())
        return out


class Space:
    """The words of a benchmark block, their weights, the latent basis and the passages in it."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, basis: np.ndarray, queries: list[tuple[int, np.ndarray]]):
        self.vocabulary, self.queries = vocabulary, queries
        # the last row stands for all words outside of the benchmark, which have no share in the space
        self.weighted = np.vstack([idf[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
        latent = np.stack([self.weighted[self.features(q)].sum(axis=0) for _, q in queries])
        self.length = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
        self.unit = (latent / self.length[:, None]).astype(np.float32)
        self.cover = COVER * self.length * np.minimum(1, WINDOW / self.words)

    def features(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == hashes, place, len(self.vocabulary))

    def candidates(self, features: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start of window within it, passage and cosine, of the words of a block of texts.

        ``bounds`` has where each text's words begin, and the end. A window is made of steps of ``STRIDE`` words of one text.
        """
        size = np.diff(bounds)
        steps = -(-size // STRIDE)
        first = np.concatenate([[0], np.cumsum(steps)])
        beyond = len(self.vocabulary)               # the row of zeros, for what stands beyond a text's end
        padded = np.full((first[-1] + 1, STRIDE), beyond)
        padded.ravel()[_runs(first[:-1] * STRIDE, size, 1)] = features
        sums = self.weighted[padded[:, 0]]
        for k in range(1, STRIDE):
            sums += self.weighted[padded[:, k]]
        width = WINDOW // STRIDE
        count = np.where(size > 0, np.maximum(steps - width + 1, 1), 0)
        text = np.repeat(np.arange(len(size)), count)
        at = _runs(first[:-1], count, 1)
        windows = np.zeros((len(at), sums.shape[1]), np.float32)
        for k in range(width):
            windows += sums[np.where(at + k < first[text + 1], at + k, len(sums) - 1)]
        length = np.maximum(np.linalg.norm(windows, axis=1), 1e-9)
        out = []
        rows = max(1, CELLS // len(self.queries))
        for low in range(0, len(windows), rows):
            part, norm = windows[low:low + rows], length[low:low + rows]
            dots = part @ self.unit.T
            # a product's last digits depend on where a row stands in it, so the pairs it leaves are taken again one by one
            w, q = np.nonzero(dots >= (COSINE - 1e-3) * norm[:, None])
            near = dots[w, q] >= 0.999 * self.cover[q]
            w, q = w[near], q[near]
            exact = (part[w].astype(np.float64) * self.unit[q]).sum(axis=1)
            keep = (exact >= COSINE * norm[w]) & (exact >= self.cover[q])
            out.append((w[keep] + low, q[keep], exact[keep] / norm[w[keep]]))
        w, q, cosine = (np.concatenate(x) for x in zip(*out, strict=True))
        return text[w], (at - first[text])[w] * STRIDE, q, cosine

    @property
    def words(self) -> np.ndarray:
        return np.array([len(q) for _, q in self.queries])

    def matches(self, text: np.ndarray, starts: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, float, bool, int]]:
        """Confirmed candidates of one text: passage, share of common words, whether the answer is there, candidate."""
        for i, (s, q) in enumerate(zip(starts.tolist(), which.tolist(), strict=True)):
            query = self.queries[q][1]
            around = text[max(0, s - len(query)):s + WINDOW + len(query)]
            share = common_subsequence(query, around) / len(query)
            if share >= PARAPHRASED:
                answer = contains(around, query[-ANSWER_WORDS:])
                if share >= COPIED or answer:
                    yield q, share, answer, i


def _runs(start: np.ndarray, count: np.ndarray, step: int) -> np.ndarray:
    """start, start + step, ... of each run, one run after another."""
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(start, count) + within * step


# ---------------------------------------------------------------- Spark jobs
def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each word of the benchmark block stands, and the number of documents."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, count, n = scanner(), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, buf, offsets in blocks(folded(batch["text"].tolist())):
                starts, _, hashes = scan.scan(buf)
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[place] == hashes)
                text = np.searchsorted(offsets, starts[hit], side="right")
                count += np.bincount(np.unique(text * len(vocabulary) + place[hit]) % len(vocabulary), minlength=len(vocabulary))
                n += len(offsets) - 1
        at = np.flatnonzero(count)
        yield pd.DataFrame({"word": np.append(at, -1), "n": np.append(count[at], n)})

    rows = (docs.select("text").mapInPandas(task, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect())
    frequency = np.zeros(len(vocabulary))
    total = 0
    for r in rows:                                   # one for each word of the block
        if r["word"] < 0:
            total = r["n"]
        else:
            frequency[r["word"]] = r["n"]
    return frequency, total


def randomised_basis(rows: DataFrame, features: int, rank: int = RANK, powers: int = POWERS) -> np.ndarray:
    """An orthonormal basis (features x rank) of the leading right singular vectors of a sparse matrix.

    ``rows`` has (at array<bigint>, weight array<double>), one row of the matrix each. Every round multiplies the basis by the
    matrix and its transpose: a task does so for its rows, and the sums by feature are aggregated.
    """
    rank = max(1, min(rank, features))
    basis = np.linalg.qr(np.random.default_rng(SEED).normal(size=(features, rank)))[0]
    for _ in range(powers + 1):
        sent = rows.sparkSession.sparkContext.broadcast(basis)     # words of a benchmark block x RANK

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            thin = sent.value
            out = np.zeros_like(thin)
            for batch in batches:
                for at, weight in zip(batch["at"], batch["weight"], strict=True):
                    out[at] += np.outer(weight, weight @ thin[at])
            used = np.flatnonzero(np.abs(out).sum(axis=1))
            yield pd.DataFrame({"feature": used, "row": list(out[used])})

        sums = rows.mapInPandas(task, "feature bigint, row array<double>").groupBy("feature").agg(
            F.array(*[F.sum(F.col("row")[i]) for i in range(rank)]).alias("row")).collect()
        product = np.zeros((features, rank))
        for r in sums:
            product[r["feature"]] = r["row"]
        basis = np.linalg.qr(product)[0]
    return basis


def _weighted_rows(spark, block: list[tuple[int, np.ndarray]], vocabulary: np.ndarray, idf: np.ndarray) -> DataFrame:
    out = []
    for _, q in block:
        at, n = np.unique(np.searchsorted(vocabulary, q), return_counts=True)
        weight = n * idf[at]
        out.append((at.tolist(), (weight / np.linalg.norm(weight)).tolist()))
    return spark.createDataFrame(out, "at array<bigint>, weight array<double>")


def _item_blocks(benchmark: DataFrame, short: bool) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Passages of all items in blocks of a bounded number of words; the items come one by one."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(
        "item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator()
    block, size = [], 0
    for r in rows:
        for p in passages([(r["item_id"], r["text"])]):
            if len(p[1]) < LEAST_WORDS and not short:
                continue
            block.append(p)
            size += len(p[1])
            if size >= BLOCK_WORDS:
                yield block
                block, size = [], 0
    if block:
        yield block


def _search(docs: DataFrame, block: list[tuple[int, np.ndarray]], keep: list[str]) -> DataFrame:
    spark = docs.sparkSession
    short, long = [p for p in block if len(p[1]) < LEAST_WORDS], [p for p in block if len(p[1]) >= LEAST_WORDS]
    latent = None
    if long:
        vocabulary = np.unique(np.concatenate([q for _, q in long]))
        frequency, total = _frequencies(docs, vocabulary)
        idf = np.log((1 + total) / (1 + frequency)) + 0.1
        latent = vocabulary, idf, randomised_basis(_weighted_rows(spark, long, vocabulary, idf), len(vocabulary)), long
    sent = spark.sparkContext.broadcast((latent, short))    # bounded by BLOCK_WORDS

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, phrases, scan = sent.value[0] and Space(*sent.value[0]), ShortItems(sent.value[1]), scanner()
        for batch in batches:
            keys, rows = batch[keep].values.tolist(), []
            for first, buf, offsets in blocks(folded(batch["text"].tolist()), 1 << 18):
                starts, _, hashes = scan.scan(buf)
                if not len(hashes):
                    continue
                bounds = np.searchsorted(starts, offsets)
                if phrases.by_words:
                    for t in np.flatnonzero(np.diff(bounds)).tolist():
                        rows.extend((*keys[first + t], i, 1.0, 1.0, True) for i in phrases.found(hashes[bounds[t]:bounds[t + 1]]))
                if space:
                    text, at, which, cosine = space.candidates(space.features(hashes), bounds)
                    cuts = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        t = int(text[a])
                        for q, share, answer, i in space.matches(hashes[bounds[t]:bounds[t + 1]], at[a:b], which[a:b]):
                            rows.append((*keys[first + t], space.queries[q][0], share, float(cosine[a + i]), answer))
            yield pd.DataFrame(rows, columns=[*keep, "item_id", "score", "cosine", "answer"])

    return docs.select(*[F.col(k).cast("string").alias(k) for k in keep], "text").mapInPandas(task, _matches(keep))


def _matches(keep: list[str]) -> str:
    return ", ".join([*(f"{k} string" for k in keep), MATCHES])


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",),
                 short: bool = False) -> DataFrame:
    """op2: (doc_id, item_id, score, cosine, answer): the items that a document holds, with the best share of an item's passage
    found in it, the cosine to six places. Documents without a match have no row. ``keep`` names the columns that tell a document;
    ``short`` also looks up items under ``LEAST_WORDS`` words."""
    bounded_batches(docs.sparkSession)
    keep, found = list(keep), None
    for block in _item_blocks(benchmark, short):
        part = written(_search(docs.select(*keep, "text"), block, keep), "matches")
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _matches(keep))
    best = found.groupBy(*keep, "item_id").agg(
        F.max("score").alias("score"), F.round(F.max("cosine"), 6).alias("cosine"), F.max("answer").alias("answer"))
    return best.select(*[F.col(k).cast("bigint").alias(k) for k in keep], "item_id", "score", "cosine", "answer")
