"""Language identification with a byte convolutional network written in numpy.

A text's UTF-8 bytes (A-Z lower-cased, other ASCII that is no letter as space, runs of spaces kept) are cut into windows of
a fixed length. Filters of several widths slide over a window's one-hot bytes; the largest response of each filter
goes to a softmax over the languages. A text's prediction is the softmax of the mean scores of all its windows.

Training: on the driver, from a bounded sample of the labelled rows it is given: at most ``rows_per_language`` rows of each
language, the first by a hash of text and key, and ``windows_per_row`` windows of each, spread over the text. Prediction is
map-only and reads whole texts.

Nulls and others: a null text, or one without any letter, is ``und`` with score 0; without any training row all are. Equal
scores go to the language that sorts first. Repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteaudit.llm.common import blocks, bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNDETERMINED = "und"
WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
LANGUAGE_ROWS, ROW_WINDOWS = 500, 6

#: What each byte counts as: A-Z as a-z, other ASCII as a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] = FOLD[97:123]
FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]   # for each width: width x 256 x FILTERS
    bias: np.ndarray            # of the filters
    out: np.ndarray             # pooled filters to languages
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each window (and where it was)."""
        best, places = [], []
        for w, table in zip(WIDTHS, self.filters, strict=True):
            span = windows.shape[1] - w + 1
            response = table[0][windows[:, :span]]
            for k in range(1, w):
                response += table[k][windows[:, k:k + span]]
            if where:
                place = response.argmax(axis=1)
                places.append(place)
                best.append(np.take_along_axis(response, place[:, None, :], axis=1)[:, 0])
            else:
                best.append(response.max(axis=1))
        return np.maximum(np.concatenate(best, axis=1) + self.bias, 0), places

    def scores(self, windows: np.ndarray) -> np.ndarray:
        return self.pooled(windows)[0] @ self.out + self.out_bias


def cut_windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts of a block, the last of each filled up with spaces, and the text of each window."""
    folded = np.concatenate([FOLD[buf], np.full(WINDOW, 32, np.uint8)])
    lengths = np.diff(offsets) - 1
    counts = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(lengths)), counts)
    starts = offsets[text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
    windows = folded[starts[:, None] + np.arange(WINDOW)]
    left = (offsets[text] + lengths[text] - starts)[:, None]
    return np.where(np.arange(WINDOW) < left, windows, 32).astype(np.uint8), text


def train(texts: list[str], languages: list[str], epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Model:
    """Fit the network to labelled windows with Adam."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    model = Model(names, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
                  np.zeros(n, np.float32), rng.normal(0, 0.2, (n, len(names))).astype(np.float32),
                  np.zeros(len(names), np.float32))
    parts = [cut_windows(buf, offsets) + (first,) for first, buf, offsets in blocks(texts)]
    windows = np.concatenate([p[0] for p in parts])
    label = np.array([names.index(x) for x in languages])[np.concatenate([p[1] + p[2] for p in parts])]
    weight = (1 / np.maximum(np.bincount(label, minlength=len(names)), 1))[label]
    weight = (weight / weight.mean()).astype(np.float32)
    params = [*model.filters, model.bias, model.out, model.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            x, y, w = windows[pick].copy(), label[pick], weight[pick]
            short = rng.random(len(pick)) < 0.4        # short texts too
            keep = np.where(short, rng.integers(6, WINDOW, len(pick)), WINDOW)
            x[np.arange(WINDOW) >= keep[:, None]] = 32
            hidden, places = model.pooled(x, where=True)
            z = hidden @ model.out + model.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            dz = (p * w[:, None] / len(y)).astype(np.float32)
            dh = (dz @ model.out.T) * (hidden > 0)
            grads = []
            for i, wd in enumerate(WIDTHS):
                g = np.zeros_like(model.filters[i])
                part = dh[:, i * FILTERS:(i + 1) * FILTERS]
                for k in range(wd):
                    np.add.at(g[k], (np.take_along_axis(x, places[i] + k, axis=1), np.arange(FILTERS)), part)
                grads.append(g)
            grads += [dh.sum(axis=0), hidden.T @ dz, dz.sum(axis=0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return model


def predict(model: Model | None, texts: list) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    language, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if model is None:
        return language, score
    for first, buf, offsets in blocks(texts, 1 << 18):
        windows, text = cut_windows(buf, offsets)
        n = len(offsets) - 1
        total = np.zeros((n, len(model.languages)))
        for at in range(0, len(windows), 512):
            np.add.at(total, text[at:at + 512], model.scores(windows[at:at + 512]))
        mean = total / np.maximum(np.bincount(text, minlength=n), 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for i, best in enumerate(p.argmax(axis=1).tolist()):
            t = texts[first + i]
            if isinstance(t, str) and any(map(str.isalpha, t)):
                language[first + i], score[first + i] = model.languages[best], float(p[i, best])
    return language, score


# ---------------------------------------------------------------- Spark jobs
def fit(labelled: DataFrame, rows_per_language: int = LANGUAGE_ROWS, windows_per_row: int = ROW_WINDOWS) -> Model | None:
    """Train on a bounded sample of (doc_id, text, lang) rows; null text or lang is left out."""
    rows = labelled.where("lang is not null and text is not null")
    size = F.length("text")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(windows_per_row - 1)), lambda i: F.substring(
        F.col("text"), (i * size / windows_per_row).cast("int") + 1, F.lit(WINDOW)))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    picked = (rows.select("doc_id", "lang", F.xxhash64(F.col("doc_id"), F.length("text")).alias("draw"),
                          F.when(size >= 2 * WINDOW, F.array_distinct(cuts)).otherwise(F.array(F.substring("text", 1, 2 * WINDOW)))
                          .alias("cuts"))
              .withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows_per_language))
    sample = picked.select("lang", "doc_id", F.posexplode("cuts").alias("i", "cut")).orderBy("lang", "doc_id", "i", "cut").collect()
    sample = [(r["lang"], r["cut"]) for r in sample if any(map(str.isalpha, r["cut"]))]
    return train([c for _, c in sample], [x for x, _ in sample]) if sample else None


def judged(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc, lang_pred, score): each row as a struct of its own columns, beside its prediction, so that no name clashes.

    The struct goes through the workers as it is, whatever types it holds; only its ``text`` goes into a prediction.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model and vars(model))    # some hundred kilobytes, whatever the input
    rows = docs.select(F.struct("*").alias("doc"))
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value and Model(**sent.value)
        for batch in batches:
            language, score = predict(known, batch.column("doc").field(at).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(language, pa.string()), pa.array(score, pa.float64())],
                                             ["doc", "lang_pred", "score"])

    kind = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(task, kind)


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score``."""
    return judged(docs.select(*dict.fromkeys([*keep, "text"])), model).select(
        *[F.col("doc")[c].alias(c) for c in keep], "lang_pred", "score")


def held_out(docs: DataFrame) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    return docs.withColumn("held_out", F.coalesce(remainder == 1, F.lit(False)))


def identify_documents(docs: DataFrame) -> DataFrame:
    """op4: train on the rows that aren't held out, predict all."""
    rows = held_out(docs.select("doc_id", "text", "lang"))
    model = fit(rows.where(~F.col("held_out")))
    return identify(rows, model, ["doc_id", "held_out"])
