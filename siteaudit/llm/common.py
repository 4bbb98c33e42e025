"""Helpers shared by the corpus operators: shared tables, byte scanning, word hashes."""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.session import bounded_batches, checkpoint_dir  # noqa: F401 - operators take bounded_batches from here

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # executors need no installed package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that a task scans at once; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder in as many buckets of ``column`` as a shuffle has partitions, and read it back.

    Joins and groupings by ``column`` read the buckets as they are, so a table that many of them take is shuffled once. The table's
    name is only needed to read its buckets; it is taken out of the catalog again, the files stay.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    table_name = f"llm_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    df.write.format("parquet").option("path", path).bucketBy(buckets, column).saveAsTable(table_name)
    stored = spark.table(table_name)
    stored.schema    # resolved while the name is there
    spark.sql(f"DROP TABLE {table_name}")
    return stored


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``written`` or ``bucketed`` gave, once all that read it are written themselves."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("llm-"):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


# ---------------------------------------------------------------- scanning bytes with numpy
def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return mix64(z)


def mix64(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class WordScanner:
    """Finds and hashes the words of many texts at once, on their UTF-8 bytes.

    ``word_byte`` tells for each of the 256 bytes whether it belongs to a word.
    Hashes are 64 bits, of the bytes with A-Z lower-cased.
    """

    BASE = 0x9E3779B97F4A7C55 | 1

    def __init__(self, word_byte: np.ndarray):
        self.word_byte = word_byte
        values = _splitmix(256, 7)
        values[65:91] = values[97:123]
        self.values = values
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        with np.errstate(over="ignore"):
            inverse = pow(self.BASE, -1, 1 << 64)
            self.up = np.cumprod(np.full(n, self.BASE, np.uint64))
            self.down = np.cumprod(np.full(n, inverse, np.uint64))

    def scan(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of a byte buffer."""
        if not len(buf):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64)
        inside = self.word_byte[buf]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if len(buf) > len(self.up):
            self._powers(1 << int(len(buf) - 1).bit_length())
        with np.errstate(over="ignore"):
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(self.values[buf] * self.up[:len(buf)], out=total[1:])
            hashes = (total[ends] - total[starts]) * self.down[starts]
        return starts, ends, mix64(hashes + (ends - starts).astype(np.uint64))


def word_bytes(separators: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


def blocks(texts, limit: int = BLOCK_BYTES):
    """Runs of texts of about ``limit`` bytes: (index of the first, byte buffer, offsets). Null texts are empty.

    A newline stands between texts, so that no word spans two of them; ``offsets`` has one entry more than texts.
    """
    first, parts, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if parts and size + len(b) > limit:
            yield first, *_joined(parts)
            first, parts, size = i, [], 0
        parts.append(b)
        size += len(b) + 1
    if parts:
        yield first, *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), offsets
