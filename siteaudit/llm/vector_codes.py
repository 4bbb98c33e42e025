"""Compression of vectors to short codes: a codebook for each part of the vector, learnt over metric trees.

A component x becomes the integer ``floor(4096 * x)``; vectors are cut into equal consecutive parts. Rows are taken in blocks,
and each part of a block is filed in a tree of balls by the anchors hierarchy, once: about sqrt(n) anchors take their points
from each other where the triangle inequality allows it, large anchors are divided again, and balls are then merged two by two,
the tightest first. A ball caches the sum and the number of its points.

A round goes down every tree with the list of entries that may be nearest to some point of a ball. A ball inherits the list of
the ball above it and strikes out each entry that another beats at every place of the ball. With one entry left, the ball
is wholly owned and its cached sum counts; in a leaf with several left the points are compared exactly. Bounds carry
a margin for rounding and never decide a tie, so the result is that of comparing every part with every entry. Blocks and trees
lie in the shared folder; a round sends one sum for each task, part, entry and position, whatever the number of rows.

Dropped: vectors that are null, empty, or hold null or non-finite components, and those whose length isn't the commonest (ties: the
longest). The first entries are the parts of the smallest ids (ties by the vector; null ids last); with fewer rows
there are fewer entries. Equal distances go to the lower entry. Repeated rows count each time and stay; null labels
are one label. An empty table gives no rows. The commonest length must be a multiple of the number of parts, and squared
distances must fit in 64 bits; otherwise a ValueError says so. Only the three named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows whose parts share a tree, and points in a leaf.
BLOCK_ROWS, LEAF = 2048, 24


@dataclass
class Tree:
    """Balls of the points of one part of a block; a ball holds the points ``lo`` to ``hi``. Ball 0 is the root."""

    points: np.ndarray   # n x width, in the order of the leaves
    row: np.ndarray      # the block's row of each point
    links: np.ndarray    # balls x (lo, hi, left, right), left < 0 in a leaf
    balls: np.ndarray    # balls x (centre, radius)
    sums: np.ndarray     # balls x width

    FIELDS = (("points", np.int64), ("row", np.int32), ("links", np.int32), ("balls", np.float64), ("sums", np.int64))

    def packed(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.FIELDS}

    @classmethod
    def unpacked(cls, fields: dict[str, bytes]) -> Tree:
        flat = {name: np.frombuffer(fields[name], kind) for name, kind in cls.FIELDS}
        width = len(flat["points"]) // len(flat["row"])
        return cls(flat["points"].reshape(-1, width), flat["row"], flat["links"].reshape(-1, 4),
                   flat["balls"].reshape(-1, width + 1), flat["sums"].reshape(-1, width))


def anchors(points: np.ndarray) -> np.ndarray:
    """The anchor that each point belongs to; fewer than sqrt(n) where points are alike."""
    wanted = math.isqrt(len(points) - 1) + 1
    x = points.astype(np.float64)
    owner = np.zeros(len(x), np.int64)
    pivots = [0]
    far = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(pivots) < wanted:
        new = int(far.argmax())
        if far[new] == 0:
            break
        half = np.sqrt(((x[pivots] - x[new]) ** 2).sum(axis=1)) / 2
        open_to = np.flatnonzero(far > half[owner])     # nearer ones can't be nearer to the new anchor
        reach = np.sqrt(((x[open_to] - x[new]) ** 2).sum(axis=1))
        closer = reach < far[open_to]
        taken = open_to[closer]
        owner[taken], far[taken] = len(pivots), reach[closer]
        pivots.append(new)
    return owner


def grow(points: np.ndarray) -> Tree:
    """The tree of balls over the rows of ``points``."""
    balls: list[tuple] = []     # centre, radius, sum, number, children or rows

    def leaf(rows: np.ndarray) -> int:
        total = points[rows].sum(axis=0)
        centre = total / len(rows)
        radius = math.sqrt(((points[rows] - centre) ** 2).sum(axis=1).max())
        balls.append((centre, radius * (1 + 1e-9), total, len(rows), rows))
        return len(balls) - 1

    def around(rows: np.ndarray) -> int:
        owner = anchors(points[rows]) if len(rows) > LEAF else np.zeros(len(rows), np.int64)
        if not owner.any():
            return leaf(rows)
        order = np.argsort(owner, kind="stable")
        groups = np.split(rows[order], np.flatnonzero(np.diff(owner[order])) + 1)
        return merged([around(g) for g in groups])

    def merged(open_balls: list[int]) -> int:
        """Join the two balls whose common ball is the smallest, until one is left."""
        ids = list(open_balls)
        centre = np.array([balls[i][0] for i in ids])
        radius, number = np.array([balls[i][1] for i in ids]), np.array([balls[i][3] for i in ids], np.float64)

        def joint(i: int) -> np.ndarray:
            apart = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
            share = number / (number + number[i])
            return np.maximum(apart * share + radius[i], apart * (1 - share) + radius) * (1 + 1e-9)

        cost = np.array([joint(i) for i in range(len(ids))])
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(ids) - 1):
            i, j = divmod(int(cost.argmin()), len(ids))
            a, b = balls[ids[i]], balls[ids[j]]
            total, n = a[2] + b[2], a[3] + b[3]
            balls.append((total / n, float(cost[i, j]), total, n, (ids[i], ids[j])))
            ids[i] = len(balls) - 1
            centre[i], radius[i], number[i] = total / n, cost[i, j], n
            alive = np.isfinite(cost).any(axis=0)
            alive[[i, j]] = True, False
            fresh = np.where(alive, joint(i), np.inf)
            fresh[i] = np.inf
            cost[i, :], cost[:, i] = fresh, fresh
            cost[j, :], cost[:, j] = np.inf, np.inf
        return ids[i] if len(open_balls) > 1 else ids[0]

    root = around(np.arange(len(points)))
    links, values, sums, rows, at = [], [], [], [], 0
    todo = [(root, -1, 0)]
    while todo:     # depth first, so that a ball's points lie together
        ball, above, side = todo.pop()
        centre, radius, total, n, held = balls[ball]
        here = len(links)
        if above >= 0:
            links[above][2 + side] = here
        links.append([at, at + n, -1, -1])
        values.append([*centre, radius])
        sums.append(total)
        if isinstance(held, tuple):
            todo += [(held[1], here, 1), (held[0], here, 0)]
        else:
            rows.append(held)
            at += n
    row = np.concatenate(rows)
    return Tree(points[row], row.astype(np.int32), np.array(links, np.int32), np.array(values), np.array(sums, np.int64))


def owned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Wholly owned balls and their entries; then the points of open leaves and theirs."""
    exact = entries.astype(np.float64)
    apart = np.sqrt(((exact[:, None] - exact) ** 2).sum(axis=2))
    first = np.array([not (entries[:i] == e).all(axis=1).any() for i, e in enumerate(entries)])
    active, may = np.zeros(1, np.int64), first[None, :]     # an entry that repeats a lower one never wins
    done, done_entry, places, masks = [], [], [], []
    while len(active):
        centre, radius = tree.balls[active, :-1], tree.balls[active, -1]
        d = ((centre[:, None] - exact) ** 2).sum(axis=2)
        best = np.where(may, d, np.inf).argmin(axis=1)
        least = d[np.arange(len(d)), best][:, None]
        margin = 1e-9 * (2 * radius[:, None] * apart[best]) + 1e-12 * (d + least) + 1
        may = may & ~(d - least > 2 * radius[:, None] * apart[best] + margin)
        whole = may.sum(axis=1) == 1
        done.append(active[whole])
        done_entry.append(best[whole])
        leaf = ~whole & (tree.links[active, 2] < 0)
        for ball, mask in zip(active[leaf], may[leaf], strict=True):
            lo, hi = tree.links[ball, :2]
            places.append(np.arange(lo, hi))
            masks.append(np.broadcast_to(mask, (hi - lo, len(entries))))
        inner = ~whole & ~leaf
        active = tree.links[active[inner], 2:].astype(np.int64).ravel()
        may = np.repeat(may[inner], 2, axis=0)
    place = np.concatenate([*places, np.zeros(0, np.int64)])
    nearest = np.zeros(0, np.int64)
    if len(place):
        d = ((tree.points[place][:, None] - entries) ** 2).sum(axis=2)
        nearest = np.where(np.concatenate(masks), d, np.iinfo(np.int64).max).argmin(axis=1)
    return np.concatenate(done), np.concatenate(done_entry), place, nearest


def gathered(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points nearest to each entry."""
    ball, entry, place, nearest = owned(tree, entries)
    sums, numbers = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    np.add.at(sums, entry, tree.sums[ball])
    np.add.at(numbers, entry, tree.links[ball, 1] - tree.links[ball, 0])
    np.add.at(sums, nearest, tree.points[place])
    np.add.at(numbers, nearest, 1)
    return sums, numbers


def assigned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each of the block's rows."""
    ball, entry, place, nearest = owned(tree, entries)
    out = np.empty(len(tree.row), np.int64)
    for b, e in zip(ball, entry, strict=True):
        out[tree.links[b, 0]:tree.links[b, 1]] = e
    out[place] = nearest
    error = ((tree.points - entries[out]) ** 2).sum(axis=1)
    back = np.argsort(tree.row)
    return out[back], error[back]


# ---------------------------------------------------------------- Spark jobs
TREE_TYPE = "struct<points: binary, row: binary, links: binary, balls: binary, sums: binary>"
TREE_ARROW = pa.struct([(name, pa.binary()) for name, _ in Tree.FIELDS])


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, v): rows whose vector can be coded, components as doubles."""
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def integers(values: np.ndarray) -> np.ndarray:
    whole = np.floor(SCALE * values)
    if len(whole) and 4.0 * whole.shape[1] * np.abs(whole).max() ** 2 >= 2.0 ** 62:
        raise ValueError("vectors are too large: squared distances would pass 64 bits")
    return whole.astype(np.int64)


def blocks_of(rows: DataFrame, parts: int) -> DataFrame:
    """(keys, labels, trees): blocks of rows, with a tree for each part."""
    kinds = dict(rows.dtypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(at, BLOCK_ROWS)
                v = integers(block.column("v").flatten().to_numpy().reshape(block.num_rows, -1))
                trees = [grow(p).packed() for p in np.split(v, parts, axis=1)]
                ends = pa.array([0, block.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(ends, block.column("key")), pa.ListArray.from_arrays(ends, block.column("label")),
                     pa.array([trees], pa.list_(TREE_ARROW))], ["keys", "labels", "trees"])

    return rows.mapInArrow(task, f"keys array<{kinds['key']}>, labels array<{kinds['label']}>, trees array<{TREE_TYPE}>")


def moved(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry is the floor of the mean of its parts; unused entries stay."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]
        for batch in batches:
            for trees in batch.column("trees"):
                for part, fields in enumerate(trees.as_py()):
                    for have, more in zip(total[part], gathered(Tree.unpacked(fields), books[part]), strict=True):
                        have += more
        rows = [(part, entry, pos, int(s), int(numbers[entry])) for part, (sums, numbers) in enumerate(total)
                for entry in np.flatnonzero(numbers).tolist() for pos, s in enumerate(sums[entry])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            list(zip(*rows, strict=True)) or [[]] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
            ["part", "entry", "pos", "total", "number"])

    sums = (blocks.select("trees").mapInArrow(task, "part int, entry int, pos int, total bigint, number bigint")
            .groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("number").alias("number")))
    out = [b.copy() for b in books]
    for r in sums.collect():     # as many as the codebooks have components
        out[r["part"]][r["entry"], r["pos"]] = r["total"] // r["number"]
    return out


def codebooks(rows: DataFrame, blocks: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    first = rows.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.split(integers(np.array([r["v"] for r in first])), parts, axis=1)
    for _ in range(rounds):
        books = moved(blocks, books)
    return books


def coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(key, label, code, error) of every row."""
    kinds = {c: t.removeprefix("array<").removesuffix(">") for c, t in blocks.dtypes}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [assigned(Tree.unpacked(fields), books[part])
                         for part, fields in enumerate(batch.column("trees")[i].as_py())]
                code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[i].values, batch.column("labels")[i].values,
                     pa.array([c.tobytes().hex() for c in code], pa.string()),
                     pa.array(sum(e for _, e in found), pa.int64())], ["key", "label", "code", "error"])

    return blocks.mapInArrow(task, f"key {kinds['keys']}, label {kinds['labels']}, code string, error bigint")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, label, code, error) of every usable row, and the codebooks (for each part: entries x width)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    rows = usable(df, key, vector, label)
    size = rows.select(F.size("v").alias("n")).first()
    if size is None:
        return rows.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), []
    if size["n"] % parts:
        raise ValueError(f"{size['n']} components can't be cut into {parts} equal parts")
    blocks = written(blocks_of(rows, parts), "trees")
    books = codebooks(rows, blocks, parts, entries, rounds)
    return coded(blocks, books), books


def compress_embeddings(embeddings: DataFrame) -> DataFrame:
    """op12: (vec_id, code, error, label_error, codebooks_sha256)."""
    found, books = compress(embeddings, "vec_id", "embedding", "label")
    rows = written(found, "codes")
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "its")
    return rows.join(labels, F.col("label").eqNullSafe(F.col("its"))).select(
        F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
