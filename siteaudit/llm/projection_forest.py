"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on the driver to a bounded sample (``SAMPLE_ROWS`` distinct vectors): an inner node splits at the median
along the difference of two random points of its part. Every vector is filed in one leaf of each tree. A query goes
down all trees together with one priority queue of nodes, ordered by the least margin on the way; leaves are opened in
that order. How many is measured, not guessed: ``CALIBRATION_QUERIES`` queries are compared with all rows, and as many
leaves are opened as bring ``RECALL`` of their true neighbours. Vectors and queries then meet by leaf, in blocks of bounded
size, and are reranked by their exact cosine in double precision.

Equal vectors are searched once: a vector stands for the k + 1 smallest ids that hold it, which is all that k nearest with
ties to smaller ids can need. Vectors that are null, empty, zero, or hold null or non-finite components take no part;
neither do those that differ from the commonest dimension. A repeated row (same id and vector) counts once; rows with a null id
take no part. With fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES, DEPTH, SAMPLE_ROWS = 10, 7, 8192
CALIBRATION_QUERIES, RECALL = 64, 0.98
BLOCK_ROWS, BLOCK_QUERIES = 8192, 32768


@dataclass
class Forest:
    """Complete trees: node i of a level has children 2i and 2i + 1; a leaf's number is tree * 2**depth + place."""

    depth: int
    normals: list[list[np.ndarray]]   # tree, level: nodes x dimension
    offsets: list[list[np.ndarray]]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.normals)), np.int64)
        for t, (normals, offsets) in enumerate(zip(self.normals, self.offsets, strict=True)):
            node = np.zeros(len(vectors), np.int64)
            for w, b in zip(normals, offsets, strict=True):
                node = 2 * node + (np.einsum("ij,ij->i", vectors, w[node]) > b[node])
            out[:, t] = node + (t << self.depth)
        return out

    def opened(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which one queue over all trees reaches them."""
        margins = [[w @ query - b for w, b in zip(normals, offsets, strict=True)]
                   for normals, offsets in zip(self.normals, self.offsets, strict=True)]
        queue = [(-math.inf, t, 0, 0) for t in range(len(self.normals))]
        while queue:
            cost, tree, level, node = heapq.heappop(queue)
            if level == self.depth:
                yield (tree << self.depth) + node
                continue
            margin = float(margins[tree][level][node])
            heapq.heappush(queue, (max(cost, margin), tree, level + 1, 2 * node))
            heapq.heappush(queue, (max(cost, -margin), tree, level + 1, 2 * node + 1))


def grow(sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    depth = max(0, min(depth, int(math.log2(max(len(sample), 1) / 16 + 1))))
    forest = Forest(depth, [], [])
    for _ in range(trees):
        node, normals, offsets = np.zeros(len(sample), np.int64), [], []
        for level in range(depth):
            w, b = np.zeros((1 << level, sample.shape[1])), np.zeros(1 << level)
            for k in range(1 << level):
                part = np.flatnonzero(node == k)
                if len(part) > 1:
                    one, two = sample[rng.choice(part, 2, replace=False)]
                    w[k] = (one - two) / (np.linalg.norm(one - two) or 1.0)
                    b[k] = np.median(sample[part] @ w[k])
            normals.append(w)
            offsets.append(b)
            node = 2 * node + (np.einsum("ij,ij->i", sample, w[node]) > b[node])
        forest.normals.append(normals)
        forest.offsets.append(offsets)
    return forest


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, summed alike for every pair."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k nearest vectors: query row, id, score. Ties go to the smaller id."""
    scaled = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    rough = (queries / np.sqrt((queries * queries).sum(axis=1))[:, None]) @ scaled.T
    if rough.shape[1] > k:
        least = np.partition(rough, -k, axis=1)[:, -k] - 1e-9       # rounding apart
    else:
        least = np.full(len(queries), -np.inf)
    q, v = np.nonzero(rough >= least[:, None])
    score = cosines(queries[q], vectors[v])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], ids[v[place < k]], score[place < k]


# ---------------------------------------------------------------- Spark jobs
def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _brute_force(vectors: DataFrame, sample: pd.DataFrame, k: int) -> list[tuple[int, int, np.ndarray]]:
    """The k nearest of a bounded set of queries among all rows: (query, id, vector), for calibration."""
    queries, own = _matrix(sample["vector"]), sample["vid"].to_numpy()

    def task(batches):
        for batch in batches:
            if len(batch):
                table, ids = _matrix(batch["vector"]), batch["vid"].to_numpy()
                q, v, score = nearest(queries, table, ids, k + 1)
                row = {x: i for i, x in enumerate(ids.tolist())}
                yield pd.DataFrame({"q": own[q], "vid": v, "score": score,
                                    "vector": [table[row[x]] for x in v.tolist()]})

    found = vectors.select("vid", "vector").mapInPandas(task, "q bigint, vid bigint, score double, vector array<double>")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vid")
    rows = (found.where("q != vid").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
            .select("q", "vid", "vector").collect())           # at most CALIBRATION_QUERIES * k
    return [(r["q"], r["vid"], np.array(r["vector"])) for r in rows]


def calibrate(forest: Forest, vectors: DataFrame, sample: pd.DataFrame, k: int, recall: float = RECALL) -> int:
    """How many leaves to open so that ``recall`` of the sample's true neighbours are met."""
    truth = _brute_force(vectors, sample, k)
    order = {int(v): {leaf: i for i, leaf in enumerate(forest.opened(x), 1)}
             for v, x in zip(sample["vid"], _matrix(sample["vector"]), strict=True)}
    needed = sorted(min(order[q][leaf] for leaf in forest.leaves(x[None])[0].tolist()) for q, _, x in truth)
    return needed[min(len(needed) - 1, math.ceil(recall * len(needed)))] if needed else 1


def neighbours(table: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row that ``is_query`` takes."""
    rows = table.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"),
                        is_query.alias("query")).where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("vector") == (size[0]["d"] if size else 0))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    vectors = written(rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector")
                      .agg(F.min("id").alias("vid"), F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    queries = written(rows.where("query").join(vectors, "vector").select(F.col("id").alias("query_id"), "vid", "vector"),
                      "queries")
    asked = queries.select("vid", "vector").distinct()

    drawn = vectors.select("vid", "vector").orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE_ROWS).toPandas()
    tried = asked.orderBy(F.xxhash64("vid"), "vid").limit(CALIBRATION_QUERIES).toPandas()
    sample = _matrix(drawn["vector"]) if len(drawn) else np.zeros((0, 1))
    forest = grow(sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample)
    to_open = calibrate(forest, vectors, tried, k) if len(tried) else 1
    sent = table.sparkSession.sparkContext.broadcast(vars(forest))      # TREES * 2**DEPTH hyperplanes at most

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Forest(**sent.value)
        for batch in batches:
            if len(batch):
                leaves = known.leaves(_matrix(batch["vector"]))
                for t in range(leaves.shape[1]):
                    yield batch.assign(leaf=leaves[:, t])

    filed = vectors.select("vid", "vector").mapInPandas(file, "vid bigint, vector array<double>, leaf bigint")
    sizes = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per leaf
    parts = {leaf: -(-n // BLOCK_ROWS) for leaf, n in sizes.items()}
    query_parts = -(-asked.count() // BLOCK_QUERIES)
    most = max(parts.values(), default=1)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Forest(**sent.value)
        for batch in batches:
            out = []
            for vid, vector in zip(batch["vid"].tolist(), batch["vector"], strict=True):
                met = 0
                for n, leaf in enumerate(known.opened(vector)):
                    if n >= to_open and met > 10 * k * TREES:
                        break
                    met += sizes.get(leaf, 0)
                    out += [(vid, vector, leaf, part) for part in range(parts.get(leaf, 0))]
            yield pd.DataFrame(out, columns=["vid", "vector", "leaf", "part"])

    asking = (asked.mapInPandas(search, "vid bigint, vector array<double>, leaf bigint, part int")
              .withColumn("query_part", F.pmod(F.xxhash64("vid"), F.lit(max(query_parts, 1)))))
    split = F.create_map(*[F.lit(x) for leaf, n in parts.items() if n > 1 for x in (leaf, n)]) if most > 1 else None
    of = F.coalesce(F.element_at(split, F.col("leaf")), F.lit(1)) if split is not None else F.lit(1)
    lying = (filed.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vid"), of).cast("int"))
             .withColumn("query_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(query_parts, 1) - 1).cast("bigint")))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_vid": [], "vid": [], "score": []})
        q, v, score = nearest(_matrix(left["vector"]), _matrix(right["vector"]), right["vid"].to_numpy(), k + 1)
        return pd.DataFrame({"query_vid": left["vid"].to_numpy()[q], "vid": v, "score": score})

    keys = ["leaf", "part", "query_part"]
    met = (asking.groupBy(*keys).cogroup(lying.groupBy(*keys))
           .applyInPandas(meet, "query_vid bigint, vid bigint, score double").distinct())
    best = Window.partitionBy("query_vid").orderBy(F.desc("score"), "vid")
    kept = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    listed = (kept.join(vectors.select("vid", "ids"), "vid")
              .join(queries.select("query_id", F.col("vid").alias("query_vid")), "query_vid")
              .select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_embeddings(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """op8: queries are the rows whose vec_id is divisible by 50."""
    return neighbours(embeddings, F.col("vec_id") % 50 == 0, k)
