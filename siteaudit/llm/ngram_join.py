"""Jaccard self-join on word n-grams with prefixes of token combinations.

A document's set holds the 64-bit hashes of its distinct n-grams of words. Equal sets are one node from the start, so exact copies
cost nothing further. For the nodes:

1. Prefixes. All n-grams have one global order: first a fixed share of the hash space by document frequency (counted over all
   nodes), then the rest by hash. Two sets with similarity t or more share all but e = floor((1 - t) n) n-grams of either. A rare
   n-gram signs alone; frequent ones sign in pairs, within ``GROUPS`` hash classes. A prefix is extended until more than e
   n-grams would have to be unshared for no single rare n-gram and no pair within a class to be shared: each rare
   one counts 1, and c frequent ones of a class count c - 1. So linked sets share a signature. Sets with fewer than
   ``PAIRS_FROM`` n-grams sign with single n-grams only; sets near that size sign both ways. A signature holds for a class of
   sizes: linked sets differ in size by a factor of t at most, so a set signs for its own class, and for the next one too
   if a linked set can be there.
2. Stars. Of the nodes with one signature that with the fewest n-grams of its own is the hub; the others are compared with
   it. That is linear in the signatures, and finds nearly all links of a group.
3. Second stars. Where nodes of one signature are still in several components, those that their hub doesn't rule out against
   every other node are compared with the one among them that has the fewest n-grams of its own: the centre of a group of
   copies, where the first hub was a node at its edge. That is linear too.
4. The rest, exactly. What is still in several components is compared in pairs of blocks of bounded size: nodes outside the
   centre's component with each other and with those inside it. Pairs are never rows; a task gives one link for two components.

Comparisons read the texts again, packed and grouped by hub in blocks of bounded size. Nothing is capped. The number of links is
counted last, within components, block by block.

Words: runs of bytes other than ASCII white space, A-Z lower-cased. With fewer than n words the whole sequence is the one
n-gram; a null or empty text has none and is linked with nothing. Rows may repeat: each row keeps a row. Rows with the same
doc_id and different texts count by their own texts. A null doc_id takes part, and is never the smallest. An empty table gives
no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import WordScanner, blocks, bounded_batches, bucketed, discard, mix64, word_bytes, written
from siteaudit.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUPS, PAIRS_FROM, FREQUENT = 16, 40, 32
#: Width of a class of sizes, in factors of 1 / t.
CLASS_WIDTH = 3
BLOCK_MEMBERS = 256
#: N-grams that are looked at together when the pairs of two blocks are counted.
COLUMNS = 4096


@dataclass(frozen=True)
class Rule:
    """Similarity at least ``share`` / 100 of n-grams of ``words`` words."""

    words: int
    share: int

    def linked(self, n: int, m: int, common: int) -> bool:
        return 100 * common >= self.share * (n + m - common)

    def errors(self, n: int) -> int:
        return n * (100 - self.share) // 100

    @property
    def sampled(self) -> int:
        """The share of the hash space, in 1/100, whose frequencies order the prefixes."""
        return min(100, (100 - self.share) * 5 // 4)


def ngram_sets(buf: np.ndarray, offsets: np.ndarray, scanner: WordScanner, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a block."""
    starts, _, hashes = scanner.scan(buf)
    bounds = np.searchsorted(starts, offsets)
    with np.errstate(over="ignore"):
        n = max(len(hashes) - words + 1, 0)
        grams = np.zeros(n, np.uint64)
        for k in range(words):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n]
        grams = mix64(grams + np.uint64(words))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                g = np.sort(grams[a:b - words + 1])
                yield g[np.concatenate([[True], g[1:] != g[:-1]])]
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for h in hashes[a:b]:
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + h
                yield mix64(whole + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _sets(texts: list, words: int) -> Iterator[np.ndarray]:
    scanner = WordScanner(word_bytes(b" \t\n\v\f\r"))
    for _, buf, offsets in blocks(texts):
        yield from ngram_sets(buf, offsets, scanner, words)


def set_key(grams: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        key = mix64(np.array([mix64(grams ^ np.uint64(0xA5A5)).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64))
    return int(key.view(np.int64)[0])


def _pairs_count(grams: np.ndarray) -> int:
    return len(grams) - len(np.unique(grams % np.uint64(GROUPS)))


def split_sample(grams: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the sampled share, and as many others as a prefix can need beyond them."""
    cut = np.searchsorted(grams, np.uint64(((1 << 64) - 1) * rule.sampled // 100), side="right")
    sample, rest = grams[:cut], grams[cut:]
    sure = len(sample) if len(grams) < _near(rule)[0] else _pairs_count(sample)
    return sample, rest[:max(0, rule.errors(len(grams)) + 1 - sure)]


def _near(rule: Rule) -> tuple[float, float]:
    """Sizes from which sets sign in pairs, and up to which they sign singly, so that linked sets have a way in common."""
    return PAIRS_FROM * rule.share / 100, PAIRS_FROM * 100 / rule.share


def size_classes(n: int, rule: Rule) -> list[int]:
    """The class of sets with n n-grams, and the one of the largest sets linked with them (with a margin for rounding)."""
    if rule.share >= 100:
        return [n]
    step = np.log(100 / rule.share)
    at = np.log(n) / step
    return sorted({int(at // CLASS_WIDTH), int((at + 1 + 1e-6) // CLASS_WIDTH)})


def signatures(n: int, sampled: int, shared: np.ndarray, frequency: np.ndarray, extra: np.ndarray, rule: Rule) -> np.ndarray:
    """The signatures of a node: of its sampled n-grams only the ``shared`` ones (frequency over 1) are listed."""
    order = np.lexsort((shared, frequency))
    shared, frequency = shared[order], frequency[order]
    need, own = rule.errors(n) + 1, sampled - len(shared)     # own n-grams come first and sign nothing
    low, high = _near(rule)
    out = []
    if n <= high:
        out.append(mix64(np.concatenate([shared, extra])[:max(0, need - own)]))
    if n >= low and need > own:
        rare = frequency < FREQUENT
        count = np.ones(len(shared), np.int64)
        classes = (shared % np.uint64(GROUPS)).astype(np.int64)
        often = np.flatnonzero(~rare)
        _, first = np.unique(classes[often], return_index=True)
        count[often[first]] = 0                                 # the first of a class counts nothing
        reached = own + np.cumsum(count)
        end = int(np.searchsorted(reached, need)) + 1
        left = need - (int(reached[-1]) if len(reached) else own)
        single = [shared[:end][rare[:end]]] + ([extra[:left]] if left > 0 else [])
        with np.errstate(over="ignore"):
            out.append(mix64(np.concatenate(single) ^ np.uint64(0x51)))
            for c in range(GROUPS):
                g = np.sort(shared[:end][~rare[:end] & (classes[:end] == c)])
                if len(g) > 1:
                    i, j = np.triu_indices(len(g), 1)
                    out.append(mix64(g[i] * np.uint64(0xC2B2AE3D27D4EB4F) + g[j]))
    if not out:
        return np.zeros(0, np.uint64)
    marks = class_marks(size_classes(n, rule))
    return np.unique(mix64(np.concatenate(out)[:, None] ^ marks).ravel())


def class_marks(numbers: list[int]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.array(numbers, np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


# ---------------------------------------------------------------- Spark jobs
def _facts(docs: DataFrame, rule: Rule, keep: list[str]) -> DataFrame:
    """Each row's set size and name, with the sampled n-grams."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part, rows = batch.iloc[at:at + 1000], []
                for g in _sets(part["text"].tolist(), rule.words):
                    sample, extra = split_sample(g, rule)
                    rows.append((len(g), set_key(g), sample.view(np.int64), extra.view(np.int64)))
                out = pd.DataFrame(rows, columns=["n", "node", "sample", "extra"])
                yield pd.concat([part[keep].reset_index(drop=True), out], axis=1)

    rows = docs.select(*[F.col(k).cast("string").alias(k) for k in keep], "text")
    schema = ", ".join(f"{k} string" for k in keep) + ", n bigint, node bigint, sample array<bigint>, extra array<bigint>"
    kinds = dict(docs.dtypes)
    return rows.mapInPandas(task, schema).select(*[F.col(k).cast(kinds[k]).alias(k) for k in keep], "n", "node", "sample", "extra")


def _places(facts: DataFrame) -> DataFrame:
    """(node, doc_id, text_hash): one document of each node, with the smallest doc_id."""
    first = facts.where("n > 0").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    return first.select("node", "f.doc_id", "f.text_hash")


def _texts(docs: DataFrame, places: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed) of the wanted nodes: the compressed text of each one's document, once.

    A document is found by doc_id and the hash of its text, so that a null or repeated doc_id is no hot key and a node meets no
    other node's text; the rows that repeat a document as a whole are made one before they are shuffled by node. The table lies in
    buckets by node: all later joins read it as it lies."""
    at = places.join(wanted, "node").select("node", F.col("doc_id").cast("string").alias("_id"), F.col("text_hash").alias("_hash"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [zlib.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"].tolist()]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "packed": packed})

    rows = (docs.select(F.col("doc_id").cast("string"), F.xxhash64("text").alias("text_hash"), "text")
            .mapInPandas(task, "doc_id string, text_hash bigint, packed binary"))
    found = (rows.join(at, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
             .groupBy("node").agg(F.collect_set("packed").alias("packed")))     # one, but for texts with the same hash
    return bucketed(found.select("node", F.explode("packed").alias("packed")), "node", "texts")


def _unpacked_sets(packed: pd.Series, rule: Rule) -> Iterator[np.ndarray]:
    return _sets([zlib.decompress(b).decode("utf-8", "surrogatepass") for b in packed], rule.words)


def _compare(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(hub, node, n_hub, n, common) of the distinct (hub, node) pairs. A hub's members come in blocks, after it."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("parts"))
    members = (pairs.join(sizes, "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
               .join(texts, "node").select("hub", "part", F.lit(1).alias("member"), "node", "packed"))
    hubs = (sizes.join(texts, F.col("hub") == F.col("node"))
            .select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"), "node", "packed"))
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = hubs.union(members).repartition(parts, "hub", "part").sortWithinPartitions("hub", "part", "member")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hub = None, None
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                sets = _unpacked_sets(part["packed"], rule)
                for h, p, member, node, g in zip(part["hub"].tolist(), part["part"].tolist(), part["member"].tolist(),
                                                 part["node"].tolist(), sets, strict=True):
                    if (h, p) != now:
                        now, hub = (h, p), None
                    if set_key(g) != node:
                        continue              # another text with the same doc_id and hash
                    if not member:
                        hub = g
                    elif hub is not None:
                        place = np.minimum(np.searchsorted(g, hub), len(g) - 1)
                        rows.append((h, node, len(hub), len(g), int((g[place] == hub).sum())))
            yield pd.DataFrame(rows, columns=["hub", "node", "n_hub", "n", "common"])

    return laid.mapInPandas(task, "hub bigint, node bigint, n_hub bigint, n bigint, common bigint").distinct()


def _links(compared: DataFrame, rule: Rule) -> DataFrame:
    return (compared.where(F.col("common") * 100 >= F.lit(rule.share) * (F.col("n_hub") + F.col("n") - F.col("common")))
            .select(F.col("hub").alias("a"), F.col("node").alias("b")))


def _signed(nodes: DataFrame, rule: Rule) -> DataFrame:
    """(node, n, hub, members), written: each node's signatures that more than one node has, by their hub and number of nodes."""
    postings = nodes.select("node", F.explode("sample").alias("gram"))
    shared = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = (postings.join(shared, "gram").groupBy("node").agg(F.collect_list(F.struct("df", "gram")).alias("grams")))
    facts = nodes.select("node", "n", F.size("sample").alias("sampled"), "extra")
    rows = facts.join(listed, "node", "left").where(F.col("grams").isNotNull() | (F.size("extra") > 0)).select(
        "node", "n", "sampled", "extra", F.coalesce(F.col("grams.gram"), F.array().cast("array<bigint>")).alias("gram"),
        F.coalesce(F.col("grams.df"), F.array().cast("array<bigint>")).alias("df"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                sigs, own = [], []
                for _, n, sampled, extra, gram, df in part.itertuples(index=False):
                    gram = np.asarray(gram, np.int64).view(np.uint64)
                    sigs.append(signatures(n, sampled, gram, np.asarray(df, np.int64),
                                           np.asarray(extra, np.int64).view(np.uint64), rule).view(np.int64))
                    own.append((sampled - len(gram)) / max(sampled, 1))
                many = [len(x) for x in sigs]
                yield pd.DataFrame({"sig": np.concatenate(sigs), "node": np.repeat(part["node"].to_numpy(), many),
                                    "n": np.repeat(part["n"].to_numpy(), many), "own": np.repeat(own, many)})

    signed = written(rows.mapInPandas(task, "sig bigint, node bigint, n bigint, own double"), "signatures")
    hubs = (signed.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("own", "node")).alias("h"))
            .where("members > 1").select("sig", "members", F.col("h.node").alias("hub")))
    held = written(signed.join(hubs, "sig").select("node", "n", "hub", "members"), "signed")
    discard(signed)
    return held


def _own_grams(texts: DataFrame, rule: Rule) -> DataFrame:
    """(node, own): how many n-grams of a node no other node of ``texts`` has."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                sets = [(k, g) for k, g in zip(part["node"].tolist(), _unpacked_sets(part["packed"], rule), strict=True)
                        if set_key(g) == k]
                yield pd.DataFrame({"gram": np.concatenate([np.zeros(0, np.int64), *(g.view(np.int64) for _, g in sets)]),
                                    "node": np.repeat(np.array([k for k, _ in sets], np.int64), [len(g) for _, g in sets])})

    grams = texts.mapInPandas(task, "gram bigint, node bigint")
    alone = (grams.groupBy("gram").agg(F.min("node").alias("node"), F.max("node").alias("other"))
             .where("node = other"))
    return alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with the component of their node (itself where it has no link)."""
    return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open_members(signed: DataFrame, stars: DataFrame, found: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(hub, node, n, own, centre) of the nodes that their hub leaves open, with the one of them that is to be compared next.

    Nodes with a signature in common have its hub in common, so links are sought by hub, each once, not by signature.
    """
    t = rule.share / 100
    known = stars.select("hub", "node", (F.col("n_hub") - F.col("common")).alias("lost"))
    members = _placed(signed.where("members > 2").select("hub", "node", "n").distinct(), found)
    open_ = members.groupBy("hub").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("hub")
    members = written(members.where("node != hub").join(open_, "hub").join(known, ["hub", "node"]).drop("component"), "open-members")
    present = members.select("node").union(members.select("hub")).distinct()     # an own n-gram is none that the hub has
    own = _own_grams(texts.join(present, "node"), rule)
    bounded = members.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    least = bounded.groupBy("hub").agg(F.min(F.col("own") - F.col("lost")).alias("least"))
    near = written(bounded.join(least, "hub").where(
        F.col("own") + F.col("lost") + F.col("least") <= F.lit((1 - t) / t) * F.col("n") + 1e-6).drop("least"), "near-members")
    centres = near.groupBy("hub").agg(F.min(F.struct("own", "lost", "node")).alias("c")).select("hub", F.col("c.node").alias("centre"))
    return near.join(centres, "hub").where("node != centre").select("hub", "node", "n", "own", "centre")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of ``left`` shares with each of ``right``."""
    flat = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(g) for g in left + right])
    _, gram, times = np.unique(flat, return_inverse=True, return_counts=True)
    held = times[gram] > 1
    gram, owner = gram[held], owner[held]
    column = np.cumsum(times > 1) - 1                   # n-grams of more than one set, numbered
    gram, width = column[gram], int((times > 1).sum())
    out = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    bounds = np.searchsorted(gram, np.arange(0, width + COLUMNS, COLUMNS))
    for i in range(len(bounds) - 1):
        part = slice(bounds[i], bounds[i + 1])
        has = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        has[owner[part], gram[part] - i * COLUMNS] = 1
        out += (has[:len(left)] @ has[len(left):].T).astype(np.int64)
    return out


def _whole_sets(rows: list[tuple], rule: Rule) -> tuple[list[tuple], list[np.ndarray]]:
    """The rows (node first, packed text last) whose text is the node's, and not another one of its doc_id and hash; with their sets."""
    sets = list(_unpacked_sets(pd.Series([r[-1] for r in rows]), rule))
    same = [i for i, g in enumerate(sets) if set_key(g) == rows[i][0]]
    return [rows[i] for i in same], [sets[i] for i in same]


def _linked(left: list[np.ndarray], right: list[np.ndarray], rule: Rule) -> np.ndarray:
    common = common_counts(left, right)
    n, m = np.array([len(g) for g in left]), np.array([len(g) for g in right])
    return 100 * common >= rule.share * (n[:, None] + m - common)


def _block_pairs(laid: DataFrame, group: str, values: list[str], schema: str, handle) -> DataFrame:
    """``handle(low, high)`` of the rows (``values``) of each pair of blocks of a group, as rows of ``schema``.

    ``laid`` has a group, low, high, block and the values; rows with block = low are the one side, those with block = high the other.
    """
    parts = max(int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = laid.repartition(parts, group, "low", "high").sortWithinPartitions(group, "low", "high")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sides = None, None
        for batch in batches:
            done = []
            for key, block, row in zip(zip(*(batch[c].tolist() for c in (group, "low", "high")), strict=True), batch["block"].tolist(),
                                       zip(*(batch[c].tolist() for c in values), strict=True), strict=True):
                if key != now:
                    if now:
                        done.append(handle(now[1] == now[2], *sides))
                    now, sides = key, ([], [])
                if block == key[1]:
                    sides[0].append(row)
                if block == key[2]:
                    sides[1].append(row)
            if done:
                yield pd.concat(done)
        if now:
            yield handle(now[1] == now[2], *sides)

    return laid.select(group, "low", "high", "block", *values).mapInPandas(task, schema)


def _open_links(members: DataFrame, found: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): a link between each two components that nodes of one hub join, besides those through the hub's centre.

    ``members`` (hub, node, centre) are what hub and centre leave open. Those outside the centre's component meet each other and
    those inside it in pairs of blocks; a task gives one link for two components, however many there are.
    """
    main = found.select(F.col("node").alias("centre"), F.col("component").alias("main"))
    near = (_placed(members.select("hub", "node", "centre"), found).join(main, "centre", "left")
            .withColumn("inside", F.col("component") == F.coalesce("main", "centre")))
    sizes = near.groupBy("hub").agg(F.ceil(F.count_if(~F.col("inside")) / BLOCK_MEMBERS).alias("outer"),
                                    F.ceil(F.count_if("inside") / BLOCK_MEMBERS).alias("inner")).where("outer > 0")
    zero = F.lit(0).cast("bigint")
    block = F.when(F.col("inside"), F.col("outer") + F.pmod(F.xxhash64("node"), F.greatest("inner", F.lit(1)))).otherwise(
        F.pmod(F.xxhash64("node"), "outer"))
    last = F.when(F.col("inside"), F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1)
    laid = (near.join(sizes, "hub").withColumn("block", block).withColumn("partner", F.explode(F.sequence(zero, last)))
            .join(texts, "node").select("hub", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"),
                                        "block", "node", "component", "packed"))

    def handle(same: bool, left: list[tuple], right: list[tuple]) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": []}).astype("int64")
        if not left or not right:
            return none
        (left, low), (right, high) = _whole_sets(left, rule), _whole_sets(right, rule)
        if not left or not right:
            return none
        a, b = np.array([r[1] for r in left], np.int64), np.array([r[1] for r in right], np.int64)
        i, j = np.nonzero(_linked(low, high, rule) & (a[:, None] != b))
        if not len(i):
            return none
        _, first = np.unique(np.stack([a[i], b[j]]), axis=1, return_index=True)
        return pd.DataFrame({"a": [left[x][0] for x in i[first].tolist()], "b": [right[x][0] for x in j[first].tolist()]})

    return _block_pairs(laid, "hub", ["node", "component", "packed"], "a bigint, b bigint", handle)


def _link_counts(found: DataFrame, texts: DataFrame, weights: DataFrame, rule: Rule) -> DataFrame:
    """(node, links): how many texts of other nodes each node of a component is linked with.

    Links lie within components. A component's nodes are dealt into blocks of about ``BLOCK_MEMBERS``, and each pair of blocks is
    counted at once in one task, so that no pair becomes a row and no task holds a component.
    """
    sizes = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).alias("blocks"))
    partner = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("partner")
    laid = (found.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
            .join(weights, "node").join(texts, "node").select("component", "block", "node", "texts", "packed", partner)
            .select("component", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"),
                    "block", "node", "texts", "packed"))

    def handle(same: bool, left: list[tuple], right: list[tuple]) -> pd.DataFrame:
        none = pd.DataFrame({"node": [], "links": []}).astype("int64")
        if not left or not right:
            return none
        left, low = _whole_sets(left, rule)
        right, high = (left, low) if same else _whole_sets(right, rule)
        if not left or not right:
            return none
        linked = _linked(low, high, rule)
        if same:
            np.fill_diagonal(linked, False)
        ends = [(left, linked @ np.array([r[1] for r in right]))]
        if not same:
            ends.append((right, linked.T @ np.array([r[1] for r in left])))
        return pd.DataFrame({"node": [r[0] for rows, _ in ends for r in rows], "links": np.concatenate([n for _, n in ends])})

    counted = _block_pairs(laid, "component", ["node", "texts", "packed"], "node bigint, links bigint", handle)
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(docs: DataFrame, rule: Rule, keep: tuple[str, ...] = ("doc_id",), count_links: bool = False) -> DataFrame:
    """Every row of ``docs`` as its ``keep`` columns (doc_id among them), n_shingles, component_id and component.

    ``component`` names the row's group where ids repeat or are null; it is null for a row without words.
    With ``count_links`` also ``n_links``: with how many different texts the row's text is linked, exactly.
    """
    bounded_batches(docs.sparkSession)
    told = docs.select(*keep, F.xxhash64("text").alias("text_hash"), "text")
    facts = written(_facts(told, rule, [*keep, "text_hash"]), "sets")
    nodes = written(facts.where("n > 0").select("node", "n", "sample", "extra").distinct(), "nodes")
    places = written(_places(facts), "places")
    rows = written(facts.select(*keep, "text_hash", "n", "node"), "rows")
    discard(facts)
    signed = _signed(nodes, rule)
    discard(nodes)
    pairs = written(signed.where("node != hub").select("hub", "node").distinct(), "stars")
    ends = pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct()
    texts = _texts(docs, places, ends)
    stars = written(_compare(pairs, texts, rule), "compared")
    links = _links(stars, rule)
    found = written(components(links), "components")
    members = written(_open_members(signed, stars, found, texts, rule), "centred")
    again = written(_compare(members.select(F.col("centre").alias("hub"), "node").distinct(), texts, rule), "compared")
    links = links.union(_links(again, rule))
    found = written(components(links), "components")
    links = links.union(written(_open_links(members, found, texts, rule), "open-links")).distinct()
    found = written(components(links), "components") if count_links else components(links)
    named = places.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("node", "component", "component_id")
    shown = [F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
             "component"]
    if count_links:
        weights = rows.where("n > 0").groupBy("node", "text_hash").agg(F.lit(1)).groupBy("node").agg(F.count(F.lit(1)).alias("texts"))
        named = (named.join(weights, "node").join(_link_counts(found, texts, weights, rule), "node", "left")
                 .withColumn("n_links", F.col("texts") - 1 + F.coalesce("links", F.lit(0).cast("bigint"))))
        shown.append(F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    return rows.select(*keep, "n", "node").join(named, "node", "left").select(*keep, *shown)


def ngram_components(docs: DataFrame) -> DataFrame:
    """op1: 3-word shingles, similarity 0.9."""
    return near_duplicates(docs.select("doc_id", "text"), Rule(3, 90), count_links=True).drop("component")
