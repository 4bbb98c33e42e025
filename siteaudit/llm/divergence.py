"""How far the sources of each language differ in their vocabulary, with copies of a text counted but read once.

1. Equal texts of a language are one row, with the number of copies in each source (a text's sources go in lists of at most
   ``SOURCES_IN_LIST``). Each distinct text is cut into terms once; its counts and its document are weighted by its copies.
2. A task adds up what it reads and sends one row a term, which holds what each source has of it. Terms in at least
   ``least_documents`` documents of their language stay.
3. Each group (lang, source) and each language gives a kept term the weight ``1 + floor(SCALE * (n + 2) / (N + 2 V))``.
   Two weights differ by ``floor((p - q)^2 / (p + q))``.
4. Pairs of sources are compared sparsely: only terms that one of the two holds are looked at; all other terms add the same
   known difference. Terms are dealt into buckets and sources into blocks of bounded size, so that no task holds a language.

All arithmetic is on integers. Null text, lang and source are read as ''. A group without terms is compared too; a
language without kept terms has pairs of value 0 and no terms. Equal values rank by the item's bytes. Repeated rows count
each time. An empty table gives no rows. Only text, lang and source are read, so other columns don't matter.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 1_000_000_000
SOURCES_IN_LIST = 4096
#: Entries (lang, source, term) that a task adds up before it sends them on.
ENTRIES = 400_000
#: Terms in a bucket and sources in a block, about, when pairs are compared.
BUCKET_TERMS, BLOCK_SOURCES = 2048, 256

#: Letters stay, A-Z in lower case; every other ASCII byte parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def copies(docs: DataFrame) -> DataFrame:
    """(lang, hash, source, n): how often each text stands in each source."""
    return docs.groupBy("lang", "hash", "source").agg(F.count(F.lit(1)).alias("n"))


def collapsed(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, text, sources): each distinct text of a language, with its copies in each source."""
    place = F.row_number().over(Window.partitionBy("lang", "hash").orderBy("source")) - 1
    lists = (held.withColumn("list", F.floor(place / SOURCES_IN_LIST)).groupBy("lang", "hash", "list")
             .agg(F.collect_list(F.struct("source", "n")).alias("sources")))
    texts = docs.groupBy("lang", "hash").agg(F.first("text").alias("text"))
    return texts.join(lists, ["lang", "hash"]).select("lang", "text", "sources")


def _sent(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """One row for each term of each language, with its sources."""
    by_lang: dict[str, dict[bytes, list]] = {}
    for (lang, source), (n, documents) in counts.items():
        terms = by_lang.setdefault(lang, {})
        for term, times in n.items():
            terms.setdefault(term, []).append((source, times, documents[term]))
    counts.clear()
    for lang, terms in by_lang.items():
        names = sorted(terms)
        for at in range(0, len(names), 20_000):
            part = names[at:at + 20_000]
            held = [terms[t] for t in part]
            ends = np.cumsum([0] + [len(h) for h in held]).astype(np.int32)
            columns = [[e[i] for h in held for e in h] for i in range(3)]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c, t)) for c, t in zip(
                columns, (pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()),
                                              pa.array(part, pa.binary()).cast(pa.string()), *lists],
                                             ["lang", "term", "sources", "n", "documents"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0
    for batch in batches:
        for lang, text, sources in zip(*(batch.column(c) for c in ("lang", "text", "sources")), strict=True):
            lang, words = lang.as_py(), terms_of(text.as_py())
            if not words:
                continue
            distinct, once = set(words), None
            for source in sources.as_py():
                n, documents = counts.setdefault((lang, source["source"]), (Counter(), Counter()))
                entries -= len(n)
                if source["n"] == 1:
                    n.update(words)
                    documents.update(distinct)
                else:
                    once = once or Counter(words)
                    for term, times in once.items():
                        n[term] += times * source["n"]
                        documents[term] += source["n"]
                entries += len(n)
                if entries > ENTRIES:
                    yield from _sent(counts)
                    entries = 0
    yield from _sent(counts)


def kept_terms(texts: DataFrame, least_documents: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of the kept terms; ``first`` marks one row of each term.

    The rows that tasks send meet once, by (lang, term): a term's sources are added up and filtered there.
    """
    sent = texts.mapInArrow(_count, "lang string, term string, sources array<string>, n array<bigint>, documents array<bigint>")
    entry = F.explode(F.arrays_zip("sources", "n", "documents")).alias("e")
    added = (sent.repartition("lang", "term").select("lang", "term", entry)
             .groupBy("lang", "term", F.col("e.sources").alias("source"))
             .agg(F.sum("e.n").alias("n"), F.sum("e.documents").alias("documents")))
    term = Window.partitionBy("lang", "term")
    return (added.withColumns({"lang_n": F.sum("n").over(term), "held": F.sum("documents").over(term),
                               "first": F.col("source") == F.min("source").over(term)})
            .where(F.col("held") >= least_documents).select("lang", "source", "term", "n", "lang_n", "first"))


def weight(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact; null without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    below = (total + 2 * terms).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(20,0)")))


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_totals(held: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total, none, block, blocks, buckets) of every occurring group.

    ``none`` is the weight of a kept term that the group lacks.
    """
    groups = held.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SOURCES).alias("blocks")).join(langs, "lang", "left")
    zero = F.lit(0).cast("bigint")
    rows = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"),
        F.coalesce("lang_total", zero).alias("lang_total"), "blocks")
    return rows.withColumns({
        "none": weight(F.lit(0), F.col("total"), F.col("terms")),
        "block": F.pmod(F.xxhash64("source"), "blocks"),
        "buckets": F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("terms") / BUCKET_TERMS))})


def leading_terms(kept: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """Part ``term``: the terms that a group holds most above its language."""
    p = weight(F.col("n"), F.col("total"), F.col("terms"))
    q = weight(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    rows = (kept.where("n > 0").join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
            .select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
            .select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value")))
    return ranked(rows, "term").where(F.col("rank") <= ranks)


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _compare(rows: pa.Table) -> pa.Table:
    """The pairs between two blocks of sources, over the terms of one bucket that one of the two sources holds.

    Rows without a term name the sources, with the weight of a term that they lack.
    """
    at = {c: rows.column(c).to_numpy() for c in ("block", "p", "low", "high")}
    header = rows.column("term").is_null().to_numpy()
    low, high = int(at["low"][0]), int(at["high"][0])
    source = rows.column("source").combine_chunks().dictionary_encode()
    code, names = source.indices.to_numpy(), source.dictionary.to_pylist()
    term = rows.column("term").combine_chunks().dictionary_encode()
    n_terms, term = len(term.dictionary), term.indices.fill_null(0).to_numpy()

    def side(block: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names, weights of lacking terms, and (source, term, weight) of what is held."""
        mine = np.flatnonzero(header & (at["block"] == block))
        mine = mine[np.argsort(np.array([names[c].encode() for c in code[mine]], object), kind="stable")]
        place = np.full(len(names), -1)
        place[code[mine]] = np.arange(len(mine))
        cells = np.flatnonzero(~header & (at["block"] == block))
        return [names[c] for c in code[mine]], at["p"][mine], place[code[cells]], term[cells], at["p"][cells]

    def apart(p, q):
        return (p - q) ** 2 // (p + q)

    left_names, left_none, left_at, left_term, left_p = side(low)
    right_names, right_none, right_at, right_term, right_p = side(high)
    dense = np.repeat(right_none[:, None], n_terms, axis=1)
    dense[right_at, right_term] = right_p
    order = np.argsort(left_at, kind="stable")
    bounds = np.searchsorted(left_at[order], np.arange(len(left_names) + 1))
    out = {"a": [], "b": [], "value": [], "base": []}
    for i, name in enumerate(left_names):
        own = order[bounds[i]:bounds[i + 1]]
        base = apart(left_none[i], right_none)
        value = (apart(left_p[own], dense[:, left_term[own]]) - base[:, None]).sum(axis=1)
        holds = np.zeros(n_terms, bool)
        holds[left_term[own]] = True
        rest = ~holds[right_term]
        other = right_at[rest]
        np.add.at(value, other, apart(left_none[i], right_p[rest]) - base[other])
        for j in range(i + 1 if low == high else 0, len(right_names)):
            out["a"].append(name)
            out["b"].append(right_names[j])
            out["value"].append(int(value[j]))
            out["base"].append(int(base[j]))
    n = len(out["a"])
    return pa.table([pa.array([rows.column("lang")[0].as_py()] * n, pa.string()), pa.array(out["a"], pa.string()),
                     pa.array(out["b"], pa.string()), pa.array(out["value"], pa.int64()), pa.array(out["base"], pa.int64())],
                    ["lang", "a", "b", "value", "base"])


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Part ``pair``: each source against each other source of its language."""
    partner = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("partner")
    ends = [F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high")]
    p = weight(F.col("n"), F.col("total"), F.col("terms"))
    cells = (kept.where("n > 0").join(groups, ["lang", "source"])
             .select("lang", F.pmod(F.xxhash64("term"), "buckets").alias("bucket"), "block", "source", "term", p.alias("p"), partner))
    names = (groups.select("lang", "block", "source", F.lit(None).cast("string").alias("term"),
                           F.coalesce("none", F.lit(1).cast("bigint")).alias("p"), partner, "buckets")
             .select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)).alias("bucket"),
                     "block", "source", "term", "p", "partner"))
    rows = cells.unionByName(names).select("lang", "bucket", *ends, "block", "source", "term", "p")
    compared = rows.groupBy("lang", "bucket", "low", "high").applyInArrow(
        _compare, "lang string, a string, b string, value bigint, base bigint")
    added = compared.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.max("base").alias("base"))
    terms = groups.groupBy("lang").agg(F.max("terms").alias("terms"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    # terms that neither holds, and those that were compared less this same base
    value = F.col("value") + F.col("base") * F.col("terms")
    return ranked(added.join(terms, "lang").select("lang", both.alias("e"), value.alias("value"))
                  .select("lang", "e.source", "e.item", "value"), "pair")


def audit_sources(docs: DataFrame, least_documents: int = 10, ranks: int = 10) -> DataFrame:
    """op11: (lang, source, part, item, value, rank), parts ``pair`` and ``term``."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    rows = rows.withColumn("hash", F.unhex(F.sha2("text", 256)))
    held = written(copies(rows), "copies")
    kept = written(kept_terms(collapsed(rows, held), least_documents), "terms")
    groups = written(group_totals(held, kept), "groups")
    return source_pairs(kept, groups).unionByName(leading_terms(kept, groups, ranks))
