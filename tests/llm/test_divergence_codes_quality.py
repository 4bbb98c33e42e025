"""Source divergence, vector codes and quality trees against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from siteaudit.llm import divergence, quality_trees, vector_codes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- divergence
def plain_divergence(rows, least, ranks):
    counts, documents = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        documents[lang or ""].update(set(words))
    out = set()
    for lang, held in documents.items():
        kept = [t for t, n in held.items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def weights(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return [1 + 10 ** 9 * (c[t] + 2) // total for t in kept]

        p = {s: weights(c) for s, c in groups.items()}
        q = weights(sum(groups.values(), collections.Counter()))
        for s in groups:
            pairs = sorted((-sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o])), o.encode()) for o in groups if o != s)
            terms = sorted((-((a - b) ** 2 // (a + b)), t.encode()) for t, a, b in zip(kept, p[s], q) if groups[s][t] and a > b)
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            out |= {(lang, s, "term", o.decode(), -v, i + 1) for i, (v, o) in enumerate(terms[:ranks])}
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def odd_rows():
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "été", "日本語", "x" * 500, "gamma", "É", "É", "zeta", " nb"]
    rows = [(None, None, None), ("", "en", "none"), ("12 _ 3", "en", None), (" ".join(words) * 2000, "en", "long"), ("beta", None, "a")]
    for i in range(150):
        text = "-".join(rng.choice(words, int(rng.integers(0, 9))))
        rows += [(text, ["en", "de", None][i % 3], ["a", "b", "c", "d", None][int(rng.integers(0, 5))])] * (30 if i == 7 else 1)
    return rows


@pytest.mark.parametrize("least", [1, 10, 10_000])
def test_divergence_equals_plain_version(spark, least):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    docs = docs.withColumnsRenamed({"doc_id": "term"}).selectExpr("*", "'clash' AS n", "array(1) AS sources", "2 AS block", "3 AS rank")
    assert found(divergence.audit_sources(docs.repartition(5), least, 3)) == plain_divergence(rows, least, 3)


def test_divergence_over_small_blocks_and_lists(spark, monkeypatch):
    for name, value in (("ENTRIES", 3), ("BUCKET_TERMS", 2), ("BLOCK_SOURCES", 2), ("SOURCES_IN_LIST", 2)):
        monkeypatch.setattr(divergence, name, value)
    rows = odd_rows()[:80] + [("same text for all", "en", f"s{i}") for i in range(9)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    assert found(divergence.audit_sources(docs, 2, 4)) == plain_divergence(rows, 2, 4)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], DOCS)).collect() == []


# ---------------------------------------------------------------- vector codes
def plain_codes(vectors, parts, entries, rounds):
    """(codes, errors, codebooks) of integer vectors that are sorted by id."""
    cut = np.split(vectors, parts, axis=1)
    books = [c[:entries].copy() for c in cut]
    for r in range(rounds + 1):
        d = [((c[:, None] - b) ** 2).sum(axis=2) for c, b in zip(cut, books)]
        near = [x.argmin(axis=1) for x in d]
        if r < rounds:
            for c, b, at in zip(cut, books, near):
                for j in range(len(b)):
                    if (at == j).any():
                        b[j] = c[at == j].sum(axis=0) // (at == j).sum()
    return ["".join(f"{int(x):02x}" for x in row) for row in zip(*near)], sum(x.min(axis=1) for x in d).tolist(), books


@pytest.mark.parametrize("n", [1, 9, 16, 700])
def test_codes_equal_plain_version(spark, monkeypatch, n):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(size=(n, 16)) * rng.choice([0.01, 1, 3], (n, 1)), 2)
    v[n // 2:] = v[n // 2:][rng.integers(0, max(1, n // 9), n - n // 2)] if n > 16 else v[n // 2:]    # many equal vectors
    rows = [(i, v[i].tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    bad = [(1000, None, 1), (-1, [], 1), (-2, [None] + [0.0] * 15, 1), (-3, [float("nan")] * 16, 1), (-4, [float("inf")] * 16, None)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").selectExpr(
        "*", "'clash' AS code", "1 AS key", "2 AS error", "3 AS its").repartition(3)
    got = {r["vec_id"]: r for r in vector_codes.compress_embeddings(df).collect()}
    codes, errors, books = plain_codes(np.floor(4096 * v).astype(np.int64), 8, 16, 6)
    assert sorted(got) == list(range(n))
    assert [got[i]["code"] for i in range(n)] == codes
    assert [got[i]["error"] for i in range(n)] == errors
    by_label = collections.Counter()
    for i in range(n):
        by_label[i % 3] += errors[i]
    assert all(got[i]["label_error"] == by_label[i % 3] for i in range(n))
    flat = ",".join(str(x) for b in books for x in b.ravel().tolist())
    assert {r["codebooks_sha256"] for r in got.values()} == {hashlib.sha256(flat.encode()).hexdigest()}


def test_trees_own_whole_balls_exactly():
    rng = np.random.default_rng(2)
    for points in (rng.normal(0, 900, (900, 4)) + rng.choice([-20000, 0, 30000], (900, 1)), rng.integers(-2, 3, (500, 3)), np.zeros((70, 2))):
        points = points.astype(np.int64)
        tree = vector_codes.Tree.unpacked(vector_codes.grow(points).packed())
        assert sorted(tree.row.tolist()) == list(range(len(points)))
        for (lo, hi, left, right), ball, total in zip(tree.links, tree.balls, tree.sums):
            assert (tree.points[lo:hi].sum(axis=0) == total).all()
            assert np.sqrt(((tree.points[lo:hi] - ball[:-1]) ** 2).sum(axis=1)).max() <= ball[-1] + 1e-6
            assert left < 0 or (tree.links[left, 0], tree.links[left, 1], tree.links[right, 0], tree.links[right, 1]) == (
                lo, tree.links[right, 0], tree.links[left, 1], hi)
        entries = points[[0, 1, 1, 5, 50, 9, 3]]
        d = ((points[:, None] - entries) ** 2).sum(axis=2)
        code, error = vector_codes.assigned(tree, entries)
        assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
        sums, numbers = vector_codes.gathered(tree, entries)
        assert (numbers == np.bincount(code, minlength=7)).all()
        assert all((sums[j] == points[code == j].sum(axis=0)).all() for j in range(7))
    near = np.concatenate([np.full((400, 2), 10), np.full((400, 2), 5000)]) + rng.integers(0, 9, (800, 2))
    assert len(vector_codes.owned(vector_codes.grow(near), np.array([[0, 0], [5000, 5000]]))[2]) == 0     # all by cached sums


def test_codes_of_empty_ragged_and_oversized(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress_embeddings(spark.createDataFrame([], kind)).collect() == []
    ragged = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 8, 1), (2, [1.0] * 8, 1), (None, [2.0] * 8, 1), (4, [1.0] * 16, 1)], kind)
    got = vector_codes.compress_embeddings(ragged).collect()
    assert sorted((r["vec_id"] or 0, r["code"]) for r in got) == [(0, "03" * 8), (1, "00" * 8), (2, "00" * 8), (2, "00" * 8)]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress_embeddings(spark.createDataFrame([(1, [1.0] * 9, 1)], kind))
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress_embeddings(spark.createDataFrame([(1, [1e20] * 8, 1)], kind)).collect()


# ---------------------------------------------------------------- quality
def test_statistics_of_whole_texts():
    texts = ["", None, "a a a b", "One line.\nOne line.\nOther!", "\n\n", "é" * 10, "x " * 200_000, " "]
    x = quality_trees.statistics(texts)
    assert x.shape[0] == len(texts) and np.isfinite(x).all()
    together = x.tolist()
    assert all(quality_trees.statistics([t])[0].tolist() == together[i] for i, t in enumerate(texts))
    assert x[0].tolist() == x[1].tolist() and not x[0].any()
    assert x[2, 0] == np.log1p(7) and x[2, 1] == np.log1p(4)
    tail = quality_trees.statistics(["a a a b"])[0][-13:]
    #      longest, distinct, once, most, same, pairs, most pair, closed, odd, chars/line, words/line, lines, repeated
    assert tail[1:9].tolist() == [0.5, 0.25, 0.75, 0.5, 2 / 3, 2 / 3, 0, 0]
    assert quality_trees.statistics([texts[3]])[0][-2:].tolist() == [2 / 3, 18 / 26]


def test_forest_finds_what_a_plain_search_finds():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 4, 400), np.zeros(400)])
    y = ((x[:, 1] >= 2) ^ (x[:, 0] > 0.3)).astype(float)
    one = quality_trees.train(x, y, trees=1, depth=1)
    share = (y.sum() + 1) / (len(y) + 2)
    g, h = share - y, np.full(len(y), share * (1 - share))

    def gain(mask):
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (mask, ~mask)) - g.sum() ** 2 / (h.sum() + 1)

    cuts = quality_trees.cuts_of(x)
    best = max((gain(x[:, c] <= t) for c in range(3) for t in cuts[c] if min(h[x[:, c] <= t].sum(), h[x[:, c] > t].sum()) >= 1))
    assert gain(x[:, one.statistic[0, 0]] <= one.threshold[0, 0]) == pytest.approx(best)
    forest = quality_trees.train(x, y)
    assert ((forest.scores(x) >= 0.5) == y).all()
    for row, score in zip(x[:50], forest.scores(x[:50])):       # the arrays, walked one node at a time
        margin = forest.base
        for statistic, threshold, value in zip(forest.statistic, forest.threshold, forest.value):
            node = 0
            while node < len(statistic):
                node = 2 * node + (2 if row[statistic[node]] > threshold[node] else 1)
            margin += value[node - len(statistic)]
        assert score == pytest.approx(1 / (1 + np.exp(-margin)))


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_trees.score_documents(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    assert {r["doc_id"]: r["score"] for r in quality_trees.score_documents(docs.drop("lang", "source"), flipped).collect()} == {
        i: r["score"] for i, r in got.items()}     # held-out labels, lang and source are no inputs


def test_quality_of_odd_rows(spark):
    rows = [(None, None), (1, None), (1, ""), (2, "word " * 300_000), (3, "!!! $$$ !!!"), (3, "!!! $$$ !!!"), (5, "plain text.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS label", "1D AS score", "array(2) AS x")
    kind = "doc_id long, quality int, text string"
    none = quality_trees.score_documents(docs, spark.createDataFrame([], kind)).collect()
    assert len(none) == len(rows) and {r["score"] for r in none} == {0.5}
    labels = [(i, i % 2, "clash") for i in range(9)] + [(None, 1, ""), (3, None, ""), (5, 7, ""), (1, 1, ""), (1, 0, "")]
    got = quality_trees.score_documents(docs, spark.createDataFrame(labels, kind)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_trees.score_documents(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(labels, kind)).collect() == []
