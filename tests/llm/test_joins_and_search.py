"""Near copies, benchmark passages, neighbours, personal data: against brute force; odd inputs."""

import random

import numpy as np
from brute import all_personal, components, personal, sha256, word_sets

from pyspark.sql import functions as F

from siteaudit.llm import decontaminate, ngram_join, personal_data, projection_forest
from siteaudit.llm import components as cc

SF = "/root/testdata/sf0.001"


def near_corpus():
    """Groups of near copies, a passage that many share, exact copies, odd rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], [rng.choice(words) for _ in range(150)]
    for i in range(120):
        text = base.copy()
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((1000 + i, " ".join(text)))
    passage = [rng.choice(words) for _ in range(30)]
    rows += [(2000 + i, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(0, 40))])) for i in range(150)]
    for i in range(80):
        short = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        rows.append((3000 + i, " ".join(short)))
    rows += [(4000 + i, " ".join(base)) for i in range(40)]
    rows += [(5000, None), (5001, ""), (5002, "One  two\tthree"), (5003, "one two three"), (5004, "one two"), (5005, "one two")]
    return rows


def test_ngram_join_equals_brute_force(spark):
    rows = near_corpus()
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id bigint, text string, n bigint, component_id string")
    for k, share in ((3, 90), (5, 80), (2, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(table, ngram_join.Rule(k, share)).collect()}
        ids = [d for d, _ in rows]
        assert got == dict(zip(ids, components(ids, word_sets([t for _, t in rows], k), share), strict=True))


def edge_groups():
    """Groups of three texts: two that are linked, and one between them and far texts that shares n-grams with one of the two only."""
    rng, rows = random.Random(11), []
    words = [f"v{i}" for i in range(4000)]
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(50, 160))]
        for _ in range(rng.randint(3, 5)):
            text = base.copy()
            for _ in range(rng.randint(0, len(base) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


def test_ngram_join_rules_out_no_link_in_small_groups(spark):
    rows = edge_groups()
    for share in (80, 90):
        got = {r.doc_id: (r.n_shingles, r.component_id)
               for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), ngram_join.Rule(3, share)).collect()}
        ids = [d for d, _ in rows]
        assert got == dict(zip(ids, components(ids, word_sets([t for _, t in rows], 3), share), strict=True))


def test_second_stars_settle_a_group_whose_hub_is_at_its_edge(spark, monkeypatch):
    rng, rows = random.Random(8), []
    words = [f"u{i}" for i in range(20000)]
    base = [rng.choice(words) for _ in range(150)]
    for i in range(400):
        text = base.copy()
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    pairs, rest = [], ngram_join._open_links
    monkeypatch.setattr(ngram_join, "_open_links", lambda *a: pairs.append(rest(*a)) or pairs[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    ids = [d for d, _ in rows]
    assert got == dict(zip(ids, components(ids, word_sets([t for _, t in rows], 3), 90), strict=True))
    assert pairs[0].count() < len(rows)


def test_ngram_join_repeated_null_and_no_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (1, "q r s"), (3, "q r s"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.ngram_components(table).collect())
    assert got == sorted(map(str, [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (1, 1, 1), (3, 1, 1), (None, 0, None)]))
    assert ngram_join.ngram_components(table.limit(0)).count() == 0


def test_ngram_join_finds_each_text_once_where_ids_repeat_or_are_null(spark, monkeypatch):
    rows = [(None if i % 3 else 7, t) for i, (_, t) in enumerate(edge_groups())]
    rows += rows[:20] * 5
    found, texts = [], ngram_join._texts
    monkeypatch.setattr(ngram_join, "_texts", lambda *a: found.append(texts(*a)) or found[-1])
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), ngram_join.Rule(3, 80)).collect()
    assert found[0].count() == found[0].select("node").distinct().count() > 150
    names, sets = list(range(len(rows))), word_sets([t for _, t in rows], 3)
    groups = {}
    for (d, _), (n, c) in zip(rows, components(names, sets, 80), strict=True):
        groups.setdefault(c, []).append((d, n))
    least = {c: min((d for d, _ in g if d is not None), default=None) for c, g in groups.items()}
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(
        str((d, n, least[c])) for c, g in groups.items() for d, n in g)
    assert len({r.component for r in got}) == len(groups)


def test_signatures_meet_for_all_linked_sets():
    rng = np.random.default_rng(2)
    for share in (80, 90):
        rule = ngram_join.Rule(3, share)
        for _ in range(300):
            n = int(rng.integers(1, 120))
            a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            b = np.concatenate([a[rng.permutation(n)[rule.errors(n) // 2:]], rng.integers(0, 1 << 64, rule.errors(n) // 2, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if not rule.linked(len(a), len(b), len(np.intersect1d(a, b))):
                continue
            often = rng.random() < 0.5
            sigs = []
            for s, other in ((a, b), (b, a)):
                sample, extra = ngram_join.split_sample(s, rule)
                shared = sample[np.isin(sample, other)]
                frequency = np.where(shared % np.uint64(3) == 0, 2, 1000) if often else np.full(len(shared), 2)
                sigs.append(ngram_join.signatures(len(s), len(sample), shared, frequency, extra, rule))
            assert len(np.intersect1d(*sigs)) > 0


def test_linked_sizes_share_a_class():
    for share in (60, 80, 90, 100):
        rule = ngram_join.Rule(3, share)
        classes = {n: set(ngram_join.size_classes(n, rule)) for n in range(1, 1500)}
        for n in classes:
            assert all(classes[n] & classes[m] for m in range(-(-n * share // 100), n + 1))
        if share > 60:
            assert not classes[100] & classes[1000]


def test_subsets_share_a_signature():
    rng = np.random.default_rng(3)
    rule = ngram_join.Rule(3, 90)
    for n in range(1, 400):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.sort(a[rng.permutation(n)[rule.errors(n):]])
        sigs = []
        for s, other in ((a, b), (b, a)):
            sample, extra = ngram_join.split_sample(s, rule)
            shared = sample[np.isin(sample, other)]
            frequency = np.where(shared % np.uint64(3) == 0, 2, 1000)
            sigs.append(ngram_join.signatures(len(s), len(sample), shared, frequency, extra, rule))
        assert rule.linked(len(a), len(b), len(b)) and len(np.intersect1d(*sigs)) > 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201)]
    got = dict(cc.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, draw(rng.randint(15, 60))) for i in range(60)]
    rows, expected = [], set()
    for i in range(300):
        rows.append((i, " ".join(draw(rng.randint(0, 300)))))
    for i, w in items[:40]:
        text = w.copy()
        if i % 2:                                       # a paraphrase: some words of the first part replaced
            for _ in range(len(w) // 8):
                text[rng.randrange(len(w) - 8)] = rng.choice(words)
        rows.append((1000 + i, " ".join(draw(rng.randint(0, 200)) + [x.upper() if i % 4 == 0 else x for x in text] + draw(20))))
        expected.add((1000 + i, i))
    docs = spark.createDataFrame([(*r, "z") for r in rows] + [(None, None, None), (5000, "", "")], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(None, "a b c d e"), (99, None), (98, ""), (97, "the")],
                                  "item_id bigint, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_common_subsequence():
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, 90)) for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == plain(a.tolist(), b.tolist())


def brute_neighbours(rows, k=5):
    table = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            table[i] = np.array(v, np.float32).astype(float)
    ids = sorted(table)
    out = {}
    for q in (i for i in ids if i % 50 == 0):
        score = {i: float((table[q] * table[i]).sum() / (np.sqrt((table[q] ** 2).sum()) * np.sqrt((table[i] ** 2).sum()))) for i in ids if i != q}
        out[q] = sorted(((-s, i) for i, s in score.items()))[:k]
    return out


def recall(spark, rows):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    truth, got = brute_neighbours(rows), {}
    for r in projection_forest.nearest_embeddings(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == {q for q, t in truth.items() if t}
    found = 0
    for q, rows_ in got.items():
        assert [x[0] for x in sorted(rows_)] == list(range(1, len(truth[q]) + 1))
        assert [(-s, i) for _, i, s in sorted(rows_)] == sorted((-s, i) for _, i, s in rows_)
        found += len({i for _, i, _ in rows_} & {i for _, i in truth[q]})
    return found / max(1, sum(map(len, truth.values())))


def test_forest_recall_with_odd_and_repeated_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1500)]
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(2000 + i, same) for i in range(500)] + [rows[0], (None, same), (3000, None), (3050, [0.0] * 8), (3100, [1.0] * 7),
                                                      (3150, [float("nan")] + [1.0] * 7), (3200, [None] + [1.0] * 7)]
    assert recall(spark, rows) >= 0.9
    assert recall(spark, rows[:3]) == 1.0
    assert projection_forest.nearest_embeddings(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_forest_recall_on_given_table(spark):
    pdf = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    vectors = np.stack(pdf["embedding"].to_numpy()).astype(float)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    ids, hits, n = pdf["vec_id"].to_numpy(), 0, 0
    got = projection_forest.nearest_embeddings(spark.read.parquet(f"{SF}/embeddings.parquet")).toPandas()
    for q in ids[ids % 50 == 0]:
        score = unit @ unit[ids == q][0]
        score[ids == q] = -2
        truth = set(ids[np.argsort(-score)[:5]].tolist())
        hits += len(truth & set(got[got["query_id"] == q]["vec_id"].tolist()))
        n += 5
    assert hits >= 0.9 * n


PII_ROWS = [None, "", "a@b.c", "x@y@z.com a@b.com.x@y.z a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 5",
            "4111-1111-1111-1111 41111111111111111", "+1 (743) 555-3824 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "ü🙂 é@x.y a.b@c-d.e-f 🙂10.0.0.1",
            "7" * 3000, "a." * 3000 + "@x", "a@" + "b." * 3000 + "c", "+" + "1 " * 900, "@ @ @", "12 " * 2000]


def test_personal_data_base_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.union(spark.createDataFrame([(-i, t) for i, t in enumerate(PII_ROWS, 1)] + [(None, "a@b.c"), (-3, "a@b.c")], docs.schema))
    found = personal_data.report(rows.selectExpr("doc_id", "text", "1 as row", "2 as start")).collect()
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found)
    expected = []
    for r in rows.collect():
        spans = personal(r.text)
        expected.append((str(r.doc_id), *[sum(s.startswith(k + ":") for s in spans) for k in personal_data.BASE], sha256(",".join(spans))))
    assert got == sorted(expected)
    assert personal_data.report(rows.limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"filler words mail to user{i}@host.example now") for i in range(12)]
    rows += [(100, "other words mail to user77-at-host99 now"), (101, "plain words went 123456 now")]
    rows += [(200 + i, f"some value {i}99999 of {i}12345") for i in range(8)]
    got = {r.doc_id: r.spans for r in personal_data.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    at = rows[12][1].index("user77")
    assert got[100] == f"email:{at}:{at + len('user77-at-host99')}"
    assert got[101] == "" and all(got[200 + i] == "" for i in range(8))


KEY = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"


def test_keys_and_what_stands_in_their_contexts(spark):
    """Keys are spans where several stand in one context, then a short one there too; a lone digest isn't, nor numbers in mixed contexts."""
    rows = [(i, f'plain words api_key: "{KEY[i:] + KEY[:i]}" then') for i in range(8)]
    rows += [(20, 'other words API_KEY: "short-77-1234" then'), (21, f"commit {KEY} of it"), (22, "room 123456 of it")]
    got = {r.doc_id: r.spans for r in personal_data.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows[:8]:
        assert got[i] == f"secret:{t.index(KEY[i:] + KEY[:i])}:{t.index(KEY[i:] + KEY[:i]) + 40}"
    assert got[20] == "secret:22:35" and got[21] == got[22] == ""


def test_extraction_against_a_plain_version(spark):
    """All spans, of base patterns and of scored contexts, whole texts, against loops over the rows."""
    rng = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = list(PII_ROWS) + ["word " * 3000 + f"mail to a{i}@b.c now " + "x" * 3000 for i in range(4)] + ["mail to user_99887 now"] * 2
    for i in range(120):
        forms = [f"u{i}@h.org", KEY[i % 40:] + KEY[:i % 40], f"10.0.{i}.7", f"id-{i}-{i * 7919}", f"{i}9999", f"zz{i}aa{i * 31}bb77"]
        word = rng.choice(["mail", "key", "my"])
        what = rng.choice(forms) if word == "my" or rng.random() < 0.08 else forms[word == "key"]
        odd.append(f"{rng.choice(['see', 'the'])} {word} {rng.choice(['to', 'is', ':'])}  {what} {rng.choice(['now', 'then', ''])}")
    rows = docs.union(spark.createDataFrame([(-i, t) for i, t in enumerate(odd, 1)], docs.schema)).collect()
    expected = all_personal([r.text for r in rows], personal_data)
    found = [x for r, e in zip(rows, expected, strict=True) for x in set(e.split(",")) - {"", *personal(r.text)}]
    assert sum(x.startswith("secret") for x in found) >= 30 and any(x.startswith("email") for x in found)
    got = personal_data.report(spark.createDataFrame(rows, docs.schema)).collect()
    assert sorted((r.doc_id, r.spans) for r in got) == sorted((r.doc_id, x) for r, x in zip(rows, expected, strict=True))


def test_mask(spark):
    rows = [(1, "a@b.c, 10.0.0.1!", 16, "x"), (2, "nothing", 7, "y"), (3, None, None, None), (4, "ü +1 (743) 555-3824", 0, "z")]
    got = {r.doc_id: (r.text, r.n_chars, r.row) for r in personal_data.mask(
        spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, row string").drop("row")
        .selectExpr("*")).selectExpr("*", "1 as row").collect()}
    assert got == {1: ("<EMAIL>, <IP>!", 14, 1), 2: ("nothing", 7, 1), 3: (None, None, 1), 4: ("ü <PHONE>", 9, 1)}


def test_number_of_links_against_brute_force(spark, monkeypatch):
    """60 near copies, a pair that differs in capitals, chains of variants, exact copies: links to different texts, all counted."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        t = list(base)
        t[rng.randrange(200)] = f"v{i}"
        texts.append(" ".join(t))
    texts += ["One two three four FIVE six", "one two three four five six", "one two three four five six"]
    chain = [f"c{i}" for i in range(120)]
    for i in range(25):
        chain = chain[4:] + [f"c{i}x{j}" for j in range(4)]
        texts.append(" ".join(chain))
    texts += [None, "", "alone", "two words", "Two words"]
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = word_sets(texts, 3)
    want = []
    for s, t in zip(sets, texts):
        others = {u for u, r in zip(texts, sets) if u != t and r and s and 100 * len(s & r) >= 90 * len(s | r)}
        want.append(len(others))
    assert sum(want[:60]) == 60 * 59 and want[60:63] == [1, 1, 1] and 0 < sum(want[63:88]) < 25 * 24
    for members in (256, 7):
        monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", members)
        got = {r.doc_id: r.n_links for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert [got[i] for i in range(len(rows))] == want


def test_components_that_one_hub_leaves_open_are_joined_by_blocks(spark, monkeypatch):
    """Groups around many centres that share most of their text: stars leave them open, pairs of blocks settle them exactly."""
    rng, rows = random.Random(12), []
    shared = [f"s{i}" for i in range(60)]
    for centre in range(40):
        own = [f"o{centre}x{i}" for i in range(4 + centre % 5)]
        for _ in range(12):
            text = shared + own
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = f"r{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(text)))
    ids = [d for d, _ in rows]
    for members in (256, 5):
        monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", members)
        for share in (80, 90):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(
                spark.createDataFrame(rows, "doc_id bigint, text string"), ngram_join.Rule(3, share)).collect()}
            assert got == dict(zip(ids, components(ids, word_sets([t for _, t in rows], 3), share), strict=True))


def test_a_group_of_thousands_counts_every_link(spark):
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(base + [f"end{i}"])) for i in range(1500)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, 1499)} and len(got) == 1500


def plain_share(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j + 1], best[j])
    return best[-1] / len(a)


def test_recall_of_passages_by_length_and_by_replaced_words(spark):
    """Every copy of 4 words or more, whatever its place; of 200 paraphrases with one or two words in eight replaced, what the README states."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    items, rows, kinds = [], [], {}
    for n, replaced in [(4, 0), (6, 0), (8, 0), (12, 0), (20, 0), (60, 0), (40, 1), (40, 2)]:
        for _ in range(100):
            i, w = len(items), draw(n)
            items.append((i, " ".join(w)))
            text = w.copy()
            for at in range(0, len(w) - 8, 8):
                for k in rng.sample(range(8), replaced):
                    text[at + k] = rng.choice(words)
            rows.append((i, " ".join(draw(rng.randint(0, 90)) + text + draw(rng.randint(0, 90)))))
            kinds[i] = (n, replaced)
    rows += [(10000 + i, " ".join(draw(rng.randint(1, 400)))) for i in range(200)]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    hit = {r.doc_id for r in got if r.doc_id == r.item_id}
    share = {k: sum(i in hit for i, x in kinds.items() if x == k) for k in sorted(set(kinds.values()))}
    print(share)
    text, item = dict(rows), dict(items)
    assert all(plain_share(item[r.item_id].split(), text[r.doc_id].split()) >= 0.5 for r in got)
    assert all(n >= (95 if k[1] else 99) for k, n in share.items()), share
    assert all(r.doc_id < 10000 for r in got)


def test_decontamination_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    plain = sorted(map(tuple, decontaminate.contaminated(docs, bench, short=True).collect()))
    assert plain and plain == sorted(map(tuple, decontaminate.contaminated(
        docs.repartition(5).sortWithinPartitions(F.hash("text")), bench, short=True).collect()))


def test_items_of_few_words_are_looked_up_exactly(spark):
    docs = spark.createDataFrame([(1, "Say YES, then go"), (2, "go then"), (3, "then go"), (4, None), (5, ""), (None, "yes")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, "then go"), (3, "say yes then"), (4, "..."), (5, "then go"), (None, "go")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.score, r.answer) for r in decontaminate.contaminated(docs, bench, short=True).collect()}
    assert got == {(d, i, 1.0, True) for d, i in [(1, 1), (1, 2), (1, 3), (1, 5), (3, 2), (3, 5), (None, 1)]}
    assert decontaminate.contaminated(docs, bench).count() == 0
