"""Language, licenses, tokens: against the public libraries, plain loops and held-out rows; odd inputs."""

import base64
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from brute import sha256
from pyspark.sql import functions as F

from siteaudit.llm import byte_bpe, byte_cnn, license_templates, piece_counts
from siteaudit.llm.queries import tokenizer, tokenizer_pattern

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "   \n\n x", "a  b", "aaaa" * 50, "ab" * 333 + " " * 99, "é́ﬁ　x", "▁a ▁▁b", "<s>a</s>", "a\x00b",
       "\x1c\x1d x\x85 y", "🙂🙂 漢字かな", "x" * 5001, "it's we'll ' 's 12 ３４ %%%", "word " * 3000]


def odd_table(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice("ab \n'’sé1２🙂the\t.") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD + made)] + [(0, None, None, None), (None, "a b", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, score int")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    with open(tokenizer("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("source", [odd_table, documents])
def test_merge_replay_equals_library(spark, library, source):
    rows = source(spark)
    got = byte_bpe.encode_documents(rows, tokenizer("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern(), keep_ids=True)
    expected = sorted(((-1 if r.doc_id is None else r.doc_id), library.encode_ordinary(r.text or ""), (r.text or "").encode())
                      for r in rows.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids), bytes(r.decoded)) for r in got.collect()) == expected
    for r in got.collect():
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == sha256(bytes(r.decoded))
        assert r.ids_sha256 == sha256(b"".join(i.to_bytes(4, "little") for i in r.ids))
    assert byte_bpe.encode_documents(rows.limit(0), tokenizer("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern()).count() == 0


@pytest.mark.parametrize("source", [odd_table, documents])
def test_heap_counts_equal_library(spark, source):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rows = source(spark)
    expected = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "")))
                      for r in rows.collect())
    got = piece_counts.count_tokens(rows, tokenizer("piece_bpe_32k.model"), limit=100).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in byte_cnn.identify_documents(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)


def test_language_odd_rows(spark):
    rows = [(1, None, "en", 0), (2, "", "en", 0), (3, "12 !! 3", "en", 0), (4, "the and of", None, 0), (4, "the and of", None, 0),
            (None, "le la les", "fr", 0), (6, "le la les", "fr", 0), (8, "the and of", "en", 0)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = byte_cnn.identify_documents(table).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in got)
    nothing = byte_cnn.identify_documents(table.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert byte_cnn.identify_documents(table.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_places(text):
    w, out = words_of(text), []
    for phrase, label in license_templates.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return sorted(out)


def test_licenses_equal_plain_search(spark):
    extra = [(None, None), (-1, ""), (-2, "Under the MIT License. under THE mit-license, cc by nc"), (-2, "under the mit licensed"),
             (-3, "This small work is licensed under the terms of the Apache License, Version 2.0"),
             (-4, "licensed under the apache license"), (-5, "Été MIT license under the mit license " * 500)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("labels", F.lit(7))
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels)
                 for r in license_templates.license_report(docs).collect())
    expected = []
    for r in docs.collect():
        b = base_places(r.text)
        expected.append((str(r.doc_id), len(words_of(r.text)), len(b), str(b[0][0] if b else None), str(b[-1][0] if b else None),
                         ",".join(sorted({x for _, x in b}))))
    assert got == sorted(expected) and any(x[2] for x in got)
    assert license_templates.license_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("markup, text, accepted", [
    ("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d", "a d", True),
    ("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d", "a b c d", True),
    ("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d", "a c d", False),
    ("a <<var;words=1-3>> d", "a x y z d", True),
    ("a <<var;words=1-3>> d", "a d", False),
    ("a <<var;words=0-2;match=[0-9]+>> d", "a 1 2 d", True),
    ("a <<var;words=0-2;match=[0-9]+>> d", "a 1 x d", False),
    ("a b", "a x b", False),
])
def test_template_automata(markup, text, accepted):
    words = text.split()
    assert (license_templates.compile_template(markup).longest(words, 0) == len(words)) == accepted


def test_template_labels_stand_for_whole_wording(spark):
    rows = [(1, "This work is licensed under the GNU General Public License, version 3."), (2, "Released under the MIT License."),
            (3, "released in the MIT license"), (4, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: (r.labels, r.score) for r in license_templates.license_report(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ("gpl-3", 1.0), 2: ("mit", 1.0), 3: ("", 0.0), 4: ("cc-by-nc", 1.0)}
