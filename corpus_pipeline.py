"""The corpus pipeline: language, near copies, benchmark passages, personal data, tokens.

Each stage works on all documents that the one before kept, takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next stage's documents. All but the last return the columns of
documents, whatever their names and types: a row goes through a stage as one struct, beside the columns that the stage
works on. Null and empty texts: language rejects them, the other stages keep them. Null and repeated ids: documents are
told by id and text. Rows that repeat a document as a whole go with its near copies, of which the one with the smallest doc_id
stays. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.llm import byte_bpe, byte_cnn, decontaminate, ngram_join, personal_data
from siteaudit.llm.common import table, written
from siteaudit.llm.queries import tokenizer, tokenizer_pattern

#: A document whose language is less certain than this goes.
LEAST_SCORE = 0.4
#: Near copies: five words, similarity 0.8.
NEAR = ngram_join.Rule(5, 80)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows that aren't held out; documents without a letter or a likely language go."""
    model = byte_cnn.fit(byte_cnn.held_out(docs.select("doc_id", "text", "lang")).where(~F.col("held_out")))
    found = byte_cnn.judged(docs, model)
    return found.where((F.col("lang_pred") != byte_cnn.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def told(docs: DataFrame) -> DataFrame:
    """(doc, id, hash): each row with its doc_id and the hash of its text; ids may repeat or be null."""
    return docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))


def among(rows: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    """The semi or anti join of ``rows`` with the documents (id, hash) of ``keys``."""
    keys = keys.select(F.col("id").alias("key_id"), F.col("hash").alias("key_hash"))
    return rows.join(keys, rows["id"].eqNullSafe(keys["key_id"]) & (rows["hash"] == keys["key_hash"]), kind)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, hash): what the operators on texts read."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; documents without words stay.

    Groups are told by their component, not by its component_id, which several groups may have. Of texts that have a group's smallest
    doc_id (or none, where all are null) the one with the smallest hash stays, and of rows that repeat doc_id and text, one.
    """
    rows = told(docs)
    groups = written(ngram_join.near_duplicates(texts(docs), NEAR, ("doc_id", "hash")), "groups").withColumnRenamed("doc_id", "id")
    empty = groups.where("n_shingles = 0").groupBy("id", "hash").agg(F.lit(1).cast("bigint").alias("copies"))
    leaders = (groups.where("n_shingles > 0").where(F.col("id").eqNullSafe(F.col("component_id")))
               .groupBy("component", "id", "hash").agg(F.count(F.lit(1)).alias("copies")))
    first = leaders.groupBy("component").agg(F.min(F.struct("hash", "id", "copies")).alias("first"))
    kept = written(first.select("first.id", "first.hash", "first.copies").union(empty), "kept")
    repeated = among(rows, kept.where("copies > 1"), "left_semi").dropDuplicates(["id", "hash"])
    return among(rows, kept.where("copies = 1"), "left_semi").union(repeated).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, not others with their doc_id."""
    found = decontaminate.contaminated(texts(docs), table(spark, sf_dir, "benchmark"), ("doc_id", "hash"))
    return among(told(docs), found.select(F.col("doc_id").alias("id"), "hash").distinct(), "left_anti").select("doc.*")


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is masked; n_chars follows."""
    return personal_data.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, counted and hashed, and the hash of what they decode to."""
    return byte_bpe.encode_documents(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern())


STAGES = [("language", language), ("near_copies", near_copies), ("decontamination", decontamination),
          ("personal", personal), ("tokens", tokens)]

#: Training, iterative joins and tokenising have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
