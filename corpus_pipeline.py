"""A corpus cleaning pipeline: language, near copies, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
its result is written as Parquet and read again as the next stage's docs.

Defined results: rows are told apart by id and text, so null and repeated ids lose no
text; of rows alike in both, near_copies keeps one. A null text counts as empty and goes
with the language stage, as do texts without a letter. Ties go to the smallest id, then
the smallest text hash; null ids come last. Empty tables give empty results; columns
beyond those of documents are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, langid, pii, piece_bpe, simhash
from factloom.llm.common import delete, read_table, shared_folder
from factloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of a document's own n-grams that its language must explain.
MIN_SCORE = 0.02


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or unlike every language; ``lang`` becomes the predicted one. Rows are judged one by one."""
    profiles = langid.learn(docs.filter(~langid.held_out()))
    verdict = langid.labelled(docs.select(*COLUMNS), profiles).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return verdict.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of texts whose five-word shingles are 0.8 similar: that of the smallest (doc_id, text hash), null ids last."""
    rows = docs.withColumn("_node", F.xxhash64(F.coalesce("text", F.lit(""))))
    roots = simhash.similar_classes(rows, "_node")
    named = rows.select("doc_id", "_node").join(roots, F.col("_node") == F.col("node"), "left").select("doc_id", "_node", F.coalesce("root", "_node").alias("_root"))
    first = named.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_node")).alias("f"))
    kept = first.select(F.col("f.doc_id").alias("_id"), F.col("f._node").alias("_kept"))
    once = rows.join(kept, (F.col("_node") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return once.dropDuplicates(["doc_id", "_node"]).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: a window of its length within a fifth of its words in edits. Rows are judged one by one."""
    return decontaminate.without_items(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's piece ids and of the text decoded from them."""
    return piece_bpe.piece_digests(docs, tokenizer_path(spark, "piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("pieces", pieces),
]

#: Language profiles, fingerprint classes and piece merging have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. The tables between them lie in the shared checkpoint folder; each goes once the next is written."""
    place, docs = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}", read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{place}/{number}-{name}")
        if number:
            delete(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
