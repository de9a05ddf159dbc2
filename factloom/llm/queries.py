"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from . import audio, bwt_dedup, cover_dedup, decontaminate, html_text, langid, packing, periods, pii, piece_bpe, simhash, tokens, turns
from .common import read_table


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """A public vocabulary file's place; ``spark.factloom.tokenizers`` names another folder."""
    import public_tokenizers

    folder = spark.conf.get("spark.factloom.tokenizers", None)
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_digests(read_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(read_table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(read_table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.filter(~langid.held_out()))
    return langid.predict(docs, profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.cut_bytes(read_table(spark, sf_dir, "documents"), texts=False)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_token_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path(spark, "byte_bpe_50k.tiktoken")
    return tokens.section_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, fields=("source", "text"))


def op9_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.cut_words(read_table(spark, sf_dir, "documents"), texts=False)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_digests(read_table(spark, sf_dir, "documents"), tokenizer_path(spark, "piece_bpe_32k.model"))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For ids whose checksum ends in 0, the words from some place on repeat three to ten times; null ids stay as they are."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    at = h // 10 % len(words)
    period = 1 + (len(words) - at) // (3 + h // 10 % 8)
    times = -(-(len(words) - at) // period)
    return words[:at] + (words[at : at + period] * times)[: len(words) - at]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(periods.periodic_runs(read_table(spark, sf_dir, "documents"), prepare=repeated_tail))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(spark, "word_bpe_49k.json"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_digests(turns.repaired(turns.damaged(read_table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_audio, op3_pii, op4_html, op5_language, op6_bwt_dedup, op7_decontaminate, op8_token_sections, op9_cover_dedup, op10_pieces, op11_periodic_runs, op12_packing, op13_turns, pipeline)}

_WORDS = r"[^\x20\x09-\x0D]+"

#: Word windows by brute grouping: DuckDB keeps every window's text, so this is for the small tables of the SQL check.
_OP9_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, r, w, len(w) AS n, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM p),
b AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1),
x AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM b),
y AS (SELECT r, list(k) AS gone FROM x GROUP BY r),
z AS (SELECT d.doc_id, d.r, len(w) AS n, w, coalesce(gone, []) AS gone FROM d LEFT JOIN y USING (r)),
e AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
t AS (SELECT e.r, string_agg(word, ' ' ORDER BY e.k) AS kept FROM e LEFT JOIN x ON x.r = e.r AND x.k = e.k WHERE x.k IS NULL GROUP BY e.r)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM z LEFT JOIN t USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op9_cover_dedup": _OP9_SQL}
