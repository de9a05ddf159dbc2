"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile lists the most frequent 1- to 3-grams of letters, words padded with
blanks. A document's own list is compared with each language's: an n-gram adds
the difference of its two ranks, one that the language lacks adds the longest
possible difference. The nearest language wins, ties by name.

Profiles are learned from about ``per_language`` rows of each label (a documented
bound, picked by a hash of the id); labels with fewer rows are used whole.

Defined results: null text or no letter gives ``und`` with score 0; repeated rows
give repeated results; null labels are never learned; with nothing to learn from
every document is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import memory

PROFILE, DOCUMENT = 400, 300
PER_LANGUAGE = 2000
PIECE = 1 << 20
#: Of every code point, whether it is a letter (numerals like superscript two or Roman eight are none).
_LETTER = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
BLANK = np.int64(0x20)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes (21 bits a letter) of a text and how often each occurs."""
    kept, counts, at, end = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
    while end < len(text):
        # Long texts go in pieces that end before a character that is no letter, so no word is cut.
        at, end = end, min(len(text), end + PIECE)
        while end < len(text) and text[end].isalpha():
            end += 1
        c = np.frombuffer(f" {text[at:end].lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letter = _LETTER[c]
        if not letter.any():
            continue
        # Of a run of other characters one blank stays.
        c = np.where(letter, c, BLANK)[letter | np.concatenate([[True], letter[:-1]])]
        two = c[:-1] << 21 | c[1:]
        three = two[:-1] << 21 | c[2:]
        codes = np.concatenate([c[c != BLANK], two, three[c[1:-1] != BLANK]])
        codes.sort()
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        found, n = codes[new], np.diff(np.concatenate([new, [len(codes)]]))
        if len(kept):
            found, where = np.unique(np.concatenate([kept, found]), return_inverse=True)
            n = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
        kept, counts = found, n
    return kept, counts


def top(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent codes, ties by code."""
    return codes[np.lexsort((codes, -counts))[:n]]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language -> its n-gram codes in rank order, from about ``per_language`` rows of each label."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = {k: per_language / n for k, n in sizes.items() if n > per_language}
    if large:
        share = F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("lang")]
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.coalesce(share, F.lit(1.0)) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in set(batch.column("lang").to_pylist()):
                texts = batch.filter(pa.compute.equal(batch.column("lang"), lang)).column("text").to_pylist()
                codes, n = grams("\n".join(texts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(ranked.select("lang", "rank", "gram").collect()):  # size rows a language at most
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in profiles.items()}


def labelled(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", length: int = DOCUMENT) -> DataFrame:
    """``docs`` with lang_pred and score in 0..1 (1 less the distance as a share of the longest); no shuffle."""
    names = sorted(profiles)
    sides = [(p[o := np.argsort(p)], o) for p in (profiles[n] for n in names)]

    def one(text: str | None) -> tuple[str, float]:
        own = top(*grams(text or ""), length)
        if not len(own) or not names:
            return "und", 0.0
        rank, best = np.arange(len(own)), None
        for name, (codes, ranks) in zip(names, sides, strict=True):
            worst = max(len(codes), length)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            far = int(np.where(codes[at] == own, np.abs(ranks[at] - rank), worst).sum())
            if best is None or far / worst < best[0]:
                best = (far / worst, name)
        return best[1], max(0.0, 1 - best[0] / len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory("langid")
        for batch in batches:
            found = [one(t.as_py()) for t in batch.column(text_col)]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score"])

    rows = docs.drop("lang_pred", "score")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", length: int = DOCUMENT) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return labelled(rows, profiles, "text", length).select("doc_id", "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of learning: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
