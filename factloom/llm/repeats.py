"""Finding long strings that occur more than once, without pairs: shared Spark steps.

A scanner turns each text into *occurrences*: an anchor key ``k``, a digest ``c``
of the whole context in which a long match through that anchor can lie, and the
context's place. Occurrences meet by ``k`` in one shuffle and are settled in key
order with a memory of one row: equal (k, c) means that the whole context repeats;
equal k with different c asks for a closer look at those contexts only.

Copies are settled before the shuffle: an Arrow batch that holds an occurrence
twice marks both at once and sends one row for all, so a group of copies costs a
row a batch, however large it is. Rows leave in page order, so that what a document's
rows have in common compresses. Keys with very many different contexts (found in a
sample of the documents) are spread over tasks by context: equal contexts still meet,
and all others of such a key are looked at closer in any case.

Row layout (all long): k, c, d, q, f. ``d`` is a hash of id and text, which
stands for the row; q packs start (32 bits), length (9), anchor offset (8) and 15
more bits of the text's hash. f: 0 one occurrence, 1 several (settled where they
were seen), 2 a settled span (start in c's upper half, end in its lower).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .hashing import U, mix

ROW = "k long, c long, d long, q long, f long"
NAMES = ["k", "c", "d", "q", "f"]
SAMPLE, HOT_LEAST = 64, 50


def pack(start: np.ndarray, length: np.ndarray, offset: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return (start.astype(U) << U(32)) | (length.astype(U) << U(23)) | (offset.astype(U) << U(15)) | tag.astype(U)


def unpack(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    q = q.view(U)
    return tuple(x.astype(np.int64) for x in (q >> U(32), q >> U(23) & U(511), q >> U(15) & U(255), q & U(0x7FFF)))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs; touching spans are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[new], reach[np.concatenate([new[1:] - 1, [len(start) - 1]])]


def local_settle(k: np.ndarray, c: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, offset: np.ndarray, d: np.ndarray, tag: np.ndarray, several: np.ndarray | None = None) -> pa.RecordBatch:
    """Occurrence rows of one batch; ``doc`` indexes ``d`` and ``tag``. Equal (k, c) are settled here."""
    order = np.lexsort((c, k))
    k, c, doc, start, length, offset = (x[order] for x in (k, c, doc, start, length, offset))
    several = np.zeros(len(k), bool) if several is None else several[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(k)))
    again = np.repeat(counts > 1, counts)
    f = ((counts > 1) | (np.logical_or.reduceat(several, first) if len(first) else False)).astype(np.int64)
    page = np.argsort(order[first])
    spans = [np.zeros(0, np.int64)] * 3
    if hit := np.flatnonzero(again & ~several).tolist():
        h = np.array(hit)
        base = doc[h] << 33  # documents apart, so that spans of two never touch
        s, e = merged(start[h] + base, start[h] + length[h] + base)
        spans = [s >> 33, s & ((1 << 33) - 1), e & ((1 << 33) - 1)]
    first, f = first[page], f[page]
    where, s, e = spans
    zero = np.zeros(len(where), np.int64)
    columns = (
        np.concatenate([k[first].view(np.int64), mix(d[where].view(U)).view(np.int64)]),
        np.concatenate([c[first].view(np.int64), s << 32 | e]),
        np.concatenate([d[doc[first]], d[where]]),
        np.concatenate([pack(start[first], length[first], offset[first], tag[doc[first]]), pack(zero, zero, zero, tag[where])]).view(np.int64),
        np.concatenate([f, zero + 2]),
    )
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64, copy=False)) for x in columns], NAMES)


def settle(batches: Iterator[pa.RecordBatch], hot: np.ndarray = np.zeros(0, np.int64)) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k, c) in; out: spans (f 2) of repeated contexts, and requests (f 0 one, f 1 several) for
    occurrences whose anchor has other contexts too (one stands for equal contexts). Needs the row before and the
    row after, no more. Contexts of ``hot`` keys are taken to have others, in other tasks."""
    held, before = np.zeros((5, 0), np.int64), None

    def decide(rows: np.ndarray, last: bool) -> pa.RecordBatch:
        nonlocal held, before
        k, c = rows[0], rows[1]
        n = len(k) if last else len(k) - 1
        same_k, same_c = k[1:] == k[:-1], (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        edge = [bool(before is not None and len(k) and before[0] == k[0]), bool(before is not None and len(k) and before == (k[0], c[0]))]
        prev_k, prev_c = np.append(edge[0], same_k)[: len(k)], np.append(edge[1], same_c)[: len(k)]
        next_k, next_c = np.append(same_k, False), np.append(same_c, False)
        alike = (prev_c | next_c[: len(k)] | (rows[4] == 1))[:n]
        # Of a run of equal contexts the first and the last stand for all.
        mixed = ((prev_k & ~prev_c) | (next_k & ~next_c)[: len(k)])[:n]
        if len(hot):
            mixed |= np.isin(k[:n], hot) & ~prev_c[:n]
        done = rows[:, :n]
        spans, asks = done[:, alike & (done[4] == 0)].copy(), done[:, mixed].copy()
        start, length, _, tag = unpack(spans[3].copy())
        spans[1] = start << 32 | (start + length)
        spans[3], spans[4] = tag, 2
        asks[4] = alike[mixed]
        if n:
            before = (k[n - 1], c[n - 1])
        held = rows[:, n:]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate([spans, asks], axis=1)], NAMES)

    for batch in batches:
        rows = np.stack([col.to_numpy(zero_copy_only=False) for col in batch.columns])
        through = rows[:, rows[4] == 2].copy()
        through[3] &= 0x7FFF
        if through.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in through], NAMES)
        rows = np.concatenate([held, rows[:, rows[4] != 2]], axis=1)
        if rows.shape[1]:
            yield decide(rows, last=False)
    if held.shape[1]:
        yield decide(held, last=True)


def settled(rows: DataFrame, hot: list[int] = ()) -> DataFrame:
    """One shuffle by anchor (and context, for ``hot`` anchors), then ``settle`` over each sorted partition."""
    keys = np.array(sorted(hot), np.int64)
    spread = [F.when(F.col("k").isin(keys.tolist()), F.col("c"))] if len(keys) else []
    return rows.repartition("k", *spread).sortWithinPartitions("k", "c").mapInArrow(lambda batches: settle(batches, keys), ROW)


def hot_keys(docs: DataFrame, occurrences: Callable, share: int = SAMPLE, least: int = HOT_LEAST) -> list[int]:
    """Keys with so many contexts in a sample of the documents (one of ``share``, by hash) that one task should not have them all.

    The 4,096 most frequent at most. They change where rows go, not the result.
    """
    rows = docs.filter(F.pmod(F.xxhash64("d"), F.lit(share)) == 0).select("d", "tag", "text").mapInArrow(occurrences, ROW).filter("f < 2")
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return [r["k"] for r in counted.orderBy(F.desc("n"), "k").limit(4096).collect()]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, d, tag, text. ``d`` and ``tag`` stand for the row: rows alike in id and text share results."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("d"), F.xxhash64("text", F.lit(1)).bitwiseAND(0x7FFF).alias("tag"), "text")


def spans_of(rows: DataFrame) -> DataFrame:
    """(d, tag, spans array<long>): merged spans of each document, packed start << 32 | end."""
    gathered = rows.groupBy("d", F.col("q").alias("tag")).agg(F.collect_set("c").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column("spans"):
                v = spans.values.to_numpy(zero_copy_only=False)
                s, e = merged(v >> 32, v & 0xFFFFFFFF)
                out.append(s << 32 | e)
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("tag"), pa.array(out, pa.list_(pa.int64()))], ["d", "tag", "spans"])

    return gathered.mapInArrow(run, "d long, tag long, spans array<long>")


def repeated_spans(docs: DataFrame, occurrences: Callable, look_closer: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, text, spans) for every row of ``identified`` docs, spans merged.

    ``occurrences`` maps Arrow batches (d, tag, text) to rows; ``look_closer`` takes the documents and the
    requests (d, tag, k, q, f) and returns more spans (d, q, c).
    """
    per_doc = _first_pass(docs, occurrences)
    asks = per_doc.filter(F.size("asks") > 0).select("d", "tag", "asks")
    more = spans_of(look_closer(docs, asks))
    known = per_doc.select("d", "tag", F.col("spans").alias("known"))
    every = docs.join(known, ["d", "tag"], "left").join(more, ["d", "tag"], "left")
    none = F.array().cast("array<long>")
    return every.select("doc_id", "text", F.concat(F.coalesce("known", none), F.coalesce("spans", none)).alias("spans"))


def _first_pass(docs: DataFrame, occurrences: Callable) -> DataFrame:
    """(d, tag, spans, asks): merged spans and requests of each document together, a small table; the only cut in the lineage."""
    first = settled(docs.select("d", "tag", "text").mapInArrow(occurrences, ROW), hot_keys(docs, occurrences))
    tagged = first.select("d", F.col("q").bitwiseAND(0x7FFF).alias("tag"), "k", "c", "q", "f")
    span, ask = F.when(F.col("f") == 2, F.col("c")), F.when(F.col("f") != 2, F.struct("k", "q", "f"))
    return cut_lineage(_merge_rows(tagged.groupBy("d", "tag").agg(F.collect_set(span).alias("spans"), F.collect_set(ask).alias("asks"))))


def _merge_rows(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column("spans"):
                v = spans.values.to_numpy(zero_copy_only=False)
                s, e = merged(v >> 32, v & 0xFFFFFFFF)
                out.append(s << 32 | e)
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("tag"), pa.array(out, pa.list_(pa.int64())), batch.column("asks")], ["d", "tag", "spans", "asks"])

    return df.mapInArrow(run, "d long, tag long, spans array<long>, asks array<struct<k: long, q: long, f: long>>")


def union_of(spans: np.ndarray) -> list[tuple[int, int]]:
    s, e = merged(spans >> 32, spans & 0xFFFFFFFF)
    return list(zip(s.tolist(), e.tolist(), strict=True))
