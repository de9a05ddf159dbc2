"""Byte-level substring dedup over a collection's BWT, built column by column.

Dealing out the collection. Each text is cut into segments that hold every
``WINDOW``-byte string once: the strings that share a minimizer (the least hash of
the ``GRAM``-byte pieces inside a window) form one segment, so equal strings always
meet under one key. Segments that occur nowhere else, and segments that are equal
as wholes, are settled when they meet; what is left, different segments under one
key, is the collection whose order must be known.

Column-wise construction. For a block of whole keys, one symbol of every segment
is inserted a round, from the last to the first: with B the transform so far, the
suffix that starts with symbol c takes the place of that c in the stable order of
B, and its common prefix with the row before is one more than the least common
prefix between their tails. B and the common prefixes are two sequential columns
that are read and rewritten once a round; a block holds BLOCK bytes at most, so its
columns stay in memory instead of in files. Neighbours with a common prefix of
WINDOW or more are repeats.

Keys with more than ``GROUP_CAP`` different segments do not enter a block; their
windows are compared one by one under a hash of the whole window (exact up to two
independent 64-bit hashes, and as linear as a count).

Defined results: a null text is empty; texts under WINDOW bytes stay whole; repeats
within a text count; rows alike in id and text are occurrences of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import PIECE, SEEDS, RunHash, U, byte_units, mix
from .repeats import ROW, identified, local_settle, merged, repeated_spans, settled, union_of, unpack

WINDOW, GRAM = 200, 100
BLOCK = 2 << 20
GROUP_CAP = 2000
_PLACE = (1 << 24) - 1


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of blocks."""
    n = len(v) - width + 1
    padded = np.concatenate([v, np.full(-len(v) % width, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, first byte, bytes), each of about PIECE bytes; long texts are cut with WINDOW - 1 bytes in common."""
    held, size = [], 0
    for row, text in enumerate(batch.column("text")):
        raw = text.as_py().encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - WINDOW + 1), PIECE):
            held.append((row, at, raw[at : at + PIECE + WINDOW - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def segments(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """k, c, row, start, length, minimizer's offset of the segments of some pieces."""
    buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    if len(buf) < WINDOW:
        return (*[np.zeros(0, U)] * 2, *[np.zeros(0, np.int64)] * 4)
    one, two = RunHash(byte_units(buf, SEEDS[0]), GRAM, 8), RunHash(byte_units(buf, SEEDS[1]), 2 * WINDOW, 8)
    at = np.arange(len(buf) - GRAM + 1)
    grams = one(at, at + GRAM)
    least = sliding_min(grams & U(~_PLACE & (1 << 64) - 1) | at.astype(U), WINDOW - GRAM + 1)
    anchor = (least & U(_PLACE)).astype(np.int64)
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
    fits = np.arange(len(anchor)) + WINDOW <= ends[part]
    new = fits & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~fits[:-1]])
    first = np.flatnonzero(new)
    closes = fits & np.concatenate([~fits[1:] | (anchor[1:] != anchor[:-1]), [True]])
    end = np.flatnonzero(closes) + WINDOW
    a = anchor[first]
    c = mix(two(first, end) + mix((a - first) << 16 | (end - first)))
    p = part[first]
    start = first - (ends - sizes)[p] + np.array([x[1] for x in parts])[p]
    return grams[a], c, np.array([x[0] for x in parts])[p], start, end - first, a - first


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [segments(parts) for parts in pieces(batch)]
        if found:
            yield local_settle(*(np.concatenate(x) for x in zip(*found, strict=True)), batch.column("d").to_numpy(), batch.column("tag").to_numpy())


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi] for each pair."""
    if not len(lo):
        return values[:0]
    order = np.argsort(lo, kind="stable")
    pairs = np.stack([lo[order], hi[order] + 1], axis=1).ravel()
    out = np.empty(len(lo), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values.dtype.type(0)), pairs)[::2]
    return out


def collection_bwt(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The collection's transform (0 ends a string, else byte + 1) and common prefixes, one column of symbols a round."""
    m, lens = len(strings), np.array([len(s) for s in strings])
    width = int(lens.max())
    columns = np.zeros((m, width + 1), np.uint8)
    for row, s in zip(columns, strings, strict=True):
        row[width + 1 - len(s) :] = np.frombuffer(s, np.uint8) + 1
    bwt, lcp, place = columns[:, -1].copy(), np.zeros(m, np.int16), np.arange(m)
    for length in range(1, width + 1):
        live = np.flatnonzero(lens >= length)
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        over = len(order) - int(np.count_nonzero(bwt))
        p = place[live]
        i = rank[p].astype(np.int64)
        up, down = order[i - 1], order[np.minimum(i + 1, len(order) - 1)]
        with_up, with_down = (i > 0) & (bwt[up] == bwt[p]), (i + 1 < len(order)) & (bwt[down] == bwt[p])
        above = np.zeros(len(p), np.int16)
        above[with_up] = range_min(lcp, up[with_up] + 1, p[with_up]) + 1
        below = range_min(lcp, p[with_down] + 1, down[with_down]) + 1
        new = i - over + m
        old = np.ones(len(bwt) + len(live), bool)
        old[new] = False
        bwt2, lcp2 = np.empty(len(old), np.uint8), np.empty(len(old), np.int16)
        bwt2[old], lcp2[old] = bwt, lcp
        bwt2[new], lcp2[new] = columns[live, width - length], above
        lcp2[new[with_down] + 1] = below
        bwt, lcp = bwt2, lcp2
        place[live] = new
    return bwt, lcp


def repeated_windows(strings: list[bytes], several: np.ndarray) -> list[np.ndarray]:
    """For each string, the starts of its WINDOW-byte strings that occur elsewhere in the collection."""
    bwt, lcp = collection_bwt(strings)
    m, n = len(strings), len(bwt)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[order] = np.arange(n) + m - int((bwt == 0).sum())
    long = np.append(lcp >= WINDOW, False)
    again = long[:-1] | long[1:]
    lens, place = np.array([len(s) for s in strings]), np.arange(m)
    owners, starts = [], []
    for length in range(1, int(lens.max()) + 1):
        live = np.flatnonzero(lens >= length)
        place[live] = step[place[live]]
        if length >= WINDOW:
            hit = live[again[place[live]] | several[live]]
            owners.append(hit)
            starts.append(lens[hit] - length)
    owner, start = np.concatenate(owners), np.concatenate(starts)
    by = np.argsort(owner, kind="stable")
    return np.split(start[by], np.searchsorted(owner[by], np.arange(1, m)))


def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests with their texts in; one row (k, d, q, f, bytes) for each requested segment out."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for d, text, asks in zip(batch.column("d").to_pylist(), batch.column("text"), batch.column("asks"), strict=True):
            raw, asks = text.as_py().encode("utf-8", "surrogatepass"), asks.values
            q = asks.field("q").to_numpy(zero_copy_only=False)
            start, length, _, _ = unpack(q.copy())
            cut = [raw[s : s + n] for s, n in zip(start.tolist(), length.tolist(), strict=True)]
            for o, v in zip(out, (asks.field("k").to_pylist(), [d] * len(cut), q.tolist(), asks.field("f").to_pylist(), cut), strict=True):
                o.extend(v)
            if len(out[0]) >= 20_000:
                yield _segment_rows(out)
                out = [[], [], [], [], []]
        yield _segment_rows(out)


def _segment_rows(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, [pa.int64()] * 4 + [pa.binary()], strict=True)], ["k", "d", "q", "f", "seg"])


def block_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by key in; spans (d, q, c) out. Blocks hold whole keys."""

    def solve(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        several = np.array([r[3] for r in rows], bool)
        out: list[list[int]] = [[], [], []]
        for (_, d, q, f, _), starts in zip(rows, repeated_windows([r[4] for r in rows], several), strict=True):
            if len(starts) and not f:
                first, _, _, tag = unpack(np.array([q]))
                s, e = merged(starts + first, starts + first + WINDOW)
                for o, v in zip(out, ([d] * len(s), [int(tag[0])] * len(s), (s << 32 | e).tolist()), strict=True):
                    o.extend(v)
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["d", "q", "c"])

    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if size >= BLOCK and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield solve(held)


def hashed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of crowded keys in; every window of theirs out, as an occurrence."""
    for batch in batches:
        lens = np.array([len(s) for s in batch.column("seg").to_pylist()], np.int64)
        buf = np.frombuffer(b"".join(batch.column("seg").to_pylist()), np.uint8)
        first, n = np.cumsum(lens) - lens, lens - WINDOW + 1
        row = np.repeat(np.arange(len(lens)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start, _, offset, tag = unpack(batch.column("q").to_numpy().copy())
        i = first[row] + at
        c = RunHash(byte_units(buf, SEEDS[1]), WINDOW, 8)(i, i + WINDOW)
        k = mix(batch.column("k").to_numpy().view(U)[row] + mix(offset[row] - at + WINDOW))
        f = batch.column("f").to_numpy()
        yield local_settle(k, c, row, start[row] + at, np.full(len(row), WINDOW), np.zeros(len(row), np.int64), batch.column("d").to_numpy(), tag, f[row].astype(bool))


def look_closer(docs: DataFrame, asks: DataFrame, group_cap: int = GROUP_CAP) -> DataFrame:
    each = asks.select("d", "tag", F.explode("asks").alias("ask")).select("d", "tag", "ask.*")
    crowded = each.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_cap).select("k", F.lit(True).alias("crowded"))
    marked = each.join(crowded, "k", "left")

    def cut(rows: DataFrame) -> DataFrame:
        asked = rows.groupBy("d", "tag").agg(F.collect_list(F.struct("k", "q", "f")).alias("asks"))
        # All columns of docs, as in the last join, so that Spark reuses one exchange of the texts.
        return docs.join(asked, ["d", "tag"]).mapInArrow(cut_segments, "k long, d long, q long, f long, seg binary")

    blocks = cut(marked.filter("crowded is null")).repartition("k").sortWithinPartitions("k").mapInArrow(block_spans, "d long, q long, c long")
    windows = settled(cut(marked.filter("crowded")).mapInArrow(hashed_windows, ROW)).filter("f = 2").select("d", "q", "c")
    return blocks.unionByName(windows)


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): the bytes to remove as spans, packed start << 32 | end, for every row."""
    return repeated_spans(identified(docs, id_col, text_col), occurrences, look_closer)


def cut_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, the kept bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw, kept, at = text.as_py().encode("utf-8", "surrogatepass"), [], 0
                runs = union_of(spans.values.to_numpy(zero_copy_only=False))
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                for o, v in zip(out, (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    o.append(v)
            kinds = (*[pa.int64()] * 3, pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(o, k) for o, k in zip(out, kinds, strict=False))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]
    return removed_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
