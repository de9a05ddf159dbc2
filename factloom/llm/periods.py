"""Periodic runs of words by Main-Lorentz divide and conquer, and texts with their repeats cut.

A run is a stretch of consecutive words with smallest period q, at least ``least`` and
``times`` x q words long, that no neighbouring word extends. A stretch of words is cut in
two; Z-functions of both halves, read from the middle outwards, give for every period how
far a repetition that crosses the middle reaches to either side, and the halves are
worked on in turn. Every run lies whole in the one node whose middle it crosses first,
so nothing found at a node's edge that would go on beyond it is kept; equal intervals
keep their smallest period.

Two tests leave out nodes that can hold no run, without loss: a run of period q repeats
some stretch of ``gram`` words at a distance of at most q, so a node needs such a
recurrence at a third (1 / ``times``) of its size or less, and inside a run of period q
only smaller periods are new.

Defined results: a null text has no words; texts without a run keep all words; repeated
rows repeat; an empty table gives an empty result; extra columns are ignored. A null id
reaches ``prepare`` as None.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 24, 3
#: Bytes of text worked on between two batches given back.
BATCH_BYTES = 8 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def gram_size(least: int, times: int) -> int:
    """Words that the stretches of any run and of its copy one period on share at least."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def z_values(s: list[int]) -> list[int]:
    """For each place, how many values from there on equal those from the start on."""
    n, left, right = len(s), 0, 0
    z = [n] * n
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def crossing(w: list[int], lo: int, mid: int, hi: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the repetitions of w[lo:hi] that cross ``mid``, intervals once with their smallest period."""
    before, after = w[lo:mid], w[mid:hi]
    back, whole, a, b = before[::-1], w[lo:hi], mid - lo, hi - mid
    of = lambda head, tail: np.array(z_values([*head, -1, *tail]), np.int64)
    # One period to the right of the middle: mid + q against mid, and what ends there against what ends at mid.
    q = np.arange(1, b + 1)
    ahead = np.append(np.array(z_values(after), np.int64)[1:], 0)
    behind = of(back, whole[::-1])[a + 1 :][b - q]
    right = (mid - behind, mid + q + ahead, q, behind)
    # One period to the left of it.
    q = np.arange(1, a + 1)
    behind = np.append(np.array(z_values(back), np.int64)[1:], 0)
    ahead = of(after, whole)[b + 1 :][a - q]
    left = (mid - q - behind, mid + ahead, q, ahead)
    start, end, period, reach = (np.concatenate(x) for x in zip(right, left, strict=True))
    order = np.argsort(period, kind="stable")
    order = order[(reach[order] > 0) & ((end - start)[order] >= np.maximum(least, times * period[order]))]
    start, end, period = start[order], end[order], period[order]
    _, first = np.unique(start * (len(w) + 1) + end, return_index=True)
    return start[first], end[first], period[first]


def recurrences(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, next place) of stretches of ``size`` words that come again, by place; equal stretches have equal codes."""
    with np.errstate(over="ignore"):
        h, have = codes.astype(np.uint64), 1
        while have < size:  # from codes of ``have`` words to those of up to twice as many
            step = min(have, size - have)
            h = (h[: len(h) - step] ^ (h[: len(h) - step] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + h[step:]
            have += step
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    at, again = order[:-1][same], order[1:][same]
    by = np.argsort(at)
    return at[by], again[by]


def find_runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    n, gram = len(words), gram_size(least, times)
    if n < least:
        return []
    at, again = recurrences(np.fromiter(map(hash, words), np.int64, n), gram)
    if not len(at):
        return []
    ids: dict = {}
    w = [ids.setdefault(x, len(ids)) for x in words]
    gap, found, todo = again - at, {}, [(0, n, [])]
    while todo:
        lo, hi, around = todo.pop()
        if hi - lo < least:
            continue
        cover = min((q for s, e, q in around if s <= lo and e >= hi), default=n)
        part = slice(*np.searchsorted(at, (lo, hi)))
        if not ((again[part] + gram <= hi) & (gap[part] * times <= hi - lo) & (gap[part] < cover)).any():
            continue
        mid = (lo + hi) // 2
        here = []
        for s, e, q in zip(*(x.tolist() for x in crossing(w, lo, mid, hi, least, times)), strict=True):
            if not ((s == lo and lo and w[lo - 1] == w[lo - 1 + q]) or (e == hi and hi < n and w[hi] == w[hi - q])):
                found[s, e] = min(q, found.get((s, e), q))
                here.append((s, e, q))
        for a, b in ((lo, mid), (mid, hi)):
            todo.append((a, b, [r for r in (*around, *here) if r[0] < b and r[1] > a]))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words outside the runs, and the first period of each; a word that any run drops goes."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, text): the runs of every text by start and period, and the words left when each is cut to its first period, joined by blanks.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``prepare(id, words)`` may give others in their place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for at, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                words = (text.as_py() or b"").split()
                if prepare:
                    words = prepare(doc_id, words)
                runs = find_runs(words, least, times)
                left = b" ".join(collapsed(words, runs))
                rows.append((doc_id, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], left))
                size += len(left)
                if size >= BATCH_BYTES or at + 1 == batch.num_rows:
                    ids, counts, found, texts = zip(*rows, strict=True)
                    columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "text"])
                    rows, size = [], 0

    # As bytes, whose split() knows just these six separators.
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text")).mapInArrow(run, SCHEMA)


def run_digests(found: DataFrame) -> DataFrame:
    """The run of the greatest exact length / period of each row (ties: the first), and digests of all runs and of the text left."""
    ahead = lambda x, best: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    top = found.withColumn("top", F.aggregate("runs", none, lambda best, x: F.when(ahead(x, best), x).otherwise(best)))
    line = lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
