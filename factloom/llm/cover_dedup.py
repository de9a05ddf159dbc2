"""Substring dedup of word windows by difference-cover anchors.

D is a perfect difference set modulo V: any shift between two places is a
difference of two members, so two equal windows of ``WINDOW`` words, wherever they
start, share an offset below V at which both places are cover positions. Only
there are the ``ANCHOR = WINDOW - V + 1`` words from the place hashed (5 of 21
places). Anchors meet by hash; an anchor's context, up to V - 1 words to either
side, holds every window through it, so equal contexts settle all of them at once.
Where one anchor has several contexts, the match is extended: the windows of those
contexts are compared whole, each place of a document once.

Equality is that of two independent 64-bit hashes (of anchor and context, or both
of the window), as for any fingerprint of long strings; they have no seed in common
from the words' bytes on.

Defined results: a null text has no words; a text shorter than a window is kept
whole; a window that repeats within its own document counts; rows alike in id and
text are occurrences of their own. Empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import PIECE, SEEDS, U, mix, run_hashes, word_hashes
from .repeats import ROW, identified, local_settle, repeated_spans, settled, union_of, unpack

WINDOW = 35
#: Perfect difference set modulo 21.
V, COVER = 21, (3, 6, 7, 12, 14)
ANCHOR = WINDOW - V + 1
#: The longest context: an anchor and V - 1 words to either side.
CONTEXT = ANCHOR + 2 * (V - 1)
_IS_COVER = np.isin(np.arange(V), COVER)


class WordChunk:
    """Words of several texts side by side, with run hashes over them."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        starts, self.one, self.two = word_hashes(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), SEEDS)
        self.base = np.searchsorted(starts, np.cumsum(sizes) - sizes)
        self.count = np.diff(np.append(self.base, len(starts)))

    def anchors(self) -> tuple[np.ndarray, ...]:
        """k, c, document, start, length, offset of every anchor context."""
        doc = np.repeat(np.arange(len(self.count)), self.count)
        place = np.arange(len(doc)) - self.base[doc]
        n = self.count[doc]
        g = np.flatnonzero(_IS_COVER[place % V] & (place + ANCHOR <= n) & (n >= WINDOW))
        doc, base = doc[g], self.base[doc[g]]
        lo, hi = np.maximum(g - V + 1, base), np.minimum(g + ANCHOR + V - 1, base + n[g])
        k = run_hashes(self.one, g, g + ANCHOR, CONTEXT)
        c = mix(run_hashes(self.two, lo, hi, CONTEXT) + mix((g - lo) << 8 | (hi - g)))
        return k, c, doc, lo - base, hi - lo, g - lo

    def windows(self, doc: np.ndarray, start: np.ndarray, length: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every window of the given contexts, each place once: k, c (both of the window), document, start, length, offset, several."""
        n = np.maximum(length - WINDOW + 1, 0)
        ask = np.repeat(np.arange(len(doc)), n)
        i = self.base[doc[ask]] + start[ask] + np.arange(len(ask)) - np.repeat(np.cumsum(n) - n, n)
        i, first, back = np.unique(i, return_index=True, return_inverse=True)
        any_several = np.zeros(len(i), np.int64)
        np.maximum.at(any_several, back, several[ask])
        doc = doc[ask[first]]
        zero = np.zeros(len(i), np.int64)
        one, two = (run_hashes(words, i, i + WINDOW, CONTEXT) for words in (self.one, self.two))
        return one, two, doc, i - self.base[doc], zero + WINDOW, zero, any_several


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of about PIECE bytes of a batch's texts."""
    at, size, held = 0, 0, []
    for row, text in enumerate(batch.column("text")):
        held.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= PIECE or row + 1 == batch.num_rows:
            yield at, held
            at, size, held = row + 1, 0, []


def _together(parts: list[tuple[np.ndarray, ...]], width: int) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(width)) if parts else tuple(np.zeros(0, U if i < 2 else np.int64) for i in range(width))


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for at, texts in chunks(batch):
            k, c, doc, *rest = WordChunk(texts).anchors()
            parts.append((k, c, doc + at, *rest))
        yield local_settle(*_together(parts, 6), batch.column("d").to_numpy(), batch.column("tag").to_numpy())


def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests with their texts in; the windows of the requested contexts out, as occurrences."""
    for batch in batches:
        parts = []
        for at, texts in chunks(batch):
            chunk = WordChunk(texts)
            asks = batch.column("asks").slice(at, len(texts))
            flat, doc = asks.flatten(), np.repeat(np.arange(len(texts)), np.array([len(a) for a in asks]))
            start, length, _, _ = unpack(flat.field("q").to_numpy(zero_copy_only=False).copy())
            k, c, where, *rest = chunk.windows(doc, start, length, flat.field("f").to_numpy(zero_copy_only=False))
            parts.append((k, c, where + at, *rest))
        *rows, several = _together(parts, 7)
        yield local_settle(*rows, batch.column("d").to_numpy(), batch.column("tag").to_numpy(), several.astype(bool))


def look_closer(docs: DataFrame, asks: DataFrame) -> DataFrame:
    # All columns of docs, as in the last join, so that Spark reuses one exchange of the texts.
    rows = docs.join(asks, ["d", "tag"]).mapInArrow(extended, ROW)
    return settled(rows).filter("f = 2").select("d", "q", "c")


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): the words to remove as word spans, packed start << 32 | end, for every row."""
    return repeated_spans(identified(docs, id_col, text_col), occurrences, look_closer)


def cut_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words, kept, at = text.as_py().encode("utf-8", "surrogatepass").split(), [], 0
                for s, e in union_of(spans.values.to_numpy(zero_copy_only=False)):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                joined = b" ".join(kept)
                for o, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined if texts else None), strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))][: 5 if texts else 4], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * texts]
    return removed_words(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
