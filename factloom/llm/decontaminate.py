"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit checks.

Texts are lower-cased words (runs of letters and digits). A document holds an item
of W words if one of its windows of W words is within floor(W * share) word edits
of it (places beyond a document's ends are blanks, which match no word). By
pigeonhole such a window keeps one run of floor(W / (edits + 1)) words of the item,
at a place shifted by no more than the edits: windows without one are passed over
without loss. The others are embedded with the CGK random walk (edit distance
becomes Hamming distance); each of several independent walks samples ``SAMPLES``
places of its output, windows and items that agree on a sample become candidates,
and each candidate is checked by edit distance, in the end on the words themselves.
Longer items get more walks (``WALKS``), for a recall of 0.97 or more at any length up
to 600 words and 20 % of edits (measured in the tests). An item of fewer words than
the share allows an edit for is found where its words stand in a row.

The item tables of a block (at most ``BLOCK_CHARS`` characters) go to the tasks; a
larger benchmark is worked in several such blocks, each against all documents.
Nothing is shuffled, so one passage in very many documents makes no hot key.

Defined results: null texts count as empty; items with a null id or no word are
skipped; a text much shorter than an item cannot hold it; repeated rows and repeated
items give repeated results; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import PIECE, RunHash, U, mix, word_hashes

SHARE, SAMPLES = 0.2, 4
#: (items of up to so many words, number of walks)
WALKS = ((70, 32), (300, 96), (1000, 192), (1 << 62, 384))
LONGEST_RUN = 4
BLOCK_CHARS = 8 << 20
AT_ONCE = 512
_OTHER = re.compile(r"[\W_]+")
PAD, EDGE = U(0x5555_5555_5555_5555), U(0x3333_3333_3333_3333)


def plain(text: str | None) -> bytes:
    return _OTHER.sub(" ", (text or "").lower()).encode("utf-8", "surrogatepass")


@cache
def walk_tables(longest: int, walks: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per walk and step: the walk's coin multiplier; per walk: sampled places as shares; sample multipliers."""
    rng = np.random.default_rng(seed)
    coins = rng.integers(1, 1 << 63, (3 * longest, walks), np.uint64) << U(1) | U(1)
    return coins, np.sort(rng.random((walks, SAMPLES)), axis=1), rng.integers(1, 1 << 63, (walks, SAMPLES), np.uint64) << U(1) | U(1)


def sample_keys(words: np.ndarray, sizes: np.ndarray, longest: int, walks: int) -> np.ndarray:
    """(n, walks) keys of rows of word hashes, ``sizes`` words each (``words`` is padded on the right)."""
    coins, shares, factors = walk_tables(longest, walks)
    n, rows = len(words), np.arange(len(words))[:, None]
    padded = np.concatenate([words, np.full((n, 1), PAD, U)], axis=1)
    # A walk of a row of W words has 3 W steps; its samples lie anywhere in them.
    places = np.floor(shares[None] * (3 * sizes)[:, None, None]).astype(np.int64)
    at = np.zeros((n, walks), np.int64)
    keys = np.zeros((n, walks), U)
    for step in range(3 * int(sizes.max())):
        symbol = padded[rows, at]
        for s in range(SAMPLES):
            hit = places[:, :, s] == step
            if hit.any():
                keys += np.where(hit, mix(symbol) * factors[None, :, s], U(0))
        at = np.minimum(at + ((symbol * coins[step][None]) >> U(63)).astype(np.int64), sizes[:, None])
    return mix(keys + mix(sizes)[:, None] + np.arange(walks, dtype=U)[None] * U(0x9E3779B97F4A7C15))


def edit_distances(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Edit distances of rows of equal width; beyond the widest limit they are only known to be larger."""
    n, width = a.shape
    band = int(limit.max())
    big = np.int32(width + 1)
    row = np.full((n, width + 1), big, np.int32)
    row[:, : band + 1] = np.arange(min(band, width) + 1)
    for i in range(1, width + 1):
        lo, hi = max(1, i - band), min(width, i + band)
        new = np.full((n, width + 1), big, np.int32)
        if i <= band:
            new[:, 0] = i
        new[:, lo : hi + 1] = np.minimum(row[:, lo - 1 : hi] + (b[:, lo - 1 : hi] != a[:, i - 1 : i]), row[:, lo : hi + 1] + 1)
        for j in range(lo, hi + 1):
            np.minimum(new[:, j], new[:, j - 1] + 1, out=new[:, j])
        row = new
    return row[:, width]


def tables(rows: list[tuple[int, str]], share: float = SHARE) -> list[Items]:
    """Search tables of a block of items, one for each class of sizes."""
    split = [(i, plain(t).split()) for i, t in rows]
    bounds = [0, *(n for n, _ in WALKS)]
    classes = [[x for x in split if lo < len(x[1]) <= hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    return [Items(some, share, walks) for some, (_, walks) in zip(classes, WALKS, strict=True) if some]


class Items:
    """Search tables of items of one class of sizes."""

    def __init__(self, split: list[tuple[int, list[bytes]]], share: float, walks: int):
        self.walks, self.raw = walks, [w for _, w in split]
        hashed = [word_hashes(np.frombuffer(b" ".join(w), np.uint8))[1] for w in self.raw]
        self.ids = np.array([i for i, _ in split], np.int64)
        self.sizes = np.array([len(w) for w in hashed], np.int64)
        self.limits = np.floor(self.sizes * share + 1e-9).astype(np.int64)
        self.longest, self.edge = int(self.sizes.max()), int(self.limits.max())
        self.words = np.full((len(split), self.longest), PAD, U)
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for row, w in enumerate(hashed):
            self.words[row, : len(w)] = w
            length = min(LONGEST_RUN, len(w) // (int(self.limits[row]) + 1))
            at = np.arange(len(w) - length + 1)
            runs.setdefault(length, []).extend((k, row, o) for o, k in enumerate(RunHash(w, LONGEST_RUN)(at, at + length).view(np.int64).tolist()))
        #: run length -> sorted run hashes with the item and offset of each
        self.runs = {n: np.array(sorted(v), np.int64).T.copy() for n, v in runs.items()}
        keys = np.concatenate([sample_keys(self.words[i : i + AT_ONCE], self.sizes[i : i + AT_ONCE], self.longest, walks) for i in range(0, len(split), AT_ONCE)])
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.rows = keys.ravel()[order], order // walks

    def windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the item-sized windows of a document that may hold an item of that size.

        An item of W words has W - q + 1 runs of q words, and an edit spoils q of them. So a
        window within k edits holds W + 1 - q (k + 1) different runs at least, none of them
        more than k words away from its place; hits that are too few for that are passed over.
        """
        found, scale = [], self.longest + 1
        for length, (keys, rows, offsets) in self.runs.items():
            if len(words) < length:
                continue
            at = np.arange(len(words) - length + 1)
            own = RunHash(words, LONGEST_RUN)(at, at + length).view(np.int64)
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            hit = np.flatnonzero(hi > lo)
            n = (hi - lo)[hit]
            entry = np.repeat(lo[hit] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            base, row = np.repeat(hit, n) - offsets[entry], rows[entry]
            some = self._enough(row, base, offsets[entry], length)
            base, size, reach = base[some], self.sizes[row[some]], self.limits[row[some]]
            span = 2 * reach + 1
            start = np.repeat(base - reach - np.cumsum(span) + span, span) + np.arange(int(span.sum()))
            size = np.repeat(size, span)
            ok = (start >= 0) & (start + size <= len(words))
            found.append(np.unique(start[ok] * scale + size[ok]))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // scale, both % scale

    def _enough(self, row: np.ndarray, base: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
        """Places of the hits that have enough different runs of their item near their base.

        Bases are dealt into cells of 2k + 1; those that go with one window lie in two neighbouring cells.
        """
        if not len(row):
            return np.zeros(0, np.int64)
        cell = base // (2 * self.limits[row] + 1)
        order = np.lexsort((offset, cell, row))
        r, c, o = row[order], cell[order], offset[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
        first = np.flatnonzero(new)
        different = np.add.reduceat((new | np.concatenate([[True], o[1:] != o[:-1]])).astype(np.int64), first)
        fr, fc = r[first], c[first]
        joined = (fr[1:] == fr[:-1]) & (fc[1:] == fc[:-1] + 1)
        beside = np.zeros(len(first), np.int64)
        beside[1:] = np.where(joined, different[:-1], 0)
        beside[:-1] = np.maximum(beside[:-1], np.where(joined, different[1:], 0))
        needed = self.sizes[fr] + 1 - length * (self.limits[fr] + 1)
        good = different + beside >= needed
        return np.sort(order[np.repeat(good, np.diff(np.append(first, len(r))))])

    def matches(self, words: np.ndarray, raw: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(item row, start, words, edits) of a document's best window for each item it holds."""
        near: set[tuple[int, int, int, int]] = set()
        blank = np.full(self.edge, EDGE, U)
        words, raw = np.concatenate([blank, words, blank]), [b"", *raw, b""]
        starts, sizes = self.windows(words)
        for at in range(0, len(starts), AT_ONCE):
            start, size = starts[at : at + AT_ONCE], sizes[at : at + AT_ONCE]
            place = np.minimum(start[:, None] + np.arange(self.longest)[None], len(words) - 1)
            window = np.where(np.arange(self.longest)[None] < size[:, None], words[place], PAD)
            keys = sample_keys(window, size, self.longest, self.walks)
            lo, hi = np.searchsorted(self.keys, keys.ravel(), "left"), np.searchsorted(self.keys, keys.ravel(), "right")
            n = hi - lo
            entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            pairs = np.unique(np.repeat(np.arange(len(n)) // self.walks, n) * len(self.ids) + self.rows[entry])
            w, item = pairs // len(self.ids), pairs % len(self.ids)
            for p in range(0, len(pairs), AT_ONCE):
                a, b = w[p : p + AT_ONCE], item[p : p + AT_ONCE]
                edits = edit_distances(window[a], self.words[b], self.limits[b])
                for i in np.flatnonzero(edits <= self.limits[b]).tolist():
                    near.add((int(b[i]), int(edits[i]), int(start[a[i]]), int(size[a[i]])))
        n, out = len(words) - 2 * self.edge, []
        for k, e, s, size in sorted(near):
            if (not out or out[-1][0] != k) and self.by_words(k, raw, s, size) <= self.limits[k]:
                at = max(0, s - self.edge)
                out.append((k, at, min(n, s + size - self.edge) - at, e))
        return out

    def by_words(self, item: int, raw: list[bytes], start: int, size: int) -> int:
        """Edit distance of an item to a window, on the words themselves."""
        window = [raw[min(max(0, i - self.edge + 1), len(raw) - 1)] for i in range(start, start + size)]
        if window == self.raw[item]:
            return 0
        number = {w: i for i, w in enumerate(self.raw[item])}
        own = np.array([[number[w] for w in self.raw[item]]])
        there = np.array([[number.get(w, -1) for w in window]])
        return int(edit_distances(there, own, self.limits[item : item + 1])[0])


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_chars: int) -> list[DataFrame]:
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    return [items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else items for b in range(blocks)]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, edits): one row for each document and item that it holds."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "item_id", "start_word", "n_words", "edits"]

    def search(items: DataFrame) -> DataFrame:
        texts = _sent(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = tables(texts.value, share)
            for batch in batches:
                found = [(batch.column(0)[row].as_py(), *hit) for row, hit in _found(held, batch.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))], names)

        return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))

    return reduce(DataFrame.unionByName, map(search, _blocks(benchmark, item_col, item_text, block_chars)))


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item; each row is judged by itself and passes through unchanged, without a shuffle."""
    for items in _blocks(benchmark, item_col, item_text, block_chars):
        texts = _sent(items)

        def run(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            held = tables(texts.value, share)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, _ in _found(held, batch.column(text_col)):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _sent(items: DataFrame):
    """A block of items for the tasks, of a bounded size."""
    return items.sparkSession.sparkContext.broadcast([(r["id"], r["text"]) for r in items.collect()])


def _found(held: list[Items], texts: pa.Array) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
    """(row, (item, start, words, edits)) of a batch's texts, worked in pieces."""
    part, at, size = [], 0, 0
    for row, text in enumerate(texts):
        part.append(plain(text.as_py()))
        size += len(part[-1])
        if size >= PIECE or row + 1 == len(texts):
            starts, words = word_hashes(np.frombuffer(b" ".join([*part, b""]), np.uint8))
            sizes = np.array([len(t) + 1 for t in part])
            base = np.append(np.searchsorted(starts, np.cumsum(sizes) - sizes), len(words))
            for table in held:
                for i in _hit_documents(table, words, base):
                    for item, *hit in table.matches(words[base[i] : base[i + 1]], part[i].split()):
                        yield at + i, (int(table.ids[item]), *hit)
            part, at, size = [], row + 1, 0


def _hit_documents(table: Items, words: np.ndarray, base: np.ndarray) -> list[int]:
    """Documents of a chunk with any run of any item (runs over a document's end may add some in vain)."""
    hit = np.zeros(len(base) - 1, bool)
    for length, (keys, _, _) in table.runs.items():
        if len(words) >= length:
            at = np.arange(len(words) - length + 1)
            own = RunHash(words, LONGEST_RUN)(at, at + length).view(np.int64)
            i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit[np.searchsorted(base, np.flatnonzero(keys[i] == own), "right") - 1] = True
    return np.flatnonzero(hit).tolist()
