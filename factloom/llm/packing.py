"""Packing of token sequences: a configuration linear program over the length histogram, rounded.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. How many pieces
there are of each length is all that the plan needs, and that histogram has ``capacity``
entries however large the corpus is. A configuration is a multiset of lengths that fits
one sequence; the program asks for the fewest (fractional) copies of configurations that
cover the histogram. It is solved by multiplicative weights: each length has a price,
at first its share of a sequence; a knapsack dynamic program finds configurations of the
best price; a length's price falls exponentially with the share of its pieces that is
covered. Copies are then rounded down, and what is left of the histogram goes to the
fullest sequence with room (best fit, longest first, all equal sequences at once).

The plan's size is bounded by the capacity, not by the data. Each piece finds its slot by
its number among the pieces of its length: its number within its partition, counted
where it was made, plus those of earlier partitions. No window runs over a length, so
a length that a third of all pieces share is no hot key.

Defined results: a null text counts as empty and has one token, the end mark; repeated
rows are packed apart; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import cut_lineage, memory

CAPACITY, END = 4096, 1
#: Words held in each of two generations; longer ones are not held.
KEEP_WORDS, SHORT = 500_000, 64
#: ASCII marks, and the signs that begin special tokens.
MARKS, SIGN = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"<|"
#: Rounds over the histogram, the price's fall for a length wholly covered, and how near to the best price a configuration must come.
PHASES, RATE, NEAR = 2, 0.1, 0.05
#: Least share of a sequence that a configuration of the program fills.
FULL = 0.9999
#: Configurations taken from one knapsack table.
COLUMNS = 256

Config = tuple[tuple[int, int], ...]


class WordIds:
    """Ids of texts as little-endian 32-bit numbers.

    White space is dropped, case is dropped, and no token of this vocabulary reaches
    across white space or from a letter or digit into the marks after it. So words are
    encoded apart, each once while it is remembered, and marks at a word's end apart
    from it. Texts with the signs of a special token are taken as they are.
    """

    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # The sign that stands for each byte of UTF-8, as the library has it.
        signs = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        some = map(chr, [*range(1, 0x800), *range(0x800, 0xD800, 0x800), *range(0xE000, 0x110000, 0x1000)])
        self.letter = {b: sign for c in some if not c.isspace() for b, sign in zip(c.encode(), signs(c)[0][0], strict=True)}

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, bytes]:
        """A word without the marks at its end, and these; whole where they may belong together."""
        core = word.rstrip(MARKS)
        return (core, word[len(core) :]) if core[-1:].isalnum() and SIGN not in word else (word, b"")

    def plain(self, word: bytes) -> bytes | None:
        """Ids of lower-case letters alone, which reach the library's model as they are; None for other words."""
        if word.isalpha() and word.islower():
            text = word.decode()
        else:
            text = word.decode("utf-8", "replace")
            if not text.isalpha() or text.lower() != text or not is_normalized("NFC", text):
                return None
            text = "".join(map(self.letter.__getitem__, text.encode()))
        return array("I", [t.id for t in self.lib.model.tokenize(text)]).tobytes()

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words; short ones are remembered."""
        cut = {w: self.parts(w) for w in words if w not in self.older}
        own = {x: self.known.get(x) or self.older.get(x) or self.plain(x) for x in {x for pair in cut.values() for x in pair if x}}
        fresh = [x for x, ids in own.items() if ids is None]
        coded = self.lib.encode_batch_fast([x.decode("utf-8", "replace") for x in fresh], add_special_tokens=False)
        own |= {x: array("I", c.ids).tobytes() for x, c in zip(fresh, coded, strict=True)}
        out = {w: own[core] + own.get(marks, b"") for w, (core, marks) in cut.items()}
        out |= {w: self.older[w] for w in words if w not in out}
        if len(self.known) >= KEEP_WORDS:
            self.older, self.known = self.known, {}
        self.known |= {w: ids for w, ids in (own | out).items() if len(w) <= SHORT}
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; new words of all of them are encoded in one call."""
        split = [(text if SIGN in text else text.lower()).split() for text in texts]
        found = [list(map(self.known.get, words)) for words in split]
        new = {w for words, ids in zip(split, found, strict=True) for w, x in zip(words, ids, strict=True) if x is None}
        if not new:
            return [b"".join(ids) for ids in found]
        held = self.learn(new)
        return [b"".join([held[w] if x is None else x for w, x in zip(words, ids, strict=True)]) for words, ids in zip(split, found, strict=True)]


def word_ids(path: str) -> WordIds:
    """The worker's coder for a vocabulary file."""
    held = memory("packing")
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """Best total price within each capacity (lengths descending)."""
    best = np.zeros(capacity + 1)
    first = np.searchsorted(-lengths, -np.arange(capacity + 1))  # the longest that fits
    for c in range(1, capacity + 1):
        k = first[c]
        best[c] = max(best[c - 1], (best[c - lengths[k:]] + price[k:]).max()) if k < len(lengths) else best[c - 1]
    return best


def traced(best: np.ndarray, lengths: np.ndarray, price: np.ndarray, room: int) -> dict[int, int]:
    """Lengths and copies that fill ``room``, each step by the table's value of what it leaves (ties: the longest)."""
    out: dict[int, int] = defaultdict(int)
    while (k := int(np.searchsorted(-lengths, -room))) < len(lengths):
        length = int(lengths[k + int((best[room - lengths[k:]] + price[lengths[k:]]).argmax())])
        out[length] += 1
        room -= length
    return out


def fractional(counts: np.ndarray, capacity: int) -> tuple[dict[Config, float], float]:
    """Configurations with their fractional copies, which cover no length beyond its pieces; and a lower bound of the number of sequences.

    One table serves many configurations: each begins with a length that is covered least
    and goes on with lengths that are still open. The bound is the best dual value met:
    prices divided by the best configuration's price.
    """
    lengths = np.flatnonzero(counts)[::-1]
    need, cover = counts.astype(float), np.zeros(capacity + 1)
    price = np.arange(capacity + 1) / capacity
    copies: dict[Config, float] = defaultdict(float)
    bound = 0.0
    for phase in range(1, PHASES + 1):
        goal, used = phase / PHASES - 1e-9, 1
        while used and len(left := lengths[cover[lengths] < goal]):
            best = knapsack(left, price[left], capacity)
            bound, used = max(bound, float(need[left] @ price[left]) / best[capacity]), 0
            for length in left[np.argsort(cover[left], kind="stable")].tolist():
                if cover[length] >= goal:
                    continue
                content = traced(best, left, price, capacity - length)
                content[length] += 1
                worth = sum(price[s] * k for s, k in content.items())
                if sum(s * k for s, k in content.items()) < FULL * capacity or worth < (1 - NEAR) * best[capacity]:
                    continue
                share = min(need[s] * (phase / PHASES - cover[s]) / k for s, k in content.items())
                copies[tuple(sorted(content.items(), reverse=True))] += share
                for s, k in content.items():
                    cover[s] += k * share / need[s]
                    price[s] *= np.exp(-RATE * k * share / need[s])
                left, used = left[cover[left] < goal], used + 1
                if used == COLUMNS:
                    break
    return copies, bound


def best_fit(counts: np.ndarray, capacity: int) -> dict[Config, int]:
    """Longest first, each piece to the fullest sequence with room; equal sequences are handled together."""
    room: dict[int, dict[Config, int]] = defaultdict(lambda: defaultdict(int))
    holds = 0  # bit r: there are sequences with room r
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fits = holds >> length
            if fits:
                free = length + (fits & -fits).bit_length() - 1
                content, have = next(iter(room[free].items()))
            else:
                free, content, have = capacity, (), left
            each = min(free // length, left)
            many = min(have, left // each)
            if fits:
                if many == have:
                    del room[free][content]
                    if not room[free]:
                        holds &= ~(1 << free)
                else:
                    room[free][content] -= many
            rest = free - each * length
            room[rest][(*content, (length, each))] += many
            holds |= 1 << rest if rest else 0
            left -= each * many
    return {content: n for contents in room.values() for content, n in contents.items()}


def configurations(counts: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Configurations and whole copies that hold exactly the pieces of the histogram."""
    copies, _ = fractional(counts, capacity)
    left, out = counts.astype(np.int64).copy(), []
    for content, share in copies.items():
        if n := int(share + 1e-6):
            out.append((content, n))
            for length, k in content:
                left[length] -= k * n
    return out + list(best_fit(left, capacity).items())


class Plan:
    """Slots of every length, in the order of the configurations."""

    def __init__(self, configs: list[tuple[Config, int]]):
        rows, sequence = [], 0
        filled: dict[int, int] = defaultdict(int)
        for content, n in configs:
            offset = 0
            for length, k in content:
                rows.append((length, filled[length], sequence, k, offset))
                filled[length] += n * k
                offset += length * k
            sequence += n
        self.sequences = sequence
        columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.key, self.first, self.base, self.each, self.offset = (columns[0] << 44) | columns[1], *columns[1:]

    def slots(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and numbers."""
        at = np.searchsorted(self.key, (length << 44) | number, "right") - 1
        copy, place = np.divmod(number - self.first[at], self.each[at])
        return self.base[at] + copy, self.offset[at] + place * length


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, number[, ids]): the pieces of every text, and each one's number among those of its length in its partition."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()] + [pa.list_(pa.uint32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = word_ids(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        mark = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some, rows = batch.slice(at, 500), []
                for doc_id, ids in zip(some.column(0).to_pylist(), coder.ids([t or b"" for t in some.column(1).to_pylist()]), strict=True):
                    ids += mark
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        cut = ids[4 * start : 4 * (start + capacity)]
                        length = len(cut) // 4
                        rows.append((doc_id, piece, start, length, zlib.crc32(cut), part, seen[length], *[np.frombuffer(cut, "<u4")] * with_ids))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names).cast(pa.schema([(n, pa.list_(pa.int64()) if n == "ids" else k) for n, k in zip(names, kinds, strict=True)]))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece in its place; the places of a sequence are gapless from 0."""
    made = cut_lineage(pieces(docs, path, capacity, id_col, text_col, with_ids))
    counted = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    plan = made.sparkSession.sparkContext.broadcast(Plan(configurations(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.value.slots(length.to_numpy(np.int64), number.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = made.join(before, ["part", "length"]).withColumn("slot", slot("length", F.col("number") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset", *["ids"] * with_ids)
