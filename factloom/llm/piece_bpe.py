"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Text is normalised as the model asks (a leading blank, blanks as U+2581), then a
score-ordered agenda of adjacent symbol pairs is worked off: the pair with the
best score, leftmost first, is merged and its new neighbours join the agenda,
until no adjacent pair is a piece (for many words at once, an agenda a row). Left symbols without a piece become their
UTF-8 byte pieces. As no piece of the vocabulary holds a blank after another
character, the words of a text are independent, and each distinct word is worked
once per Python worker (a bounded memory of words and their ids).

Every Arrow batch is compared with the sentencepiece library, and a difference
raises (unless ``verify`` is off).

Defined results: a null text counts as empty (no ids); repeated rows repeat;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory

SPACE = "▁"
#: Words held in each of two generations, and those of the texts at hand; longer runs than SHORT are not held.
KEEP_WORDS = 400_000
SHORT, NONE = 40, 1 << 30
#: Words whose agendas are worked off together; fewer than FEW are worked one by one.
AGENDAS, FEW = 1 << 12, 32
#: Characters of texts that are compared with the library at once, unless one text is longer.
AT_ONCE = 1 << 20
#: A word with the blanks before it; blanks at the end of a text stand alone.
_WORD = re.compile(" *[^ ]+| +")


def parts(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in parts of up to 100 texts and AT_ONCE characters, or a single longer one."""
    some: list[str] = []
    held = 0
    for text in texts:
        if some and (len(some) == 100 or held + len(text) > AT_ONCE):
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield some


class PieceCoder:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special(i)}
        order = {score: r for r, score in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces of this vocabulary cross words")
        self.surface = [str(i) for i in range(len(self.pieces))]
        # Symbols as numbers: ids of pieces, ``pad`` for none, and beyond it characters that are no piece. All pairs that join to a piece.
        self.pad = len(self.pieces)
        self.char = np.arange(sys.maxunicode + 1, dtype=np.int32) + self.pad + 1
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[ord(" ")] = self.char[ord(SPACE)]
        number = lambda p: self.ids.get(p, int(self.char[ord(p)]) if len(p) == 1 else None)
        halves = ((number(p[:k]), number(p[k:]), p) for p in self.ids for k in range(1, len(p)))
        joins = sorted((left << 21 | right, self.rank[p], self.ids[p]) for left, right, p in halves if left is not None and right is not None)
        code, rank, whole = zip(*joins, (1 << 62, NONE, self.pad), strict=True)
        self.join_code, self.join_rank, self.join_id = np.array(code, np.int64), np.array(rank, np.int32), np.array(whole, np.int32)
        # The bytes of all ids one after another, where an id's bytes begin, and how many they are.
        every = [self.raw.get(i, b"") for i in range(len(self.pieces))]
        self.flat = np.frombuffer(b"".join(every), np.uint8)
        self.size = np.array([len(b) for b in every], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def merge(self, text: str) -> list[str]:
        """Final symbols of one run of characters. The agenda is a heap over linked symbols; stale entries are skipped."""
        get, symbols, n = self.rank.get, list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(r, i, text[i : i + 2]) for i in range(n - 1) if (r := get(text[i : i + 2], NONE)) != NONE]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(piece + symbols[k], NONE)) != NONE:
                    heapq.heappush(agenda, (r, i, piece + symbols[k]))
            if (h := before[i]) >= 0 and (r := get(symbols[h] + piece, NONE)) != NONE:
                heapq.heappush(agenda, (r, h, symbols[h] + piece))
        return [s for s in symbols if s]

    def _joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of symbols in ``join_code``, and whether they are there."""
        code = left.astype(np.int64) << 21 | right
        at = np.searchsorted(self.join_code, code)
        return at, self.join_code[at] == code

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, there = self._joins(left, right)
        return np.where(there, self.join_rank[at], np.int32(NONE))

    def merge_many(self, words: list[str]) -> Iterator[tuple[str, str]]:
        """Words (without the blank before them) and their ids as text. A row of ``agenda`` holds the ranks of a word's adjacent pairs; every round works off the least, leftmost one of each row."""
        size = np.array([len(w) + 1 for w in words])
        column = np.arange(size.max() + 1)
        symbols = np.full((len(words), len(column)), self.pad, np.int32)
        symbols[column < size[:, None]] = self.char[np.frombuffer(" ".join(["", *words]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        rows, agenda = np.arange(len(words)), self._ranks(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            each, best = np.arange(len(rows)), agenda.argmin(1)
            going = agenda[each, best] != NONE
            if not going.all():
                over = symbols[~going]
                for i, found, n in zip(rows[~going].tolist(), over.tolist(), (over != self.pad).sum(1).tolist(), strict=True):
                    try:
                        yield words[i], ",".join([self.surface[j] for j in found[:n]])
                    except IndexError:  # characters without a piece become bytes
                        yield words[i], ",".join([self.surface[j] if j < self.pad else self.bytes_ids(chr(j - self.pad - 1)) for j in found[:n]])
                rows, symbols, agenda, best = rows[going], symbols[going], agenda[going], best[going]
                each = each[: len(rows)]
            joined = self.join_id[self._joins(symbols[each, best], symbols[each, best + 1])[0]]
            after = column >= best[:, None]
            symbols[:, :-1] = np.where(after[:, :-1], symbols[:, 1:], symbols[:, :-1])
            agenda[:, :-1] = np.where(after[:, :-2], agenda[:, 1:], agenda[:, :-1])
            symbols[each, best] = joined
            for at in (best, np.maximum(best - 1, 0)):
                agenda[each, at] = self._ranks(symbols[each, at], symbols[each, at + 1])

    def bytes_ids(self, char: str) -> str:
        return ",".join([str(self.bytes[b]) for b in char.encode("utf-8", "replace")])

    def word(self, w: str) -> tuple[str, int, bytes]:
        """Ids of a word (without the blank before it) as text, their number and the bytes they stand for."""
        symbols = self.merge(SPACE + w.replace(" ", SPACE))
        found = ",".join([self.surface[self.ids[s]] if s in self.ids else self.bytes_ids(s) for s in symbols])
        ids = found.split(",")
        return found, len(ids), b"".join([self.raw[int(i)] for i in ids])

    def learn(self, words: set[str]) -> list[str]:
        """Fills ``known`` with all ``words``; returns those too long to be held."""
        if len(self.known) >= KEEP_WORDS:
            self.older, self.known = self.known, {}
        fresh, long = [], []
        for w in words.difference(self.known):
            if (found := self.older.get(w)) is not None:
                self.known[w] = found
            elif len(w) < SHORT:
                fresh.append(w)
            else:
                long.append(w)
                self.known[w] = self.word(w)[0]
        if len(fresh) < FEW:
            self.known.update([(w, self.word(w)[0]) for w in fresh])
            return long
        fresh.sort(key=len)
        for at in range(0, len(fresh), AGENDAS):
            self.known.update(self.merge_many(fresh[at : at + AGENDAS]))
        return long

    @staticmethod
    def words(text: str) -> list[str]:
        """Words of a text, each without the one blank that is before every word."""
        text = text.replace(SPACE, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [w[1:] for w in _WORD.findall(" " + text)]
        return text.split(" ") if text else []

    def ids_texts(self, texts: list[str]) -> list[str]:
        """Ids of each text in decimal, joined by commas."""
        words = [self.words(t) for t in texts]
        long = self.learn(set().union(*words))
        found = [",".join(map(self.known.__getitem__, some)) for some in words]
        for w in long:
            del self.known[w]
        return found

    def ids_text(self, text: str) -> str:
        return self.ids_texts([text])[0]

    def encode(self, text: str) -> list[int]:
        ids = self.ids_text(text)
        return list(map(int, ids.split(","))) if ids else []

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids stand for, one after another, and where each id's bytes end."""
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)
        return self.flat[at].tobytes(), end

    def decode(self, ids: list[int]) -> str:
        return self._text(b"".join(self.raw.get(i, b"") for i in ids))

    @staticmethod
    def _text(raw: bytes) -> str:
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def coded(self, texts: list[str], verify: bool) -> Iterator[tuple[str, int, str]]:
        """Ids as text, their number and the decoded text of each text; with ``verify``, held against the library."""
        for some in parts(texts):
            own = self.ids_texts(some)
            counts = [t.count(",") + 1 if t else 0 for t in own]
            ids = np.fromstring(",".join(filter(None, own)), np.int32, sep=",") if any(counts) else np.zeros(0, np.int32)
            raw, end = self.bytes_of(ids)
            last = np.append(0, end)[np.cumsum([0, *counts])].tolist()
            decoded = [self._text(raw[i:j]) for i, j in zip(last[:-1], last[1:], strict=True)]
            if verify:
                held = self.lib.encode_as_numpy(some, num_threads=1)
                same = [len(h) for h in held] == counts and np.array_equal(np.concatenate(held), ids)
                if not same or decoded != [self.lib.decode(h) for h in held]:
                    raise ValueError(f"differs from the library, in one of {[t[:40] for t in some]!r}")
            yield from zip(own, counts, decoded, strict=True)

    def check(self, texts: list[str]) -> None:
        for _ in self.coded(texts, verify=True):
            pass


def coder(path: str) -> PieceCoder:
    """The worker's coder for a model file."""
    held = memory("piece_bpe")
    if path not in held:
        held[path] = PieceCoder(path)
    return held[path]


def _over(docs: DataFrame, path: str, id_col: str, text_col: str, verify: bool, one, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [one(*found) for found in c.coded([t or "" for t in part.column(1).to_pylist()], verify)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in zip(*rows, strict=True))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """doc_id, ids array<int>, decoded string for every row."""

    def one(ids: str, _: int, decoded: str):
        return pa.scalar([int(i) for i in ids.split(",")] if ids else [], pa.list_(pa.int32())), decoded

    return _over(docs, model_path, id_col, text_col, verify, one, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; ids never leave the worker."""

    def one(ids: str, n: int, decoded: str):
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _over(docs, model_path, id_col, text_col, verify, one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
