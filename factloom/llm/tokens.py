"""Token counts of fields and sections by offset-mapped attribution.

A whole document (its fields in order, one newline between) is encoded once; each
token's byte span is mapped to a character span and joined, as an interval, with
the spans of the sections. A token inside one section counts there. One that
crosses a boundary goes to the section that holds most of its characters, ties to
the earlier one. A token that is only part of a character takes that character's
place; separators between sections belong to the section before them. The counts
of a document's sections therefore add up to its tokens.

Sections are the lines of a field; an empty field or line is a section with no
characters of its own. Defined results: a null field counts as empty; repeated
rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def vocabulary(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of a ranks file, and the bytes of each id."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            lengths[i] = len(piece)
        _LOADED[path] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths)
    return _LOADED[path]


def token_spans(text: str, encoding: tiktoken.Encoding, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of the tokens; part of a character spans that character."""
    sizes = lengths[np.array(encoding.encode_ordinary(text), np.int64)]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if text.isascii():  # one byte a character
        return starts, ends
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Tokens of each section, given the sections' first characters (ascending from 0)."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    chosen = first.copy()
    for i in np.flatnonzero(first != last):
        edges = np.clip(np.append(sections[first[i] : last[i] + 1], ends[i]), starts[i], ends[i])
        chosen[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(chosen, minlength=len(sections))


def section_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(doc_id, field, section, start, n_chars, n_tokens) for every line of every field.

    ``start`` is the section's first character in the field; ``n_chars`` leaves the line end out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = vocabulary(vocabulary_path, pattern)
        names = ["doc_id", "field", "section", "start", "n_chars", "n_tokens"]
        for batch in batches:
            ids, columns, out = batch.column(0).to_pylist(), [batch.column(i + 1).to_pylist() for i in range(len(fields))], [[] for _ in names]
            for row, doc_id in enumerate(ids):
                whole = "\n".join(c[row] or "" for c in columns)
                lines = whole.split("\n")
                sizes = np.array([len(x) for x in lines])
                sections = np.cumsum(sizes + 1) - sizes - 1
                counts = attribute(*token_spans(whole, encoding, lengths), sections)
                at = 0
                for field, c in zip(fields, columns, strict=True):
                    n = (c[row] or "").count("\n") + 1
                    part = slice(at, at + n)
                    for o, v in zip(out, ([doc_id] * n, [field] * n, range(n), (sections[part] - sections[at]).tolist(), sizes[part].tolist(), counts[part].tolist()), strict=True):
                        o.extend(v)
                    at += n
                if len(out[0]) >= 20_000 or row + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(o, pa.string() if n == "field" else pa.int64()) for o, n in zip(out, names, strict=True)], names)
                    out = [[] for _ in names]

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return picked.mapInArrow(run, "doc_id long, field string, section long, start long, n_chars long, n_tokens long")
