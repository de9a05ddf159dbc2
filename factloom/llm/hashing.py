"""Vectorised 64-bit hashes of words, bytes and runs of units.

Every step goes through a mixing function that is not linear, so that no repetitive
text (as "abba..." against its complement) collides by construction, as it would
under a polynomial modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
FACTOR, LENGTH = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PIECE = 1 << 18
#: Longer words are hashed one by one.
LONG_WORD = 128
#: Units of a sequence whose run hashes are held at once.
STEP = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = np.array(x, dtype=U)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class RunHash:
    """Hash of any run ``[i, j)`` of up to ``longest`` units: that of its length and of the two blocks of a power of two that cover it.

    ``units`` are hashes of ``first`` neighbours each; a run is no shorter than ``first``.
    """

    def __init__(self, units: np.ndarray, longest: int, first: int = 1):
        self.blocks = {first: units}
        while 2 * first <= longest:
            u = self.blocks[first]
            self.blocks[2 * first] = mix(u[: max(0, len(u) - first)] * FACTOR + u[first:])
            first *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size, out = j - i, np.empty(len(i), U)
        for m, block in self.blocks.items():
            of = np.flatnonzero((size >= m) & ((size < 2 * m) | (2 * m not in self.blocks)))
            if len(of):
                a, b = (i, j) if len(of) == len(i) else (i[of], j[of])
                out[of] = mix(block[a] * FACTOR + block[b - m] + (b - a).astype(U) * LENGTH)
        return out


def run_hashes(units: np.ndarray, i: np.ndarray, j: np.ndarray, longest: int) -> np.ndarray:
    """Hashes of the runs ``[i, j)``, ``i`` ascending; long sequences go piece by piece."""
    if len(units) <= STEP or not len(i):
        return RunHash(units, longest)(i, j)
    out, cuts = np.empty(len(i), U), np.searchsorted(i, np.arange(0, len(units) + STEP, STEP))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a < b:
            lo = int(i[a])
            out[a:b] = RunHash(units[lo : int(j[a:b].max())], longest)(i[a:b] - lo, j[a:b] - lo)
    return out


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of a buffer, as one number."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", np.ascontiguousarray(buf).data, strides=(1,)) if len(buf) > 7 else np.zeros(0, U)


def byte_units(buf: np.ndarray, seed: int) -> np.ndarray:
    """Units of eight neighbours each, for RunHash."""
    return mix(eights(buf) ^ U(seed))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the maximal runs of bytes outside 0x20 and 0x09-0x0D."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~SPACES[buf]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def word_hashes(buf: np.ndarray, seeds: tuple[int, ...] = SEEDS[:1]) -> tuple[np.ndarray, ...]:
    """Start byte of each word and one hash of it for each seed: the words' bytes are taken in eight at a time."""
    starts, ends = word_spans(buf)
    values, lens = eights(np.concatenate([buf, np.zeros(8, np.uint8)])), ends - starts
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
    out = [mix(lens.astype(U) * LENGTH + U(seed)) for seed in seeds]
    live, at = np.flatnonzero(lens <= LONG_WORD), 0
    while len(live):
        v = (values[starts[live] + at] & masks[np.minimum(lens[live] - at, 8)]) * FACTOR
        for h in out:
            h[live] = mix(h[live] + v)
        at += 8
        live = live[lens[live] > at]
    for w in np.flatnonzero(lens > LONG_WORD).tolist():
        raw = buf[starts[w] : ends[w]].tobytes()
        for h, seed in zip(out, seeds, strict=True):
            h[w] = xxhash.xxh64_intdigest(raw, seed)
    return starts, *out
