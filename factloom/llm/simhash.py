"""Near-duplicate groups by SimHash and Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two
fingerprints that differ in two bits or fewer agree wholly on at least one
segment (pigeonhole), and differ in at most two bits on the segment after it.
Padded to 23 bits, that following segment is decoded with the perfect binary
Golay code: a word at distance three from its codeword is also filed under the
five codewords at distance four, and then any two words at distance two or less
share a codeword index. A key is (exact segment, codeword index of the next), so
a fingerprint has 3 to 18 keys, and every link has a key in common.

Keys join distinct fingerprints, never documents, so copies cost nothing. Keys
with up to ``bucket_cap`` fingerprints are joined and verified by Hamming
distance. The members of larger buckets are linked exactly without pairs: two
words are within two bits of each other exactly if they share a word one flip
away, so each is filed under its 65 neighbours and tied to the least member there.

``similar_classes`` links texts by the Jaccard similarity of their five-word shingles
instead. A similarity of 0.8 leaves about a seventh of the bits different, so it takes a
longer fingerprint: 11 segments of 23 bits, each decoded to its codeword indices. A text is
filed under each index together with its least shingle in the segment's own order. Two texts
are candidates if they meet in such a group and share an index of another segment too.
At the similarity 0.8 a segment has a common index with about 0.60 and the least shingle is
the same with 0.8: a pair is missed once in 700. More than ``FAR`` of 256 bits differ
once in 700 such pairs. A group holds texts with a shingle in common, so it grows with the
copies of that shingle, not with the corpus: a text has about 58 rows, however many texts there are.
Candidates are verified by their whole shingle sets. First every text is compared with a few
leaders of the texts under its indices, which ties crowds of near copies without pairs; then all
candidates between different classes are verified, however large a group is: large groups are
dealt into blocks, and a task compares two blocks and gives only the links that join classes.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other. Repeated rows stay as rows of one
class; a null id stays a row and never is the smallest id (null if no other is).
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, memory
from .hashing import LENGTH, U, mix

WORDS, SEED, BITS = 3, 42, 2
BUCKET_CAP = 32
LIKE_WORDS, SIMILARITY = 5, 0.8
#: Segments of 23 bits of a long fingerprint, the most differing bits of a candidate, leaders a text is compared with.
PARTS, FAR, NEAREST = 11, 56, 4
#: Bits of the table that passes over texts without a candidate, and pairs of a group held at once.
SLOTS, AT_ONCE = 1 << 24, 1 << 21
#: Rows and shingle hashes of a group's block (on average), which bound what a task holds.
BLOCK_ROWS, BLOCK_HASHES = 2048, 1 << 21
STRETCH = np.arange(1, 5, dtype=U) * LENGTH
#: Odd factors, by which each segment has its own order of the shingle hashes.
ORDERS = mix(np.arange(101, 101 + PARTS, dtype=U)) | U(1)
#: Texts of a group whose pairs are looked at one by one, rows of a table that is sent to all tasks.
FEW, SENT = 64, 1 << 17
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0xAE3
#: (shift, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str, words: int = WORDS) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    rows = zip(*(tokens[i:] for i in range(words)), strict=False) if len(tokens) >= words else [tokens]
    values = map(xxhash.xxh64_intdigest, map(b" ".join, rows), repeat(SEED))
    n = max(1, len(tokens) - words + 1)
    hashes, ones = np.fromiter(values, "<u8", n), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; whole texts, one Arrow batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of single bytes at shifts 0, 8, 16; the leader and, for leaders of
    weight three, the five weight-four patterns of each of the 2,048 cosets."""

    def rest(w: int) -> int:
        for bit in range(22, 10, -1):
            if w >> bit & 1:
                w ^= GOLAY << (bit - 11)
        return w

    byte = np.array([[rest(v << s & 0x7FFFFF) for v in range(256)] for s in (0, 8, 16)], np.uint32)
    leader, fours = np.zeros(2048, np.uint32), [[] for _ in range(2048)]
    single = [rest(1 << b) for b in range(23)]
    for weight in (1, 2, 3, 4):
        for at in combinations(range(23), weight):
            s, pattern = 0, 0
            for b in at:
                s, pattern = s ^ single[b], pattern | 1 << b
            if weight < 4:
                leader[s] = pattern
            else:
                fours[s].append(pattern)
    return byte, leader, np.array([p if len(p) == 5 else [int(leader[s])] * 5 for s, p in enumerate(fours)], np.uint32)


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """(n, 6) indices: the nearest codeword, and at distance three its five rivals (else the same again)."""
    byte, leader, fours = golay_tables()
    w = segment.astype(np.uint32)
    s = byte[0][w & 255] ^ byte[1][w >> 8 & 255] ^ byte[2][w >> 16 & 255]
    return np.concatenate([(w ^ leader[s])[:, None], w[:, None] ^ fours[s]], axis=1) >> 11


def golay_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 18) join keys of 64-bit fingerprints, with repeats."""
    fp = fp.astype(np.int64).view(np.uint64)
    parts = [(fp >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]
    keys = [np.uint64(i << 40) | (parts[i] << np.uint64(12))[:, None] | codeword_indices(parts[(i + 1) % 3]).astype(np.uint64) for i in range(3)]
    return np.concatenate(keys, axis=1).view(np.int64)


def fingerprint_links(distinct: DataFrame, bits: int = BITS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Links (a, b) whose classes are those of all pairs of ``fp`` at ``bits`` or fewer differing bits."""
    assert bits == BITS, "the key scheme is exact for two differing bits"
    keys = F.pandas_udf(lambda fp: pd.Series(list(golay_keys(fp.to_numpy()))), "array<long>")
    keyed = distinct.select("fp", F.explode(F.array_distinct(keys("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(keyed.join(shared, "key"))
    small = members.filter(F.col("n") <= bucket_cap)
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")
    near = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = members.filter(F.col("n") > bucket_cap).select("fp").distinct().select("fp", F.explode(F.concat(F.array("fp"), near)).alias("centre"))
    least = around.groupBy("centre").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("centre", "b")
    ties = around.join(least, "centre").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(ties).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; the root is the least node.

    Alternating large and small stars: each round ties every node to the least of
    its neighbours; the number of rounds grows with the logarithm of a class.
    """
    edges, seen = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()), None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = low.select("u", F.col("m").alias("v")).unionByName(tied.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    tree = components(fingerprint_links(distinct.select("fp")))
    rooted = distinct.join(tree, distinct.fp == tree.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str, words: int = LIKE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (the whole sequence, where it has fewer words), as signed 64-bit numbers."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    rows = zip(*(tokens[i:] for i in range(words)), strict=False) if len(tokens) >= words else [tokens]
    n = max(1, len(tokens) - words + 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, rows), repeat(SEED)), "<u8", n).view(np.int64))


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 majority bits of a set of shingle hashes, each stretched to four words."""
    ones, n = np.zeros(256, np.int64), len(hashes)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(U)
        wide = mix(part[:, None] + STRETCH)
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        full = len(bits) // 128 * 128  # sums of 128 bits fit a byte
        ones += np.add.reduce(bits[:full].reshape(-1, 128, 256), axis=1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def parts_of(fp: np.ndarray) -> np.ndarray:
    """(n, PARTS) segments of (n, 4) fingerprints."""
    at = 23 * np.arange(PARTS)
    low = fp[:, at // 64] >> (at % 64).astype(U)
    high = np.where(at % 64 > 41, fp[:, np.minimum(at // 64 + 1, 3)] << (-at % 64).astype(U), U(0))
    return ((low | high) & U((1 << 23) - 1)).astype(np.uint32)


def part_indices(fp: np.ndarray) -> np.ndarray:
    """(n, PARTS, 6) codeword indices of the segments, each with its segment's number above it."""
    own = codeword_indices(parts_of(fp).ravel()).reshape(len(fp), PARTS, 6)
    return own.astype(np.int64) | (np.arange(PARTS) << 12)[None, :, None]


def least(hashes: np.ndarray) -> np.ndarray:
    """The least of a set of shingle hashes in the order of each segment."""
    out = np.full(PARTS, ~U(0))
    for at in range(0, len(hashes), 1 << 14):
        out = np.minimum(out, (hashes[at : at + (1 << 14)].view(U)[:, None] * ORDERS).min(0))
    return out


def group_keys(fp: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(n, PARTS, 6) groups: a codeword index of a segment under the least shingle in its order, the segment's number in the low four bits."""
    keys = mix(part_indices(fp).astype(U) * LENGTH + low[:, :, None])
    return (keys & ~U(15) | np.arange(PARTS, dtype=U)[None, :, None]).view(np.int64)


def long_fingerprints(texts: DataFrame, words: int = LIKE_WORDS) -> DataFrame:
    """(node, n, a, b, c, d, least) for every (node, text): the number of shingles, the fingerprint's words, the least shingle in each segment's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory("simhash")
        for batch in batches:
            sets = (shingles(t.as_py() or "", words) for t in batch.column(1))
            rows = np.array([(len(s), *long_fingerprint(s).view(np.int64).tolist(), *least(s).view(np.int64).tolist()) for s in sets], np.int64).reshape(-1, 5 + PARTS)
            low = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * PARTS, pa.int32()), pa.array(rows[:, 5:].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows[:, :5].T), low], ["node", "n", "a", "b", "c", "d", "least"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, a long, b long, c long, d long, least array<long>")


def leader_pairs(prints: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every text and the nearest of the four leaders of each of its groups (the least and the greatest text hash, twice)."""
    keys = F.pandas_udf(lambda a, b, c, d: pd.Series(list(part_indices(np.stack([x.to_numpy().view(U) for x in (a, b, c, d)], axis=1)).reshape(len(a), -1))), "array<long>")
    keyed = prints.select("node", F.explode(F.array_distinct(keys("a", "b", "c", "d"))).alias("g"))
    turned = lambda c: F.col(c).bitwiseXOR(F.xxhash64("g"))
    ends = keyed.select("g", "node", turned("node").alias("t")).groupBy("g").agg(F.min("node").alias("l1"), F.max("node").alias("l2"), F.min("t").alias("t1"), F.max("t").alias("t2"))
    leads = ends.select("g", F.explode(F.array_distinct(F.array("l1", "l2", turned("t1"), turned("t2")))).alias("node"))
    # 4 leaders for each of 11 * 4096 groups at most (10 MB), however many texts there are.
    table = leads.join(prints, "node").select("g", "node", "n", "a", "b", "c", "d").toArrow()
    known = np.stack([c.to_numpy() for c in table.columns])
    known = known[:, known[0].argsort(kind="stable")]
    sent = prints.sparkSession.sparkContext.broadcast((known, np.searchsorted(known[0], np.arange((PARTS << 12) + 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = sent.value
        lead_fp = np.ascontiguousarray(known[3:].T).view(U)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = np.stack([c.to_numpy() for c in batch.slice(at, 1000).columns])
                fp = np.ascontiguousarray(rows[2:].T).view(U)
                g = part_indices(fp).reshape(rows.shape[1], -1)
                count = (start[g + 1] - start[g]).ravel()
                i = np.repeat(np.repeat(np.arange(len(g)), g.shape[1]), count)
                lead = np.repeat(start[g].ravel(), count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                bits = np.bitwise_count(fp[i] ^ lead_fp[lead]).sum(1, dtype=np.int64)
                n, lead_n = rows[1, i], known[2, lead]
                near = (bits <= FAR) & (np.minimum(n, lead_n) >= np.maximum(n, lead_n) * similarity - 1e-9) & (known[1, lead] != rows[0, i])
                i, node, bits = i[near], known[1, lead[near]], bits[near]
                order = np.lexsort((node, bits, i))
                i, node = i[order], node[order]
                once = np.append(True, (i[1:] != i[:-1]) | (node[1:] != node[:-1]))[: len(i)]
                i, node = i[once], node[once]
                best = np.arange(len(i)) - np.searchsorted(i, i) < NEAREST
                own, node = rows[0, i[best]], node[best]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, node)), pa.array(np.maximum(own, node))], ["a", "b"])

    return prints.select("node", "n", "a", "b", "c", "d").mapInArrow(run, "a long, b long").distinct()


def cross_pairs(comp: np.ndarray, n: np.ndarray, fp: np.ndarray, part: int, similarity: float, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs (i << 32 | j) of a group's texts in different classes, which share an index of a segment besides ``part`` and are near.

    With ``side``, rows of sides 0 and 1 pair with the other side only.
    """
    m, out = len(comp), [np.zeros(0, np.int64)]
    if m < 2 or (comp == comp[0]).all():
        return out[0]
    own = part_indices(fp)

    def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        like = (np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * similarity - 1e-9) & (comp[i] != comp[j])
        if side is not None:
            like &= (side[i] != side[j]) | (side[i] < 0)
        i, j = i[like], j[like]
        near = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64) <= FAR
        return i[near], j[near]

    if m <= FEW:
        i, j = kept(*np.triu_indices(m, 1))
        shared = (own[i][:, :, :, None] == own[j][:, :, None, :]).any((2, 3))
        shared[:, part] = False
        return (i << 32 | j)[shared.any(1)]
    others = np.delete(own, part, axis=1).reshape(m, -1)
    by_comp = comp.argsort(kind="stable")
    entries = np.unique(others * m + by_comp.argsort()[:, None])
    key, who = entries // m, by_comp[entries % m]
    # Within an index the texts lie by class: each meets those of the classes after its own.
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_comp = new_key | np.concatenate([[True], comp[who[1:]] != comp[who[:-1]]])
    ends = lambda new: np.append(np.flatnonzero(new)[1:], len(new))[np.cumsum(new) - 1]
    first, last = ends(new_comp), ends(new_key)
    count = last - first
    cuts = np.unique([0, *np.searchsorted(np.cumsum(count), np.arange(AT_ONCE, int(count.sum()), AT_ONCE)), len(count)]).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        c = count[lo:hi]
        i = np.repeat(who[lo:hi], c)
        j = who[np.repeat(first[lo:hi], c) + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)]
        i, j = kept(np.minimum(i, j), np.maximum(i, j))
        out.append(np.unique(i << 32 | j))
    return np.unique(np.concatenate(out))


def tiled(keyed: DataFrame, weight: Column | None = None) -> DataFrame:
    """``keyed`` (g, node, comp, ...) with a tile ``k`` in front and ``side``. A group of more than ``BLOCK_ROWS`` rows or
    ``BLOCK_HASHES`` of ``weight`` is dealt into blocks, and each two blocks (or one with itself) are a tile of their own;
    one whose texts are all of one class has nothing to link and goes. A tile keeps its group's segment in the low four bits."""
    over = F.count(F.lit(1)) / BLOCK_ROWS
    over = over if weight is None else F.greatest(over, F.sum(weight) / BLOCK_HASHES)
    crowded = cut_lineage(keyed.groupBy("g").agg(F.ceil(over).alias("blocks")).filter("blocks > 1"))
    # A row for each crowded group: sent to the tasks while they are few, joined by shuffle otherwise. Only in these are the classes looked at.
    few = crowded.count() <= SENT
    mixed = keyed.select("g", "comp").join(F.broadcast(crowded) if few else crowded, "g").groupBy("g").agg(F.when(F.min("comp") < F.max("comp"), F.max("blocks")).otherwise(0).alias("blocks"))
    large = cut_lineage(mixed)
    dealt = keyed.join(F.broadcast(large) if few else large, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).filter("blocks > 0")
    met = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    of_two = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).bitwiseAND(F.lit(-16)).bitwiseOR(F.col("g").bitwiseAND(F.lit(15)))
    tile = F.when(F.col("blocks") > 1, of_two).otherwise(F.col("g"))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).cast("long")
    rows = met.select(tile.alias("k"), side.alias("side"), *[c for c in keyed.columns if c != "g"])
    return rows.repartition("k").sortWithinPartitions("k")


def each_tile(batches: Iterator[pa.RecordBatch], solve, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns ``names`` of ``solve(numbers, lists)`` for the rows of each tile, which follow each other: nine columns of numbers
    and, if there is one, the lists of the tenth. Tiles with texts of one class only are passed over."""
    held: list[tuple[np.ndarray, pa.Array | None]] = []
    found: list[np.ndarray] = []

    def done() -> None:
        if held:
            lists = None if held[0][1] is None else pa.concat_arrays([x for _, x in held])
            found.append(solve(np.concatenate([x for x, _ in held], axis=1), lists))
            held.clear()

    def out() -> pa.RecordBatch:
        rows = np.concatenate([np.zeros((len(names), 0), np.int64), *found], axis=1)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns[:9]])
        start = np.append(0, np.flatnonzero(np.diff(rows[0])) + 1)
        end = np.append(start[1:], batch.num_rows)
        if held and held[0][0][0, 0] != rows[0, 0]:
            done()
        mixed = np.minimum.reduceat(rows[3], start) < np.maximum.reduceat(rows[3], start)
        # The last tile may go on in the next batch; the first may have begun in the one before.
        mixed[-1] = True
        mixed[0] |= bool(held)
        for at in np.flatnonzero(mixed).tolist():
            lo, hi = int(start[at]), int(end[at])
            if at:
                done()
            held.append((rows[:, lo:hi], batch.column(9).slice(lo, hi - lo) if batch.num_columns > 9 else None))
        yield out()
    done()
    yield out()


def tile_pairs(rows: np.ndarray, similarity: float) -> np.ndarray:
    """The candidates of a tile (k, side, node, comp, n, a to d), as in ``cross_pairs``."""
    side = rows[1] if (rows[1] >= 0).any() else None
    return cross_pairs(rows[3], rows[4], np.ascontiguousarray(rows[5:].T).view(U), int(rows[0, 0]) & 15, similarity, side)


def ties(pairs: np.ndarray, comp: np.ndarray, lists: pa.Array, similarity: float) -> list[tuple[int, int]]:
    """Those of ``pairs`` with sets as similar that join two classes; pairs inside a class by then are not looked at."""
    if not len(pairs):
        return []
    label = np.unique(comp, return_inverse=True)[1]
    n, column = np.diff(lists.offsets.to_numpy()), np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    at, mark, out = np.append(0, np.cumsum(n)), np.zeros(len(column), bool), []
    first, second = pairs >> 32, pairs & 0xFFFFFFFF
    cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(pairs)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        i = int(first[lo])
        js = second[lo:hi]
        js = js[label[js] != label[i]]
        if not len(js):
            continue
        own = column[at[i] : at[i + 1]]
        mark[own] = True
        common = np.array([np.count_nonzero(mark[column[at[j] : at[j + 1]]]) for j in js.tolist()])
        mark[own] = False
        for j in js[common >= (n[i] + n[js] - common) * similarity - 1e-9].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def candidate_members(prints: DataFrame, similarity: float) -> DataFrame:
    """(g, node): the texts of ``prints`` (node, comp, n, a to d, least) with a candidate of another class in tile g."""
    names = ["g", "node", "comp", "n", "a", "b", "c", "d"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = np.stack([c.to_numpy() for c in part.columns[:7]])
                low = part.column(7).flatten().to_numpy().reshape(-1, PARTS).view(U)
                g = np.sort(group_keys(np.ascontiguousarray(rows[3:].T).view(U), low).reshape(rows.shape[1], -1), axis=1)
                i, at_key = np.nonzero(np.append(np.ones((len(g), 1), bool), g[:, 1:] != g[:, :-1], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(g[i, at_key]), *map(pa.array, rows[:, i])], names)

    def solve(rows: np.ndarray, _: None) -> np.ndarray:
        pairs = tile_pairs(rows, similarity)
        found = rows[2, np.unique(np.concatenate([pairs >> 32, pairs & 0xFFFFFFFF]))]
        return np.stack([np.full(len(found), rows[0, 0]), found])

    keyed = prints.select(*names[1:], "least").mapInArrow(spread, "g long, node long, comp long, n long, a long, b long, c long, d long")
    return tiled(keyed).mapInArrow(lambda batches: each_tile(batches, solve, ["g", "node"]), "g long, node long").distinct()


def own_pairs(pairs: np.ndarray, tile: int, keys: np.ndarray) -> np.ndarray:
    """Those of a tile's candidates that meet in no group (``keys`` as of ``group_keys``) of an earlier segment nor, in a tile that is a whole group, in a lower one of its own segment. Candidates are so wherever they meet, hence each is left to one tile, or to a few of one segment."""
    part, kept = tile & 15, [np.zeros(0, np.int64)]
    whole = len(keys) > 0 and bool((keys[0, part] == tile).any())
    for at in range(0, len(pairs), 1 << 16):
        left = pairs[at : at + (1 << 16)]
        for q in range(part + whole):
            x, y = keys[left >> 32, q], keys[left & 0xFFFFFFFF, q]
            meet = x[:, :, None] == y[:, None, :]
            if q == part:
                meet &= (x < tile)[:, :, None]
            left = left[~meet.any((1, 2))]
        kept.append(left)
    return np.concatenate(kept)


def own_members(members: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """(g, node): those of ``members`` with a candidate that is the tile's own, so that whole sets are not sent to every tile where a pair meets."""

    def solve(rows: np.ndarray, lists: pa.Array) -> np.ndarray:
        keys = group_keys(np.ascontiguousarray(rows[5:].T).view(U), lists.flatten().to_numpy().reshape(-1, PARTS).view(U))
        pairs = own_pairs(tile_pairs(rows, similarity), int(rows[0, 0]), keys)
        found = rows[2, np.unique(np.concatenate([pairs >> 32, pairs & 0xFFFFFFFF]))]
        return np.stack([np.full(len(found), rows[0, 0]), found])

    known = members.join(prints, "node").select("g", "node", "comp", "n", "a", "b", "c", "d", "least")
    return tiled(known).mapInArrow(lambda batches: each_tile(batches, solve, ["g", "node"]), "g long, node long").distinct()


def candidate_links(prints: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """(a, b): links whose classes, with those of ``comp``, are the classes of all candidates of ``prints`` as similar by their whole shingle sets.

    The sets go to the tiles where a text has a candidate of the tile's own and are compared there, so there is no row for a pair:
    a tile gives fewer links than it has texts, however many of its pairs are candidates or similar.
    """
    members = cut_lineage(own_members(cut_lineage(candidate_members(prints, similarity)), prints, similarity))
    sets = shingle_sets(members.select("node").distinct(), texts, words)

    def solve(rows: np.ndarray, lists: pa.Array) -> np.ndarray:
        found = np.array(ties(tile_pairs(rows, similarity), rows[3], lists, similarity), np.int64).reshape(-1, 2)
        return np.stack([rows[2, found.min(1)], rows[2, found.max(1)]])

    known = members.join(prints.select("node", "comp", "n", "a", "b", "c", "d"), "node").select("g", "node", "comp", "n", "a", "b", "c", "d").join(sets, "node")
    return tiled(known, F.col("n")).mapInArrow(lambda batches: each_tile(batches, solve, ["a", "b"]), "a long, b long").distinct()


def shingle_sets(met: DataFrame, texts: DataFrame, words: int = LIKE_WORDS) -> DataFrame:
    """(node, hashes) for the texts of ``met`` (node).

    Only texts that may be in it are cut into shingles: a table of ``SLOTS`` bits goes to the tasks, whose size
    is bounded however many there are; what it passes in vain the join drops.
    """
    met = cut_lineage(met)
    slot = F.pmod("node", F.lit(SLOTS))
    bits = met.select((slot / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    table = np.zeros(SLOTS // 64, U)
    for r in bits.collect():  # SLOTS / 64 rows at most
        table[r["w"]] = np.int64(r["v"]).view(U)
    sent = met.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() % SLOTS
            some = batch.take(pa.array(np.flatnonzero(sent.value[at >> 6] >> (at & 63).astype(U) & U(1))))
            for k in range(0, some.num_rows, 500):
                part = some.slice(k, 500)
                sets = [shingles(t.as_py() or "", words) for t in part.column(1)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "hashes"])

    return cut_lineage(texts.select("node", "text").mapInArrow(run, "node long, hashes array<long>").join(met, "node", "left_semi").dropDuplicates(["node"]))


def similar_pairs(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, words: int = LIKE_WORDS) -> DataFrame:
    """Those of ``pairs`` whose whole shingle sets are as similar."""
    whole = shingle_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), texts, words)
    side = lambda c, name: whole.select(F.col("node").alias(c), F.col("hashes").alias(name))
    sets = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return sets.filter(common >= (F.size("x") + F.size("y") - common) * similarity - 1e-9).select("a", "b")


def similar_classes(docs: DataFrame, node: str, text_col: str = "text", similarity: float = SIMILARITY, words: int = LIKE_WORDS) -> DataFrame:
    """(node, root) for every node with a link; ``node`` names a column that is a hash of the text."""
    texts = docs.select(F.col(node).alias("node"), F.col(text_col).alias("text"))
    every = long_fingerprints(texts, words)
    prints = cut_lineage(every.groupBy("node").agg(*[F.max(c).alias(c) for c in every.columns[1:]]))
    led = cut_lineage(similar_pairs(cut_lineage(leader_pairs(prints, similarity)), texts, similarity, words))
    classed = prints.join(components(led), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    more = candidate_links(cut_lineage(classed), texts, similarity, words)
    return components(led.unionByName(more))
