"""Periodic runs, packing and conversation repair against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import packing, periods, queries, turns

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# Periodic runs.


def brute_runs(words, least, times):
    """Every maximal stretch of every period, the smallest period of equal stretches."""
    found = {}
    for q in range(1, len(words)):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize(("least", "times"), [(2, 2), (6, 2), (6, 3), (24, 3), (10, 5)])
def test_runs_against_brute_force(least, times):
    rnd = random.Random(least * 10 + times)
    for _ in range(250):
        words = [rnd.choice("ab") * rnd.choice((1, 1, 2)) for _ in range(rnd.randrange(90))]
        for _ in range(rnd.randrange(4)):
            unit = [rnd.choice("abcd") for _ in range(rnd.randrange(1, 12))]
            at = rnd.randrange(len(words) + 1)
            words[at:at] = (unit * rnd.randrange(2, 9))[: rnd.randrange(1, 80)]
        assert periods.find_runs(words, least, times) == brute_runs(words, least, times)


def test_z_values():
    rnd = random.Random(1)
    for _ in range(200):
        s = [rnd.randrange(2) for _ in range(rnd.randrange(30))]
        assert periods.z_values(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_long_repetitive_texts():
    assert periods.find_runs(["a"] * 50_000) == [(0, 50_000, 1)]
    unit = [f"w{i}" for i in range(997)]
    assert periods.find_runs(["x", *unit * 30, "y"]) == [(1, 997 * 30, 997)]


def digest_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words, 24, 3)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_run_rows(spark):
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a\x0bb\x0c" * 20, " a " * 30, "ab ba " * 400]
    for _ in range(60):
        words = [rnd.choice("abcdef") for _ in range(rnd.randrange(200))]
        texts.append("  ".join(words[: rnd.randrange(200)] + ["x", "y", "z", "y"] * rnd.randrange(12)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "x y " * 40), (3, "x y " * 40), (None, "p q r " * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "n_words", "start", "top")}).repartition(4)
    got = periods.run_digests(periods.periodic_runs(docs, prepare=queries.repeated_tail))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(digest_row(*r) for r in rows)
    assert periods.run_digests(periods.periodic_runs(docs.limit(0))).count() == 0


# Packing.


def histogram(lengths, capacity):
    return np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)


def check_plan(lengths, capacity):
    counts = histogram(lengths, capacity)
    configs = packing.configurations(counts, capacity)
    held = np.zeros(capacity + 1, np.int64)
    for content, n in configs:
        assert sum(s * k for s, k in content) <= capacity
        for s, k in content:
            held[s] += k * n
    assert (held == counts).all()
    return sum(n for _, n in configs)


def test_plans_hold_every_piece_and_are_tight():
    rnd = random.Random(5)
    for capacity, many, longest in ((20, 300, 20), (100, 2_000, 60), (4096, 3_000, 4096), (4096, 50_000, 900), (7, 3, 7)):
        lengths = [rnd.randrange(1, longest + 1) for _ in range(many)]
        least = -(-sum(lengths) // capacity)
        assert check_plan(lengths, capacity) <= max(least * 1.003 + 1, 2 * sum(x > capacity // 2 for x in lengths) if longest > capacity * 0.9 else 0)
    assert check_plan([], 10) == 0
    assert check_plan([10] * 5 + [1], 10) == 6
    assert check_plan([6, 4] * 1000, 10) == 1000


def test_fractional_bound_is_valid():
    counts = histogram([6] * 50 + [5] * 31 + [3] * 20, 10)
    copies, bound = packing.fractional(counts, 10)
    least = 50 + 16  # a six shares its sequence with a three at most, two fives fill one
    assert bound <= least
    for content in copies:
        assert sum(s * k for s, k in content) <= 10


def test_equal_lengths_are_grouped():
    plan = packing.configurations(histogram([4096] * 10_000 + [1] * 1_000_000, 4096), 4096)
    assert len(plan) < 10 and sum(n for _, n in plan) == 10_000 + -(-1_000_000 // 4096)


def test_word_ids_equal_the_library():
    coder, rnd = packing.WordIds(VOCABULARY), random.Random(2)
    letters = ["a", "B", "é", "é", "ß", "İ", "Σ", "ς", "'s", "'", " ", " ", "\x1c", "\x85", " ", "\n", "\t", "\x0b", "7", "٣", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", ",", "-", "|>", "I", "\u0307", "K", "\x00", "日本", "ñandú", "straße", "привет", "\U0001d51e", "😀", ".", "́", "‍"]
    texts = ["", " ", *("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 60))) for _ in range(600)), "x" * 5000]
    expected = [c.ids for c in coder.lib.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    for keep in (500_000, 20):
        packing.KEEP_WORDS, old = keep, packing.KEEP_WORDS
        try:
            other = packing.WordIds(VOCABULARY)
            got = [b for i in range(0, len(raw), 50) for b in other.ids(raw[i : i + 50])]
        finally:
            packing.KEEP_WORDS = old
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == expected


@pytest.mark.parametrize("capacity", [4096, 16])
def test_packed_rows(spark, capacity):
    rnd = random.Random(7)
    texts = [None, "", " ", "word " * 5000, "same text"] + ["hello there"] * 60 + [" ".join(rnd.choice(("some", "words", "2024", "x")) for _ in range(rnd.randrange(60))) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "hello there"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("length", "part", "number", "start", "slot", "before", "n")}).repartition(7)
    got = packing.pack(docs, VOCABULARY, capacity).collect()
    lib = packing.word_ids(VOCABULARY).lib
    expected = Counter()
    for doc_id, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            cut = ids[start : start + capacity]
            expected[doc_id, piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in got) // capacity)
    assert len(sequences) <= least * 1.1 + 1
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0
    held = packing.pack(docs, VOCABULARY, capacity, with_ids=True).select("ids_crc32", "ids").collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in held)


# Conversations.


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Cheapest (cost, audit, turns) of all edit strings with up to one insertion before each row and two at the end."""
    wrong, best = faults(rows), None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = []
    for (role, text), w in zip(rows, wrong, strict=True):
        more = w == "truncated"
        own = [("D", 3, [])]
        if w not in ("blank", "duplicate"):
            own += [("K", more, [(role, text)]), ("R", 2 + more, [("user", text)]), ("R", 2 + more, [("assistant", text)])]
        choices.append([(f"{'I' * len(i)}{e}", 2 * len(i) + c, [(r, "") for r in i] + out) for i in inserts for e, c, out in own])
    choices.append([("I" * len(i), 2 * len(i), [(r, "") for r in i]) for i in inserts])
    for picked in product(*choices):
        out = [t for p in picked for t in p[2]]
        initials = "".join(r[:1] for r, _ in out)
        body = initials[1:] if initials[:1] == "s" else initials
        if initials and (len(body) < 2 or len(body) % 2 or body != "ua" * (len(body) // 2)) or any(len(r) == 0 for r, _ in out):
            continue
        key = (sum(p[1] for p in picked), "".join(p[0] for p in picked))
        if best is None or key < best[0]:
            best = (key, out)
    return (*best[0], best[1])


ROLES, TEXTS = ("user", "assistant", "system", "tool", " "), ("Hi.", "cut", "", " \t", "Go?", "ok. ", "x ")


def test_walk_against_all_edit_strings():
    rnd = random.Random(11)
    for _ in range(150):
        rows = [(rnd.choice(ROLES), rnd.choice(TEXTS)) for _ in range(rnd.randrange(5))]
        full = [(r, t, f) for (r, t), f in zip(rows, faults(rows), strict=True)]
        costs = turns.costs_to_go(full, turns.END)
        audit, out, _ = turns.walk(full, costs, 0, True)
        cost, expected, same = brute_repair(rows)
        assert (costs[0][0], audit, out) == (cost, expected, same)
        assert turns.cost_of(audit, full) == cost


def conversation_row(conv_id, rows):
    """Brute force of a result row from a conversation's rows (turn, role, text) before damage."""
    left = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        left += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    said = [(r, t) for _, r, t in left]
    wrong = faults(said)
    full = [(r, t, f) for (r, t), f in zip(said, wrong, strict=True)]
    audit, out, _ = turns.walk(full, turns.costs_to_go(full, turns.END), 0, True)
    numbers = [t for t, _, _ in left if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:], strict=False)]
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return {
        "conv_id": conv_id, "gaps": gaps, "blank": wrong.count("blank"), "duplicate": wrong.count("duplicate"), "truncated": wrong.count("truncated"),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": turns.cost_of(audit, full), "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


@pytest.mark.parametrize("parts", [1, 8])
def test_repaired_rows(spark, parts):
    rnd = random.Random(13)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rnd.randrange(1, 9)):
            rows.append((conv, rnd.choice((None, *range(9))), rnd.choice((*ROLES, None)), rnd.choice((*TEXTS, None))))
    rows += [(7, 100 + i // 2, rnd.choice(ROLES), rnd.choice(TEXTS) + str(i % 50)) for i in range(3000)]  # spans parts
    rows += [(8, 5, "user", "Same.")] * 1500
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("part", "pos", "seen", "cost", "kind", "copy", "tie")}).repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = turns.repair_digests(turns.repaired(turns.damaged(given))).collect()
        assert turns.repaired(turns.damaged(given.limit(0))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    by = defaultdict(list)
    for conv, *rest in rows:
        by[conv].append(rest)
    expected = {conv: conversation_row(conv, rest) for conv, rest in by.items()}
    assert len(got) == len(expected)
    for r in got:
        assert r.asDict() == expected[r.conv_id]


def test_conversations_of_the_tables(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    by = defaultdict(list)
    for r in table.collect():
        by[r.conv_id].append((r.turn, r.role, r.text))
    got = {r.conv_id: r.asDict() for r in queries.op13_turns(spark, sf).collect()}
    assert got == {conv: conversation_row(conv, rest) for conv, rest in by.items()}
