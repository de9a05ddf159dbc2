"""Stages and operators against brute force, where a part of the job was left out before."""

import random

import pytest

from factloom.llm import piece_bpe, queries, simhash

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(5)


def first_of_classes(rows, least=0.8):
    """The smallest id of each class of texts linked by the similarity of all pairs."""
    ids = sorted(rows)
    sets = {i: set(simhash.shingles(rows[i] or "").tolist()) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}


def edited(rnd, text, n):
    words = text.split()
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = first_of_classes({r["doc_id"]: r["text"] for r in docs.collect()})
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == want


def test_near_copies_in_crowds(spark):
    """Crowds of near copies, some of whose pairs are just below the similarity, and many texts that share a line."""
    rnd = random.Random(5)
    words = lambda n: " ".join(f"w{rnd.randrange(9000)}" for _ in range(n))
    base, line = words(300), words(60)
    texts = [None, "", " \n", "a b", "A  b", "a b c"] + [edited(rnd, base, k % 9) for k in range(400)]
    texts += [f"{line} {words(40)}" for _ in range(150)]  # one common line, otherwise different
    texts += [edited(rnd, t, rnd.randrange(3)) for t in texts[-20:]]
    rows = dict(enumerate(texts))
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert {r["doc_id"] for r in stage(spark, frame(spark, rows.items()), "").collect()} == first_of_classes(rows)


def test_candidates_of_a_group_by_all_pairs():
    """The pairs between classes that share an index in another segment, and no others, in small and large groups and between two sides."""
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (3, 4)).astype(np.uint64)
    fp = np.repeat(base, 40, axis=0) ^ np.packbits(rng.random((120, 256)) < 0.08, axis=1, bitorder="little").view("<u8")
    comp, n, side = rng.integers(0, 5, 120), rng.integers(80, 110, 120), rng.integers(-1, 2, 120)
    own = [set(row) for row in simhash.part_indices(fp).reshape(120, -1).tolist()]
    found = 0
    for part in range(simhash.PARTS):
        want, across = set(), set()
        for i in range(120):
            for j in range(i + 1, 120):
                near = sum(int(x).bit_count() for x in fp[i] ^ fp[j]) <= simhash.FAR
                if comp[i] != comp[j] and {x >> 12 for x in own[i] & own[j]} - {part} and near and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]):
                    want.add((i, j))
                    if side[i] != side[j] or side[i] < 0:
                        across.add((i, j))
        for at_once, few in ((simhash.AT_ONCE, simhash.FEW), (50, simhash.FEW), (simhash.AT_ONCE, 1000)):
            (simhash.AT_ONCE, simhash.FEW), before = (at_once, few), (simhash.AT_ONCE, simhash.FEW)
            for sides, wanted in ((None, want), (side, across)):
                got = simhash.cross_pairs(comp, n, fp, part, 0.8, sides)
                assert {(int(x >> 32), int(x & 0xFFFFFFFF)) for x in got} == wanted
            simhash.AT_ONCE, simhash.FEW = before
        found += len(want)
    assert found


def test_tiles_over_batches():
    """A tile that runs over several batches is solved once, whole; tiles of one class are passed over."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    k = np.sort(rng.integers(0, 40, 600))
    k[200:420] = k[200]
    rows = np.zeros((9, 600), np.int64)
    rows[0], rows[2], rows[3] = k, np.arange(600), rng.integers(0, 2, 600)
    names = ["k", "side", "node", "comp", "n", "a", "b", "c", "d"]
    seen = []

    def solve(part, _):
        seen.append(part[2].tolist())
        return part[[0, 2]]

    for size in (1, 7, 64, 600):
        seen.clear()
        batches = (pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, at : at + size]], names) for at in range(0, 600, size))
        out = pa.Table.from_batches(list(simhash.each_tile(batches, solve, ["k", "node"])))
        want = [np.flatnonzero(k == v) for v in np.unique(k)]
        mixed = [g.tolist() for g in want if len(set(rows[3, g].tolist())) > 1]
        assert [g for g in seen if len(set(rows[3, g].tolist())) > 1] == mixed
        assert out.num_rows == sum(map(len, seen)) and len({x for g in seen for x in g}) == out.num_rows


def test_recall_of_long_fingerprints():
    """Texts whose shingles are 0.8 to 0.85 similar meet in a group, share an index of another segment and are near, all but a few in a thousand."""
    import numpy as np

    rng = np.random.default_rng(4)
    total = found = 0
    for _ in range(1500):
        n = int(rng.integers(20, 400))
        away = int(rng.integers(n * 15 // 185, n // 9 + 1))  # (n - away) / (n + away) from 0.85 to 0.8
        h = rng.integers(-(1 << 63), (1 << 63) - 1, n + away)
        a, b = simhash.long_fingerprint(h[:n]), simhash.long_fingerprint(h[away:])
        if not 0.8 <= (n - away) / (n + away) <= 0.85:
            continue
        x, y = (simhash.part_indices(f[None])[0] for f in (a, b))
        shared = [bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
        u, v = (simhash.group_keys(f[None], simhash.least(part)[None])[0] for f, part in ((a, h[:n]), (b, h[away:])))
        met = [bool(set(p) & set(q)) for p, q in zip(u.tolist(), v.tolist(), strict=True)]
        assert all(s for s, m in zip(shared, met, strict=True) if m)
        total += 1
        found += sum(shared) >= 2 and any(met) and int(np.bitwise_count(a ^ b).sum()) <= simhash.FAR
    assert total > 500 and found >= 0.99 * total


def test_every_batch_of_pieces_is_checked(spark, monkeypatch):
    class Wrong(piece_bpe.PieceCoder):
        def word(self, w):
            return ("5", 1, b"x")

    class Docs:
        """Stands for a table; runs the mapped function here, where the coder is replaced."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            import pyarrow as pa

            return list(run(iter([pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["a wrong coder"])], ["doc_id", "text"])])))

    monkeypatch.setattr(piece_bpe, "coder", Wrong)
    monkeypatch.setattr(queries, "read_table", lambda *_: Docs())
    for job in (lambda: queries.op10_pieces(spark, ""), lambda: dict(corpus_pipeline.STAGES)["pieces"](spark, Docs(), "")):
        with pytest.raises(ValueError, match="differs from the library"):
            job()


def test_stages_with_null_and_repeated_ids(spark, monkeypatch):
    rnd = random.Random(3)
    a, b, c, item = (" ".join(f"{x}{rnd.randrange(999)}" for _ in range(40)) for x in "abci")
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near_copies"](spark, frame(spark, [(None, a), (None, a), (None, b), (1, c), (1, "other words"), (2, c), (None, c)]), "")
    assert sorted((r["doc_id"] or -1, r["text"]) for r in near.collect()) == sorted([(-1, a), (-1, b), (1, c), (1, "other words")])
    monkeypatch.setattr(corpus_pipeline, "read_table", lambda *_: spark.createDataFrame([(1, item)], "item_id long, text string"))
    clean = stages["benchmark_passages"](spark, frame(spark, [(None, item), (None, a), (1, b), (1, f"{c} {item}"), (2, None)]), "")
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in clean.collect()) == sorted([(-1, a), (1, b), (2, "")])


def test_stages_with_empty_tables_and_clashing_columns(spark, monkeypatch):
    from pyspark.sql import functions as F

    text = "the words of a text that is kept by every stage " * 4
    odd = frame(spark, [(1, text), (1, text), (None, None), (2, "²")]).withColumns({c: F.lit("x") for c in ("lang_pred", "score", "_node", "_root", "node", "root", "rid", "th")})
    for docs, want in ((odd, [(1, 36)]), (odd.limit(0), [])):
        monkeypatch.setattr(corpus_pipeline, "read_table", lambda *_: spark.createDataFrame([(1, "not in it")], "item_id long, text string"))
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            assert name == "pieces" or docs.columns == list(corpus_pipeline.COLUMNS)
        assert [r["doc_id"] for r in docs.collect()] == [w[0] for w in want]


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a[:n]


def test_repetitive_words_and_bytes_do_not_collide(spark):
    import numpy as np

    from factloom.llm import bwt_dedup, cover_dedup, hashing

    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"c{i}" for i in range(34))
    rows = cover_dedup.cut_words(frame(spark, [(1, f"{common} {one}"), (2, f"{common} {other}")])).collect()
    assert [(r["n_words"], r["n_removed"]) for r in rows] == [(35, 0)] * 2
    rows = bwt_dedup.cut_bytes(frame(spark, [(1, one), (2, other)])).collect()
    assert [r["n_removed"] for r in rows] == [2048 if one[:200] in other else 0] * 2
    words = [f"{x}{y}" for x in ("", "a", "b" * 7, "c" * 8, "d" * 9, "e" * 127, "f" * 128, "g" * 129, "h" * 3000) for y in "xyz"]
    _, *got = hashing.word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8), hashing.SEEDS)
    assert len(set(np.concatenate(got).tolist())) == 2 * len(words)
    _, alone = hashing.word_hashes(np.frombuffer(words[-1].encode(), np.uint8))
    assert alone[0] == got[0][-1]


def test_run_hashes_are_of_the_run_alone():
    import numpy as np

    from factloom.llm import hashing

    rng = np.random.default_rng(0)
    units = rng.integers(0, 4, 3 * hashing.STEP).astype(np.uint64)
    i = np.sort(rng.integers(0, len(units) - 60, 3000))
    j = i + rng.integers(1, 56, 3000)
    got = hashing.run_hashes(units, i, j, 55)
    seen = {}
    for a, b, h in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        assert seen.setdefault(units[a:b].tobytes(), h) == h
    assert len(set(got.tolist())) == len(seen)
    assert (got == hashing.RunHash(units, 55)(i, j)).all()


def test_crowds_in_blocks(spark, monkeypatch):
    """Groups dealt into many small blocks give the same classes."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 30)
    test_near_copies_in_crowds(spark)


def test_ties_of_a_block():
    """The links that join classes give the classes of all similar pairs."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    sets = [np.unique(np.append(rng.choice(100, 60, replace=False) + 1000 * (k % 3), rng.integers(0, 9999, k % 4))) for k in range(60)]
    pairs = np.array([i << 32 | j for i in range(60) for j in range(i + 1, 60)])
    comp = np.arange(60) // 2 * 7

    def classes(links):
        label = comp.copy()
        for i, j in links:
            label[label == label[j]] = label[i]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

    alike = [(i, j) for i in range(60) for j in range(i + 1, 60) if len(c := set(sets[i]) & set(sets[j])) >= 0.45 * (len(sets[i]) + len(sets[j]) - len(c))]
    lists = pa.concat_arrays([pa.array([[1]]), pa.array([x.tolist() for x in sets])]).slice(1)  # an array that starts later
    found = simhash.ties(pairs, comp, lists, 0.45)
    assert set(found) <= set(alike) and classes(found) == classes(alike) and len(found) < 60
