"""Near copies: whole sets go to few tiles."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import simhash


@pytest.mark.parametrize("block", [simhash.BLOCK_ROWS, 2])
def test_candidates_are_left_to_one_tile(spark, monkeypatch, block):
    """Sets went to each tile where two texts meet (a dozen); now every candidate is in some tile, and most in one."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rnd, texts = random.Random(11), []
    for _ in range(12):
        words = [f"w{rnd.randrange(4000)}" for _ in range(200)]
        for _ in range(4):
            own = list(words)
            for _ in range(rnd.randrange(5)):
                own[rnd.randrange(200)] = f"x{rnd.randrange(4000)}"
            texts.append(" ".join(own))
    known = {i: simhash.shingles(t) for i, t in enumerate(texts)}
    prints = simhash.long_fingerprints(spark.createDataFrame(list(enumerate(texts)), "node long, text string")).withColumn("comp", F.col("node")).localCheckpoint()
    every = simhash.candidate_members(prints, 0.8).localCheckpoint()
    some = simhash.own_members(every, prints, 0.8).localCheckpoint()

    def pairs(members):
        tiles = defaultdict(set)
        for g, node in members.collect():
            tiles[g].add(node)
        return {p for nodes in tiles.values() for p in combinations(sorted(nodes), 2)}

    fp = np.stack([simhash.long_fingerprint(known[i]) for i in range(len(texts))])
    keys = simhash.group_keys(fp, np.stack([simhash.least(known[i]) for i in range(len(texts))])).reshape(len(texts), -1)
    own = simhash.part_indices(fp).reshape(len(texts), -1)
    wanted = set()
    for i, j in combinations(range(len(texts)), 2):
        met, parts = set(keys[i].tolist()) & set(keys[j].tolist()), {x >> 12 for x in set(own[i].tolist()) & set(own[j].tolist())}
        alike = min(len(known[i]), len(known[j])) >= 0.8 * max(len(known[i]), len(known[j])) and int(np.bitwise_count(fp[i] ^ fp[j]).sum()) <= simhash.FAR
        if alike and any(parts - {g & 15} for g in met):
            wanted.add((i, j))
    assert len(wanted) > 30 and wanted <= pairs(every) and wanted <= pairs(some)
    assert some.count() * (3 if block > 2 else 1) < every.count()
