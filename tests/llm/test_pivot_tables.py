"""op2: the pivot table search against all pairs, step by step."""

import random
from itertools import combinations

import numpy as np
import pytest

from basaltql.llm import simhash, similar
from basaltql.llm.simhash import PivotTable, block_families, linked_fingerprints, near_pairs


def points(seed, clusters=20, members=8, others=300):
    """Fingerprints: clusters of near ones around a random one, chains among them, and random ones."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(others)}
    for _ in range(clusters):
        x = rng.getrandbits(64)
        for _ in range(members):
            out.add(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def roots_by_all_pairs(fps, radius):
    root = {f: f for f in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = 0
    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            n += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}, n


@pytest.mark.parametrize(("radius", "look", "slot"), [(4, 256, 4096), (6, 256, 4096), (4, 2, 3)])
def test_search_against_all_pairs(spark, monkeypatch, radius, look, slot):
    monkeypatch.setattr(simhash, "LOOK", look)
    monkeypatch.setattr(simhash, "SLOT_ROWS", slot)
    fps = points(radius + look)
    want, links = roots_by_all_pairs(fps, radius)
    report = {}
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(5)
    got = {r["fp"] % (1 << 64): r["root"] for r in linked_fingerprints(frame, radius, report).collect()}
    groups = lambda roots: sorted(sorted(f for f in roots if roots[f] == r) for r in set(roots.values()))
    assert groups(got) == groups(want) and len(set(want.values())) > 300
    # every link of the first pass is a survivor of the table, and the table discards chance candidates
    assert 0 < report["linked"] <= links
    if look > 2:
        assert report["candidates"] > report["survivors"] >= report["linked"]


def test_one_large_group_and_strangers(spark):
    rng = random.Random(9)
    x = rng.getrandbits(64)
    group = {x} | {x ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}  # 2,017 fingerprints, all within 4 bits
    fps = sorted(group | {x ^ sum(1 << b for b in rng.sample(range(64), 9)) for _ in range(200)})
    want, _ = roots_by_all_pairs(fps, 4)
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    got = {r["fp"] % (1 << 64): r["root"] for r in linked_fingerprints(frame, 4).collect()}
    assert len({got[f] for f in group}) == 1 and len(set(got.values())) == len(set(want.values()))
    assert linked_fingerprints(frame.limit(0), 4).count() == 0


@pytest.mark.parametrize("count", [10, 10**6, 10**10])
def test_families_meet_every_pair_within_the_radius(count):
    families, rng = block_families(4, count), random.Random(count)
    for _ in range(300):
        flips = set(rng.sample(range(64), 4))
        assert any(flips.isdisjoint(f) for f in families)


def test_table_against_counted_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 64, (50, 2), dtype=np.uint64)
    families = [sorted(rng.choice(128, 20, replace=False).tolist()) for _ in range(4)]
    table = PivotTable(2, families).distances(fps)
    for i, row in enumerate(fps.tolist()):
        for f, bits in enumerate(families):
            for r in range(simhash.REFERENCES):
                pivot = [simhash.reference(w * simhash.REFERENCES + r) for w in range(2)]
                assert table[i, f, r] == sum((row[b // 64] ^ pivot[b // 64]) >> b % 64 & 1 for b in bits)
    x, y = fps[:, 0], fps[:, 0] ^ np.uint64(0b1011)
    assert near_pairs(x, y, 3)[0].all() and not near_pairs(x, y, 2)[0].any()
    assert near_pairs(x, fps[:, 1], 4)[1] < 5


def test_chance_of_a_missed_pair():
    for percent, count in ((80, 100), (80, 10**9), (90, 10**6)):
        families = similar.bit_families(percent, count)
        same = 1 - similar.differing_share(percent)
        assert (1 - same ** len(families[0])) ** len(families) <= similar.MISS
