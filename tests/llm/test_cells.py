"""Near-dedup of a group with pairs on either side of the limit: whole, and without its rows searched again in every family."""

import random

import numpy as np

from basaltql.llm import simhash, similar


def group(members):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(90)]
    for i in range(members):
        words = list(base)
        for at in rng.sample(range(90), i % 5):
            words[at] = word()
        yield i, " ".join(words)


def test_group_around_the_limit(spark, monkeypatch):
    rows = list(group(250))
    sets = [similar.shingle_set(t, 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * 100 >= (len(sets[i]) + len(sets[j]) - both) * 80:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    counts, write = {}, simhash.written

    def written(df, name):
        out = write(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "written", written)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in similar.one_of_similar(docs, 5, 80).collect())
    assert got == sorted({find(i) for i in range(len(rows))}) and len(got) > 20
    assert counts.get("several_rows", 0) <= 4 * len(rows)


def test_undecided_cells_go_to_their_buckets(spark, monkeypatch):
    rows = list(group(60))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(r["doc_id"] for r in similar.one_of_similar(docs, 5, 80).collect())
    monkeypatch.setattr(similar, "CELL_COST", -1)
    assert sorted(r["doc_id"] for r in similar.one_of_similar(docs, 5, 80).collect()) == want


def test_blocks_hold_every_pair(spark, monkeypatch):
    rows = list(group(60))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(r["doc_id"] for r in similar.one_of_similar(docs, 5, 80).collect())
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", 500)
    assert sorted(r["doc_id"] for r in similar.one_of_similar(docs, 5, 80).collect()) == want
