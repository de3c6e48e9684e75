"""Near-dedup of the pipeline against exact Jaccard similarity of all pairs."""

import random

import corpus_pipeline


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for base in range(40):
        words = [word() for _ in range(90)]
        for copy in range(6):
            changed = list(words)
            for _ in range(min(copy, 4)):
                changed[rng.randrange(90)] = word()
            rows.append((base * 10 + copy, " ".join(changed)))
    rows += [(None, rows[0][1]), (None, word()), (7, rows[6][1]), (7, word())]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    rank = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=rank)
                root[b] = a
    want = sorted(rows[i][1] for i in range(len(rows)) if find(i) == i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(r["text"] for r in got.collect()) == want
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
