"""Sharding and decontamination against brute force, with the edge cases that their docstrings define."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from basaltql.llm.common import positions
from basaltql.llm.decontaminate import build_index, contamination, drop_contaminated, item_terms, proximity_matches
from basaltql.llm.sharding import jump_shard, shard_documents

DOCS = "doc_id long, text string, doc long, row string, item int, shard string"


def docs_of(spark, rows, schema=DOCS):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 17, 100])
def test_jump_shard_is_the_published_function(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345, *range(50)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_shard(F.col("k"), n)).collect()
    assert all(s == jump(k, n) for k, s in got)


def test_sharding_edges(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (None, "é"), (3, ""), *[(i, "same") for i in range(10, 60)]]
    got = shard_documents(docs_of(spark, rows), 4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 4) and r["grown_shard"] in (r["shard"], 4) and r["law"] == "key"
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    odd = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}
    assert odd[2] == (1, 0) and odd[3] == (1, 0) and odd[None] == (3, zlib.crc32("é".encode()))
    assert shard_documents(docs_of(spark, []), 4).count() == 0


def test_positions_are_gapless_with_one_hot_group(spark):
    df = spark.range(500).select((F.col("id") % 50 == 0).cast("int").alias("g"), F.col("id"))
    got = positions(df, ["g"], ["id"], "n").collect()
    for g in (0, 1):
        mine = sorted((r["id"], r["n"]) for r in got if r["g"] == g)
        assert [n for _, n in mine] == list(range(len(mine)))


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), []
        for item_id, body in items:
            v = words(body)
            n = min(window, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            at = [p for p in range(len(w) - n + 1) if n and tuple(w[p : p + n]) in grams]
            if at:
                found.append(str(item_id))
                hit |= {p + i for p in at for i in range(n)}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def test_contamination_against_brute_force(spark):
    import random

    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice("a b c d e Été x9 ß".split()) for _ in range(n))
    items = [(1, draw(14)), (2, draw(12)), (3, "c"), (4, "b, d."), (5, None), (6, "!!"), (7, "a a a a a a a a a a a a"), (8, "q r")]
    docs = [(i, draw(rng.randint(0, 40))) for i in range(25)]
    docs += [(100, f"{draw(3)} {items[0][1].upper()} tail"), (101, items[1][1][:20] + " ... " + items[1][1]), (102, "a " * 40), (103, None), (104, "")]
    docs += [(100, f"{draw(3)} {items[0][1].upper()} tail"), (None, items[0][1])]
    frame = docs_of(spark, docs)
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    for window in (10, 4):
        got = sorted((tuple(r) for r in contamination(frame, bench, window).collect()), key=str)
        assert got == brute(docs, items, window)


def test_contamination_of_empty_tables(spark):
    none, item = docs_of(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination(none, item).count() == 0
    got = contamination(docs_of(spark, [(1, "a b c")]), item.limit(0)).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(3, 0, False)]


def test_drop_contaminated_keeps_columns_and_judges_null_keys(spark):
    item = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    frame = docs_of(spark, [(1, "x one two three"), (2, "clean"), (None, "one two three"), (3, None)])
    got = drop_contaminated(frame, item)
    assert got.columns == frame.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 3]


def test_index_and_proximity(spark):
    item = spark.createDataFrame([(1, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10")], "item_id long, text string")
    frame = docs_of(spark, [(1, "z k1 k2 k3 new k4 k5 k6 k7 k8 k9 k10"), (2, "k1 k5 k9 other words here"), (3, "k10 k9 k8 k7 k6 k5 k4 k3 k2 k1")])
    assert [(r["doc_id"], r["item_id"], r["n_matched"]) for r in proximity_matches(frame, item).collect()] == [(1, 1, 10)]
    vocabulary = item_terms(item).select(F.col("offset").cast("long").alias("term_id"), "word")
    index = build_index(frame, vocabulary)
    assert index.where("term_id = -1").count() == 3 and index.where("term_id = 0").count() == 3


def slow_proximity(docs, items, window, least, slack):
    out = {}
    for d, text in docs:
        doc = (text or "").split()
        for i, body in items:
            words = (body or "").split()
            width = min(window, len(words))
            best = 0
            for k in range(len(words) - width + 1 if words else 0):
                for low in range(-len(words) - slack, len(doc)):
                    hit = sum(any(0 <= low + s + o < len(doc) and doc[low + s + o] == words[o] for s in range(slack + 1)) for o in range(k, k + width))
                    best = max(best, hit)
            if words and best >= min(least, len(words)):
                out[d, i] = best
    return out


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_proximity_against_brute_force(spark, monkeypatch, broadcast):
    from basaltql.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rng = random.Random(8)
    word = lambda n: "v" + str(rng.randint(0, n))
    items = [(i, " ".join(word(30) for _ in range(n))) for i, n in enumerate([12, 11, 9, 5, 1, 6])] + [(90, None), (91, "")]
    docs = [(100, "p0 p1 p2"), (101, None), (102, "")]
    # one whose matches lie on four diagonals, within the slack
    items.append((80, "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9"))
    docs.append((103, "x a0 a1 y a2 a3 y a4 a5 y a6 a7"))
    for d in range(14):
        words = [word(30) for _ in range(12)]
        for w in items[d % 6][1].split():
            if rng.random() < 0.85:
                words.append(w)
            if rng.random() < 0.2:
                words.append(word(30))
        docs.append((d, " ".join(words + [word(30) for _ in range(5)])))
    for window, least, slack in ((10, 8, 3), (6, 5, 0), (4, 1, 1)) if broadcast else ((10, 8, 3),):
        found = proximity_matches(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window, least, slack)
        assert {(r["doc_id"], r["item_id"]): r["n_matched"] for r in found.collect()} == slow_proximity(docs, items, window, least, slack)
