"""Page text, SimHash, language, quality, WARC, attribution, packing and toxicity on small fixtures."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from basaltql.llm import html_extract, langid, packing, quality, simhash, toxicity
from basaltql.llm.attribution import attribute_tokens
from basaltql.llm.components import components
from basaltql.llm.tokens import ByteBpe, default_path
from basaltql.llm.warc import coalesced, read_records, write_archives

CLASH = "doc_id long, text string, fp string, root string, length string, grade string, label string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], CLASH)


# op1


def test_lcs_against_dynamic_programming(monkeypatch):
    rng = random.Random(1)

    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for limit in (1 << 28, 16):
        monkeypatch.setattr(html_extract, "_ALIGN_BITS", limit)
        for _ in range(400):
            a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
            kept = [x for x, hit in zip(a, html_extract.lcs_marks(a, b), strict=True) if hit]
            rest = iter(b)
            assert all(x in rest for x in kept) and len(kept) == longest(a, b)


def test_blocks_of_awkward_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>
    <!-- c --><div class="ad">Buy</div><article><header><h1>Ti&amp;tle</h1></header><p><b>One  &lt;b&gt;<br><p>Two&nbsp;x</p><form><p>Sign</p></form><div class="comments"><p>Nice!</p></div>
    <p>Three</article><aside>Side</aside><footer>&copy; me</footer><p cut="""
    assert [b.text for b in html_extract.blocks(page) if b.main] == ["Ti&tle", "One <b>", "Two x", "Three"]


# op2


def slow_fingerprint(text, shingle):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(120):
        w = base[i % 12].split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 5))
        rows.append((100 + i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "Two WORDS"), (903, "two words"), (904, "É é"), (0, base[0])]
    got = simhash.near_duplicates(docs_of(spark, rows), 4, 4).collect()
    assert len(got) == len(rows)
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    assert all(fps[i] == slow_fingerprint(t, 4) for i, t in rows)
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert all(r["component_id"] == find(r["doc_id"]) for r in got)
    assert simhash.near_duplicates(docs_of(spark, []), 4, 4).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(1, 41)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and got[1] != got[100]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# op5


def test_languages_held_out(spark):
    rng = random.Random(2)
    syllables = {"xx": ["lor", "em", "ip", "sum"], "yy": ["ñu", "caz", "ó"], "zz": ["中文", "字", "語"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[n]) for _ in range(3)) for _ in range(30)), n) for i, n in enumerate(["xx", "yy", "zz"] * 60)]
    rows += [(900, None, "xx"), (901, "123 !?", "yy"), (902, "", None), (None, "lorem ipsum lorem", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict_languages(df, langid.fit_languages(df)).collect()}
    for i, _, name in rows[:180]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["lang_pred"] == name and 0 <= got[i]["score"] <= 1
    assert [got[i]["lang_pred"] for i in (900, 901, 902, None)] == ["und", "und", "und", "xx"]
    empty = df.where("false")
    assert langid.predict_languages(df.limit(2), langid.fit_languages(empty)).count() == 2


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)
    members = np.arange(5000) % 70
    names, slots = [f"l{i:02d}" for i in range(70)], langid.slots_for(5000 // 70 + 1)
    parts = [langid.set_bits(hashes[i : i + 999], members[i : i + 999], slots) for i in range(0, 5000, 999)]
    parts.append(langid.set_bits(hashes[:7], np.full(7, 69), slots))  # n-grams of two languages
    model = langid.build_filter(names, slots, *map(np.concatenate, zip(*parts, strict=True)), 0)
    counts = model.counts(hashes[::70])  # all of language 0
    assert counts[0] == len(hashes[::70]) and counts[1:69].max() <= 3
    assert model.counts(hashes[:7])[69] == 7 and all(model.counts(hashes[i : i + 1])[i] == 1 for i in range(70))


@pytest.mark.parametrize("piece", [langid._PIECE, 5, 64])
def test_grams_of_pieces_are_those_of_the_whole_text(monkeypatch, piece):
    monkeypatch.setattr(langid, "_PIECE", piece)
    letters, rng = langid._Letters(), random.Random(piece)
    for _ in range(60):
        text = "".join(rng.choice("abÄ ß 12,.\n中𝒳") for _ in range(rng.randint(0, 90)))
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        line = f" {' '.join(words)} "
        want = sorted(line[i : i + n] for n in langid.GRAMS for i in range(len(line) - n + 1)) if words else []
        got = [h for part in langid.gram_hashes(text, letters) for h in part.tolist()]
        known = {}
        for gram in set(want):  # the hash of an n-gram by itself, by the same rule
            h = len(gram)
            for c in gram:
                h = (h ^ (0 if c == " " else ord(c))) * int(langid._BASE) % (1 << 64)
                h ^= h >> 29
            known[gram] = h
        assert sorted(got) == sorted(known[g] for g in want)


def test_popcounts_against_sets(spark):
    """The filter holds, for every language, just the n-grams that stand often enough in its training rows."""
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(12)), f"l{i % 4}") for i in range(200)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    letters, total = langid._Letters(), [{} for _ in range(4)]
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for part in langid.gram_hashes(text, letters):
                for h in part.tolist():
                    total[int(lang[1])][h] = total[int(lang[1])].get(h, 0) + 1
    grams = np.array(sorted({h for t in total for h in t}), dtype=np.uint64)
    masks = model.masks(grams)[0]
    several = 0
    for h, mask in zip(grams.tolist(), masks.tolist(), strict=True):
        want = sum(1 << k for k in range(4) if total[k].get(h, 0) >= max(langid.MIN_COUNT, langid.MIN_RATE * sum(total[k].values())))
        assert mask & want == want
        several += want.bit_count() == 4
    exact = sum(max(langid.MIN_COUNT, langid.MIN_RATE * sum(t.values())) <= n for t in total for n in t.values())
    assert several > 100 and sum(m.bit_count() for m in masks.tolist()) <= exact + 0.02 * 4 * len(grams)
    again = spark.createDataFrame(rows[:3] * 2 + [(7, "abcd " * 200_000, "l0")], "doc_id long, text string, lang string")
    again = again.selectExpr("*", "lang AS score", "text AS lang_pred")
    got = langid.predict_languages(again, model).collect()
    assert len(got) == 7 and len({(r["doc_id"], r["lang_pred"], r["score"]) for r in got}) == 4


# op6


def test_quality_measures_against_brute_force():
    import zstandard

    compressor = zstandard.ZstdCompressor(level=3)
    text = "a b c d\na b c x\n\n \na b c d\r\na b c d\n# $|é\x1cq"
    _, n, chars, symbols, lines, repeated, size, _, top, _ = quality.measure(1, text, compressor)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    assert (n, chars, symbols, lines, repeated, size) == (len(words), sum(map(len, words)), 3, 1, len(covered), len(text.encode())) and top is None
    assert quality.measure(1, None, compressor)[:6] == (1, 0, 0, 0, 0, 0)


def test_quality_verdicts(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("etaoin shrdlu".replace(" ", "")) for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 900))) for i in range(150)]
    noise = base64.b64encode(bytes(rng.randrange(256) for _ in range(3000))).decode()
    rows += [(900, " ".join(f"w{i}" for i in range(60)) * 60), (901, "short text"), (902, None), (903, ""), (904, " ".join(noise[i : i + 7] for i in range(0, len(noise), 7)))]
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(None, 1), (904, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs_of(spark, rows), labels).collect()}
    assert sum(got[i]["kept"] for i in range(150)) >= 149
    assert not any(got[i]["kept"] for i in (900, 901, 902, 903, 904)) and got[902]["base_failed"] and not got[904]["base_failed"]
    kept = quality.drop_low_quality(docs_of(spark, rows), labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.quality_verdicts(docs_of(spark, []), labels.limit(0)).count() == 0


# op7


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same é"), (5, "http://a/5", "same é"), (9, None, "same é"), (2, "http://a/2\n", "x" * 70000), (3, "u", None), (4, "u", ""), (None, "n", "lonely"), (7, "t", "t"), (7, "t", "t")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, offset string")
    index = write_archives(pages, f"file://{tmp_path}/w", file_bytes=1000)
    assert index.count() == len(rows)
    got = read_records(index, keep_payload=True).collect()
    want = sorted((p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for p, _, h in rows if p)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got if r["page_id"]) == want
    refers = {r["page_id"]: r["refers_to"] for r in got}
    assert refers == {1: 9, 5: 9, 9: None, 2: None, 3: 4, 4: None, None: None, 7: None}
    assert [bytes(r["payload"]).decode() for r in got if r["page_id"] == 9] == ["same é"]
    some = read_records(index.where("page_id = 2")).collect()
    assert len(some) == 1 and some[0]["payload"] is None
    big = read_records(write_archives(pages.where("page_id IN (1, 5)"), f"file://{tmp_path}/v", min_revisit_bytes=100)).collect()
    assert {r["record_type"] for r in big} == {"response"}
    assert read_records(write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_ranges_coalesce():
    assert coalesced([(0, 10), (10, 5), (30, 5), (500, 5)], gap=20, most=100) == [(0, 3, 0, 35), (3, 4, 500, 5)]
    assert coalesced([(0, 60), (60, 60)], gap=0, most=100) == [(0, 1, 0, 60), (1, 2, 60, 60)]


# op8, op9


TEXTS = ["one two\nthree", "é中😀\n\nx", "", "no newline " * 30, "a\n", "<|endoftext|>\nx", "tab\t \n  end"]


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_attribution_against_the_tokenizer(spark, rule):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (0, TEXTS[0])]
    got = attribute_tokens(docs_of(spark, rows), ("text",), rule).collect()
    exact = ByteBpe(default_path()).exact
    for i, text in enumerate(TEXTS):
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["section"])[:: 2 if i == 0 else 1]
        starts = [r["char_start"] for r in mine]
        want = [0] * len(starts)
        for a, b in exact.encode(text, add_special_tokens=False).offsets:
            parts = [(max(0, min(b, e) - max(a, s)), -k) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True))]
            inside = [-k for n, k in parts if n]
            want[{"first": inside[0], "last": inside[-1], "most": -max(parts)[1]}[rule]] += 1
        assert [r["n_tokens"] for r in mine] == want, text
        assert "".join(text[r["char_start"] : r["char_end"]] for r in mine) == text
    assert [(r["field"], r["n_tokens"]) for r in got if r["doc_id"] == 99] == [(None, 0)]


def test_attribution_of_fields(spark):
    df = spark.createDataFrame([(1, "head", "body one\nbody two"), (2, None, "x"), (3, None, None)], "doc_id long, title string, text string")
    got = attribute_tokens(df, ("title", "text")).collect()
    assert [(r["doc_id"], r["field"], r["section"]) for r in got] == [(1, "title", 0), (1, "text", 0), (1, "text", 1), (2, "text", 0), (3, None, 0)]
    assert all(sum(r["n_tokens"] for r in got if r["doc_id"] == d) == next(r["doc_tokens"] for r in got if r["doc_id"] == d) for d in (1, 2, 3))


def test_packing_round_trip(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "b", "c9"]) for _ in range(rng.randint(0, 400)))) for i in range(120)]
    rows += [(500 + i, "same text " * 17) for i in range(60)] + [(900, None), (901, ""), (None, "null key"), (0, rows[0][1])]
    got = packing.pack(docs_of(spark, rows), window=256).collect()
    bpe, by_sequence, by_doc = ByteBpe(default_path()), {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 256
    for doc_id, text in rows[1:120] + rows[180:182]:
        ids = np.append(bpe.ids(text or ""), 0).astype("<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    used = sum(r["length"] for r in got)
    assert used == sum(len(bpe.ids(t or "")) + 1 for _, t in rows) and len(by_sequence) <= 1.05 * used / 256 + 2
    assert packing.pack(docs_of(spark, []), window=256).count() == 0


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    for _ in range(20):
        h = {rng.randint(1, 64): rng.randint(1, 300) for _ in range(rng.randint(1, 40))}
        report = {}
        planned = packing.plan(h, 64, report)
        assert report["solved"] + report["greedy"] == report["pieces"] == sum(h.values())
        used: dict[int, int] = {}
        for lengths, n in planned:
            assert n > 0 and sum(lengths) <= 64
            for v in lengths:
                used[v] = used.get(v, 0) + n
        assert used == h
        taken = sorted((v, first, n) for v, first, n, *_ in packing.slots(planned))
        for (v, first, n), after in zip(taken, taken[1:], strict=False):
            assert after[0] != v or after[1] == first + n


def test_ids_equal_the_tokenizer():
    bpe, rng = ByteBpe(default_path()), random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice("ab 1_'\n\té²中😀.!s\xa0\x85") for _ in range(rng.randint(0, 30)))
        ids = bpe.ids(text)
        assert ids.tolist() == bpe.exact.encode(text, add_special_tokens=False).ids and bpe.n_bytes[ids].sum() == len(text.encode())


# op10


def test_severity(spark):
    rng = random.Random(9)
    clean = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.choice("qrst")) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = " ".join(rng.choice(["grobian", "schuftig", "schufte"]) for _ in range(1 + i % 5)) if i % 8 == 0 else ""
        rows.append((i, f"{clean(40)} {bad} {clean(10)}"))
        labels.append((i, int(i % 8 == 0)))
    labels += [(None, 1), (5, None), (0, 1)]
    unseen = [(900, clean(50)), (901, clean(20) + " Grobian! schuftlein schufterei"), (902, None), (903, "")]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_severity(docs_of(spark, rows), marks)
    assert len(model.thresholds) == 1  # binary labels: two grades
    got = {r["doc_id"]: r for r in toxicity.score_severity(docs_of(spark, rows + unseen), model).collect()}
    assert np.mean([got[i]["toxic"] == (i % 8 == 0) for i in range(400)]) > 0.98
    assert [got[i]["toxic"] for i in (900, 901, 902, 903)] == [False, True, False, False]
    assert all(abs(r["expected_severity"] - r["p_toxic"]) < 1e-12 and 0 <= r["p_toxic"] <= 1 for r in got.values())
    kept = toxicity.drop_toxic(docs_of(spark, rows + unseen), model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["toxic"]}
    nothing = toxicity.fit_severity(docs_of(spark, []), marks)
    assert not any(r["toxic"] for r in toxicity.score_severity(docs_of(spark, unseen), nothing).collect())


def test_severity_of_graded_labels(spark):
    """Grades 0 to 3, by how strong a word is said: expected severity rises with the grade, on rows not learned from as well."""
    rng = random.Random(11)
    strong = [[], ["grumpily", "sulkish"], ["nastier", "spiteful"], ["vilest", "hateful"]]

    def text(grade):
        said = [rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrst") for _ in range(30)]
        return " ".join(said + [rng.choice(w) for g in range(1, grade + 1) for w in [strong[g]]])

    rows = [(i, text(i % 4)) for i in range(600)]
    marks = spark.createDataFrame([(i, i % 4) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit_severity(docs_of(spark, rows), marks)
    assert len(model.thresholds) == 3 and list(model.thresholds) == sorted(model.thresholds)
    unseen = [(10_000 + i, text(i % 4)) for i in range(200)]
    twice = docs_of(spark, rows + unseen + unseen[:1]).selectExpr("*", "text AS grade")
    got = toxicity.score_severity(twice, model).collect()
    assert len(got) == 801
    mean = [np.mean([r["expected_severity"] for r in got if r["doc_id"] >= 10_000 and r["doc_id"] % 4 == g]) for g in range(4)]
    assert all(a + 0.5 < b for a, b in zip(mean, mean[1:], strict=False))
    assert np.mean([r["grade"] == r["doc_id"] % 4 for r in got]) > 0.9
    assert all(r["toxic"] == (r["p_toxic"] >= 0.5) for r in got)
    long = toxicity.score_severity(docs_of(spark, [(1, "clean " * 300_000 + "vilest")]), model).first()
    assert long["expected_severity"] > 0
    none = toxicity.fit_severity(docs_of(spark, rows), marks.limit(0))
    assert not any(r["toxic"] for r in toxicity.score_severity(docs_of(spark, unseen), none).collect())


def test_ordinal_gradient_against_differences():
    """At the fitted point, no weight or threshold can be moved to a better penalised likelihood."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (300, 4))
    grades = np.clip(x[:, 0] + x[:, 1] + (rng.random(300) < 0.2), 0, 2)
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, cols, grades, 4)

    def loss(w, theta):
        above = 1 / (1 + np.exp(-((x @ w)[:, None] - theta)))
        edges = np.hstack([np.ones((300, 1)), above, np.zeros((300, 1))])
        return -np.log(edges[np.arange(300), grades] - edges[np.arange(300), grades + 1]).mean() + 1e-4 / 2 * (w**2).sum() / 4**0.5

    best = loss(w, theta)
    for i in range(4):
        for step in (-0.05, 0.05):
            assert loss(w + step * np.eye(4)[i], theta) > best - 1e-6
    for i in range(2):
        for step in (-0.05, 0.05):
            assert loss(w, theta + step * np.eye(2)[i]) > best - 1e-6


def test_ordinal_gradient_orders_thresholds():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (600, 3))
    grades = np.clip(x[:, 0] + x[:, 1], 0, 2)
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, cols, grades, 3)
    assert w[0] > 1 and w[1] > 1 and abs(w[2]) < 0.5 and theta[0] < theta[1]
