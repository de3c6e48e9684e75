"""op1: tokenizer, and the whole query against slow reference implementations."""

import random
import time

import pytest

from basaltql.llm import html_extract
from basaltql.llm.html_extract import NEIGHBOURS, REACH, blocks, extract_main_text, tokens

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000,
        "<a '" * 250_000,
        '<a "' * 200_000 + ">",
        "<b>" * 300_000 + "</i>" * 100_000,
        "<b>" * 200_000 + "<p>" * 100_000,
        "<!--" * 250_000,
        "<div>" * 100_000 + "</div>" * 100_000,
        "<" * 500_000,
        "<script>" * 125_000,
        "<a x= " + " " * 500_000 + ">",
        "<a b=\"c='" * 100_000 + ">",
    ],
)
def test_hostile_markup_takes_linear_time(page):
    began = time.process_time()
    blocks(page)
    assert time.process_time() - began < 10


def test_tokens():
    assert list(tokens("a < b<c d='>'>e</c x>f<!-- <g> --><!doctype h>i<br/>j<k")) == [
        ("text", "", "a "),
        ("text", "", "<"),
        ("text", "", " b"),
        ("start", "c", " d='>'"),
        ("text", "", "e"),
        ("end", "c", " x"),
        ("text", "", "f"),
        ("text", "", "i"),
        ("start", "br", "/"),
        ("text", "", "j"),
    ]
    assert list(tokens("<script>if (a</b>c) {}</script >x")) == [("raw", "script", ""), ("text", "", "x")]
    assert list(tokens("<a b='c>d</a>e")) == [("start", "a", " b='c"), ("text", "", "d"), ("end", "a", ""), ("text", "", "e")]


def test_inline_parts_declared_to_be_no_text_do_not_split_a_line():
    assert [b.text for b in blocks("<p>One <span hidden>no</span>two <span class='ad'>no</span>three</p>")] == ["One two three"]


def longest_marks(a, b):
    """Marks of a longest common subsequence by the textbook table; where several exist, any."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    marks, i, j = [False] * len(a), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            marks[i] = True
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return marks


def slow_texts(rows):
    """{page_id: text} of pages whose markup declares nothing, by pairing every page with its neighbours anew."""
    pages = {r[0]: (r[1].split("/")[2], r[1].split("?")[0], [b.text for b in blocks(r[2])]) for r in rows}
    out = {}
    for page_id, (host, _, lines) in pages.items():
        places = {}
        for h, url, other in pages.values():
            if h == host:
                places[tuple(other)] = min(url, places.get(tuple(other), url))
        ranked = sorted(places, key=places.get)
        at = ranked.index(tuple(lines))
        counts, n = [0] * len(lines), 0
        for side in (ranked[max(0, at - REACH) : at][::-1], ranked[at + 1 : at + 1 + REACH]):
            fresh = [o for o in side if sum(len(x) for x in lines if x in o) <= 0.9 * sum(map(len, lines))][:NEIGHBOURS]
            n += len(fresh)
            for o in fresh:
                counts = [c + m for c, m in zip(counts, longest_marks(lines, list(o)), strict=True)]
        kept = []
        for i, x in enumerate(lines):
            if len(x.split(" ")) >= html_extract.PROSE_WORDS:
                needed = max(2, n // 2 + 1)
            else:
                needed = 1 if i in (0, len(lines) - 1) or counts[i - 1] or counts[i + 1] else 2
            if counts[i] < needed:
                kept.append(x)
        out[page_id] = "\n".join(kept)
    return out


def site(rng, pages):
    """Pages of two hosts without any declared article: menu, notice, body, foot."""
    notice = " ".join(f"notice{i}" for i in range(30))
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = []
    for i in range(pages):
        host = rng.choice(["a.org", "b.org"])
        menu = [f"Menu {k} of {host}" for k in range(rng.randint(2, 4))]
        body = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.15:
            body.insert(rng.randint(0, len(body)), passage)
        foot = [notice, f"Rights of {host}"]
        html = "".join(f"<p>{x}</p>" for x in menu + body + foot)
        rows.append((i, f"http://{host}/{rng.choice('xyz')}/{i:04d}?q={i}", html))
    copy = rows[0][2]  # a run of copies longer than the reach
    rows += [(1000 + i, f"http://{rows[0][1].split('/')[2]}/x/{i:03d}-copy", copy) for i in range(2 * REACH + 3)]
    return rows


def test_whole_query_against_brute_force(spark):
    rows = site(random.Random(5), 60)
    want = slow_texts(rows)
    got = {r["page_id"]: r for r in extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    whole = {r[0]: "\n".join(b.text for b in blocks(r[2])) for r in rows}
    assert sum(want[k] != whole[k] for k in want) > 0.9 * len(want)  # differencing decides
    assert all(r["n_differenced"] == r["n_deleted"] > 0 for r in got.values())
    assert not any("notice1 " in t for t in want.values()) and sum("Menu" in t for t in want.values()) < 0.1 * len(want)
    assert sum("passage1 " in t for t in want.values()) == sum("passage1 " in t for t in whole.values()) > 0


def test_results_do_not_depend_on_partitions(spark, monkeypatch):
    rows = site(random.Random(6), 80)
    monkeypatch.setattr(html_extract, "BUCKET", 5)
    want = slow_texts(rows)
    for parts in (1, 7):
        random.Random(parts).shuffle(rows)
        frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        assert {r["page_id"]: r["text"] for r in extract_main_text(frame).collect()} == want


def test_articles_repeat_and_markup_weighs(spark):
    page = "<div>Home</div><article><h1>Same</h1><p>All the same text</p></article><footer>f</footer>"
    rows = [(i, f"http://h.org/{i}", page) for i in range(5)]
    got = extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["text"] for r in got} == {"Same\nAll the same text"}
    rows = [(i, f"http://h.org/{i}", f"<article><h1>Title {i}</h1><p>Text of page {i}.</p><p>Read more</p></article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Title {i}\nText of page {i}." for i in range(9)}


def test_awkward_rows(spark):
    rows = [(1, "http://h.org/a", "<p>x y</p>", "c", "h")] * 2 + [
        (1, "http://h.org/a", "<p>other</p>", "c", "h"),
        (None, None, None, None, None),
        (2, "", "", None, None),
        (3, "nonsense", "<p>kept</p>", None, None),
        (4, "http://h.org/long", "<p>" + "word " * 200_000 + "</p>", None, None),
        (5, "http://h.org/none", None, None, None),
    ]
    frame = spark.createDataFrame(rows, SCHEMA + ", host string, html_hash string")
    got = sorted((r["page_id"] or -1, r["n_chars"], r["text"][:5]) for r in extract_main_text(frame).collect())
    assert got == [(-1, 0, ""), (1, 3, "x y"), (1, 3, "x y"), (1, 5, "other"), (2, 0, ""), (3, 4, "kept"), (4, 999_999, "word "), (5, 0, "")]
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0
