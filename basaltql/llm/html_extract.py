"""Main text of web pages by nearest-URL page differencing.

The distinct pages of a host are ranked by URL path, and each is paired with the nearest ones on either side. The text
lines (blocks) of a pair are aligned by longest common subsequence; lines that a page shares with its neighbours
are deleted: menus, notices and footers repeat from page to page, articles do not.

Three things weigh a shared line, because corpora repeat passages and whole articles as well:
a neighbour that shares nearly all of the page is a copy and proves nothing, so the next one is taken; a long line (prose)
must be shared by most neighbours, a short one by any; and inside an element that the markup declares to be the
article only lines of a few words are deleted, if three quarters of the neighbours share them.
Blocks that markup declares to be menus, adverts, forms, comments and so on, and blocks outside a declared article, are
deleted also where they differ from page to page, which differencing cannot see.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltql.llm.common import positions, small, written

#: Nearest pages on either side that a page is held against, and how far they are looked for past copies of it.
NEIGHBOURS = 4
REACH = 12
#: Share of a page's characters beyond which a neighbour that has them too is a copy of the page.
COPY_SHARE = 0.9
#: Words from which a line is prose, whose repetition alone does not make it boilerplate.
PROSE_WORDS = 20
#: Inside a declared article a line is only up for deletion below so many words, at so many neighbours at least.
ARTICLE_WORDS, ARTICLE_SHARERS = 8, 4
#: Ranks of a host's pages that are compared together; pages at the edges are handed to both sides.
BUCKET = 512
#: Bytes of marks up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Bits of alignment rows held at once; larger alignments are halved.
_ALIGN_BITS = 1 << 28

# Elements of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg canvas audio video select".split())
_SKIP = frozenset("nav footer aside form button dialog menu head figure-ad".split()) | _RAW
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "head", "option"}
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_SKIP_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|promoted|"
    r"nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|pagination|pager|toc|footer|foot|masthead|topbar|toolbar|"
    r"sidebar|side|aside|rail|widget|widgets|related|recommended|recommendations|trending|share|sharing|social|"
    r"cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|"
    r"comment|comments|commentlist|disqus|respond|reply|replies|discussion|form|search|skip|hidden|copyright|legal|disclaimer|tags|tagcloud|site-header|page-header)(?:$|[-_ ])"
)
#: Inside the declared article only whole class names that cannot name a part of the text count, and no ids.
_SKIP_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsored promo navbar breadcrumb breadcrumbs pagination share sharing share-buttons "
    "social social-share cookie-banner cookie-consent newsletter newsletter-signup paywall comments commentlist comment-list disqus".split()
)
_MAIN_NAMES = re.compile(r"(?:^|[-_ ])(?:article|articlebody|post|entry|main|maincontent|story|content)(?:$|[-_ ])")
#: Names of a site's head and foot; inside the article they name its own parts.
_SITE_NAMES = re.compile(r"(?:^|[-_ ])(?:header|head|top|bottom|logo|brand|branding|title-bar)(?:$|[-_ ])")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: A tag as nearly all are: no angle bracket inside, so that no attempt at a match looks past the next one.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+)*+)>")
_TAG_PART = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


@dataclass
class _Open:
    tag: str
    skip: bool
    main: bool


@dataclass(frozen=True)
class Block:
    """A text line; declared by markup to be in the article (main) or to be no main text (skip); mostly links."""

    text: str
    main: bool
    skip: bool
    linked: bool


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): text, start and end tags of ``page`` in order, in time linear in its length.

    A tag ends at the next ``>`` outside quotes. A quote that is never closed would swallow the rest of the page; from
    the first such tag on, tags end at any ``>``. A tag that the page's end cuts off is dropped, as are comments and declarations.
    """
    at, end, quotes, shut = 0, len(page), True, page.rfind(">")
    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            yield "text", "", page[at:]
            return
        if begin > at:
            yield "text", "", page[at:begin]
        plain = _PLAIN_TAG.match(page, begin)
        if plain is not None:
            tag = plain[2].lower()
            if plain[1] or tag not in _RAW:
                yield ("end" if plain[1] else "start"), tag, plain[3]
                at = plain.end()
                continue
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            at = end if stop < 0 else stop + 3
            continue
        closes = page.startswith("/", begin + 1)
        name = _NAME.match(page, begin + 1 + closes)
        if name is None and page[begin + 1 : begin + 2] not in ("!", "?", "/"):
            yield "text", "", "<"
            at = begin + 1
            continue
        if begin > shut:
            return
        inside = name.end() if name else begin + 2
        stop = -1
        if quotes and name:
            stop = inside
            while True:
                stop = _TAG_PART.match(page, stop).end()
                if stop >= end:
                    quotes, stop = False, -1
                    break
                if page[stop] == ">":
                    break
                stop = page.find(page[stop], stop + 1) + 1
                if not stop:
                    quotes, stop = False, -1
                    break
        if stop < 0:
            stop = page.find(">", inside)
            if stop < 0:
                return
        at = stop + 1
        if name is None:
            continue
        tag = name[0].lower()
        if not closes and tag in _RAW and not page[inside:stop].rstrip().endswith("/"):
            raw_end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            closing = page.find(">", raw_end.end()) if raw_end else -1
            at = end if closing < 0 else closing + 1
            yield "raw", tag, ""
            continue
        yield ("end" if closes else "start"), tag, page[inside:stop]


@lru_cache(maxsize=4096)
def _flags(tag: str, raw_attrs: str, in_main: bool) -> tuple[bool, bool]:
    """(the element is declared to be no main text, the element is declared to be the article)"""
    skip = tag in _SKIP or (tag == "header" and not in_main)
    main = tag in ("article", "main")
    if raw_attrs and not raw_attrs.isspace():
        attrs = {n.lower(): a or b or c for n, a, b, c in _ATTR.findall(raw_attrs)}
        role = attrs.get("role", "").lower()
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
        if role in _SKIP_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            skip = True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
            skip = True
        if tag not in ("html", "body") and names.strip():
            declared = role == "main" or attrs.get("itemprop", "").lower() == "articlebody"
            if tag not in ("article", "main") and not declared:
                if in_main:
                    skip = skip or not _SKIP_CLASSES.isdisjoint(attrs.get("class", "").lower().split())
                else:
                    skip = skip or bool(_SKIP_NAMES.search(names)) or bool(_SITE_NAMES.search(names))
                declared = tag in ("div", "section", "td") and bool(_MAIN_NAMES.search(names))
            main = main or declared
        main = main or role in ("main", "article")
    return skip, main and not skip


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of ``page`` in order.

    Tolerates unclosed and truncated markup. Character references are decoded once; white space inside a
    block becomes one space. Raw elements (scripts, styles, ...) end at their own end tag only. Time is linear in the page.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    open_tags: Counter = Counter()
    open_blocks: list[int] = []  # places in the stack of block elements
    text: list[str] = []
    linked, total, links = 0, 0, 0
    skips, inline_skips, mains = 0, 0, 0

    def flush() -> None:
        nonlocal linked, total
        if text:
            line = _SPACE.sub(" ", "".join(text)).strip()
            if line:
                out.append(Block(line, mains > 0 and not skips, skips > 0, total > 0 and linked >= 0.8 * total))
            text.clear()
        linked, total = 0, 0

    def close(upto: int) -> None:
        nonlocal skips, inline_skips, mains, links
        while len(stack) > upto:
            gone = stack.pop()
            open_tags[gone.tag] -= 1
            if open_blocks and open_blocks[-1] == len(stack):
                open_blocks.pop()
            if gone.skip and gone.tag in _BLOCK:
                flush()
            skips -= gone.skip
            inline_skips -= gone.skip and gone.tag not in _BLOCK
            mains -= gone.main
            links -= gone.tag == "a"

    for kind, tag, content in tokens(page):
        if kind == "text":
            if inline_skips:  # inside a line of text, what is declared to be none is left out
                continue
            piece = _html.unescape(content) if "&" in content else content
            text.append(piece)
            n = len(piece)
            total += n
            if links:
                linked += n
        elif kind == "end":
            if tag in _BLOCK:
                flush()
            if open_tags[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
        elif kind == "raw":
            if tag in _BLOCK:
                flush()
        elif tag == "br" or (tag in _VOID and tag != "hr"):
            text.append(" ")
        else:
            if tag in _BLOCK:
                flush()
                if tag in _CLOSES_P and open_blocks:  # a paragraph ends where a block begins, inline elements left open in it too
                    p = open_blocks[-1]
                    if stack[p].tag == "p" or (tag == stack[p].tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                        close(p)
            if tag == "hr" or content.rstrip().endswith("/"):
                continue
            skip, main = _flags(tag, content, mains > 0)
            if tag in _BLOCK:
                open_blocks.append(len(stack))
            stack.append(_Open(tag, skip, main))
            open_tags[tag] += 1
            skips += skip
            inline_skips += skip and tag not in _BLOCK
            mains += main
            links += tag == "a"
    flush()
    return out


def lcs_marks(a: list, b: list) -> list[bool]:
    """For each line of ``a``, whether one longest common subsequence of ``a`` and ``b`` holds it.

    Bit-parallel: one big integer a row, a bit for each line of ``b``. Lines that the other side lacks
    are left out first; alignments too large to hold are halved (Hirschberg), so memory stays bounded.
    """
    marks = [False] * len(a)
    in_b, in_a = set(b), set(a)
    places = [i for i, x in enumerate(a) if x in in_b]
    right = [x for x in b if x in in_a]
    left = [a[i] for i in places]
    for i in _aligned(left, right):
        marks[places[i]] = True
    return marks


def _rows(a: list, b: list, keep: bool) -> list[int]:
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        both = row & at.get(x, 0)
        row = ((row + both) | (row - both)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _aligned(a: list, b: list) -> list[int]:
    """Indexes in ``a`` of a longest common subsequence."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    got = list(range(head))
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    if mid_a and mid_b:
        if len(mid_a) == 1:
            inner = [0] if mid_a[0] in mid_b else []
        elif len(mid_a) * len(mid_b) > _ALIGN_BITS:
            half = len(mid_a) // 2
            n = len(mid_b)
            up = _rows(mid_a[:half], mid_b, False)[0]
            down = _rows(mid_a[half:][::-1], mid_b[::-1], False)[0]
            ahead, behind = [0], [0]
            for j in range(n):
                ahead.append(ahead[-1] + (1 - (up >> j & 1)))
                behind.append(behind[-1] + (1 - (down >> j & 1)))
            cut = max(range(n + 1), key=lambda j: ahead[j] + behind[n - j])
            inner = _aligned(mid_a[:half], mid_b[:cut]) + [half + i for i in _aligned(mid_a[half:], mid_b[cut:])]
        else:
            rows = _rows(mid_a, mid_b, True)
            inner, i, j = [], len(mid_a) - 1, len(mid_b) - 1
            while i >= 0 and j >= 0:
                if rows[i] >> j & 1:  # column j adds nothing to the first i + 1 lines
                    j -= 1
                elif i and not rows[i - 1] >> j & 1:
                    i -= 1
                else:
                    inner.append(i)
                    i, j = i - 1, j - 1
            inner.reverse()
        got += [head + i for i in inner]
    return got + list(range(len(a) - tail, len(a)))


_LINE = np.dtype([("hash", "<i8"), ("chars", "<u4"), ("own", "u1")])
_SHARED = np.dtype("<u2")


def line_table(lines: list[Block]) -> np.ndarray:
    """What differencing needs of a page: a hash and the length of each line, and whether it may be main text."""
    import xxhash

    has_main = any(x.main for x in lines)
    rows = [(xxhash.xxh64_intdigest(x.text.encode(errors="surrogatepass")) - (1 << 63), len(x.text), x.main or not (has_main or x.skip)) for x in lines]
    return np.array(rows, dtype=_LINE)


def shared_lines(page: np.ndarray, before: list[np.ndarray], after: list[np.ndarray], neighbours: int = NEIGHBOURS) -> tuple[np.ndarray, int]:
    """(in how many neighbours' alignments each line of ``page`` is, the number of neighbours).

    ``before`` and ``after`` are the line tables of the pages on either side, nearest first; of each the first
    ``neighbours`` that are no copies are taken.
    """
    lines = page["hash"].tolist()
    own = [(h, c) for h, c, mine in page.tolist() if mine] or [(h, c) for h, c, _ in page.tolist()]
    weight = sum(c for _, c in own) or 1
    counts, n = np.zeros(len(page), dtype=np.int64), 0
    for side in (before, after):
        taken = 0
        for other in side:
            if taken == neighbours:
                break
            theirs = set(other["hash"].tolist())
            if sum(c for h, c in own if h in theirs) > COPY_SHARE * weight:
                continue  # a copy of the page: sharing with it tells nothing about menus
            counts += np.array(lcs_marks(lines, other["hash"].tolist()), dtype=np.int64)
            taken += 1
        n += taken
    return counts, n


def deleted_lines(lines: list[Block], shared: np.ndarray | None, n: int, markup: bool = True) -> list[tuple[bool, bool]]:
    """(deleted, by differencing alone or as well) of each line; ``shared`` and ``n`` are ``shared_lines``, None: no neighbours."""
    counts = [0] * len(lines) if shared is None else shared.tolist()
    has_main = markup and any(x.main for x in lines)
    out = []
    for i, x in enumerate(lines):
        words = x.text.count(" ") + 1
        if has_main and x.main:
            needed = max(ARTICLE_SHARERS, -(-3 * n // 4)) if words < ARTICLE_WORDS else n + 1
        elif words >= PROSE_WORDS:
            needed = max(2, n // 2 + 1)
        else:  # a short line alone between lines of the page's own may be shared by chance
            beside = i == 0 or i == len(lines) - 1 or counts[i - 1] > 0 or counts[i + 1] > 0
            needed = 1 if beside else 2
        differenced = counts[i] >= needed
        declared = markup and (x.skip or (has_main and not x.main))
        menu = x.linked and not (has_main and x.main) and ((i > 0 and lines[i - 1].linked) or (i + 1 < len(lines) and lines[i + 1].linked))
        out.append((differenced or declared or menu, differenced))
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _line_tables(keyed: DataFrame) -> DataFrame:
    """(host, html_hash, path, digest, lines) of the pages that have a host and lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            packed = [line_table(blocks(t.as_py())).tobytes() for t in batch.column(3)]
            digests = np.array([xxhash.xxh64_intdigest(t) for t in packed], dtype=np.uint64).view(np.int64)
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.int64()), pa.array(packed, pa.binary())], names=["host", "html_hash", "path", "digest", "lines"])
            yield out.filter(pa.array([len(t) > 0 for t in packed], pa.bool_()))

    rows = keyed.where("host <> '' AND html IS NOT NULL").select("host", "html_hash", "path", "html")
    return rows.mapInArrow(run, "host string, html_hash long, path string, digest long, lines binary")


def _differenced(ranked: DataFrame, neighbours: int) -> DataFrame:
    """(host, digest, shared, n) of ``ranked`` (host, digest, lines, rank): pages are compared in buckets of ranks.

    A bucket has the ``REACH`` pages beyond its edges as well, so results do not depend on how rows are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (bucket, rank, digest, host, lines) of one bucket, a window of it at a time
        current = 0

        def finish(at: int) -> tuple | None:
            (host, bucket), rank, digest, lines = held[at]
            if rank // BUCKET != bucket:
                return None
            mine = [x for x in held[max(0, at - REACH) : at + REACH + 1] if x[0] == (host, bucket)]
            before = [x[3] for x in reversed(mine) if x[1] < rank]
            after = [x[3] for x in mine if x[1] > rank]
            counts, n = shared_lines(lines, before, after, neighbours)
            return (host, digest, np.minimum(counts, 65535).astype(_SHARED).tobytes(), n) if counts.any() else None

        def emit(done: list) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [pa.string(), pa.int64(), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "digest", "shared", "n"])

        for batch in batches:
            done = []
            for host, bucket, rank, digest, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(((host, bucket), rank, digest, np.frombuffer(lines, dtype=_LINE)))
                while len(held) - 1 - current >= REACH:
                    done.append(finish(current))
                    current += 1
                    if current > REACH:
                        held.pop(0)
                        current -= 1
            done = [d for d in done if d]
            if done:
                yield emit(done)
        done = [d for at in range(current, len(held)) if (d := finish(at))]
        if done:
            yield emit(done)

    low, high = (F.floor((F.col("rank") + d) / BUCKET).cast("long") for d in (-REACH, REACH))
    dealt = ranked.select("host", F.explode(F.sequence(F.greatest(low, F.lit(0).cast("long")), high)).alias("bucket"), "rank", "digest", "lines")
    dealt = dealt.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "rank")
    return dealt.mapInArrow(run, "host string, digest long, shared binary, n int")


def extract_main_text(pages: DataFrame, neighbours: int = NEIGHBOURS, markup: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html); then n_lines, n_deleted, n_differenced.

    n_deleted counts the deleted lines, n_differenced those that neighbours share often enough to be deleted for it.
    ``markup`` False lets differencing alone decide. Null or empty html: empty text. A null url, or one without a
    host, has no neighbours. Pages of a host with equal lines, whatever their number, are one page of the comparison
    and get one verdict; it stands where the smallest of their paths does, ties of path in order of content.
    Of near copies, over ``COPY_SHARE`` alike, up to ``REACH`` on a side are passed over. Repeated rows come back
    each. Other columns of ``pages`` are not read. Empty table: no rows.

    Two passes parse the html, which is not shuffled itself: line hashes are compared, a distinct page once, and
    the marks are broadcast back if their size allows, else joined by host and content.
    """
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    keyed = keyed.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64("html").alias("html_hash"))
    tables = written(_line_tables(keyed), "line_tables")
    first = tables.groupBy("host", "digest").agg(F.min(F.struct("path", "lines")).alias("f"))
    ranked = positions(first.select("host", "digest", "f.path", "f.lines"), ["host"], ["path", "digest"], "rank")
    compared = written(_differenced(ranked, neighbours), "differenced")
    same = tables.select("host", "html_hash", "digest").distinct()
    marks = same.join(compared, ["host", "digest"]).select(F.col("host").alias("_host"), F.col("html_hash").alias("_hash"), "shared", "n")
    marks = written(marks, "marks")
    size = marks.agg(F.count("*").alias("rows"), F.sum(F.octet_length("shared") + F.octet_length("_host") + 20).alias("bytes")).first()
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        marks = small(marks, size["rows"])
    joined = keyed.join(marks, (F.col("host") == F.col("_host")) & (F.col("html_hash") == F.col("_hash")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for html, shared, n in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                lines = blocks(html.as_py() or "")
                verdicts = deleted_lines(lines, None if shared is None else np.frombuffer(shared, dtype=_SHARED), n or 0, markup)
                texts.append("\n".join(x.text for x, (gone, _) in zip(lines, verdicts, strict=True) if not gone))
                counts.append((len(texts[-1]), len(lines), sum(gone for gone, _ in verdicts), sum(d for _, d in verdicts)))
            numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *numbers], names=_RESULT)

    schema = "page_id long, url string, text string, n_chars long, n_lines long, n_deleted long, n_differenced long"
    return joined.select("page_id", "url", "html", "shared", "n").mapInArrow(run, schema)


_RESULT = ["page_id", "url", "text", "n_chars", "n_lines", "n_deleted", "n_differenced"]
