"""SimHash near-duplicates of a given Jaccard similarity of word-shingle sets.

The search is that of ``simhash``: pivot distance tables give the candidates, discard and verify. Fingerprints have 256 bits
here, because the bits that texts of similarity s differ in scatter about their mean, arccos(cosine) / pi of all, too
widely in 64; 2 s / (1 + s) is the cosine of two sets of one size. A linked pair then leaves no block of bits
surely alone, so families are random sets of bits, as many as keep the chance that a pair at the limit agrees in
none of them below ``MISS``. The survivors are verified by all 256 bits and at last by the shingle sets themselves:
links are never a guess, and components are formed of verified links only. Where bits cannot tell linked from unlinked, as in
a large group with pairs on either side of the limit, the group's shingle sets are held against each other in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltql.llm.common import small, written
from basaltql.llm.simhash import SEED, bit_counts, linked

WORDS = 4
#: Bound on the chance that a pair at the limit of similarity is no candidate.
MISS = 1e-3
#: Chance members of a bucket beyond which families take more bits.
BUCKET_ROWS = 64
#: Families that near copies are first linked in, before all are searched for what remains.
LEAD = 8
LEAST_BITS = 18
#: Shingles that a block of one cell's sets holds on either side.
BLOCK_SHINGLES = 500_000
#: Strangers times shingles of a cell beyond which it is left to its buckets.
CELL_COST = 10**12
#: Rows of shingle sets in an Arrow batch.
SET_ROWS = 512
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; words as in ``fingerprint_of``. Fewer words: the whole sequence; none: empty."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    shingles = set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles)))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256-bit SimHash of ``shingle_set``'s hashes, each of which is mixed into four words. Empty: zero."""
    words, h = [], hashes
    for _ in range(WORDS):
        words.append(h)
        h = (h ^ h >> np.uint64(31)) * _MIX + np.uint64(SEED)
        h = h ^ h >> np.uint64(29)
    counts = np.concatenate([bit_counts(w) for w in words])
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def differing_share(percent: int) -> float:
    """Share of its bits in which the fingerprints of two sets of one size and this similarity differ on average."""
    s = percent / 100
    return acos(2 * s / (1 + s)) / pi


def bit_families(percent: int, count: int) -> list[list[int]]:
    """Random bit sets that a pair at the limit agrees in one of, but for a chance of ``MISS``; more bits for more points."""
    size = max(LEAST_BITS, ceil(log2(max(count, 1) / BUCKET_ROWS)))
    families = ceil(log(MISS) / log(1 - (1 - differing_share(percent)) ** size))
    draw = np.random.default_rng(SEED)
    return [sorted(draw.choice(64 * WORDS, size, replace=False).tolist()) for _ in range(families)]


def radius_of(percent: int, bits: int) -> int:
    """Differing bits that a pair at the limit exceeds with a chance of about 3e-4: 3.5 standard deviations over the mean."""
    p = differing_share(percent)
    return ceil(bits * p + 3.5 * (bits * p * (1 - p)) ** 0.5)


def _marks(numbered: DataFrame, shingle: int) -> DataFrame:
    """(row, key, fp, n, words) of ``numbered`` (row, key, text); fp names the shingle set, n is its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            fps, sizes, words = np.zeros(batch.num_rows, dtype=np.uint64), [], []
            for i, text in enumerate(batch.column(2)):
                hashes = shingle_set(text.as_py(), shingle)
                fps[i] = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
                sizes.append(len(hashes))
                words.append(wide_fingerprint(hashes).view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(fps.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(words, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "fp", "n", "words"])

    return numbered.mapInArrow(run, "row long, key long, fp long, n long, words array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(fp, hashes) of ``texts`` (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SET_ROWS):
                part = batch.slice(at, SET_ROWS)
                sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "hashes"])

    return texts.mapInArrow(run, "fp long, hashes array<long>")


def block_links(strangers: list[tuple], members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Linked (a, b) of (id, part, comp, hashes) in ``strangers`` and ``members``: one of each stranger and other component, none within a part."""
    ids, parts, comps = (np.array([m[i] for m in members]) for i in range(3))
    sizes = np.array([len(m[3]) for m in members])
    known = np.unique(np.concatenate([s[3] for s in strangers]))
    if not len(known):
        return []
    hashes, owner = np.concatenate([m[3] for m in members]), np.repeat(np.arange(len(members)), sizes)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    found = known[place] == hashes
    place, owner, links = place[found], owner[found], []
    for a, part, comp, own in strangers:
        mark = np.zeros(len(known), dtype=bool)
        mark[np.searchsorted(known, own)] = True
        both = np.bincount(owner[mark[place]], minlength=len(members))
        hit = np.flatnonzero((both * 100 >= (sizes + len(own) - both) * percent) & (parts != part) & (comps != comp))
        links += [(a, int(ids[i])) for i in hit[np.unique(comps[hit], return_index=True)[1]]]
    return links


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``rows`` (cell, sx, sy, side, id, part, comp, hashes): the links of each block's sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sides = None, ([], [])

        def out() -> pa.RecordBatch:
            links = block_links(*sides, percent) if sides[0] and sides[1] else []
            a, b = (pa.array([x[i] for x in links], pa.int64()) for i in range(2))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            hashes = batch.column(7)
            for i, (cell, sx, sy, side, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:7]), strict=True)):
                if (cell, sx, sy) != block:
                    yield out()
                    block, sides = (cell, sx, sy), ([], [])
                sides[side].append((*row, np.array(hashes[i].values)))
        yield out()

    dealt = rows.repartition("cell", "sx", "sy").sortWithinPartitions("cell", "sx", "sy")
    return dealt.mapInArrow(run, "a long, b long")


def similar_sets(points: DataFrame, numbered: DataFrame, shingle: int, percent: int, report: dict | None = None) -> DataFrame:
    """(fp, root) of ``points`` (fp, row, n, words): sets linked at a similarity of ``percent`` or more share a root."""
    known = points.select("fp", "n", "words")

    def verify(pairs: DataFrame) -> DataFrame:
        left = known.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("words").alias("wa"))
        right = known.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("words").alias("wb"))
        sized = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        bits = sum(F.bit_count(F.col("wa")[i].bitwiseXOR(F.col("wb")[i])) for i in range(WORDS))
        sized = written(sized.where(bits <= radius_of(percent, 64 * WORDS)).select("a", "b", "na", "nb"), "candidates")
        nodes = sized.select(F.col("a").alias("fp")).union(sized.select("b")).distinct()
        chosen = written(points.select("fp", "row").join(nodes, "fp"), "chosen")
        sets = written(_sets(numbered.join(small(chosen), "row").select("fp", "text"), shingle), "sets")
        x = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x"))
        y = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
        both = sized.join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
        return written(both.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b"), "links")

    def narrow(ids: DataFrame) -> tuple[DataFrame, Column]:
        """The sizes n of the sets and of their parts s that any other of them has too: a pair shares at most the lesser s.

        That leaves out, without forming the pair, texts that were changed too much to be linked to any copy of their group.
        """
        wanted = written(points.select("fp", "row", "n").join(ids.withColumnRenamed("id", "fp"), "fp"), "wanted")
        sets = _sets(numbered.join(small(wanted.select("fp", "row")), "row").select("fp", "text"), shingle)
        own = sets.select("fp", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("m"), F.min("fp").alias("fp")).where("m = 1")
        own = own.groupBy(F.col("fp").alias("_fp")).agg(F.count("*").alias("own"))
        sizes = wanted.join(own, F.col("fp") == F.col("_fp"), "left")
        most = F.least("x.s", "y.s")
        return sizes.select(F.col("fp").alias("id"), "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("s")), most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent

    def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links that join components of a cell, found between every set and those that are not of the cell's largest part, in blocks."""
        sized = written(rows.join(points.select(F.col("fp").alias("id"), "row", "n"), "id"), "sized")
        by_part = sized.groupBy("cell", "part").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
        per_cell = by_part.groupBy("cell").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), (F.sum("m") - F.max_by("m", F.struct("n", "part"))).alias("m"))
        slots = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK_SHINGLES)).cast("int")
        per_cell = written(per_cell.select("cell", "main", (F.col("n") * F.col("m")).alias("cost"), slots(F.col("n") - F.col("most")).alias("nx"), slots(F.col("n")).alias("ny")), "cells")
        todo = written(sized.join(small(per_cell.where(F.col("cost") <= CELL_COST)), "cell"), "todo")
        sets = _sets(numbered.join(small(todo.select(F.col("id").alias("fp"), "row")), "row").select("fp", "text"), shingle)
        held = todo.drop("row", "n", "cost").join(sets, F.col("id") == F.col("fp"))
        slot = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
        side = lambda number, x, y: F.struct(x.alias("sx"), y.alias("sy"), F.lit(number).alias("side"))
        members = F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda x: side(1, x, slot("ny")))
        strangers = F.transform(F.sequence(F.lit(0), F.col("ny") - 1), lambda y: side(0, slot("nx"), y))
        dealt = held.withColumn("at", F.explode(F.when(F.col("part") == F.col("main"), members).otherwise(F.concat(members, strangers))))
        blocks = dealt.select("cell", "at.sx", "at.sy", "at.side", "id", "part", "comp", "hashes")
        return written(_blocks(blocks, percent), "block_links"), per_cell.where(F.col("cost") > CELL_COST).select("cell")

    families = bit_families(percent, points.count())
    searched = points.select(F.col("fp").alias("id"), "words")
    roots = linked(searched, families, radius_of(percent, 64), verify, report, WORDS, LEAD, narrow, settle, radius_of(percent, 128))
    return roots.select(F.col("id").alias("fp"), "root")


def one_of_similar(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component of texts linked at ``percent`` or more Jaccard similarity one row stays.

    That is the row of the smallest key, null keys last. Rows are told apart by a number in a written copy of ``docs``,
    so null and repeated keys are judged like any other, and other columns travel along. Null, empty and wordless texts are alike,
    one of them stays. Texts are read whole. An empty table stays empty.
    """
    copy = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    numbered = copy.select(F.col("_row").alias("row"), F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    marks = written(_marks(numbered, shingle), "marks")
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "row")).alias("rep")
    reps = marks.groupBy("fp").agg(first)
    points = written(reps.join(marks.select("row", "n", "words"), F.col("rep.row") == F.col("row")), "points")
    roots = written(points.select("fp", "rep").join(similar_sets(points, numbered.select("row", "text"), shingle, percent), "fp"), "roots")
    smallest = written(roots.groupBy("root").agg(F.min("rep").alias("kept")), "smallest")
    named = written(roots.join(smallest, "root").select("fp", F.col("kept.row").alias("kept")), "named")
    gone = written(marks.select("row", "fp").join(named, "fp").where("row <> kept").select(F.col("row").alias("_gone")), "gone")
    return copy.join(small(gone), F.col("_row") == F.col("_gone"), "left_anti").drop("_row")
