"""SimHash near-duplicates by pivot distance tables.

The table holds Hamming distances of each distinct fingerprint to ``REFERENCES`` pseudo-random reference fingerprints
(pivots), over all of its bits and over the bits of each of several families. By the triangle inequality two
fingerprints that differ in k bits of a family differ by at most k in every coordinate over it. So:

1. A family's bits are left alone by a linked pair in at least one family (``block_families``: all unions of m - radius of
   m blocks, by pigeonhole). Its coordinates are then equal, and pairs are formed only among fingerprints whose
   coordinates over some family agree: those share a bucket. No linked pair is lost.
2. Of these, pairs whose distances over all bits differ by more than the radius in any coordinate are discarded.
3. The survivors are verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltql.llm.common import small, written
from basaltql.llm.components import components

SEED = 42
REFERENCES = 16
#: Cost of testing a chance candidate in units of dealing a fingerprint to one more family (0.08 against 1 microsecond, measured).
CANDIDATE_COST = 0.08
#: Earlier rows of its bucket that a row meets in the first pass, and how many of the near ones it is linked with there.
LOOK = 256
CHAIN = 1
#: Rows of a bucket that the second pass holds against the others in one group.
SLOT_ROWS = 4096
_PIECE = 65_536
_TABLE_ROWS = 1024
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of ``hashes`` (rows of 64-bit words) have each bit set."""
    octets = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(len(hashes), -1)
    return np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(octets.shape[1])])


def fingerprint_of(text: str | None, shingle: int) -> int:
    """64-bit SimHash: bit set where over half of the shingles' XXH64 (seed 42) have it set. No words: 0."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    total = len(words) - shingle + 1
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, total, _PIECE):
        part = words[at : min(at + _PIECE, total) + shingle - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        bits += bit_counts(np.array([digest(s, SEED) for s in shingles], dtype="<u8"))
    return int.from_bytes(np.packbits(bits * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_families(radius: int, count: int) -> list[list[int]]:
    """The bits of each family: all unions of m - radius of m blocks of a 64-bit fingerprint.

    Any m is exact. More blocks mean more families to deal to and fewer chance candidates in each bucket; the m with
    the least cost of both for ``count`` fingerprints is taken, radius + 2 at least: with one block a family, buckets
    fill from some ten thousand fingerprints on. At radius 4 that is 15 families up to some 70 million fingerprints.
    """

    def cost(m: int) -> float:
        return comb(m, radius) * (1 + CANDIDATE_COST * count / 2.0 ** (1 + 64 * (m - radius) // m))

    m = min(range(radius + 2, radius + 8), key=cost)
    blocks = [range(64 * i // m, 64 * (i + 1) // m) for i in range(m)]
    return [[b for block in chosen for b in block] for chosen in combinations(blocks, m - radius)]


def reference(i: int) -> int:
    """64 bits of the pseudo-random reference fingerprints (splitmix64 of i)."""
    z = (i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
    return z ^ z >> 31


_PIVOTS = np.array([reference(i) for i in range(REFERENCES)], dtype=np.uint64)


class PivotTable:
    """Distances of fingerprints of ``words`` 64-bit words to the references, over the bits of each of ``families``."""

    def __init__(self, words: int, families: list[list[int]], first: int = 0):
        """first: the number of the first family, which its keys depend on."""
        pivots = np.array([[reference(w * REFERENCES + i) for w in range(words)] for i in range(REFERENCES)], dtype="<u8")
        bits = np.unpackbits(pivots.view(np.uint8).reshape(REFERENCES, -1), axis=1, bitorder="little").astype(np.float32)
        inside = np.zeros((64 * words, len(families), 1), dtype=np.float32)
        for f, chosen in enumerate(families):
            inside[chosen, f] = 1
        # the distance over a family: the pivot's set bits there, and for each set bit of the fingerprint 1 or -1
        self.base = (inside * bits.T[:, None, :]).sum(axis=0).reshape(-1)
        self.signs = (inside * (1 - 2 * bits.T[:, None, :])).reshape(64 * words, -1)
        draw = lambda f: np.random.default_rng([SEED, f]).integers(0, 1 << 64, REFERENCES, dtype=np.uint64)
        self.factors = np.stack([draw(first + f) for f in range(len(families))]) | np.uint64(1)

    def distances(self, fps: np.ndarray) -> np.ndarray:
        """(rows, families, references) for ``fps`` (rows, words)."""
        bits = np.unpackbits(np.ascontiguousarray(fps, dtype="<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
        return (bits.astype(np.float32) @ self.signs + self.base).astype(np.uint64).reshape(len(fps), *self.factors.shape)

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """(rows, families): a bucket key, the hash of a family's coordinates."""
        parts = [(self.distances(fps[at : at + _TABLE_ROWS]) * self.factors).sum(axis=2) for at in range(0, len(fps), _TABLE_ROWS)]
        keys = np.concatenate(parts) if parts else np.zeros((0, len(self.factors)), dtype=np.uint64)
        keys = (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return keys ^ keys >> np.uint64(32)


def near_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
    """(whether each pair of words of ``x`` and ``y`` is linked, how many pairs the coordinates did not discard)."""
    linked = np.zeros(len(x), dtype=bool)
    left = np.arange(len(x))
    for pivot in _PIVOTS:
        a, b = np.bitwise_count(x[left] ^ pivot), np.bitwise_count(y[left] ^ pivot)
        left = left[np.maximum(a, b) - np.minimum(a, b) <= radius]
    linked[left] = np.bitwise_count(x[left] ^ y[left]) <= radius
    return linked, len(left)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _table(word: Column) -> list[Column]:
    """The distances of a word to the 16 references, eight 7-bit coordinates to a long."""
    packed = []
    for half in range(2):
        coordinates = F.lit(0).cast("long")
        for i in range(8):
            distance = F.bit_count(word.bitwiseXOR(F.lit(_signed(reference(8 * half + i))))).cast("long")
            coordinates = coordinates.bitwiseOR(F.shiftleft(distance, 7 * i))
        packed.append(coordinates)
    return packed


def _near(a: str, b: str, radius: int, wide: int | None) -> Column:
    """No coordinate differs by more than ``radius``, and (verified) neither do the bits, nor those of two words by more than ``wide``."""
    survives = F.lit(True)
    for half in ("p0", "p1"):
        for i in range(8):
            read = lambda side: F.shiftright(F.col(f"{side}.{half}"), 7 * i).bitwiseAND(F.lit(127))  # noqa: E731, B023
            survives = survives & (F.abs(read(a) - read(b)) <= radius)
    bits = F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch")))
    survives = survives & (bits <= radius)
    return survives if wide is None else survives & (bits + F.bit_count(F.col(f"{a}.more").bitwiseXOR(F.col(f"{b}.more"))) <= wide)


_PAIR, _AGAIN, _COUNTS = 0, 1, 2


def _scanned(bucketed: DataFrame, radius: int, chain: int, wide: int | None) -> DataFrame:
    """(kind, a, b) of ``bucketed`` (key, id, sketch, comp, with ``wide`` more), range-dealt and sorted by key and id: one pass.

    A row meets the ``LOOK`` rows before it in its bucket that are of other components (null: the row alone) and is paired
    with the first ``chain`` near ones, each of which is so paired ``chain`` times. Buckets in which that may leave pairs out are told: those with more near
    ones or more rows, and the first and the last of a task, which other tasks may share. The third kind counts
    candidates and survivors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * (4 if wide is None else 5)
        first = True

        def out(kind: int, a, b) -> pa.RecordBatch:
            a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(held[0])
            comps = pc.coalesce(batch.column(3), batch.column(1))
            columns = [*batch.columns[:3], comps, *batch.columns[4:]]
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, columns, strict=True)]
            key, ids, sketch, comp = held[:4]
            words = sketch.view(np.uint64)
            again = [key[old : old + 1]] if first else []
            first = False
            hits, given = np.zeros((2, len(key)), dtype=np.int32)
            pairs, tested, survived = [], 0, 0
            at = np.arange(old, len(key))
            for back in range(1, LOOK + 1):
                at = at[at >= back]
                at = at[key[at] == key[at - back]]
                if not len(at):
                    break
                apart = at[comp[at] != comp[at - back]]
                near, passed = near_pairs(words[apart], words[apart - back], radius)
                if wide is not None:
                    both = sum(np.bitwise_count(w[apart[near]] ^ w[apart[near] - back]) for w in (words, held[4].view(np.uint64)))
                    near[near] = both <= wide
                tested, survived = tested + len(apart), survived + passed
                hit = apart[near]
                free = (hits[hit] < chain) & (given[hit - back] < chain)
                fresh = hit[free]
                pairs.append(np.stack([ids[fresh - back], ids[fresh]], axis=1))
                again.append(key[hit[~free]])
                hits[hit] += 1
                given[hit - back] += 1
            else:
                again.append(key[at])
            found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype=np.int64)
            flagged = np.unique(np.concatenate(again)) if again else np.zeros(0, dtype=np.int64)
            yield out(_PAIR, found[:, 0], found[:, 1])
            yield out(_AGAIN, flagged, np.zeros(len(flagged)))
            yield out(_COUNTS, [tested], [survived])
            held = [c[-LOOK:] for c in held]
        if len(held[0]):
            yield out(_AGAIN, held[0][-1:], [0])

    return bucketed.mapInArrow(run, "kind int, a long, b long")


def linked(
    points: DataFrame,
    families: list[list[int]],
    radius: int,
    verify: Callable[[DataFrame], DataFrame] | None = None,
    report: dict | None = None,
    n_words: int = 1,
    lead: int = 0,
    narrow: Callable[[DataFrame], tuple[DataFrame, Column]] | None = None,
    settle: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    wide: int | None = None,
) -> DataFrame:
    """(id, root): points whose fingerprints share a bucket and are linked have the same root.

    ``points``: id (distinct), words (array of ``n_words`` longs); the coordinates and the radius of the tests are those of the first word,
    ``wide`` is the radius over the first two, ``verify`` takes and returns (a, b) for further tests; ``narrow`` takes the ids (id) that are searched again and returns
    further columns of them and a condition on x and y that linked pairs meet. ``report`` receives the pairs left after each step of the passes.

    Near copies are linked along their buckets, a few edges a member: first in ``lead`` of the families (0: all), then in
    rounds of others. Where near points need not be linked, those that a chain of near ones joins are a cell, and ``settle`` decides every cell at once in the first two rounds: it takes
    (id, cell, part, comp), where points of one part or component are decided already, and returns the links (a, b) that join
    components and the cells (cell) it leaves undecided. Rows of one cell, or of one component of such cells, no longer meet. Only buckets that may still hold pairs are searched
    again: every row meets those that are not of the bucket's largest cell, in groups of ``SLOT_ROWS``. So a group of
    near copies of any size never has all its pairs formed, and no link between components is lost.
    """
    verify = verify or (lambda pairs: pairs)
    names = ["key", "id", "sketch", "comp"] + ["more"] * (wide is not None)

    def bucketed(frame: DataFrame, first: int, last: int) -> DataFrame:
        """``comp``: the rows of one need not meet."""
        some = families[first:last]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = PivotTable(n_words, some, first)
            for batch in batches:
                words = batch.column(1).flatten().to_numpy().reshape(-1, n_words)
                keys = table.keys(words.view(np.uint64)).view(np.int64)
                sketch, more = (pa.array(np.ascontiguousarray(words[:, i])) for i in (0, min(1, n_words - 1)))
                for f in range(len(some)):
                    columns = [pa.array(np.ascontiguousarray(keys[:, f])), batch.column(0), sketch, batch.column(2), more]
                    yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

        return frame.select("id", "words", "cell").mapInArrow(run, ", ".join(f"{n} long" for n in names))

    def scan(frame: DataFrame, first: int, last: int) -> DataFrame:
        dealt = bucketed(frame, first, last).repartitionByRange("key", "id").sortWithinPartitions("key", "id")
        scanned = written(_scanned(dealt, radius, CHAIN, wide), "scanned")
        if report is not None:
            counts = scanned.where(F.col("kind") == _COUNTS).agg(F.sum("a"), F.sum("b")).first()
            for name, n in zip(("candidates", "survivors", "linked"), (*counts, scanned.where(F.col("kind") == _PAIR).distinct().count()), strict=True):
                report[name] = report.get(name, 0) + (n or 0)
        return scanned

    def joined(frame: DataFrame, pairs: DataFrame, label: str, out: str) -> DataFrame:
        """``frame`` with ``out``: its ``label`` (null: alone), made one where ``pairs`` join two."""
        named = frame.select("id", F.coalesce(label, "id").alias("c"))
        a, b = (named.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
        roots = components(pairs.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        up = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        rows = frame.join(up, F.coalesce(label, "id") == F.col("_n"), "left").withColumn(out, F.coalesce("_r", label))
        return written(rows.drop("_n", "_r"), "labelled")

    def merged(frame: DataFrame, pairs: DataFrame, early: bool) -> DataFrame:
        """``frame`` (id, words, comp, cell; null: alone) with the components that verified pairs join, and if ``early`` the cells that near ones do."""
        pairs = written(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            return frame
        frame = joined(frame, verify(pairs), "comp", "comp")
        if settle is None:
            return frame.withColumn("cell", F.col("comp"))
        if not early:
            return frame
        frame = joined(frame, pairs, "cell", "whole")
        # parts: the cells of before, and components of rows that were in none; "c" and "p" keep their names apart
        part = F.when(F.col("cell").isNotNull(), F.concat(F.lit("c"), "cell")).otherwise(F.concat(F.lit("p"), F.coalesce("comp", "id")))
        inside = frame.where("whole IS NOT NULL").select("id", F.col("whole").alias("cell"), part.alias("part"), F.coalesce("comp", "id").alias("comp"))
        several = inside.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("comp").alias("least"), F.max("comp").alias("most"))
        several = written(several.where("low <> high AND least <> most").select("cell"), "open_cells")
        if several.isEmpty():
            return written(frame.select("id", "words", "comp", F.col("whole").alias("cell")), "settled")
        links, undecided = settle(written(inside.join(small(several), "cell"), "open_rows"))
        frame = joined(frame, links, "comp", "comp").join(small(undecided.select(F.col("cell").alias("_u"))), F.col("whole") == F.col("_u"), "left")
        return written(frame.select("id", "words", "comp", F.when(F.col("_u").isNull(), F.col("whole")).otherwise(F.col("comp")).alias("cell")), "settled")

    alone = F.lit(None).cast("long")
    labelled, told, at = points.select("id", "words", alone.alias("comp"), alone.alias("cell")), [], 0
    while at < len(families):  # rounds of ``lead`` families, then of as many as went before
        upto = min(len(families), at + (max(at, lead) or len(families)))
        scanned = scan(labelled, at, upto)
        labelled = merged(labelled, scanned.where(F.col("kind") == _PAIR).select("a", "b"), at <= lead)
        told.append(scanned.where(F.col("kind") == _AGAIN).select(F.col("a").alias("key")))
        at = upto
    roots = labelled.select("id", F.coalesce("comp", "id").alias("root"))
    again = written(reduce(DataFrame.union, told).distinct(), "again")
    if again.isEmpty():
        return roots

    cells = labelled.withColumn("cell", F.coalesce("cell", "id"))
    told_rows = written(bucketed(cells, 0, len(families)).join(small(again), "key", "left_semi"), "told_rows")
    several = told_rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rows = told_rows.join(small(written(several, "several")), "key")
    if rows.isEmpty():
        return roots
    fits = F.lit(True)
    if narrow is not None:
        rows = written(rows, "several_rows")
        known, fits = narrow(rows.select("id").distinct())
        rows = written(rows.join(small(written(known, "known")), "id"), "narrowed_rows")
    by_component = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    buckets = by_component.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    buckets = written(buckets.select("key", "main", F.ceil(F.col("n") / SLOT_ROWS).cast("int").alias("slots")), "buckets")
    p0, p1 = _table(F.col("sketch"))
    mixed = rows.join(small(buckets), "key").select("*", p0.alias("p0"), p1.alias("p1"))
    all_rows = mixed.withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int"))
    strangers = mixed.where("comp <> main").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.slot") == F.col("y.slot"))
    other = (F.col("x.comp") < F.col("y.comp")) | ((F.col("x.comp") > F.col("y.comp")) & (F.col("x.comp") == F.col("x.main")))
    met = all_rows.alias("x").join(strangers.alias("y"), same & other & fits & _near("x", "y", radius, wide))
    pairs = written(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "met")
    last = joined(labelled, verify(pairs), "comp", "comp")
    return last.select("id", F.coalesce("comp", "id").alias("root"))


def linked_fingerprints(points: DataFrame, radius: int, report: dict | None = None) -> DataFrame:
    """(fp, root) for the distinct fingerprints of ``points`` (fp): linked ones, at ``radius`` or fewer bits, share a root. Exact."""
    families = block_families(radius, points.count())
    roots = linked(points.select(F.col("fp").alias("id"), F.array("fp").alias("words")), families, radius, report=report)
    return roots.select(F.col("id").alias("fp"), "root")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs``.

    component_id is the smallest doc_id that links reach, the document itself included. Fewer words than a shingle:
    the whole sequence is the shingle. Null or wordless text: fingerprint zero, linked like any other.
    Repeated rows come back each; null doc_ids never are a component_id unless a component has no other.
    Equal fingerprints are one point of the search. Texts of any length are hashed in pieces. Other columns of ``docs``
    are not read. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, shingle, key, text), "fingerprints")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    roots = written(points.join(linked_fingerprints(points, radius), "fp"), "roots")
    smallest = written(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "smallest")
    named = written(roots.join(smallest, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
