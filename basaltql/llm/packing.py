"""Sequence packing by non-negative least squares over the length histogram.

Documents are cut at multiples of the window; what is packed are the pieces' lengths. Shallow combinations
(one, two or three lengths) that fill the window are enumerated, repeat counts x >= 0 are solved for in
min ||A x - h|| against the histogram h, rounded so that no length is used more often than it occurs,
and the residual histogram is packed greedily. The plan depends on the histogram alone, which has at
most `window` rows; pieces find their places by their rank among pieces of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltql.llm.common import positions, written
from basaltql.llm.tokens import default_path, encoder

END_ID = 0


def pieces(docs: DataFrame, window: int, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc, start, length, ids_crc32, doc_tokens): every document's ids and the end id, cut at multiples of ``window``.

    ``doc`` numbers the rows, so that repeated rows and null keys stay apart. Null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc_id, doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    ids = np.append(bpe.ids(body.as_py() or ""), END_ID).astype("<u4")
                    for start in range(0, len(ids), window):
                        cut = ids[start : start + window]
                        out.append((doc_id, doc, start, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_PIECE)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in _PIECE))


_PIECE = ["doc_id", "doc", "start", "length", "ids_crc32", "doc_tokens"]


def combinations_of(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill ``window`` exactly: all singles, pairs and triples, about window ** 2 / 12 at most."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    rows = [[window, 0, 0]] if have[window] else []
    rows += [[a, window - a, 0] for a in range(window // 2, window) if have[a] and have[window - a] and a >= window - a]
    triples = []
    for a in range(-(-window // 3), window - 1):
        if have[a]:
            b = np.arange(max(1, -(-(window - a) // 2)), min(a, window - a - 1) + 1)
            b = b[have[b] & have[window - a - b]] if len(b) else b
            triples.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate([np.array(rows, dtype=np.int64).reshape(-1, 3), *triples])


def solve_counts(combos: np.ndarray, histogram: np.ndarray, gain: float = 0.01, every: int = 25) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients, until ``every`` steps lower the residual by less than ``gain`` of it.

    Rows of A x - h are weighted by 1 / sqrt(h), so that rare lengths count as well. A residual of a millionth of the
    histogram is taken as none.
    """
    window = len(histogram) - 1
    h = histogram.astype(float)
    weight = np.where(h > 0, 1 / np.maximum(h, 1), 0.0)
    use = lambda x: sum(np.bincount(combos[:, i], weights=x, minlength=window + 1) for i in range(3)) * (np.arange(window + 1) > 0)
    back = lambda r: sum(np.where(combos[:, i] > 0, r[combos[:, i]], 0.0) for i in range(3))
    probe = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'WA
        probe = back(weight * use(probe))
        norm = np.linalg.norm(probe)
        probe = probe / norm if norm else probe
    step = 1 / (norm * 1.05) if norm else 1.0
    x, y, t = np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    size = weight @ (h * h)
    before = size
    while size:
        for _ in range(every):
            nxt = np.maximum(0, y - step * back(weight * (use(y) - h)))
            if (y - nxt) @ (nxt - x) > 0:  # past the minimum along the way: start the momentum anew
                t = 1.0
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y = nxt + (t - 1) / t2 * (nxt - x)
            x, t = nxt, t2
        residual = weight @ (use(x) - h) ** 2
        if residual <= 1e-12 * size or residual > (1 - gain) * before:
            break
        before = residual
    return x


def plan(histogram: dict[int, int], window: int, report: dict | None = None) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that use every piece of ``histogram`` once; no sequence exceeds ``window``.

    Counts are rounded down first; then combinations take one more each in order of what that cut off, while
    pieces last. ``report`` receives the pieces that the solution and the greedy rest place, and their padding.
    """
    h = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        h[length] = n
    total = int(h.sum())
    out: list[tuple[tuple[int, ...], int]] = []
    combos = combinations_of(np.flatnonzero(h), window)
    if len(combos):
        solved = solve_counts(combos, h)
        whole = np.floor(solved + 1e-6).astype(np.int64)
        rest = solved - whole
        rounds = [(i, int(whole[i])) for i in np.argsort(-whole, kind="stable") if whole[i] > 0]
        rounds += [(i, 1) for i in np.argsort(-rest, kind="stable") if rest[i] > 1e-3]
        left, repeats = h.tolist(), {}
        for i, n in rounds:
            a, b, c = combos[i].tolist()
            n = min(n, left[a] // (1 + (a == b) + (a == c)))
            if b:
                n = min(n, left[b] // (1 + (a == b) + (b == c)))
            if c:
                n = min(n, left[c] // (1 + (a == c) + (b == c)))
            if n > 0:
                repeats[i] = repeats.get(i, 0) + n
                for v in (a, b, c):
                    left[v] -= n * (v > 0)
        out = [(tuple(v for v in combos[i].tolist() if v), n) for i, n in repeats.items()]
        h = np.array(left, dtype=np.int64)
    planned = len(out)
    present = [int(v) for v in np.flatnonzero(h)]
    while present:  # the largest piece, then always the largest that still fits; repeated while all last
        lengths, room, used = [], window, {}
        for v in reversed(present):
            fit = min(room // v, int(h[v]))
            if fit:
                lengths += [v] * fit
                used[v] = fit
                room -= v * fit
        n = min(int(h[v]) // k for v, k in used.items())
        out.append((tuple(lengths), n))
        for v, k in used.items():
            h[v] -= n * k
        present = [v for v in present if h[v]]
    if report is not None:
        greedy = out[planned:]
        report |= {"pieces": total, "solved": sum(len(c) * n for c, n in out[:planned]), "greedy": sum(len(c) * n for c, n in greedy)}
        report["greedy_padding"] = sum((window - sum(c)) * n for c, n in greedy)  # solved sequences have none
    return out


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, per sequence, first sequence, first offset): where runs of ranks of a length go."""
    rows, taken, base = [], {}, 0
    for lengths, n in planned:
        offset = 0
        for v in dict.fromkeys(lengths):  # equal lengths stand next to each other
            per = lengths.count(v)
            rows.append((v, taken.get(v, 0), n * per, per, base, offset))
            taken[v] = taken.get(v, 0) + n * per
            offset += v * per
        base += n
    return rows


def pack(docs: DataFrame, window: int = 1024, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, its end id included, is in exactly one piece; pieces of a sequence follow each other from
    offset 0 without gaps. Null and empty texts are one piece of the end id. Repeated rows are packed each;
    an empty table gives no rows. Whole texts are encoded once; narrow rows are ranked by a range shuffle, so
    that a length which a third of the pieces share is no single task. The driver sees the histogram
    (at most ``window`` rows) and broadcasts the plan (bounded by the window too).
    """
    cut = written(pieces(docs, window, tokenizer or default_path(), key, text), "pieces")
    spark = cut.sparkSession
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = slots(plan(histogram, window))
    runs: dict[int, list] = {}
    for v, first, n, per, sequence, offset in places:
        runs.setdefault(v, []).append((first, first + n, per, sequence, offset))
    if not runs:
        empty = spark.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
        return empty
    ranked = positions(cut, ["length"], ["doc_id", "doc", "start"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {v: np.array(r, dtype=np.int64) for v, r in runs.items()}
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for v in np.unique(length):
                at = np.flatnonzero(length == v)
                rows = tables[int(v)]
                run = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                inside = rank[at] - run[:, 0]
                sequence[at] = run[:, 3] + inside // run[:, 2]
                offset[at] = run[:, 4] + inside % run[:, 2] * v
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, schema)
