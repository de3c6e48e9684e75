"""Quality rules by compression bands.

zstandard ratios of the whole document and of its fixed-size chunks must lie inside bands whose limits
depend on the length. Repetitive text compresses too well, encoded or random text too badly. The
bands are quantiles of documents labelled good, by length class, with a margin that narrows with
the count of such documents; classes without any take wide default bands. Chunks have 4096 bytes, in texts
of fewer than that 1024; texts of fewer than 1024 bytes are judged as a whole only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltql.llm.common import small, written

#: Chunk sizes, largest first: a text is cut into chunks of the first that it has as many bytes as.
CHUNKS = (4096, 1024)
#: Bands where no document is labelled: ratios of ordinary prose lie well inside at any length.
DEFAULT_LOW, DEFAULT_HIGH = 0.3, 4.0
#: Two classes an octave of UTF-8 bytes, up to the longest string.
LENGTH_CLASSES = 64
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_MEASURES = [
    ("doc_id", pa.int64()),
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("n_bytes", pa.int64()),
    ("ratio", pa.float64()),
    ("chunk_max", pa.float64()),
    ("chunk_min", pa.float64()),
]
_SPARK = {pa.int64(): "long", pa.float64(): "double"}


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    n, covered = 0, 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            n += i + 3 - max(covered, i)
            covered = i + 3
    return n


def dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


def measure(doc_id, text: str | None, compressor) -> tuple:
    """One row of ``_MEASURES``. A null or empty text has no words and no ratios."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # splits bytes at exactly \\x20 and \\x09-\\x0D
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    ratio = len(raw) / len(compressor.compress(raw)) if raw else None
    size = next((c for c in CHUNKS if c <= len(raw)), 0)
    starts = list(range(0, len(raw) - size + 1, size)) if size else []
    if starts and len(raw) % size:
        starts.append(len(raw) - size)  # the last bytes, in a full chunk that overlaps the one before
    chunks = [size / len(compressor.compress(raw[i : i + size])) for i in starts]
    low_high = (max(chunks), min(chunks)) if chunks else (None, None)
    symbols = len(_SYMBOLS.findall(text))
    return (doc_id, len(words), chars, symbols, dup_lines(text), repeat_words(words), len(raw), ratio, *low_high)


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [measure(k, t.as_py(), compressor) for k, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, (_, t) in zip(columns, _MEASURES, strict=True)], names=[n for n, _ in _MEASURES]
                )

    schema = ", ".join(f"{n} {_SPARK[t]}" for n, t in _MEASURES)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def length_class():
    """Two classes an octave of UTF-8 bytes."""
    return F.floor(F.log2(F.greatest(F.col("n_bytes"), F.lit(1))) * 2).cast("int")


def chunk_size(length):
    """The chunk size of a text of ``length`` bytes; 0: none."""
    out = F.lit(0)
    for size in reversed(CHUNKS):
        out = F.when(length >= size, size).otherwise(out)
    return out


def fit_bands(measured: DataFrame, good: DataFrame, tail: float = 0.001) -> DataFrame:
    """(length_class, low, high, chunk_low, chunk_high): a row for each length class, null where nothing was learned.

    ``good``: doc_id of documents labelled good; all of them count. Chunk bands come from all good chunks of a size.
    Documents that fail the base rules teach nothing.
    """
    taught = measured.where(~base_failed()).join(good.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    margin = lambda n: F.lit(0.01) + F.lit(0.3) / F.sqrt(n)

    def limits(key, name: str, lowest: str, highest: str, out: str) -> DataFrame:
        sums = taught.groupBy(key.alias(name)).agg(
            F.count(lowest).alias("_n"),
            F.percentile_approx(lowest, tail, 10000).alias("_low"),
            F.percentile_approx(highest, 1 - tail, 10000).alias("_high"),
        )
        low, high = F.col("_low") - margin(F.col("_n")), F.col("_high") + margin(F.col("_n"))
        return sums.where("_n > 0").select(name, low.alias(f"{out}low"), high.alias(f"{out}high"))

    classes = measured.sparkSession.range(LENGTH_CLASSES).select(F.col("id").cast("int").alias("length_class"))
    classes = classes.withColumn("_size", chunk_size(F.floor(F.pow(F.lit(2.0), F.col("length_class") / 2) + F.lit(1e-6))))
    by_length = limits(length_class(), "length_class", "ratio", "ratio", "")
    by_size = limits(chunk_size(F.col("n_bytes")), "_size", "chunk_min", "chunk_max", "chunk_")
    return classes.join(F.broadcast(by_length), "length_class", "left").join(F.broadcast(by_size), "_size", "left").drop("_size")  # fixed numbers of rows


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def quality_verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs`` with its measures, base_failed and kept.

    kept: not base_failed, the whole ratio inside its length class's band, and every chunk inside the band of its size;
    the last chunk is the text's final bytes. Null or empty text: zero counts, base_failed. Repeated rows are judged
    alike; rows of ``labels`` (doc_id, quality) with quality 1 teach the bands, null labels teach nothing, nor do
    labels of doc_ids that are not there. Limits themselves are inside. Texts of any length are read whole, once; what is
    joined with labels is a narrow row a document. Other columns are not read. An empty table gives no rows.
    """
    measured = written(measures(docs, key, text), "measures")
    bands = fit_bands(measured, labels.where(F.col("quality") == 1)).withColumnRenamed("length_class", "_class")
    inside = lambda c, low, high: F.col(c).isNull() | F.col(c).between(
        F.coalesce(F.col(low), F.lit(DEFAULT_LOW)), F.coalesce(F.col(high), F.lit(DEFAULT_HIGH))
    )
    judged = measured.join(F.broadcast(bands), length_class() == F.col("_class"), "left")  # LENGTH_CLASSES rows
    kept = ~base_failed() & inside("ratio", "low", "high")
    kept = kept & inside("chunk_max", "chunk_low", "chunk_high") & inside("chunk_min", "chunk_low", "chunk_high")
    return judged.select(
        *["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        base_failed().alias("base_failed"),
        kept.alias("kept"),
        *["ratio", "chunk_max", "chunk_min"],
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_verdicts`` keeps.

    Only documents labelled good are measured beforehand. The bands (``LENGTH_CLASSES`` rows) travel with the function that
    measures and filters, so that no text is shuffled. Rows of null key are judged like any other.
    """
    good = labels.where(F.col("quality") == 1).select("doc_id").where("doc_id IS NOT NULL").distinct()
    named = written(good.select(F.col("doc_id").alias("_good")), "good")
    taught = docs.join(small(named), F.col(key) == F.col("_good"), "left_semi")
    fitted = fit_bands(written(measures(taught, key, text), "measures"), good).collect()
    bands = {r["length_class"]: (r["low"], r["high"]) for r in fitted}
    chunks = {r["length_class"]: (r["chunk_low"], r["chunk_high"]) for r in fitted}
    column = docs.columns.index(text)

    def inside(x, limits) -> bool:
        low, high = limits
        return x is None or (DEFAULT_LOW if low is None else low) <= x <= (DEFAULT_HIGH if high is None else high)

    def stays(body: str | None, compressor) -> bool:
        _, n, _, _, _, repeated, size, ratio, top, bottom = measure(None, body, compressor)
        if n < MIN_WORDS or repeated * 100 > n * MAX_REPEAT_PERCENT:
            return False
        which = math.floor(math.log2(max(size, 1)) * 2)
        return inside(ratio, bands[which]) and inside(top, chunks[which]) and inside(bottom, chunks[which])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield batch.filter(pa.array([stays(t.as_py(), compressor) for t in batch.column(column)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
