"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in each slot, a bit for every language. The slots of an n-gram, ANDed, give
the set of all languages that contain it. A text's n-grams are looked up once for all languages; the
per-language popcounts, corrected for each language's false-positive rate, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltql.llm.common import written

UNDETERMINED = "und"
#: Bound of the training rows a language (documented parameter; drawn by hash, all if fewer).
TRAIN_ROWS = 5_000
#: A language contains an n-gram that stands in its training rows at least so often, and so often per n-gram of theirs.
MIN_COUNT = 3
MIN_RATE = 2e-6
HASHES = 4
#: Slots of the filter for each n-gram of the language with the most, so that at most a third of a language's bits is set.
SLOTS_PER_GRAM = 3 * HASHES
LEAST_SLOTS = 1 << 16
GRAMS = (3, 4)
_PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Letters:
    """Which code points are letters: a table of the basic plane, and the others as they come."""

    def __init__(self):
        self._table = np.array([chr(i).isalpha() for i in range(1 << 16)])

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        wide = codes >= 1 << 16
        if not wide.any():
            return self._table[codes]
        out = self._table[np.where(wide, 0, codes)]
        kinds, place = np.unique(codes[wide], return_inverse=True)
        out[wide] = np.array([chr(c).isalpha() for c in kinds])[place]
        return out


def gram_hashes(text: str | None, letters: _Letters) -> Iterator[np.ndarray]:
    """64-bit hashes of the text's n-grams of lower-cased letters, words set off by one space; in pieces. None without a letter.

    The pieces overlap, so that the n-grams are those of the whole text, once each.
    """
    text = (text or "").lower()
    before = np.zeros(1, dtype=np.uint64)  # the last codes of the pieces so far: a space at first
    seen = False
    for at in range(0, len(text), _PIECE):
        codes = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters(codes)
        seen = seen or bool(is_letter.any())
        last = [0] if at + _PIECE >= len(text) else []
        codes = np.concatenate([before, np.where(is_letter, codes, 0), last]).astype(np.uint64)
        old = len(before)
        keep = np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])
        keep[:old] = True
        codes = codes[keep]
        if seen:
            for n in GRAMS:
                part = codes[max(0, old - n + 1) :]
                if len(part) >= n:
                    h = np.full(len(part) - n + 1, n, dtype=np.uint64)
                    for i in range(n):
                        h = (h ^ part[i : len(part) - n + 1 + i]) * _BASE
                        h ^= h >> np.uint64(29)
                    yield h
        before = codes[-(max(GRAMS) - 1) :]


def _slots(h: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(33)) | np.uint64(1)
    for i in range(HASHES):
        yield ((h + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64)


@dataclass(frozen=True)
class LanguageFilter:
    """languages: sorted; words: (ceil(languages / 64), slots) bit slices; rates: false-positive rate of each language."""

    languages: tuple[str, ...]
    words: np.ndarray
    rates: np.ndarray
    common: int

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """(words, n-grams): the set of the languages that contain each n-gram, a bit for each."""
        masks = None
        for slot in _slots(hashes, self.words.shape[1]):
            found = self.words[:, slot]
            masks = found if masks is None else masks & found
        return masks

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains."""
        masks = self.masks(hashes)
        return np.array([int(((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum()) for i in range(len(self.languages))], dtype=float)


def slots_for(most_grams: int) -> int:
    """Slots, a power of two, for a filter whose fullest language has so many n-grams."""
    return max(LEAST_SLOTS, 1 << max(0, most_grams * SLOTS_PER_GRAM - 1).bit_length())


def set_bits(hashes: np.ndarray, languages: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, bits): the words of the filter, numbered through all slices, that n-gram i in language i sets bits of; a place once."""
    places = np.concatenate([(languages // 64) * slots + slot for slot in _slots(hashes, slots)])
    bits = np.tile(np.uint64(1) << (languages % 64).astype(np.uint64), HASHES)
    order = np.argsort(places, kind="stable")
    at, first = np.unique(places[order], return_index=True)
    return at, (np.bitwise_or.reduceat(bits[order], first) if len(at) else bits)


def build_filter(languages: list[str], slots: int, places: np.ndarray, bits: np.ndarray, common: int) -> LanguageFilter:
    """places, bits: what ``set_bits`` gives, in any number of parts."""
    words = np.zeros(max(1, -(-len(languages) // 64)) * slots, dtype=np.uint64)
    np.bitwise_or.at(words, places, bits)
    words = words.reshape(-1, slots)
    fill = np.array([((words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return LanguageFilter(tuple(languages), words, fill**HASHES, common)


def held_out(key: Column) -> Column:
    """The third of documents that is never learned from: crc32 of the key as text, modulo 3, is 1 (null key: as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageFilter:
    """Learn the filter from text and lang of the rows that are not held out, at most about ``TRAIN_ROWS`` a language.

    Every n-gram that a language contains is in the filter, for all languages that do. N-grams are counted and their bits
    set on the executors; the driver gets the words of the filter, whose size the training rows bound.
    Rows are drawn by hash of key and text; repeated rows count each. Null texts and languages teach nothing; nothing
    else than the three columns is read.
    """
    taught = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    taught = taught.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("k")))
    sizes = {r["lang"]: r["count"] for r in taught.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return build_filter([], LEAST_SLOTS, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), 0)
    share = F.lit(0)
    for name in languages:
        share = F.when(F.col("lang") == name, int(min(1.0, TRAIN_ROWS / sizes[name]) * (1 << 20))).otherwise(share)
    drawn = taught.where(F.pmod(F.xxhash64(F.coalesce(F.col("k").cast("string"), F.col("text"))), F.lit(1 << 20)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, index = _Letters(), {name: i for i, name in enumerate(languages)}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                seen: dict[int, list[np.ndarray]] = {}
                for name, body in zip(part.column(1).to_pylist(), part.column(0), strict=True):
                    seen.setdefault(index[name], []).extend(gram_hashes(body.as_py(), letters))
                for which, arrays in seen.items():
                    if arrays:
                        grams, n = np.unique(np.concatenate(arrays), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(grams), which, dtype=np.int32)), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))],
                            names=["lang", "gram", "n"],
                        )

    counts = drawn.select("text", "lang").mapInArrow(count, "lang int, gram long, n long")
    counts = written(counts.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "gram_counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(totals), "lang")  # a row a language
    contained = written(rated.where((F.col("n") >= MIN_COUNT) & (F.col("n") >= F.col("total") * MIN_RATE)).select("gram", "lang"), "contained")
    slots = slots_for(max((r["count"] for r in contained.groupBy("lang").count().collect()), default=0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits = set_bits(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.int64), slots)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bits.view(np.int64))], names=["place", "bits"])

    placed = contained.mapInArrow(place, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    places, bits = (placed.column(i).to_numpy() for i in range(2))
    common = languages.index(max(languages, key=lambda name: (sizes[name], name)))
    return build_filter(languages, slots, places.astype(np.int64), bits.astype(np.int64).view(np.uint64), common)


def decide(model: LanguageFilter, text: str | None, letters: _Letters) -> tuple[str, float]:
    """(language, score): the largest corrected popcount and its part of all; ties go to the first in sorted order."""
    total, hits = 0, np.zeros(len(model.languages))
    for hashes in gram_hashes(text, letters):
        total += len(hashes)
        if model.languages:
            hits += model.counts(hashes)
    if not total or not model.languages:
        return UNDETERMINED, 0.0
    corrected = np.maximum(0.0, (hits - total * model.rates) / np.maximum(1e-9, 1 - model.rates))
    if not corrected.any():
        return model.languages[model.common], 0.0
    best = int(corrected.argmax())
    return model.languages[best], float(corrected[best] / corrected.sum())


def predict_languages(docs: DataFrame, model: LanguageFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs``; the text alone decides.

    Null texts and texts without a letter: ``und``, score 0. Texts of letters that no filter knows get the most
    frequent training language, score 0. Repeated rows come back each; a model without languages says
    ``und``. Ties go to the first language in order. Texts of any length are read whole, other columns than the two not
    at all. Empty table: no rows. The training rows bound the filter's size, whatever the corpus. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.rates, model.common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, filters = _Letters(), LanguageFilter(*shared.value)
        for batch in batches:
            told = [decide(filters, body.as_py(), letters) for body in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
