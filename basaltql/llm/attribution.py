"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once, as a whole. The ids' byte lengths give each token's character span, the spans are
interval-joined to the section spans (both sorted, so by binary search), and a token that crosses
a boundary goes to one section by an explicit rule. The sections' counts therefore add up to the
document's tokens, which separate encodings of the sections would not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltql.llm.tokens import default_path, encoder

#: first: the section of a token's first character; last: of its last one; most: the section with most of its
#: characters, the earlier one at a tie.
RULES = ("first", "last", "most")
JOINER = "\n"
SCHEMA = "doc_id long, field string, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"


def section_spans(bodies: list[str | None], names: list[str]) -> tuple[list[str], list[int], np.ndarray]:
    """(field, index in the field, start in the whole) of each section: the lines of each field.

    Fields are joined by one line feed, which like every line feed belongs to the section before it, so that
    sections tile the whole. A null field has no sections and no joiner.
    """
    fields, indexes, starts, at = [], [], [], 0
    for name, body in zip(names, bodies, strict=True):
        if body is not None:
            for i, line in enumerate(body.split("\n")):
                fields.append(name)
                indexes.append(i)
                starts.append(at)
                at += len(line) + 1
    return fields, indexes, np.array(starts, dtype=np.int64)


def token_spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token of ``lengths`` bytes; tokens may share a character that they split."""
    char = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80) - 1
    stop = np.cumsum(lengths)
    return char[stop - lengths], char[stop - 1]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary)."""
    low = np.searchsorted(starts, first, side="right") - 1
    high = np.searchsorted(starts, last, side="right") - 1
    if rule == "first":
        return low, low != high
    if rule == "last":
        return high, low != high
    place = low.copy()
    for i in np.flatnonzero(low != high):  # few tokens cross
        edges = np.concatenate([[first[i]], starts[low[i] + 1 : high[i] + 1], [last[i] + 1]])
        place[i] = low[i] + int(np.argmax(np.diff(edges)))
    return place, low != high


def attribute_tokens(
    docs: DataFrame, fields: tuple[str, ...] = ("text",), rule: str = "first", tokenizer: str | None = None, key: str = "doc_id"
) -> DataFrame:
    """A row per section of every row of ``docs``: doc_id, field, section, char_start, char_end, n_tokens, n_crossing, doc_tokens.

    Sections are the lines of ``fields`` (columns of ``docs``), numbered from 0 in each field; spans are in the
    document that joins the fields by line feeds. n_crossing: tokens counted here that reach into another
    section. An empty field is one section without tokens; a document whose fields are all null is one
    row of null field, section 0 and no tokens. Repeated rows come back each. One pass, no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        types = [pa.int64(), pa.string(), *[pa.int64()] * 6]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list] = [[] for _ in types]
                for doc_id, *bodies in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True):
                    labels, indexes, starts = section_spans(bodies, list(fields))
                    whole = JOINER.join(b for b in bodies if b is not None)
                    if not labels:
                        labels, indexes, starts = [None], [0], np.zeros(1, dtype=np.int64)
                    ids = bpe.ids(whole)
                    n, crossing = np.zeros(len(labels), dtype=np.int64), np.zeros(len(labels), dtype=np.int64)
                    if len(ids):
                        first, last = token_spans(whole.encode(), bpe.n_bytes[ids])
                        place, crosses = allocate(first, last, starts, rule)
                        n = np.bincount(place, minlength=len(labels))
                        crossing = np.bincount(place[crosses], minlength=len(labels))
                    ends = np.append(starts[1:], len(whole))
                    for column, values in zip(
                        columns,
                        ([doc_id] * len(labels), labels, indexes, starts.tolist(), ends.tolist(), n.tolist(), crossing.tolist(), [len(ids)] * len(labels)),
                        strict=True,
                    ):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return rows.mapInArrow(run, SCHEMA)
