"""Benchmark decontamination by a distributed positional inverted index, on DataFrame functions only.

The index is a written table of postings (term_id, row, pos) of the training documents for the terms of
the benchmark. A benchmark item is looked up from the rarest terms of each of its windows: their posting lists
are shifted by the term's offset in the item and intersected, which leaves (document, item, diagonal)
candidates; the remaining terms of the item are then intersected on those diagonals only, and
runs of consecutive matches are exact phrases. ``proximity_matches`` works on the same index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltql.llm.common import lower_ascii, small, spread_join, written

#: A word: a maximal run of digits, letters a-z (texts are lower-cased in A-Z first) and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest terms of a window whose posting lists must meet before the others are looked at.
ANCHORS = 2
#: Marks the end of a document in the index; no word contains it.
_END = "\x00"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, n, offset, word) of every word of every item that has words; ``item`` numbers the rows."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("item_id"), words_of(F.col(text)).alias("w"))
    out = rows.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("offset", "word"))
    return written(out, "item_terms")


def build_index(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (term_id, row, pos, doc_id) of the words in ``vocabulary`` (term_id, word), written.

    Texts are read once and nothing is shuffled while the vocabulary can be broadcast; beyond that a frequent
    word is spread over tasks by row. Each document also has one
    posting of term_id -1 at the position after its last word, which alone carries its doc_id; so
    the index knows every document and its length.
    """
    terms = vocabulary.union(vocabulary.sparkSession.range(1).select(F.lit(-1).cast("long").alias("term_id"), F.lit(_END).alias("word")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("_key"),
        F.concat(words_of(F.col(text)), F.array(F.lit(_END))).alias("w"),
    )
    postings = spread_join(rows.select("row", "_key", F.posexplode("w").alias("pos", "word")), terms, "word", "row", count=vocabulary.count())
    return written(postings.select("term_id", "row", "pos", F.when(F.col("term_id") < 0, F.col("_key")).alias("doc_id")), "postings")


def _narrowed(index: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Postings whose ``column`` is in ``wanted`` (one column of that name, distinct, written)."""
    return index.join(small(wanted), column, "left_semi")


def phrase_runs(index: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """(row, item, item_id, start, stop): maximal runs of at least ``window`` item words that stand in a document.

    ``terms``: item_terms with term_id. An item of fewer words must be found whole. start and stop (included) are
    positions of words in the document.
    """
    need = F.least("n", F.lit(window))
    counts = written(index.groupBy("term_id").count(), "term_counts")
    rated = terms.join(small(counts), "term_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - need + 1), F.least(F.col("offset"), F.col("n") - need)))
    in_windows = rated.select("item", "offset", "term_id", "count", starts.alias("k"))
    by_rarity = Window.partitionBy("item", "k").orderBy("count", "offset")
    anchors = in_windows.withColumn("rank", F.row_number().over(by_rarity)).where(F.col("rank") <= ANCHORS)
    anchors = written(anchors.select("item", "offset", "term_id").distinct(), "anchors")

    need_of = terms.select("item", need.alias("need")).distinct()
    meets = (
        spread_join(index, anchors, "term_id", "row")
        .groupBy("row", "item", (F.col("pos") - F.col("offset")).alias("diagonal"))
        .agg(F.count("*").alias("met"))
        .where(F.col("met") >= 2 if ANCHORS > 1 else F.lit(True))
    )
    if ANCHORS > 1:  # a window of one word has one anchor
        single = anchors.join(need_of.where("need = 1"), "item", "left_semi")
        alone = spread_join(index, written(single, "single"), "term_id", "row").select("row", "item", (F.col("pos") - F.col("offset")).alias("diagonal"))
        meets = meets.select("row", "item", "diagonal").union(alone).distinct()
    candidates = written(meets, "candidates")

    rows = written(candidates.select("row").distinct(), "candidate_rows")
    postings = _narrowed(index.where("term_id >= 0").select("term_id", "row", "pos"), "row", rows)
    expected = candidates.join(small(terms.select("item", "item_id", "n", "offset", "term_id")), "item").withColumn(
        "pos", F.col("diagonal") + F.col("offset")
    )
    matched = expected.where("pos >= 0").join(postings, ["row", "pos", "term_id"])
    in_order = Window.partitionBy("row", "item", "diagonal").orderBy("offset")
    runs = matched.withColumn("run", F.col("offset") - F.row_number().over(in_order))
    return (
        runs.groupBy("row", "item", "diagonal", "run")
        .agg(F.first("item_id").alias("item_id"), F.first("n").alias("n"), F.min("pos").alias("start"), F.max("pos").alias("stop"))
        .where(F.col("stop") - F.col("start") + 1 >= need)
        .select("row", "item", "item_id", "start", "stop")
    )


def _prepared(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    words = item_terms(items)
    vocabulary = written(words.select("word").distinct().select(F.monotonically_increasing_id().alias("term_id"), "word"), "vocabulary")
    return build_index(docs, vocabulary), written(words.join(small(vocabulary), "word"), "terms")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs`` (doc_id, text).

    ``items``: item_id, text. A document word inside an occurrence of a window of ``window`` consecutive item words
    (the whole item if shorter) is hit; items_sha256 is over the sorted, comma-joined item_ids found. Null
    and empty texts have no words; items without words are found nowhere. Repeated rows, of documents
    or items, count each. Texts of any length are read whole. Other columns are not read. Empty tables: no rows, or no hits.
    """
    index, terms = _prepared(docs, items)
    runs = written(phrase_runs(index, terms, window), "runs")
    earlier = Window.partitionBy("row").orderBy("start", "stop", "item").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(earlier) + 1, F.lit(0))) + 1)
    hits = runs.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    found = (
        runs.select("row", "item", "item_id").distinct()
        .groupBy("row")
        .agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    )
    marked = hits.join(found, "row")
    documents = index.where("term_id = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return documents.join(marked, "row", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without contaminated ones.

    Rows are told apart by a number in a written copy of ``docs``, so null and repeated keys are judged like any other.
    """
    copy = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    read = copy.select(F.col("_row").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hit = contamination(read, items, window).where("contaminated")
    hit = written(hit.select(F.col("doc_id").alias("_hit")), "contaminated")
    return copy.join(small(hit), F.col("_row") == F.col("_hit"), "left_anti").drop("_row")


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = 10, least: int = 8, slack: int = 3) -> DataFrame:
    """(doc_id, item_id, n_matched): items with a window whose words stand nearly together in a document, from the index.

    Of ``window`` consecutive item words (the whole item if shorter) at least ``least`` (all, if fewer) must stand in the
    document on diagonals, position less offset, that differ by at most ``slack`` in all: quotations with words
    put in, left out or changed. n_matched is the most words of a window that do. Exact: of the window - least + 2
    rarest words of a window at least two are among the matched, so their postings alone give the candidates.
    Documents and items are told apart by row, as in ``contamination``; a pair is one row.
    """
    index, terms = _prepared(docs, items)
    width = F.least("n", F.lit(window))
    needed = F.least("n", F.lit(least))
    counts = written(index.groupBy("term_id").count(), "term_counts")
    rated = terms.join(small(counts), "term_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - width + 1), F.least(F.col("offset"), F.col("n") - width)))
    by_rarity = Window.partitionBy("item", "k").orderBy("count", "offset")
    ranked = rated.select("*", starts.alias("k")).withColumn("rank", F.row_number().over(by_rarity))
    anchors = ranked.where(F.col("rank") <= width - needed + F.least(needed, F.lit(2)))
    anchors = written(anchors.select("item", "offset", "term_id", F.least(needed, F.lit(2)).alias("two")).distinct(), "near_anchors")

    diagonal = F.col("pos") - F.col("offset")
    shifted = F.explode(F.sequence(diagonal - slack, diagonal)).alias("low")  # every band of diagonals that the posting is in
    met = spread_join(index.where("term_id >= 0").select("term_id", "row", "pos"), anchors, "term_id", "row")
    met = met.select("row", "item", "offset", "two", shifted).groupBy("row", "item", "low")
    candidates = written(met.agg(F.count_distinct("offset").alias("met"), F.first("two").alias("two")).where("met >= two").select("row", "item", "low"), "near_candidates")

    rows = written(candidates.select("row").distinct(), "near_rows")
    postings = _narrowed(index.where("term_id >= 0").select("term_id", "row", "pos"), "row", rows)
    every = F.explode(F.sequence(F.col("low") + F.col("offset"), F.col("low") + F.col("offset") + slack)).alias("pos")
    expected = candidates.join(small(terms), "item").select("row", "item", "item_id", "low", "n", "offset", "term_id", every)
    matched = expected.join(postings, ["row", "pos", "term_id"]).select("row", "item", "item_id", "low", "n", "offset").distinct()
    windows = matched.select("row", "item", "item_id", "low", "n", starts.alias("k"))
    found = windows.groupBy("row", "item", "item_id", "low", "n", "k").agg(F.count("*").alias("n_matched")).where(F.col("n_matched") >= needed)
    best = found.groupBy("row", "item", "item_id").agg(F.max("n_matched").alias("n_matched"))
    named = index.where("term_id = -1").select("row", "doc_id")
    return best.join(named, "row").select("doc_id", "item_id", "n_matched")
