"""The pipeline's stages on the smallest tables, each held against its operator's decisions."""

import random

import corpus_pipeline
from basaltql.llm.common import written
from basaltql.llm.queries import ORACLE, QUERIES


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.4 * counts[0]
    assert docs.select("doc_id").distinct().count() == counts[-1]


def test_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)


def test_awkward_rows(spark, tmp_path):
    """Null, empty, very long and repeated texts, null and repeated keys, columns that clash, and empty tables."""
    folder = str(tmp_path)
    def prose(seed, n=120):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("aeioustnrl") for _ in range(rng.randint(2, 8))) for _ in range(n))

    rows = [(1, prose(1)), (1, prose(2)), (None, prose(3)), (2, prose(3)), (3, None), (4, ""), (5, "\t \n"), (6, prose(6, 60_000)), (7, prose(7) + " b1 b2 b3 b4 b5 b6 b7 b8 b9 b10"), (None, prose(8) + " b1 b2 b3 b4 b5 b6 b7 b8 b9 b10")]
    extra = "lang string, source string, n_chars long, row long, key long, fp long, comp long, grade int, quality int"
    schema = f"doc_id long, text string, {extra}"
    docs = spark.createDataFrame([(k, t, *["x"] * 2, *[9] * 7) for k, t in rows], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    held = written(docs, "docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = written(stage(spark, held, folder), name)
        assert held.columns == docs.columns
    assert sorted(r["text"] for r in held.collect()) == sorted([prose(1), prose(2), prose(3), rows[7][1]])
    packed = corpus_pipeline.run(spark, folder)
    assert packed.agg({"length": "sum"}).first()[0] == packed.dropDuplicates(["doc_id", "doc_tokens"]).agg({"doc_tokens": "sum"}).first()[0]
    empty = str(tmp_path / "empty")
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
