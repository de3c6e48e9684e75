"""Helpers that the training-data operators share: scratch tables, distributed ranks, Arrow mapping."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words; other code points belong to words.
WORD_SPACE = "\\x20\\x09-\\x0D"
#: A table is broadcast only when its counted rows are at most this many narrow rows.
BROADCAST_ROWS = 500_000
#: Tasks that the rows of one value are spread over in a join with a larger table.
SPREAD = 32

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder that is removed at exit and
    a cluster session gets a folder below its warehouse, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] == "local":
            root = tempfile.mkdtemp(prefix="basaltql-")
            atexit.register(shutil.rmtree, root, True)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/llm-{uuid.uuid4().hex}/{name}"


#: Folders of the tables that ``written`` has left, oldest first.
_left: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, so lost executors redo nothing before it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _left.append(path.rsplit("/", 1)[0])
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """A place in the order of written tables, for ``sweep``."""
    return len(_left)


def sweep(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables written after the mark ``since``, but for the last ``keep``: nothing may be read from them any more."""
    gone = _left[since : len(_left) - keep]
    del _left[since : since + len(gone)]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in gone:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a written table for broadcast if it is proven small; else it stays an ordinary join side."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def spread_join(rows: DataFrame, table: DataFrame, on: str, row_id: str, how: str = "inner", count: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on the column ``on``, of which one value may be a large part of the rows.

    A small table is broadcast. Else it is repeated ``SPREAD`` times and the rows are dealt by the value and a number drawn from
    ``row_id``, so that the rows of one value go to as many tasks.
    """
    n = table.count() if count is None else count
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, how)
    repeated = table.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(row_id), F.lit(SPREAD)).cast("int"))
    return dealt.join(repeated, [on, "_deal"], how).drop("_deal")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take Spark's fast ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def positions(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the gapless rank from 0 of each row inside its ``group``, ordered by ``order``.

    A group's rows are range-dealt over many tasks, so one group may hold most rows. Only a row
    for each (task, group) pair is summed up to find where each task's share begins.
    """
    keys = [*group, *order]
    ranked = written(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    ranked = ranked.withColumn("_task", F.shiftrightunsigned("_at", 33))
    starts = ranked.groupBy("_task", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        starts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first"),
        "starts",
    )
    renamed = starts.select("_base", F.col("_task").alias("_t"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    on = F.col("_task") == F.col("_t")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        ranked.join(small(renamed), on)
        .withColumn(out, (F.col("_base") + F.col("_at")).cast("long"))
        .drop("_at", "_task", "_t", "_base", *[f"_g{i}" for i in range(len(group))])
    )
