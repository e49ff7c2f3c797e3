"""Intermediate tables in the folder that all nodes share.

A table written here cuts lineage and outlives lost executors. The folder is the one
that ``spark.checkpoint.dir`` names; a local session without the setting (tests, a laptop)
gets a temporary one, any other an error. Operators delete what only their steps need;
what a lazy result still reads stays until :func:`sweep`, or whoever owns the folder,
deletes the application's part of it.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
    return (path or _own()).rstrip("/")


@functools.cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="stopweave-")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stopweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that no plan will read any more."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has stored; results that were not written are gone, too."""
    _delete(spark, f"{shared_dir(spark)}/stopweave/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Words of 64 bits of a bitmap that is broadcast.
BITMAP = 1 << 17


def let_through(rows: DataFrame, column: str, wanted: DataFrame, hashed: str, others: bool = False) -> DataFrame:
    """``rows`` whose ``column``, a hash, may be among those of ``wanted``: looked up in a bitmap of 1 MB at any size.

    With ``others``, the rows that are certainly not among them.
    """
    word = lambda h: F.pmod(h, F.lit(BITMAP)).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    bits = wanted.groupBy(word(F.col(hashed)).alias("_word")).agg(F.bit_or(bit(F.col(hashed))).alias("_bits"))
    near = rows.withColumn("_word", word(F.col(column))).join(F.broadcast(bits), "_word", "left" if others else "inner")
    there = F.coalesce(F.col("_bits").bitwiseAND(bit(F.col(column))), F.lit(0)) != 0
    return near.filter(~there if others else there).select(*rows.columns)


ROW = ("_row1", "_row2")


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` and ``ROW``, 128 bits of hash of all their columns: rows that agree in them are interchangeable."""
    return rows.withColumns({ROW[0]: F.xxhash64(*rows.columns), ROW[1]: F.xxhash64(F.lit(1), *rows.columns)})


def split_hot(slim: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """``slim``, rows with ``ROW``, in two parts with ``_times``: those that repeat ``limit`` times at most, as they are
    (1), and of the others one each, with their number. No more than one in ``limit`` rows is of the second part."""
    many = slim.groupBy(*ROW).agg(F.count(F.lit(1)).alias("_times")).filter(F.col("_times") > limit)
    many = stored(many, "many")
    if many.isEmpty():
        return slim.withColumn("_times", F.lit(1).cast("long")), None
    few = slim.join(F.broadcast(many), [*ROW], "left_anti").withColumn("_times", F.lit(1).cast("long"))
    return few, slim.dropDuplicates([*ROW]).join(F.broadcast(many), [*ROW])


def repeated(once: DataFrame, limit: int) -> DataFrame:
    """Each row ``_times`` times, with ``_again`` from 0: dealt out in stretches of ``limit``."""
    parts = once.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / limit))))
    parts = parts.repartition(*map(F.col, ROW), F.col("_part"))
    last = F.least(F.col("_times"), (F.col("_part") + 1) * limit) - 1
    return parts.withColumn("_again", F.explode(F.sequence(F.col("_part") * limit, last))).drop("_part")


def attached(docs: DataFrame, slim: DataFrame, slim_all: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All columns of ``docs``, and ``columns`` of ``slim``, whose rows have the ``ROW`` of the one they stand for.

    Rows of ``docs`` that repeat, by ``slim_all`` with one row for each of them, meet their rows of ``slim`` once.
    """
    often = slim_all.groupBy(*ROW).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*ROW)
    often = stored(often, "often")
    rows = keyed(docs)
    of = slim.select(*ROW, *columns)
    if often.isEmpty():
        return rows.join(of, [*ROW]).drop(*ROW)
    once = rows.join(often, [*ROW], "left_semi").dropDuplicates([*ROW])
    return rows.join(often, [*ROW], "left_anti").unionByName(once).join(of, [*ROW]).drop(*ROW)


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, in a session that sends at most 1000 rows and 4 MB at once to Python.

    Spark's own limits, 10,000 rows and 64 MB, are for narrow rows: with whole texts or sets of shingles, each
    task holds a batch two or three times over on both sides. The setting stays, as plans run later.
    """
    conf = rows.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.match(r"[0-9]+", conf.get(key, None) or "")
        if not now or not 0 < int(now[0]) <= most:
            conf.set(key, str(most))
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(
    docs: DataFrame, needed: Sequence[str], run: Callable[[DataFrame], DataFrame], added: Sequence[str] = ()
) -> DataFrame:
    """``run`` on ``docs`` whose other columns are out of its way: under names that no operator uses.

    Returns the columns of ``docs``, in order, and then those of ``added``. A column of ``docs`` that has such a name
    is ``<name>_before`` there.
    """
    names = {c: c if c in needed else f"_other{i}" for i, c in enumerate(docs.columns)}
    out = run(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    own = [F.col(f"`{n}`").alias(f"{c}_before" if c in added else c) for c, n in names.items()]
    return out.select(*own, *added)
