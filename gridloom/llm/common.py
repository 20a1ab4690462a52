"""Helpers shared by the training-data operators: lineage cuts in the shared
folder, joins that survive hot keys, and small column expressions."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot when it holds more than one row in HOT_SHARE.  At most HOT_SHARE
#: keys can do so, which bounds what the hot side of a join broadcasts.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.  Where that is unset a
    private folder serves on a local master; on a cluster it is an error, since
    executors don't see each other's disks."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder: its lineage ends there, so lost
    executors cost a reread only.  The files go when the driver drops the
    DataFrame: the setting for that is turned on here, as Spark's default is off."""
    checkpoint_dir(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are over: it does so
    when the driver's garbage is collected, which may be long after a cut."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared folder, whatever file system that is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, for files that tasks write."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as one struct column ``_row`` beside ``columns``, so that names of
    its own can't clash with theirs; ``select("_row.*")`` opens it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def bytes_of(text: Column | str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right`` (unique on ``keys``), where column
    ``count`` of ``right`` says how many rows of ``left`` have the key.

    Keys with more than total/HOT_SHARE rows, at most HOT_SHARE of them, are
    broadcast, so their rows stay where they are; the others are shuffled, and
    none of those fills a task.  Null keys match none.  ``left`` is read twice:
    pass something materialised.
    """
    least = max(total // HOT_SHARE, 10_000)
    if total <= least:
        return left.join(right, keys)
    hot = right.filter(F.col(count) > least)
    cold = right.filter(F.col(count) <= least)
    names = hot.select(*keys)
    return left.join(F.broadcast(hot), keys).unionByName(left.join(F.broadcast(names), keys, "left_anti").join(cold, keys))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, spread: Column) -> DataFrame:
    """Like ``hot_join``, but reads ``left`` once: rows of hot keys meet the
    broadcast side and then go through the shuffle under a key of their own,
    by ``spread``, so they are dealt evenly."""
    least = max(total // HOT_SHARE, 10_000)
    values = [c for c in right.columns if c not in keys and c != count]
    if total <= least:
        return left.join(right.drop(count), keys)
    hot = right.filter(F.col(count) > least).select(*keys, F.struct(*values).alias("_hot"))
    cold = right.filter(F.col(count) <= least).select(*keys, F.lit(0).cast("long").alias("_deal"), F.struct(*values).alias("_cold"))
    met = left.join(F.broadcast(hot), keys, "left")
    met = met.withColumn("_deal", F.when(F.col("_hot").isNotNull(), F.shiftrightunsigned(F.xxhash64(spread), 1) + 1).otherwise(F.lit(0)).cast("long"))
    found = met.join(cold, [*keys, "_deal"], "left").withColumn("_found", F.coalesce("_hot", "_cold")).filter("_found IS NOT NULL")
    return found.select(*left.columns, "_found.*")


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, most: int = 10_000) -> DataFrame:
    """Inner join of ``left`` (materialised) with the wide rows of ``right``,
    unique on ``key``.  A key with more than ``most`` rows of ``left`` is dealt
    to parts by ``spread``, and its row of ``right`` is sent to each of them,
    so neither a task nor a broadcast grows with a hot key."""
    counts = cut(left.groupBy(key).agg(F.count("*").alias("_many")))
    parts = F.ceil(F.col("_many") / most).cast("int")
    dealt = hot_join(left, counts, [key], "_many", left.count()).withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_many")
    copies = right.join(counts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_many")
    return dealt.join(copies, [key, "_part"]).drop("_part")
