"""Reading the project's tables and cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a fresh local one only where it is unset and the session is local."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-quire-"))
    return jsc.getCheckpointDir().get()


def file_signature(spark: SparkSession, paths: list[str]) -> str:
    """A key of the files below some paths, by their names, sizes and times; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    r = found.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("s"), F.bit_xor(one).alias("x")).first()
    return f"{r.n}-{r.s % (1 << 63) if r.s is not None else 0}-{r.x & (1 << 64) - 1 if r.x is not None else 0:x}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_key(text: Column) -> Column:
    """A 128-bit key of a string, as struct of two longs: equal keys are taken as equal strings."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.reverse(text)).alias("h2"))


#: Buckets of :func:`near`, which bound what it broadcasts to as many longs.
BUCKETS = 1 << 18


def near(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key falls in a bucket that some key of ``wanted`` falls in, before an exact join.

    The buckets, at most ``BUCKETS`` longs whatever the data, are broadcast, so that a wide table is thinned before it
    is shuffled; with very many wanted keys all rows pass, and the exact join does the work.
    """
    bucket = F.pmod(F.xxhash64(F.lit(11), key), F.lit(BUCKETS))
    buckets = wanted.select(bucket.alias("_bucket")).distinct()
    return df.withColumn("_bucket", bucket).join(F.broadcast(buckets), "_bucket", "left_semi").drop("_bucket")
