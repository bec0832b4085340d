"""The run log as tables and as a stream: sequence numbers, pages by cursor, latest answers, admission rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGE, LOOK_BACK, WINDOW_SECONDS = 200, 20, 60


def numbered(events: DataFrame) -> DataFrame:
    """``(run_id, seq, ts, phase, event_id)``: events of each run from 0 in order of arrival."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select(F.col("user_id").alias("run_id"), seq.cast("bigint").alias("seq"), "ts", F.col("event_type").alias("phase"), "event_id", "value")


def page(log: DataFrame, cursor: int, size: int = PAGE) -> DataFrame:
    return log.where((F.col("seq") >= cursor) & (F.col("seq") < cursor + size))


def finished(log: DataFrame, marker: str) -> DataFrame:
    """``(run_id, n, done)``: whether a run's last lines hold the end marker."""
    last = F.max("seq").over(Window.partitionBy("run_id"))
    tail = log.withColumn("last", last)
    return tail.groupBy("run_id").agg(F.count("*").alias("n"), F.max(((F.col("seq") > F.col("last") - LOOK_BACK) & (F.col("phase") == marker)).cast("int")).alias("done"))


def formatted(log: DataFrame) -> DataFrame:
    return log.select("run_id", "seq", F.format_string("[RUN %08d] phase=%s, gen=%d | %s", "run_id", "phase", "seq", F.col("value").cast("string")).alias("line"))


def parsed(lines: DataFrame) -> DataFrame:
    part = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    return lines.select("run_id", "seq", part(r"phase=([^,|]+)").alias("phase"), part(r"gen=(\d+)").cast("bigint").alias("gen"), part(r"(?s)\| (.*)$").alias("message"))


def latest(log: DataFrame, phase: str) -> DataFrame:
    """``(run_id, value)``: what the last event of a phase says."""
    return log.where(F.col("phase") == phase).groupBy("run_id").agg(F.max_by("value", "seq").alias("value"))


def admission_rate(events: DataFrame) -> DataFrame:
    """``(event_id, in_window)``: events of a kind in the minute up to each.

    Time is cut into buckets of the window's length; an event counts in its own bucket and stands in the next one for
    those after it, so that a kind of any size spreads over as many tasks as it has buckets.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    span = WINDOW_SECONDS * 1_000_000
    placed = events.select("event_id", "event_type", t.alias("t"), F.explode(F.array(F.lit(0), F.lit(1))).alias("after"))
    bucketed = placed.withColumn("bucket", F.floor(F.col("t") / span) + F.col("after"))
    w = Window.partitionBy("event_type", "bucket").orderBy("t").rangeBetween(-span, 0)
    return bucketed.withColumn("in_window", F.count("*").over(w)).where("after = 0").select("event_id", "in_window")


def log_stream(spark: SparkSession, path: str, schema: StructType, checkpoint: str, out: str):
    """Reads a folder of event files as a stream and appends each new event once to ``out``; state is bounded by a watermark."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(spark: SparkSession, path: str, schema: StructType):
    """A stream of counts per kind and minute, closed by the watermark."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "10 minutes")
    return events.groupBy(F.window("at", "1 minute"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "event_type", "n")


def merged_pieces(pieces: DataFrame) -> DataFrame:
    """``(run_id, text)``: pieces in order, where one that begins with all text so far replaces it."""
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "piece"))), F.lit(""), lambda acc, x: F.when(x["piece"].startswith(acc), x["piece"]).otherwise(F.concat(acc, x["piece"])))
    return pieces.groupBy("run_id").agg(fold.alias("text"))
