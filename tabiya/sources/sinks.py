"""Where results go besides collections: CSV exports and histograms of request logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabiya.sources.shared import completed, run_id

#: Upper ends of the latency buckets, in milliseconds. Fixed values.
LATENCY_BUCKETS = (5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000)


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("header", True).option("emptyValue", "").csv(path)


def export_stream(stream: DataFrame, path: str, checkpoint: str, rows: Callable[[DataFrame], DataFrame] = lambda batch: batch, every: str | None = None) -> StreamingQuery:
    """A stream exported exactly once: each batch has a folder of its own, by the run and its number, which a batch that
    is run again overwrites; a folder counts when it is complete. Without `every` what is there is worked off."""
    run = run_id(stream.sparkSession, checkpoint)
    writer = stream.writeStream.foreachBatch(lambda batch, n: write_csv(rows(batch), f"{path}/part={run}-{n}")).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def exported(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of an export by `export_stream`."""
    parts = [f"{path}/part={name}" for name in completed(spark, path, "part")]
    return spark.read.option("header", True).schema(schema).csv(parts) if parts else spark.createDataFrame([], schema)


def latency_histogram(requests: DataFrame, duration: str = "millis", by: tuple[str, ...] = ("operation", "error")) -> DataFrame:
    """Requests by bucket, operation and error type; bucket is the number of upper ends below the duration."""
    bucket = sum((F.when(F.col(duration) > end, 1).otherwise(0) for end in LATENCY_BUCKETS), F.lit(0))
    return requests.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(duration).alias("total"))


def quantiles(rows: DataFrame, value: str, at: dict[str, float], by: str, buckets: int = 1000) -> DataFrame:
    """Exact quantiles of each group, interpolated between the two values around each; nulls don't count. Values are
    counted first, then counted again in buckets of equal width; only the buckets that hold a wanted rank are sorted,
    so a group with most of all rows is in no single task."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ends = counted.groupBy(by).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("all"))
    place = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets), F.lit(buckets - 1))
    placed = counted.join(ends, by).withColumn("bucket", F.when(F.col("high") > F.col("low"), place).otherwise(0).cast("long"))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(by, "bucket").agg(F.sum("n").alias("in_bucket")).withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in at.items()])).alias("w")
    wanted = ends.select(by, ranks, "all").select(by, "w.name", (F.col("w.q") * (F.col("all") - 1)).alias("rank"))
    wanted = wanted.select(by, "name", "rank", F.explode(F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))).alias("k"))
    held = wanted.join(sums, by).where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("in_bucket")))
    inside = Window.partitionBy(by, "bucket").orderBy("v")
    sorted_ = placed.join(held.select(by, "bucket", "before").distinct(), [by, "bucket"]).withColumn("upto", F.col("before") + F.sum("n").over(inside)).withColumn("from", F.col("upto") - F.col("n"))
    found = held.select(by, "name", "rank", "k", "bucket").join(sorted_.select(by, "bucket", "from", "upto", "v"), [by, "bucket"]).where((F.col("k") >= F.col("from")) & (F.col("k") < F.col("upto")))
    low, high, part = F.min("v"), F.max("v"), F.max(F.col("rank") - F.floor("rank"))
    each = found.groupBy(by, "name").agg((low + (high - low) * part).alias("value"))
    return each.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in at])
