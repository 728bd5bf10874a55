"""Bounded scans of record tables and readers of change logs.

A time range is half open, [since, until). Scans are filters over Parquet (or any DataFrame), so ranges and columns
reach the files.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabiya.functions.games import eligible
from tabiya.functions.predicates import any_of, half_open
from tabiya.operators.changes import DELETE, action, last_per_document

Time = datetime | str
OPERATIONS = {"forum": ("delete", "insert", "replace", "update"), "team": ("delete", "insert", "replace", "update"), "ublog": ("delete", "insert", "replace", "update"), "game": ("update", "delete")}
MAX_POST = 5000


def touched(times: list[str], since: Time, until: Time | None = None) -> Column:
    """One of the times is in the range; plain comparisons, which reach the files."""
    return any_of([half_open(F.col(t), F.lit(since), None if until is None else F.lit(until)) for t in times])


def forum_posts(posts: DataFrame, since: Time, until: Time | None = None, longest: int = MAX_POST) -> DataFrame:
    rows = posts.where(touched(["created_at", "updated_at", "erased_at"], since, until)).where(F.length("text") <= longest)
    return rows.withColumn("action", action(F.lit("update"), F.col("erased_at").isNotNull()))


def teams(records: DataFrame, since: Time, until: Time | None = None) -> DataFrame:
    rows = records.where(touched(["created_at", "updated_at", "erased_at"], since, until))
    return rows.withColumn("action", action(F.lit("update"), ~F.col("enabled")))


def ublogs(records: DataFrame, since: Time, until: Time | None = None) -> DataFrame:
    rows = records.where(touched(["lived.at"], since, until))
    return rows.withColumn("action", action(F.lit("update"), ~F.col("live") | (F.col("automod.quality") == 0)))


def games(records: DataFrame, since: Time, until: Time | None = None, newest_first: bool = False) -> DataFrame:
    rows = records.where(touched(["created_at"], since, until)).where(eligible(F.col("status"), F.col("source"), F.col("players")))
    return rows.orderBy(F.col("created_at").desc(), "_id") if newest_first else rows


def is_broadcast(origin: Column) -> Column:
    return F.coalesce(origin.startswith("relay"), F.lit(False))


def studies(records: DataFrame, since: Time, until: Time | None = None) -> DataFrame:
    return records.where(touched(["created_at", "updated_at"], since, until)).where(~is_broadcast(F.col("origin")))


def deleted_studies(log: DataFrame, since: Time, until: Time | None = None, namespace: str = "study") -> DataFrame:
    """_id and ts (and seq, where the log has one) of studies deleted in the range."""
    rows = log.where(touched(["ts"], since, until) & F.col("ns").endswith(f".{namespace}") & (F.col("op") == "d"))
    return rows.select(F.col("o._id").alias("_id"), *[c for c in ("ts", "seq") if c in log.columns]).where("_id IS NOT NULL")


def study_likes(log: DataFrame, since: Time, until: Time | None = None, namespace: str = "study") -> DataFrame:
    """Partial updates of likes, and of rank where the entry has one; entries without id or likes are skipped."""
    rows = log.where(touched(["ts"], since, until) & F.col("ns").endswith(f".{namespace}") & (F.col("op") == "u"))
    found = rows.select(F.col("o2._id").alias("_id"), F.col("o.diff.u.likes").alias("likes"), F.col("o.diff.u.rank").alias("rank"), *[c for c in ("ts", "seq") if c in log.columns])
    return found.where("_id IS NOT NULL AND likes IS NOT NULL").select("*", F.lit(True).alias("has_likes"), F.col("rank").isNotNull().alias("has_rank"))


def change_log(spark: SparkSession, path: str, schema: StructType, stream: bool = False, file_format: str = "parquet", max_files: int = 100) -> DataFrame:
    """A folder of change events, as a table or a stream; update events carry the whole current document."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if stream else spark.read
    return reader.schema(schema).format(file_format).load(path)


def counted_games(events: DataFrame, parity: bool = False) -> Column:
    """Which events are changes of games that fit, or deletions (not with `parity`)."""
    doc, deletion = events["full_document"], events["op"] == DELETE
    fit = F.coalesce(eligible(doc["status"], doc["source"], doc["players"]), F.lit(False))
    return events["op"].isin(list(OPERATIONS["game"])) & (fit if parity else fit | deletion)


def game_changes(events: DataFrame, parity: bool = False) -> DataFrame:
    """Last change of each game as index or delete. With `parity` deletes are dropped, as a filter that asks for the
    state of a document that is gone would do."""
    return last_per_document(events.where(counted_games(events, parity))).withColumn("action", action(F.col("op"), F.lit(False)))


def counted(events: DataFrame, collection: str, longest: int | None = None) -> Column:
    """Which events are changes of the other collections; the length is asked of documents that are indexed."""
    known = events["op"].isin(list(OPERATIONS[collection]))
    return known if longest is None else known & ((events["op"] == DELETE) | (F.length(events["full_document"]["text"]) <= longest))


def changes(events: DataFrame, collection: str, dead: Column, longest: int | None = None) -> DataFrame:
    """Last change of each document of the other collections."""
    return last_per_document(events.where(counted(events, collection, longest))).withColumn("action", action(F.col("op"), dead))
