"""Lookup joins that complete records before they are translated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accounts that may be broadcast.
BROADCAST_ACCOUNTS = 1_000_000


def with_topic(posts: DataFrame, topics: DataFrame) -> DataFrame:
    """Posts with the name of their topic; posts of unknown topics go. The sides' sizes decide the join."""
    return posts.join(topics.select(F.col("_id").alias("topic_id"), F.col("name").alias("topic")), "topic_id")


def with_chapters(studies: DataFrame, chapters: DataFrame, chapter: Column) -> DataFrame:
    """Studies with the sorted list of their chapters, null where there is none."""
    lists = chapters.groupBy(F.col("study_id").alias("_id")).agg(F.sort_array(F.collect_list(chapter)).alias("chapters"))
    return studies.join(lists, "_id", "left")


def looked_up(lookup: DataFrame, batch: DataFrame, key: str, lookup_key: str = "_id") -> DataFrame:
    """The part of a lookup table that a batch needs."""
    return lookup.join(batch.select(F.col(key).alias(lookup_key)).distinct(), lookup_key, "left_semi")


def bot_accounts(accounts: DataFrame) -> DataFrame:
    """Distinct ids of bot accounts; a table without any is an error, as it would mark every bot as human."""
    bots = accounts.where(F.col("title") == "BOT").select("_id").distinct()
    if bots.isEmpty():
        raise ValueError("no bot account found")
    return bots


def with_bot_flags(games: DataFrame, bots: DataFrame) -> DataFrame:
    """white_bot and black_bot; no name is never a bot."""
    n = bots.limit(BROADCAST_ACCOUNTS + 1).count()
    small = F.broadcast if n <= BROADCAST_ACCOUNTS else (lambda frame: frame)
    for side in ("white", "black"):
        flag = small(bots.where("_id <> ''").select(F.col("_id").alias(f"{side}_user"), F.lit(True).alias(f"{side}_bot")))
        games = games.join(flag, f"{side}_user", "left").withColumn(f"{side}_bot", F.coalesce(f"{side}_bot", F.lit(False)))
    return games
