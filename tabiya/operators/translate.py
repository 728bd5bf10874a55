"""Source records to search documents, each one select of built-in expressions; `keep` names columns to carry along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabiya.functions import games as g

TAGS = {"variant": "Variant", "event": "Event", "white": "White", "black": "Black", "white_fide_id": "WhiteFideId", "black_fide_id": "BlackFideId", "eco": "ECO", "opening": "Opening"}
RELEVANT_TAGS = ("Variant", "Event", "Round", "White", "Black", "WhiteFideId", "BlackFideId", "ECO", "Opening", "Annotator")
NO_CLOCK = -1


def _played() -> Column:
    return F.coalesce(F.col("moved_at"), F.col("created_at"))


def _elapsed() -> Column:
    return F.unix_seconds(_played()) - F.unix_seconds("created_at")


def games(records: DataFrame, *keep: str) -> DataFrame:
    """Game records (with bot flags and start number joined on) to game documents."""
    c = F.col
    limit, increment = g.clock_limit(c("clock")), g.clock_increment(c("clock"))
    return records.select(
        "_id", "status", g.turns(c("ply")).alias("turns"), F.coalesce("rated", F.lit(False)).alias("rated"),
        g.perf(F.coalesce("variant", F.lit(g.STANDARD)), g.speed(limit, increment)).alias("perf"), g.winner_color(c("white_won"), c("status")).alias("winner_color"),
        g.mean_rating(c("white_rating"), c("black_rating")).alias("average_rating"), F.coalesce("white_ai", "black_ai", F.lit(0)).alias("ai"), F.unix_seconds(_played()).alias("date"),
        g.duration(_elapsed(), limit.isNotNull()).alias("duration"), F.coalesce(limit, F.lit(NO_CLOCK)).alias("clock_init"),
        F.coalesce(increment, F.lit(NO_CLOCK)).alias("clock_inc"), F.coalesce("analysed", F.lit(False)).alias("analysed"), g.player(c("players"), 1).alias("white_user"),
        g.player(c("players"), 2).alias("black_user"), c("source"), "white_rating", "black_rating", "chess960_pos", "white_bot", "black_bot", *keep,
    )


def game_csv(records: DataFrame) -> DataFrame:
    """The exported row: what is missing is blank, and some rules differ from the document's."""
    c = F.col
    blank = lambda column: F.coalesce(column.cast("string"), F.lit(""))
    limit, increment = g.clock_limit(c("clock")), g.clock_increment(c("clock"))
    color = F.when(c("white_won"), 1).when(~c("white_won"), 2).otherwise(3)
    return records.select(
        "_id", "status", g.turns(c("ply")).alias("turns"), F.coalesce("rated", F.lit(False)).alias("rated"),
        g.perf(F.coalesce("variant", F.lit(g.STANDARD)), g.speed(limit, increment)).alias("perf"), blank(F.concat_ws(",", "players")).alias("uids"),
        blank(c("winner")).alias("winner"), blank(g.loser(c("players"), c("winner"))).alias("loser"), color.alias("winner_color"),
        g.export_rating(c("white_rating"), c("black_rating")).alias("average_rating"), blank(F.coalesce("white_ai", "black_ai")).alias("ai"),
        F.unix_millis(_played()).alias("date"), g.export_duration(_elapsed()).alias("duration"), blank(limit).alias("clock_init"),
        blank(increment).alias("clock_inc"), F.coalesce("analysed", F.lit(False)).alias("analysed"), g.player(c("players"), 1).alias("white_user"),
        g.player(c("players"), 2).alias("black_user"), blank(c("source")).alias("source"),
    )


def posts(records: DataFrame, *keep: str) -> DataFrame:
    return records.select("_id", F.col("text").alias("body"), "topic", "topic_id", F.col("user_id").alias("author"), "troll", F.unix_millis("created_at").alias("date"), *keep)


def _meaningful(text: Column, *nothing: str) -> Column:
    return F.when((F.trim(text) != "") & ~F.coalesce(text.isin(list(nothing)), F.lit(False)), text) if nothing else F.when(F.trim(text) != "", text)


def chapter_name(name: Column) -> Column:
    """Null for names that only number the chapter."""
    return F.when(~name.rlike(r"^Chapter \d+$"), name)


def tag_struct(tags: Column) -> Column:
    """Known tags of `Name:Value` strings, split at the first colon, the last of a name; null for an empty list."""
    last = lambda name: F.try_element_at(F.filter(tags, lambda t: t.startswith(f"{name}:")), F.lit(-1))
    value = lambda name: F.regexp_replace(last(name), "^[^:]*:", "")
    return F.when(F.size(tags) > 0, F.struct(*[value(name).alias(field) for field, name in TAGS.items()]))


def bad_tags(tags: Column) -> Column:
    """How many strings are no tags; to be counted, not to fail a record."""
    return F.size(F.filter(tags, lambda t: ~t.contains(":")))


def relevant_values(tags: Column) -> Column:
    kept = F.filter(tags, lambda t: F.substring_index(t, ":", 1).isin(list(RELEVANT_TAGS)) & t.contains(":"))
    return F.transform(kept, lambda t: F.regexp_replace(t, "^[^:]*:", ""))


def chapter(record: Column) -> Column:
    return F.struct(record["_id"].alias("id"), _meaningful(record["name"]).alias("name"), _meaningful(record["description"]).alias("description"), tag_struct(record["tags"]).alias("tags"))


def studies(records: DataFrame, *keep: str) -> DataFrame:
    shown = lambda column: F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    return records.select(
        "_id", "name", _meaningful(F.col("description"), "-").alias("description"), F.col("owner_id").alias("owner"), F.coalesce(F.map_keys("members"), F.array().cast("array<string>")).alias("members"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), F.transform("chapters", chapter).alias("chapters"), F.coalesce("likes", F.lit(0)).alias("likes"),
        F.coalesce(F.col("visibility") == "public", F.lit(False)).alias("public"), shown("rank").alias("rank"), shown("created_at").alias("created_at"), shown("updated_at").alias("updated_at"), *keep,
    )


def teams(records: DataFrame, *keep: str) -> DataFrame:
    return records.select("_id", "name", "description", F.col("nb_members").cast("short").alias("nb_members"), *keep)


def author(blog: Column) -> Column:
    """The part after `user:`."""
    return F.try_element_at(F.split(blog, ":"), F.lit(2))


def ublogs(records: DataFrame, *keep: str) -> DataFrame:
    c = F.col
    topics = F.replace(F.concat_ws(" ", "topics"), F.lit("Chess"), F.lit(""))
    text = F.concat_ws("\n", *[F.coalesce(part, F.lit("")) for part in (c("title"), topics, author(c("blog")), c("intro"), c("markdown"))])
    date = F.coalesce(F.unix_millis(c("lived.at")), F.lit(0))
    return records.select("_id", text.alias("text"), "language", c("likes").cast("short").alias("likes"), date.alias("date"), c("automod.quality").cast("short").alias("quality"), *keep)
