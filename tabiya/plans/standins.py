"""The driver's tables seen as the collections and logs that the library works on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.operators.fulltext import TextIndex
from tabiya.operators.search import ForumQuery, StudyQuery, TeamQuery, UblogQuery
from tabiya.sources.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query with the SQL of its result, if SQL can state it."""

        def register(run: Query) -> Query:
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return run

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> str:
    """Epoch seconds of a timestamp without time zone."""
    return f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))"


def ntz(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz")


#: Both engines read this text; {epoch} and {customers} differ.
GAME_COLUMNS = """
  CAST(o_orderkey AS STRING) AS _id,
  CASE o_orderkey % 6 WHEN 0 THEN 30 WHEN 1 THEN 31 WHEN 2 THEN 32 WHEN 3 THEN 34 WHEN 4 THEN 35 ELSE 39 END AS status,
  CAST(o_orderkey % 97 AS INT) AS turns, o_orderkey % 2 = 0 AS rated,
  CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 6 ELSE 11 END AS perf,
  CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS winner_color,
  CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 2800 AS INT) END AS average_rating,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 8 ELSE 0 END AS INT) AS ai, {epoch} AS date,
  CAST(o_orderkey % 7200 AS INT) AS duration, CAST((o_orderkey % 10) * 60 AS INT) AS clock_init, CAST(o_orderkey % 5 AS INT) AS clock_inc,
  o_orderkey % 3 = 0 AS analysed, CONCAT('u', CAST(o_custkey AS STRING)) AS white_user,
  CONCAT('u', CAST((o_orderkey * 31 + 7) % {customers} AS STRING)) AS black_user, CAST(o_orderkey % 8 AS INT) AS source
"""
GAMES_SQL = "WITH g AS (SELECT " + GAME_COLUMNS.format(epoch="CAST(floor(epoch(o_orderdate)) AS BIGINT)", customers="(SELECT count(*) FROM customer)") + " FROM orders) "


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").count()
    text = GAME_COLUMNS.format(epoch=seconds("o_orderdate"), customers=customers)
    orders = table(spark, sf_dir, "orders")
    orders.createOrReplaceTempView("tabiya_orders")
    return spark.sql(f"SELECT {text} FROM tabiya_orders")


def forum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those that are not labelled are shown to all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("body"), F.col("source").alias("topic"), F.col("lang").alias("author"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("troll"), F.col("doc_id").alias("date")
    )


FORUM_SQL = "WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS _id, text AS body, source AS topic, lang AS author, coalesce(toxic = 1, false) AS troll, doc_id AS date FROM documents LEFT JOIN labels USING (doc_id)) "


def blogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("_id"), "text", F.col("lang").alias("language"), F.col("n_chars").alias("likes"), (F.col("doc_id") * 1000).alias("date"), "quality"
    )


BLOGS_SQL = "WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS _id, text, lang AS language, n_chars AS likes, doc_id * 1000 AS date, quality FROM documents LEFT JOIN labels USING (doc_id)) "


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("description"), F.col("p_size").alias("nb_members"))


TEAMS_SQL = "WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS _id, p_name AS name, p_type || ' ' || p_brand AS description, p_size AS nb_members FROM part) "


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a study, its turns are chapters."""
    text, none = F.col("text"), F.lit(None).cast("string")
    tags = F.struct(
        F.col("role").alias("variant"), none.alias("event"), F.concat(F.lit("p"), F.col("turn") % 3).alias("white"), F.concat(F.lit("p"), (F.col("turn") + 1) % 3).alias("black"),
        none.alias("white_fide_id"), none.alias("black_fide_id"), F.concat(F.lit("B"), F.col("turn") % 10).alias("eco"), text.alias("opening"),
    )
    chapter = F.struct(F.col("turn").alias("turn"), F.col("turn").cast("string").alias("id"), F.col("role").alias("name"), text.alias("description"), tags.alias("tags"))
    by_study = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(chapter)).alias("chapters"), F.sort_array(F.collect_set("role")).alias("members"))
    k = F.col("conv_id")
    return by_study.select(
        k.cast("string").alias("_id"), F.concat(F.lit("Study "), (k * 7 % 13).cast("string")).alias("name"), F.element_at("chapters", 1)["description"].alias("description"), F.concat(F.lit("o"), k % 5).alias("owner"),
        "members", F.array(F.concat(F.lit("t"), k % 4)).alias("topics"), "chapters", F.size("chapters").alias("likes"), (k % 3 == 0).alias("public"),
        F.when(k % 2 == 0, k).alias("rank"), k.alias("created_at"), (k * 3 % 17).alias("updated_at"),
    )


STUDIES_SQL = """WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS _id, 'Study ' || CAST(conv_id * 7 % 13 AS VARCHAR) AS name, 'o' || CAST(conv_id % 5 AS VARCHAR) AS owner,
  list_sort(list(DISTINCT role)) AS members, count(*) AS likes, conv_id % 3 = 0 AS public, CASE WHEN conv_id % 2 = 0 THEN conv_id END AS rank, conv_id AS created_at, conv_id * 3 % 17 AS updated_at
  FROM conversations GROUP BY conv_id) """


def stored_index(spark: SparkSession, sf_dir: str, name: str) -> TextIndex:
    """The stored postings of a collection, built when they are first asked for in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        collection, query = INDEXED[name]
        _BUILT[key] = TextIndex(spark, new_path(spark, f"index-{name}"), query.index).build(collection(spark, sf_dir))
    return _BUILT[key]


_BUILT: dict[tuple[str, str, str], TextIndex] = {}
INDEXED = {"forum": (forum, ForumQuery), "team": (teams, TeamQuery), "ublog": (blogs, UblogQuery), "study": (studies, StudyQuery)}


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a change log: the user is the document."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("cluster_time"), F.col("event_id").alias("seq"), op.alias("op"), "value", "event_type")


CHANGES_SQL = """WITH c AS (SELECT user_id AS doc_id, ts AS cluster_time, event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, value, event_type FROM events),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cluster_time DESC, seq DESC) = 1) """
