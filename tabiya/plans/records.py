"""Queries of record translation and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabiya.functions import games as g
from tabiya.operators import translate as tr
from tabiya.operators.enrich import bot_accounts, with_bot_flags
from tabiya.plans.standins import Catalogue, table
from tabiya.sources.scans import is_broadcast
from tabiya.sources.shared import new_path
from tabiya.sources.sinks import write_csv

CATALOGUE = Catalogue()
query = CATALOGUE.query

#: Both engines read this text: game records made from orders. {ts} casts whole seconds to a timestamp.
RECORD = """
  CAST(k AS STRING) AS _id, CAST(CASE k % 5 WHEN 0 THEN 30 WHEN 1 THEN 32 WHEN 2 THEN 34 WHEN 3 THEN 38 ELSE 20 END AS INT) AS status, CAST(k % 200 AS INT) AS ply,
  CASE WHEN k % 4 <> 0 THEN k % 4 = 1 END AS rated, CAST(CASE WHEN k % 12 > 0 THEN k % 12 END AS INT) AS variant, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS white_won,
  CAST(CASE WHEN k % 5 <> 0 THEN 1000 + k % 1500 END AS INT) AS white_rating, CAST(CASE WHEN k % 7 <> 0 THEN 900 + k % 1700 END AS INT) AS black_rating,
  CAST(CASE WHEN k % 11 = 0 THEN k % 8 END AS INT) AS white_ai, CAST(CASE WHEN k % 13 = 0 THEN k % 9 END AS INT) AS black_ai,
  CAST(CASE WHEN k % 8 > 0 THEN k % 8 END AS INT) AS source, CASE WHEN k % 6 > 0 THEN k % 6 = 1 END AS analysed,
  CONCAT('w', CAST(k % 90 AS STRING)) AS p1, CASE WHEN k % 10 > 0 THEN CONCAT('b', CAST(k % 80 AS STRING)) END AS p2,
  CASE k % 3 WHEN 0 THEN CONCAT('w', CAST(k % 90 AS STRING)) WHEN 1 THEN CONCAT('b', CAST(k % 80 AS STRING)) END AS winner,
  CAST(k % 256 AS INT) AS byte1, CAST(k % 60 AS INT) AS byte2, k % 9 > 0 AS clocked, CASE WHEN k % 10 > 1 THEN 1000000000 + k * 60 + (k % 50000) - 10 END AS moved, 1000000000 + k * 60 AS created
"""
RECORDS_SQL = f"""WITH o AS (SELECT o_orderkey AS k FROM orders), r AS (SELECT {RECORD} FROM o),
q AS (SELECT *, CASE WHEN clocked THEN CASE WHEN byte1 < 181 THEN byte1 * 60 ELSE (byte1 - 180) * 15 END END AS lim, CASE WHEN clocked THEN byte2 END AS inc,
  coalesce(moved, created) - created AS elapsed FROM r),
v AS (SELECT *, CASE WHEN lim IS NULL THEN 'correspondence' WHEN lim + 40 * inc < 30 THEN 'ultraBullet' WHEN lim + 40 * inc < 180 THEN 'bullet' WHEN lim + 40 * inc < 480 THEN 'blitz' WHEN lim + 40 * inc < 1500 THEN 'rapid'
  WHEN lim + 40 * inc < 21600 THEN 'classical' ELSE 'correspondence' END AS speed FROM q),
p AS (SELECT *, CASE coalesce(variant, 1) WHEN 2 THEN 11 WHEN 4 THEN 12 WHEN 5 THEN 15 WHEN 6 THEN 13 WHEN 7 THEN 14 WHEN 8 THEN 16 WHEN 9 THEN 17 WHEN 10 THEN 18
  ELSE CASE speed WHEN 'ultraBullet' THEN 0 WHEN 'bullet' THEN 1 WHEN 'blitz' THEN 2 WHEN 'classical' THEN 3 WHEN 'correspondence' THEN 4 ELSE 6 END END AS perf FROM v) """


def records(spark, d):
    table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).createOrReplaceTempView("tabiya_keys")
    rows = spark.sql(f"SELECT {RECORD} FROM tabiya_keys")
    two = F.unhex(F.concat(F.lpad(F.hex("byte1"), 2, "0"), F.lpad(F.hex("byte2"), 2, "0")))
    ranks = g.start_positions(spark).select(F.col("number").alias("start"), F.col("rank").alias("back_rank"))  # 960 rows
    rows = rows.withColumn("start", F.when(F.col("variant") == 2, (F.col("created") / 60 % 960).cast("int"))).join(F.broadcast(ranks), "start", "left")
    return rows.select(
        "*", F.when(F.col("clocked"), two).otherwise(F.unhex(F.lit("05"))).alias("clock"), F.array_compact(F.array("p1", "p2")).alias("players"),
        F.timestamp_seconds("moved").alias("moved_at"), F.timestamp_seconds("created").alias("created_at"),
    )


DOCUMENT_SQL = """_id, status, CAST((ply + 1) // 2 AS INT) AS turns, coalesce(rated, false) AS rated, perf,
  CASE WHEN white_won THEN 1 WHEN NOT white_won THEN 2 WHEN status > 32 AND status <> 38 THEN 3 ELSE 0 END AS winner_color,
  CASE WHEN white_rating > 0 AND black_rating > 0 THEN (white_rating + black_rating) // 2 ELSE 0 END AS average_rating, coalesce(white_ai, black_ai, 0) AS ai, coalesce(moved, created) AS date,
  CAST(CASE WHEN lim IS NULL OR elapsed <= 0 THEN 0 WHEN elapsed < 43200 THEN elapsed ELSE 43201 END AS INT) AS duration, coalesce(lim, -1) AS clock_init, coalesce(inc, -1) AS clock_inc,
  coalesce(analysed, false) AS analysed, p1 AS white_user, coalesce(p2, '') AS black_user, source, white_rating, black_rating, CASE WHEN variant = 2 THEN CAST(created // 60 % 960 AS INT) ELSE 1000 END AS chess960_pos,
  p1 IN (SELECT _id FROM bots) AS white_bot, coalesce(p2 IN (SELECT _id FROM bots), false) AS black_bot"""
BOTS_SQL = ", bots AS (SELECT (CASE WHEN c_custkey % 2 = 0 THEN 'w' ELSE 'b' END) || (c_custkey % 100) AS _id FROM customer WHERE c_mktsegment = 'MACHINERY') "


def accounts(spark, d):
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "w").otherwise("b"), (F.col("c_custkey") % 100).cast("string"))
    return table(spark, d, "customer").select(name.alias("_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "BOT").alias("title"))


@query("game_translate", RECORDS_SQL + BOTS_SQL + f"SELECT {DOCUMENT_SQL} FROM p")
def game_translate(spark, d):
    rows = records(spark, d).withColumn("white_user", F.col("p1")).withColumn("black_user", F.coalesce("p2", F.lit("")))
    return tr.games(with_bot_flags(g.with_start_number(rows), bot_accounts(accounts(spark, d))))


CSV_SQL = """_id, status, CAST((ply + 1) // 2 AS INT) AS turns, coalesce(rated, false) AS rated, perf, concat_ws(',', p1, p2) AS uids, coalesce(winner, '') AS winner,
  coalesce(CASE WHEN p1 IS DISTINCT FROM winner THEN p1 ELSE p2 END, '') AS loser, CASE WHEN white_won THEN 1 WHEN NOT white_won THEN 2 ELSE 3 END AS winner_color,
  CASE WHEN white_rating IS NULL AND black_rating IS NULL THEN '' ELSE CAST((coalesce(white_rating, 1500) + coalesce(black_rating, 1500)) // 2 AS VARCHAR) END AS average_rating,
  coalesce(CAST(coalesce(white_ai, black_ai) AS VARCHAR), '') AS ai, coalesce(moved, created) * 1000 AS date, CASE WHEN elapsed < 43200 THEN CAST(elapsed AS VARCHAR) ELSE '' END AS duration,
  coalesce(CAST(lim AS VARCHAR), '') AS clock_init, coalesce(CAST(inc AS VARCHAR), '') AS clock_inc, coalesce(analysed, false) AS analysed, p1 AS white_user, coalesce(p2, '') AS black_user, coalesce(CAST(source AS VARCHAR), '') AS source"""


@query("csv_rating_rules", RECORDS_SQL + f"SELECT {CSV_SQL} FROM p")
def csv_rating_rules(spark, d):
    return tr.game_csv(records(spark, d))


@query("csv_export", RECORDS_SQL + f"SELECT _id, average_rating, uids, loser, duration, clock_init FROM (SELECT {CSV_SQL} FROM p WHERE status >= 30)")
def csv_export(spark, d):
    """Written as CSV and read back."""
    path = new_path(spark, "csv")
    rows = tr.game_csv(records(spark, d).where(F.col("status") >= g.FINISHED))
    write_csv(rows, path)
    back = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in rows.columns)).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("_id", "average_rating", "uids", "loser", "duration", "clock_init")])


@query("duration_cap", RECORDS_SQL + "SELECT _id, CAST(CASE WHEN lim IS NULL OR elapsed <= 0 THEN 0 WHEN elapsed < 43200 THEN elapsed ELSE 43201 END AS INT) AS duration FROM p")
def duration_cap(spark, d):
    elapsed = F.coalesce("moved", "created") - F.col("created")
    return records(spark, d).select("_id", g.duration(elapsed, F.col("clocked")).alias("duration"))


@query("avg_rating_rules", RECORDS_SQL + "SELECT _id, CASE WHEN white_rating > 0 AND black_rating > 0 THEN (white_rating + black_rating) // 2 ELSE 0 END AS average_rating FROM p")
def avg_rating_rules(spark, d):
    return records(spark, d).select("_id", g.mean_rating(F.col("white_rating"), F.col("black_rating")).alias("average_rating"))


@query("clock_decode", RECORDS_SQL + "SELECT _id, lim AS clock_limit, inc AS clock_increment FROM p")
def clock_decode(spark, d):
    return records(spark, d).select("_id", g.clock_limit(F.col("clock")).alias("clock_limit"), g.clock_increment(F.col("clock")).alias("clock_increment"))


@query("speed_class", RECORDS_SQL + "SELECT speed, count(*) AS n FROM p GROUP BY speed")
def speed_class(spark, d):
    name = g.speed(g.clock_limit(F.col("clock")), g.clock_increment(F.col("clock")))
    return records(spark, d).groupBy(name.alias("speed")).agg(F.count("*").alias("n"))


@query("perf_map", RECORDS_SQL + "SELECT _id, perf FROM p")
def perf_map(spark, d):
    speed = g.speed(g.clock_limit(F.col("clock")), g.clock_increment(F.col("clock")))
    return records(spark, d).select("_id", g.perf(F.coalesce("variant", F.lit(1)), speed).alias("perf"))


@query("start_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 1000 ELSE CAST(o_orderkey % 960 AS INT) END AS chess960_pos FROM orders")
def start_number(spark, d):
    """Back ranks of known start positions, numbered again; some orders have none."""
    ranks = g.start_positions(spark)
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 960).cast("int")).alias("number"))
    rows = rows.join(F.broadcast(ranks), "number", "left").select("o_orderkey", F.col("rank").alias("back_rank"))
    return g.with_start_number(rows).select("o_orderkey", "chess960_pos")


@query("forum_translate", "SELECT CAST(doc_id AS VARCHAR) AS _id, text AS body, 'T' || source AS topic, source AS topic_id, lang AS author, n_chars > 3000 AS troll, (1000000000 + doc_id) * 1000 AS date FROM documents")
def forum_translate(spark, d):
    docs = table(spark, d, "documents")
    posts = docs.select(F.col("doc_id").cast("string").alias("_id"), "text", F.concat(F.lit("T"), "source").alias("topic"), F.col("source").alias("topic_id"), F.col("lang").alias("user_id"), (F.col("n_chars") > 3000).alias("troll"), F.timestamp_seconds(1000000000 + F.col("doc_id")).alias("created_at"))
    return tr.posts(posts)


@query("team_translate", "SELECT CAST(p_partkey AS VARCHAR) AS _id, p_name AS name, p_type AS description, CAST(p_size AS SMALLINT) AS nb_members FROM part")
def team_translate(spark, d):
    return tr.teams(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_size").alias("nb_members")))


@query("ublog_text", """SELECT CAST(doc_id AS VARCHAR) AS _id, source || chr(10) || replace('Chess ' || lang || ' Chess' || source, 'Chess', '') || chr(10) || lang || chr(10) || '' || chr(10) || text AS text, lang AS language,
  CAST(n_chars % 30000 AS SMALLINT) AS likes, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (1000000000 + doc_id) * 1000 END AS date, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 END AS SMALLINT) AS quality FROM documents""")
def ublog_text(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        k.cast("string").alias("_id"), F.col("source").alias("title"), F.lit("").alias("intro"), F.col("text").alias("markdown"), F.concat(F.lit("user:"), "lang").alias("blog"), F.col("lang").alias("language"),
        (F.col("n_chars") % 30000).alias("likes"), F.array(F.lit("Chess"), F.col("lang"), F.concat(F.lit("Chess"), "source")).alias("topics"), F.struct(F.when(k % 3 != 0, F.timestamp_seconds(1000000000 + k)).alias("at")).alias("lived"),
        F.struct(F.when(k % 2 == 0, k % 4).alias("quality")).alias("automod"),
    )
    return tr.ublogs(rows)


def _study_records(spark, d):
    k, text = F.col("doc_id"), F.col("text")
    tags = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("ECO:A"), (k % 10).cast("string")), F.concat(F.lit("Opening:"), "lang", F.lit(": b")), F.concat(F.lit("ECO:C"), (k % 7).cast("string")), F.lit("broken"), F.lit("Round:3")))
    chapter = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("_id"), F.when(k % 2 == 0, F.concat(F.lit("Chapter "), (k % 30).cast("string"))).otherwise(F.concat(F.lit("On "), "source")).alias("name"), F.when(k % 3 == 0, " ").otherwise(text).alias("description"), tags.alias("tags"))
    return table(spark, d, "documents").select(
        k.cast("string").alias("_id"), F.concat(F.lit("S "), "source").alias("name"), F.when(k % 5 == 0, "-").when(k % 5 == 1, "  ").otherwise(text).alias("description"), F.col("lang").alias("owner_id"),
        F.create_map(F.lit("m1"), F.lit("r"), F.col("source"), F.lit("w")).alias("members"), F.when(k % 2 == 0, F.array("lang", "source")).alias("topics"), F.array(chapter).alias("chapters"),
        F.when(k % 6 != 0, (k % 100).cast("int")).alias("likes"), F.when(k % 3 == 0, "public").when(k % 3 == 1, "private").alias("visibility"), F.when(k % 2 == 0, F.timestamp_seconds(1000000000 + k)).alias("rank"),
        F.timestamp_seconds(1000000000 + k).alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.when(k % 8 == 0, "relay x").when(k % 8 == 1, "scratch").alias("origin"),
    )


@query("study_translate", """WITH d AS (SELECT doc_id AS k, source, lang, text AS t FROM documents)
SELECT CAST(k AS VARCHAR) AS _id, 'S ' || source AS name, CASE WHEN k % 5 <= 1 OR trim(t) = '' OR t = '-' THEN NULL ELSE t END AS description, lang AS owner, 'm1,' || source AS members, CASE WHEN k % 2 = 0 THEN lang || ',' || source ELSE '' END AS topics,
  CAST(coalesce(CASE WHEN k % 6 <> 0 THEN k % 100 END, 0) AS INT) AS likes, k % 3 = 0 AS public, CASE WHEN k % 2 = 0 THEN strftime(make_timestamp((1000000000 + k) * 1000000), '%Y-%m-%d %H:%M:%S') END AS rank,
  strftime(make_timestamp((1000000000 + k) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at, NULL::VARCHAR AS updated_at, 'c' || k AS chapter_id, CASE WHEN k % 3 = 0 OR trim(t) = '' THEN NULL ELSE t END AS chapter_description,
  CASE WHEN k % 4 <> 0 THEN 'C' || (k % 7) END AS eco, CASE WHEN k % 4 <> 0 THEN lang || ': b' END AS opening, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS bad_tags,
  CASE WHEN k % 4 = 0 THEN '' ELSE 'A' || (k % 10) || '|' || lang || ': b|C' || (k % 7) || '|3' END AS relevant, CASE WHEN k % 2 = 1 THEN 'On ' || source END AS meaningful_name FROM d WHERE NOT k % 8 = 0""")
def study_translate(spark, d):
    source = _study_records(spark, d).where(~is_broadcast(F.col("origin")))
    extra = source.select("_id", tr.bad_tags(F.col("chapters")[0]["tags"]).alias("bad_tags"), F.array_join(tr.relevant_values(F.col("chapters")[0]["tags"]), "|").alias("relevant"), tr.chapter_name(F.col("chapters")[0]["name"]).alias("meaningful_name"))
    c = F.col("chapters")[0]
    return tr.studies(source).join(extra, "_id").select(
        "_id", "name", "description", "owner", F.array_join("members", ",").alias("members"), F.array_join("topics", ",").alias("topics"), "likes", "public", "rank", "created_at", "updated_at",
        c["id"].alias("chapter_id"), c["description"].alias("chapter_description"), c["tags"]["eco"].alias("eco"), c["tags"]["opening"].alias("opening"), "bad_tags", "relevant", "meaningful_name",
    )
