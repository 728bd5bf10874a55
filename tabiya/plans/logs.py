"""Queries over change logs: last changes, batches applied, scans, streams, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabiya.functions.games import eligible
from tabiya.operators import changes as ch
from tabiya.operators.enrich import bot_accounts, looked_up, with_bot_flags, with_chapters, with_topic
from tabiya.plans.standins import CHANGES_SQL, GAMES_SQL, Catalogue, change_events, games, ntz, table
from tabiya.sources import scans
from tabiya.sources.shared import new_path
from tabiya.sources.sinks import latency_histogram, quantiles
from tabiya.streaming.collection import Collection
from tabiya.streaming.ingest import ingest

CATALOGUE = Catalogue()
query = CATALOGUE.query


@query("last_change_per_id", CHANGES_SQL + "SELECT doc_id, seq, op, value FROM l")
def last_change_per_id(spark, d):
    return ch.last_per_document(change_events(spark, d)).select("doc_id", "seq", "op", "value")


@query("liveness_split", CHANGES_SQL + "SELECT doc_id, CASE WHEN op = 'delete' OR value < 5 THEN 'delete' ELSE 'index' END AS action FROM l")
def liveness_split(spark, d):
    last = ch.last_per_document(change_events(spark, d))
    return last.select("doc_id", ch.action(F.col("op"), F.col("value") < 5).alias("action"))


def _base(spark, d):
    """All accounts are there before the changes; the log has others too."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_acctbal").alias("value"), F.lit(0).cast("long").alias("likes"))


BASE_SQL = "b AS (SELECT c_custkey AS _id, c_acctbal AS value, 0::BIGINT AS likes FROM customer)"


@query("apply_changes", CHANGES_SQL + f""", {BASE_SQL},
u AS (SELECT doc_id AS _id, value, seq AS likes FROM l WHERE op = 'insert'), p AS (SELECT doc_id AS _id, seq AS likes, value > 50 AS has_likes FROM l WHERE op = 'update'), x AS (SELECT doc_id AS _id FROM l WHERE op = 'delete'),
n AS (SELECT * FROM b WHERE _id NOT IN (SELECT _id FROM u) UNION ALL SELECT * FROM u)
SELECT n._id, n.value, CASE WHEN coalesce(has_likes, false) THEN p.likes ELSE n.likes END AS likes FROM n LEFT JOIN p ON n._id = p._id WHERE n._id NOT IN (SELECT _id FROM x)""")
def apply_changes(spark, d):
    """Inserts replace whole documents, updates set `likes` where given, errors delete."""
    last = ch.last_per_document(change_events(spark, d)).withColumnRenamed("doc_id", "_id")
    ups = last.where("op = 'insert'").select("_id", "value", F.col("seq").alias("likes"))
    parts = last.where("op = 'update'").select("_id", F.col("seq").alias("likes"), (F.col("value") > 50).alias("has_likes"))
    return ch.apply_changes(_base(spark, d), ups, parts, last.where("op = 'delete'").select("_id"), ["likes"])


@query("stream_apply_changes", CHANGES_SQL + "SELECT doc_id AS _id, value, seq AS version FROM l WHERE op <> 'delete'")
def stream_apply_changes(spark, d):
    """The change log as a stream, worked off in micro-batches; the collection's documents afterwards."""
    folder = new_path(spark, "stream")
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    events = raw.select(F.col("user_id").alias("doc_id"), F.col("ts").alias("cluster_time"), F.col("event_id").alias("seq"), op.alias("op"), "value")
    document = "_id long, value double, shown long, version struct<t:timestamp_ntz,seq:long>, deleted boolean"
    collection = Collection(spark, f"{folder}/users", spark.createDataFrame([], document).schema)

    def translate(last):
        version = F.struct(F.col("cluster_time").cast("timestamp_ntz").alias("t"), "seq").alias("version")
        return last.select(F.col("doc_id").alias("_id"), "value", F.col("seq").alias("shown"), version, F.when(F.col("op") == "delete", ch.DELETE).otherwise(ch.INDEX).alias("action"))

    ingest(events, collection, translate, f"{folder}/checkpoint").awaitTermination()
    return collection.documents().select("_id", "value", F.col("shown").alias("version"))


@query("interval_counts", "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def interval_counts(spark, d):
    rows = table(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("backfill_scan", "SELECT o_orderkey FROM orders WHERE (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-03-01') OR (o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1995-01-01' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1995-03-01')")
def backfill_scan(spark, d):
    rows = table(spark, d, "orders").withColumn("updated_at", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return rows.where(scans.touched(["o_orderdate", "updated_at"], ntz("1995-01-01"), ntz("1995-03-01"))).select("o_orderkey")


@query("backfill_open", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def backfill_open(spark, d):
    return table(spark, d, "events").where(scans.touched(["ts"], ntz("2024-01-20"))).select("event_id")


def _oplog(spark, d):
    """Events as log entries with nested documents; likes are in the event's JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    diff = F.struct(F.struct(F.when(kind != "view", k).alias("likes"), F.when(kind == "purchase", F.col("event_id")).alias("rank")).alias("u")).alias("diff")
    return table(spark, d, "events").select(
        "ts", F.concat(F.lit("db."), F.when(F.col("user_id") % 4 == 0, "team").otherwise("study")).alias("ns"), F.when(kind == "error", "d").when(kind == "signup", "i").otherwise("u").alias("op"),
        F.struct(F.when(kind == "error", F.col("user_id")).alias("_id"), diff).alias("o"), F.struct(F.col("user_id").alias("_id")).alias("o2"),
    )


SINCE, UNTIL = "2024-01-05", "2024-01-25"
RANGE_SQL = f"ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}' AND user_id % 4 <> 0"


@query("delete_log", f"SELECT user_id AS _id FROM events WHERE {RANGE_SQL} AND event_type = 'error'")
def delete_log(spark, d):
    return scans.deleted_studies(_oplog(spark, d), ntz(SINCE), ntz(UNTIL)).select("_id")


@query("likes_partial", f"""SELECT user_id AS _id, CAST(json_extract_string(props, '$.k') AS INT) AS likes, CASE WHEN event_type = 'purchase' THEN event_id END AS rank, true AS has_likes, event_type = 'purchase' AS has_rank
FROM events WHERE {RANGE_SQL} AND event_type IN ('click', 'purchase')""")
def likes_partial(spark, d):
    return scans.study_likes(_oplog(spark, d), ntz(SINCE), ntz(UNTIL)).select("_id", "likes", "rank", "has_likes", "has_rank")


@query("action_counts", CHANGES_SQL + "SELECT CASE WHEN op = 'delete' THEN 'delete' ELSE 'index' END AS action, count(*) AS n FROM c GROUP BY ALL")
def action_counts(spark, d):
    return ch.action_counts(change_events(spark, d).withColumn("action", ch.action(F.col("op"), F.lit(False))))


@query("dry_run", CHANGES_SQL + "SELECT CASE WHEN op = 'delete' THEN 'delete' ELSE 'index' END AS action, count(*) AS n FROM l GROUP BY ALL")
def dry_run(spark, d):
    return ch.action_counts(scans.changes(change_events(spark, d), "forum", F.lit(False)))


GAME_EVENTS_SQL = """, e AS (SELECT *, CASE WHEN op = 'delete' THEN NULL ELSE 28 + CAST(seq % 6 AS INT) END AS status, CASE WHEN seq % 9 > 0 THEN CAST(seq % 9 AS INT) END AS source, seq % 11 > 0 AS played FROM c)
SELECT doc_id, op, action FROM (SELECT *, CASE WHEN op = 'delete' THEN 'delete' ELSE 'index' END AS action FROM e
  WHERE op = 'delete' OR (op = 'update' AND status >= 30 AND (source IS NULL OR source <> 7) AND played)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cluster_time DESC, seq DESC) = 1"""


@query("game_operations", CHANGES_SQL + GAME_EVENTS_SQL)
def game_operations(spark, d):
    """Updates carry the whole current document, deletions none; unfit documents don't count as changes."""
    seq = F.col("seq")
    doc = F.struct((28 + seq % 6).cast("int").alias("status"), F.when(seq % 9 > 0, (seq % 9).cast("int")).alias("source"), F.when(seq % 11 > 0, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("players"))
    events = change_events(spark, d).withColumn("full_document", F.when(F.col("op") != "delete", doc))
    return scans.game_changes(events).select("doc_id", "op", "action")


@query("batch_time", CHANGES_SQL + "SELECT strftime(max(cluster_time), '%Y-%m-%d %H:%M:%S') AS latest, strftime(arg_max(cluster_time, seq), '%Y-%m-%d %H:%M:%S') AS of_last FROM c")
def batch_time(spark, d):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return ch.batch_time(change_events(spark, d)).select(shown("latest"), shown("of_last"))


@query("merged_actions", f"""SELECT 'delete' AS action, user_id AS _id, NULL::INT AS likes FROM events WHERE {RANGE_SQL} AND event_type = 'error'
UNION ALL SELECT 'update', user_id, CAST(json_extract_string(props, '$.k') AS INT) FROM events WHERE {RANGE_SQL} AND event_type IN ('click', 'purchase')
UNION ALL SELECT 'index', c_custkey, NULL FROM customer""")
def merged_actions(spark, d):
    """Three streams of one interval as one, split and put together again."""
    since, until = ntz(SINCE), ntz(UNTIL)
    log = _oplog(spark, d)
    index = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"))
    one = ch.merged(delete=scans.deleted_studies(log, since, until).select("_id"), update=scans.study_likes(log, since, until).select("_id", "likes"), index=index)
    return ch.merged(**ch.split_actions(one)).select("action", "_id", "likes")


@query("lookup_keys", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def lookup_keys(spark, d):
    batch = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return looked_up(table(spark, d, "customer").select("c_custkey", "c_name"), batch, "o_custkey", "c_custkey")


@query("topic_join", "SELECT doc_id, 'Topic ' || source AS topic FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'de' AND n_chars > 2000)")
def topic_join(spark, d):
    docs = table(spark, d, "documents")
    topics = docs.where("lang = 'de' AND n_chars > 2000").select(F.col("source").alias("_id")).distinct().withColumn("name", F.concat(F.lit("Topic "), "_id"))
    return with_topic(docs.select("doc_id", F.col("source").alias("topic_id")), topics).select("doc_id", "topic")


@query("chapters_left_join", "SELECT o_orderkey, (SELECT string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY l_partkey, l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS chapters FROM orders")
def chapters_left_join(spark, d):
    chapters = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "study_id")
    rows = with_chapters(table(spark, d, "orders").select(F.col("o_orderkey").alias("_id")), chapters, F.struct("l_partkey", "l_suppkey"))
    shown = F.array_join(F.transform("chapters", lambda c: F.concat(c["l_partkey"].cast("string"), F.lit(":"), c["l_suppkey"].cast("string"))), ",")
    return rows.select(F.col("_id").alias("o_orderkey"), shown.alias("chapters"))


@query("bot_flag", GAMES_SQL + ", a AS (SELECT 'u' || c_custkey AS _id FROM customer WHERE c_mktsegment = 'MACHINERY') SELECT _id, white_user IN (SELECT _id FROM a) AS white_bot, black_user IN (SELECT _id FROM a) AS black_bot FROM g")
def bot_flag(spark, d):
    accounts = table(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "BOT").alias("title"))
    return with_bot_flags(games(spark, d), bot_accounts(accounts)).select("_id", "white_bot", "black_bot")


@query("eligibility", GAMES_SQL + "SELECT _id FROM g WHERE status >= 31 - CAST(_id AS INT) % 2 AND (NULLIF(source, 0) <> 7 OR NULLIF(source, 0) IS NULL) AND status >= 30")
def eligibility(spark, d):
    rows = games(spark, d).withColumn("source", F.expr("nullif(source, 0)"))
    players = F.when(F.col("white_user") != "", F.array("white_user", "black_user"))
    return rows.where(eligible(F.col("status"), F.col("source"), players)).where(F.col("status") >= 31 - F.col("_id").cast("int") % 2).select("_id")


@query("latency_histogram", """SELECT event_type AS operation, CAST(user_id % 3 AS INT) AS error, CAST(len(list_filter([5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000], lambda e: CAST(floor(value * 10) AS BIGINT) > e)) AS INT) AS bucket,
  count(*) AS n, CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL""")
def latency_histogram_query(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("operation"), (F.col("user_id") % 3).cast("int").alias("error"), F.floor(F.col("value") * 10).alias("millis"))
    return latency_histogram(log)


@query("latency_quantiles", "SELECT event_type AS operation, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_quantiles(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("operation"), "value")
    return quantiles(log, "value", {"median": 0.5, "p99": 0.99}, by="operation").select("operation", F.round("median", 6).alias("median"), F.round("p99", 6).alias("p99"))
