"""Queries of whole collection jobs: records scanned or streamed, completed by lookups, translated and applied."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabiya.functions.analysis import standard_query
from tabiya.operators import fulltext, translate as tr
from tabiya.operators.changes import DELETE, INDEX, UPDATE
from tabiya.operators.fulltext import TextIndex
from tabiya.operators.search import UblogQuery
from tabiya.plans.records import BOTS_SQL, CSV_SQL, DOCUMENT_SQL, RECORDS_SQL, accounts, records
from tabiya.plans.standins import CHANGES_SQL, Catalogue, change_events, table
from tabiya.plans.texts import bm25_sql
from tabiya.sources import scans
from tabiya.sources.collections import SPECS, create, write
from tabiya.sources.shared import new_path
from tabiya.sources.sinks import export_stream, exported
from tabiya.streaming import jobs
from tabiya.streaming.collection import Collection
from tabiya.streaming.guard import Guard
from tabiya.streaming.ingest import ingest, run_all

CATALOGUE = Catalogue()
query = CATALOGUE.query

#: Seconds since 1970 at which the stand-ins begin; the range that jobs are asked for, and a time inside it.
START, DAY = 1_000_000_000, 86_400
LOW, MIDDLE, HIGH = START + 3600, START + DAY, START + 3 * DAY
at = lambda seconds: F.lit(datetime.fromtimestamp(seconds, timezone.utc))
TIMES_SQL = f"""{START} + k * 60 AS created, CASE WHEN k % 3 = 0 THEN {START} + k * 60 + {DAY} END AS updated, CASE WHEN k % 7 = 0 THEN {START} + k * 60 + 2 * {DAY} END AS erased"""
IN_RANGE_SQL = " OR ".join(f"({t} >= {LOW} AND {t} < {HIGH})" for t in ("created", "updated", "erased"))


def _times(k):
    created = F.lit(START) + k * 60
    later = lambda every, days: F.timestamp_seconds(F.when(k % every == 0, created + days * DAY))
    return [F.timestamp_seconds(created).alias("created_at"), later(3, 1).alias("updated_at"), later(7, 2).alias("erased_at")]


def _tables(spark, d):
    """The sources of all jobs, by name."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def posts():
        return docs.select(k.cast("string").alias("_id"), "text", F.col("source").alias("topic_id"), (F.col("n_chars") > 3000).alias("troll"), F.col("lang").alias("user_id"), *_times(k))

    def topics():
        return docs.select(F.col("source").alias("_id")).distinct().where("_id <> 'src3'").withColumn("name", text("T", F.col("_id")))

    def teams():
        n = F.col("p_partkey")
        return table(spark, d, "part").select(n.cast("string").alias("_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_size").alias("nb_members"), (n % 5 != 0).alias("enabled"), *_times(n))

    def ublogs():
        return docs.select(
            k.cast("string").alias("_id"), F.col("source").alias("title"), F.lit("").alias("intro"), F.col("text").alias("markdown"), text("user:", F.col("lang")).alias("blog"), F.col("lang").alias("language"),
            (F.col("n_chars") % 30000).alias("likes"), F.array(F.col("lang")).alias("topics"), (k % 4 != 0).alias("live"), F.struct(F.timestamp_seconds(F.when(k % 3 != 0, START + k * 60)).alias("at")).alias("lived"),
            F.struct(F.when(k % 2 == 0, k % 6).alias("quality")).alias("automod"),
        )

    def studies():
        return docs.select(
            k.cast("string").alias("_id"), text("S ", F.col("source")).alias("name"), F.when(k % 5 == 0, "-").otherwise(F.col("text")).alias("description"), F.col("lang").alias("owner_id"),
            F.create_map(F.col("source"), F.lit("w")).alias("members"), F.array("lang").alias("topics"), F.when(k % 6 != 0, (k % 100).cast("int")).alias("likes"), F.when(k % 3 == 0, "public").otherwise("private").alias("visibility"),
            F.lit(None).cast("timestamp").alias("rank"), F.when(k % 8 == 0, "relay x").alias("origin"), *_times(k)[:2],
        )

    def chapters():
        tags = lambda i: F.array(F.lit("ECO:A00"), text("ECO:C", (k % 7 + i).cast("string")), text("Event:", F.col("lang")))
        one = lambda i: F.struct(text("c", k.cast("string"), f"-{i}").alias("_id"), k.cast("string").alias("study_id"), F.col("source").alias("name"), F.col("text").alias("description"), tags(i).alias("tags"))
        many = F.filter(F.array(one(0), one(1)), lambda _, i: (i == 0) | (k % 5 != 0))
        return docs.where(k % 9 != 0).select(F.explode(many).alias("c")).select("c.*")

    def study_log():
        """Clicks and purchases give likes, a purchase also the rank; few of the errors delete."""
        kind, seq = F.col("event_type"), F.col("event_id")
        likes = F.when(kind.isin("click", "purchase"), F.get_json_object("props", "$.k").cast("int"))
        diff = F.struct(F.struct(likes.alias("likes"), F.when(kind == "purchase", F.col("ts").cast("timestamp")).alias("rank")).alias("u")).alias("diff")
        gone, user = (kind == "error") & (seq % 37 == 0), F.col("user_id").cast("string")
        return table(spark, d, "events").select(
            F.col("ts").cast("timestamp").alias("ts"), seq.alias("seq"), F.when(F.col("user_id") % 4 == 0, "db.team").otherwise("db.study").alias("ns"), F.when(gone, "d").when(kind.isin("signup", "error"), "i").otherwise("u").alias("op"),
            F.struct(F.when(gone, user).alias("_id"), diff).alias("o"), F.struct(user.alias("_id")).alias("o2"),
        )

    found = {"posts": posts, "topics": topics, "teams": teams, "ublogs": ublogs, "games": lambda: records(spark, d), "accounts": lambda: accounts(spark, d), "studies": studies, "chapters": chapters, "study_log": study_log}
    return lambda name: found[name]()


def _indexed(spark, d, job):
    """The collection after two consecutive ranges, the first of them twice."""
    collection, tables = job.collection(spark, new_path(spark, f"job-{job.name}")), _tables(spark, d)
    for low, high in ((LOW, MIDDLE), (LOW, MIDDLE), (MIDDLE, HIGH)):
        jobs.index(job, tables, collection, at(low), at(high))
    return collection.documents()


POSTS_SQL = f"p AS (SELECT *, {TIMES_SQL} FROM (SELECT *, doc_id AS k FROM documents))"


@query("job_forum", f"""WITH {POSTS_SQL} SELECT CAST(k AS VARCHAR) AS _id, text AS body, 'T' || source AS topic, source AS topic_id, lang AS author, n_chars > 3000 AS troll, created * 1000 AS date
FROM p WHERE ({IN_RANGE_SQL}) AND length(text) <= 5000 AND erased IS NULL AND source <> 'src3'""")
def job_forum(spark, d):
    """Posts touched in the range; erased ones go, as do long ones and those of unknown topics."""
    return _indexed(spark, d, jobs.FORUM)


@query("job_team", f"""WITH p AS (SELECT *, {TIMES_SQL} FROM (SELECT *, p_partkey AS k FROM part))
SELECT CAST(k AS VARCHAR) AS _id, p_name AS name, p_type AS description, CAST(p_size AS SMALLINT) AS nb_members FROM p WHERE ({IN_RANGE_SQL}) AND k % 5 <> 0""")
def job_team(spark, d):
    return _indexed(spark, d, jobs.TEAM)


UBLOG_SQL = f"""WITH p AS (SELECT *, CASE WHEN k % 3 <> 0 THEN {START} + k * 60 END AS created, CASE WHEN k % 2 = 0 THEN k % 6 END AS q FROM (SELECT *, doc_id AS k FROM documents))
SELECT CAST(k AS VARCHAR) AS _id, source || chr(10) || replace(lang, 'Chess', '') || chr(10) || lang || chr(10) || chr(10) || text AS text, lang AS language, CAST(n_chars % 30000 AS SMALLINT) AS likes, created * 1000 AS date, CAST(q AS SMALLINT) AS quality
FROM p WHERE created >= {LOW} AND created < {HIGH} AND k % 4 <> 0 AND (q IS NULL OR q <> 0)"""


@query("job_ublog", UBLOG_SQL)
def job_ublog(spark, d):
    return _indexed(spark, d, jobs.UBLOG)


@query("job_text_index", f"WITH v AS ({UBLOG_SQL}), " + bm25_sql("v", {"text": 1}, ["the", "nicht"]) + "SELECT _id, round(score, 6) AS score FROM r")
def job_text_index(spark, d):
    """A stored text index that follows a collection from range to range."""
    collection, tables = jobs.UBLOG.collection(spark, new_path(spark, "job-followed")), _tables(spark, d)
    index = TextIndex(spark, new_path(spark, "job-index"), UblogQuery.index)
    for low, high in ((LOW, MIDDLE), (MIDDLE, HIGH)):
        jobs.index(jobs.UBLOG, tables, collection, at(low), at(high))
        jobs.follow(index, collection)
    return fulltext.best_field(index, standard_query("the nicht"), {"text": 1}).select("_id", F.round("_score", 6).alias("score"))


GAMES_IN_RANGE = f"status >= 30 AND (source IS NULL OR source <> 7) AND created >= {LOW} AND created < {HIGH}"


@query("job_game", RECORDS_SQL + BOTS_SQL + f"SELECT {DOCUMENT_SQL} FROM p WHERE {GAMES_IN_RANGE}")
def job_game(spark, d):
    """With the bots that the accounts name when the batch runs."""
    return _indexed(spark, d, jobs.GAME)


@query("collection_layout", RECORDS_SQL + "SELECT count(*) AS n, CAST(25 AS BIGINT) AS files, CAST(0 AS BIGINT) AS out_of_order, max(coalesce(moved, created)) AS newest FROM p")
def collection_layout(spark, d):
    """Games written in their collection's layout, over an empty collection of the same name: files, rows that are
    newer than the row before them in a file, and the newest date."""
    spec, path = SPECS["game"], new_path(spark, "layout")
    create(spark, spec, path)
    rows = jobs.GAME.changes(records(spark, d).withColumn("action", F.lit(INDEX)).withColumn("version", F.lit(0)), _tables(spark, d))
    write(rows.select(*spec.schema.names), spec, path)
    create(spark, spec, path)  # what is there stays
    back = spark.read.schema(spec.schema).parquet(path).select("date", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = F.lag("date").over(Window.partitionBy("file").orderBy("at"))
    return back.withColumn("newer", (F.col("date") > before).cast("long")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.sum("newer").alias("out_of_order"), F.max("date").alias("newest"))


@query("backfill_newest_first", RECORDS_SQL + f"SELECT _id, created FROM p WHERE {GAMES_IN_RANGE} ORDER BY created DESC, _id LIMIT 50")
def backfill_newest_first(spark, d):
    """The 50 newest games of a range."""
    return scans.games(records(spark, d), at(LOW), at(HIGH), newest_first=True).limit(50).select("_id", "created")


#: Records of a file of the exported stream, about.
EXPORT_ROWS = 1 << 18


@query("csv_export_stream", RECORDS_SQL + f"SELECT _id, average_rating, uids, duration FROM (SELECT {CSV_SQL} FROM p WHERE status >= 30)")
def csv_export_stream(spark, d):
    """A stream of game records exported as CSV in three batches, and read back; files are of a size, however many."""
    source, out = new_path(spark, "csv-source"), new_path(spark, "csv-stream")
    files = max(3, math.ceil(table(spark, d, "orders").count() / EXPORT_ROWS))
    records(spark, d).where(F.col("status") >= 30).repartition(files, "_id").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", math.ceil(files / 3)).parquet(source)
    export_stream(stream, out, f"{out}-checkpoint", tr.game_csv).awaitTermination()
    names = tr.game_csv(spark.read.parquet(source)).columns
    back = exported(spark, out, ", ".join(f"`{c}` string" for c in names))
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("_id", "average_rating", "uids", "duration")])


STUDY_UNTIL = "2024-01-20 00:00:00"
STUDY_SQL = f"""WITH p AS (SELECT *, {TIMES_SQL} FROM (SELECT *, doc_id AS k FROM documents)),
g AS (SELECT user_id AS k, ts, event_id AS seq, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS n FROM events WHERE ts < TIMESTAMP '{STUDY_UNTIL}' AND user_id % 4 <> 0),
gone AS (SELECT DISTINCT k FROM g WHERE event_type = 'error' AND seq % 37 = 0),
liked AS (SELECT k, n AS likes FROM g WHERE event_type IN ('click', 'purchase') QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, seq DESC) = 1),
ranked AS (SELECT k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS rank FROM g WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, seq DESC) = 1) """


@query("job_study", STUDY_SQL + f"""SELECT CAST(k AS VARCHAR) AS _id, 'S ' || source AS name, CASE WHEN k % 5 <> 0 AND trim(text) <> '' AND text <> '-' THEN text END AS description, lang AS owner, source AS members,
  CAST(coalesce(liked.likes, CASE WHEN k % 6 <> 0 THEN k % 100 ELSE 0 END) AS INT) AS likes, ranked.rank, k % 3 = 0 AS public, strftime(make_timestamp(created * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at,
  CASE WHEN k % 9 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'C' || (k % 7) ELSE 'C' || (k % 7) || '|C' || (k % 7 + 1) END END AS ecos
FROM p LEFT JOIN liked USING (k) LEFT JOIN ranked USING (k) WHERE k % 8 <> 0 AND (created >= {LOW} OR updated >= {LOW}) AND k NOT IN (SELECT k FROM gone)""")
def job_study(spark, d):
    """A stream of scans of consecutive intervals, with the log's deletions, likes and ranks, stopped and taken up again."""
    collection = jobs.STUDY.collection(spark, new_path(spark, "job-study"))
    end, start, checkpoint = datetime.fromisoformat(STUDY_UNTIL).replace(tzinfo=timezone.utc), datetime.fromtimestamp(LOW, timezone.utc), new_path(spark, "job-study-checkpoint")
    for until in (datetime(2005, 1, 1, tzinfo=timezone.utc), datetime(2024, 1, 10, tzinfo=timezone.utc), end):
        jobs.watch(jobs.STUDY, None, _tables(spark, d), collection, checkpoint, start, until=until).awaitTermination()
        collection.compact()
    rows = collection.documents()
    return rows.select("_id", "name", "description", "owner", F.array_join("members", ",").alias("members"), "likes", "rank", "public", "created_at", F.array_join(F.transform("chapters", lambda c: c["tags"]["eco"]), "|").alias("ecos"))


@query("job_dry_run", f"""WITH {POSTS_SQL}, t AS (SELECT *, {TIMES_SQL} FROM (SELECT *, p_partkey AS k FROM part))
SELECT 'forum' AS collection, CASE WHEN erased IS NULL THEN 'index' ELSE 'delete' END AS action, count(*) AS n FROM p WHERE ({IN_RANGE_SQL}) AND length(text) <= 5000 AND (source <> 'src3' OR erased IS NOT NULL) GROUP BY ALL
UNION ALL SELECT 'team', CASE WHEN k % 5 <> 0 THEN 'index' ELSE 'delete' END, count(*) FROM t WHERE ({IN_RANGE_SQL}) GROUP BY ALL""")
def job_dry_run(spark, d):
    """What the jobs of two collections would do."""
    tables = _tables(spark, d)
    return jobs.index_all([(job, tables, job.collection(spark, "unused")) for job in (jobs.FORUM, jobs.TEAM)], at(LOW), at(HIGH), dry=True)


def _raw_events(spark, d):
    """The event table as a stream of files."""
    raw = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return raw.select(F.col("user_id").cast("string").alias("doc_id"), F.col("ts").cast("timestamp").alias("cluster_time"), F.col("event_id").alias("seq"), op.alias("op"), "value")


@query("job_streams", CHANGES_SQL + """, g AS (SELECT * FROM c WHERE op = 'delete' OR (op = 'update' AND seq % 5 > 0) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cluster_time DESC, seq DESC) = 1)
SELECT 'team' AS collection, CAST(doc_id AS VARCHAR) AS _id, 'n' || seq AS shown, CAST(NULL AS BOOLEAN) AS white_bot FROM l WHERE op <> 'delete' AND seq % 4 <> 0
UNION ALL SELECT 'game', CAST(doc_id AS VARCHAR), 'w' || (seq % 90), 'w' || (seq % 90) IN (SELECT (CASE WHEN c_custkey % 2 = 0 THEN 'w' ELSE 'b' END) || (c_custkey % 100) FROM customer WHERE c_mktsegment = 'MACHINERY') FROM g WHERE op <> 'delete'""")
def job_streams(spark, d):
    """Two collections kept by streams of one session, with the lookups of each batch."""
    tables, seq = _tables(spark, d), F.col("seq")
    alive = lambda doc: F.when(F.col("op") != "delete", doc).alias("full_document")
    team = F.struct(F.concat(F.lit("n"), seq).alias("name"), F.lit("").alias("description"), (seq % 1000).alias("nb_members"), (seq % 4 != 0).alias("enabled"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    game = F.struct(
        F.when(seq % 5 > 0, 30).otherwise(20).alias("status"), F.lit(1).alias("source"), F.array(F.concat(F.lit("w"), (seq % 90).cast("string")), F.lit("b1")).alias("players"), (seq % 100).cast("int").alias("ply"), F.col("cluster_time").alias("created_at"),
        none("timestamp", "moved_at"), none("boolean", "rated"), none("int", "variant"), none("binary", "clock"), none("boolean", "white_won"), none("int", "white_rating"), none("int", "black_rating"), none("int", "white_ai"), none("int", "black_ai"), none("boolean", "analysed"),
    )
    folder, found = new_path(spark, "job-streams"), {}

    def started(job, doc):
        found[job.name] = job.collection(spark, f"{folder}/{job.name}")
        events = _raw_events(spark, d).select("doc_id", "cluster_time", "seq", "op", alive(doc))
        return lambda: jobs.watch(job, events, tables, found[job.name], f"{folder}/checkpoint-{job.name}")

    run_all([started(jobs.TEAM, team), started(jobs.GAME, game)])
    teams = found["team"].documents().select(F.lit("team").alias("collection"), "_id", F.col("name").alias("shown"), F.lit(None).cast("boolean").alias("white_bot"))
    return teams.unionByName(found["game"].documents().select(F.lit("game").alias("collection"), "_id", F.col("white_user").alias("shown"), "white_bot"))


def _values(spark, path, updatable=()):
    schema = spark.createDataFrame([], f"_id string, value double, likes long, version {jobs.VERSION}, deleted boolean").schema
    return Collection(spark, path, schema, updatable)


def _translated(last):
    version = F.struct(F.col("cluster_time").alias("t"), "seq").alias("version")
    return last.select(F.col("doc_id").alias("_id"), "value", F.col("seq").alias("likes"), version, F.when(F.col("op") == "delete", DELETE).otherwise(INDEX).alias("action"))


def _translated_partly(rows):
    action = F.when(F.col("op") == "update", UPDATE).when(F.col("op") == "delete", DELETE).otherwise(INDEX)
    version = F.struct(F.col("cluster_time").alias("t"), "seq").alias("version")
    return rows.select(F.col("doc_id").alias("_id"), "value", F.col("seq").alias("likes"), F.lit(True).alias("has_likes"), version, action.alias("action"))


@query("stream_restart", CHANGES_SQL + "SELECT CAST(doc_id AS VARCHAR) AS _id, value, seq AS likes FROM l WHERE op <> 'delete'")
def stream_restart(spark, d):
    """The first half of the log, a compaction, and a start at a time before that, with a new checkpoint, on the same
    collection: older documents stay, and what is read twice changes nothing."""
    folder = new_path(spark, "restart")
    collection, events = _values(spark, f"{folder}/values"), _raw_events(spark, d)
    ingest(events.where("cluster_time < TIMESTAMP '2024-01-16 00:00:00+00:00'"), collection, _translated, f"{folder}/first").awaitTermination()
    collection.compact()
    ingest(events, collection, _translated, f"{folder}/second", since=F.lit("2024-01-14 00:00:00+00:00").cast("timestamp")).awaitTermination()
    return collection.documents()


@query("stream_partial_updates", CHANGES_SQL + """, w AS (SELECT * FROM c WHERE op <> 'update' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cluster_time DESC, seq DESC) = 1),
u AS (SELECT doc_id, seq AS likes FROM c WHERE op <> 'delete' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cluster_time DESC, seq DESC) = 1)
SELECT CAST(doc_id AS VARCHAR) AS _id, value, u.likes FROM w JOIN u USING (doc_id) WHERE op = 'insert'""")
def stream_partial_updates(spark, d):
    """Inserts are whole documents, updates give likes only, errors delete; two streams share the work."""
    folder = new_path(spark, "partial")
    collection, events = _values(spark, f"{folder}/values", ("likes",)), _raw_events(spark, d)

    for name, part in (("later", "seq % 2 = 1"), ("first", "seq % 2 = 0")):
        ingest(events.where(part), collection, _translated_partly, f"{folder}/{name}", last_only=False).awaitTermination()
        collection.compact()
    return collection.documents()


@query("stream_guarded", CHANGES_SQL + """, w AS (SELECT * FROM c WHERE op <> 'update' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cluster_time DESC, seq DESC) = 1),
u AS (SELECT doc_id, seq AS likes FROM c WHERE op <> 'delete' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cluster_time DESC, seq DESC) = 1)
SELECT CAST(doc_id AS VARCHAR) AS _id, value, u.likes, CAST(0 AS BIGINT) AS written_again FROM w JOIN u USING (doc_id) WHERE op = 'insert'""")
def stream_guarded(spark, d):
    """The log in three files, then all of it again, by the same stream and by one that starts from what the collection
    has: the documents, and how many delta rows the repetitions left."""
    folder = new_path(spark, "guarded")
    collection, log = _values(spark, f"{folder}/values", ("likes",)), change_events(spark, d)
    rows = log.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("cluster_time").cast("timestamp").alias("cluster_time"), "seq", "op", "value")
    guard = lambda seed: Guard(deletion=F.col("op") == "delete", partial=F.col("op") == "update", gives=F.array(F.lit("likes")), seed=seed)

    def ingested(name, seed=False):
        events = scans.change_log(spark, f"{folder}/log", rows.schema, stream=True, max_files=1)
        ingest(events, collection, _translated_partly, f"{folder}/{name}", last_only=False, guard=guard(seed)).awaitTermination()

    rows.repartition(3, F.xxhash64("seq")).write.parquet(f"{folder}/log")
    ingested("first")
    before = set(collection.tables("delta"))
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/log")
    ingested("first")
    ingested("second", seed=True)
    return collection.documents().withColumn("written_again", F.lit(collection.delta_rows(set(collection.tables("delta")) - before)).cast("long"))


@query("change_batch_and_stream", CHANGES_SQL + "SELECT doc_id, seq FROM c WHERE cluster_time >= TIMESTAMP '2024-01-10' AND cluster_time < TIMESTAMP '2024-01-12'")
def change_batch_and_stream(spark, d):
    """A range of a change log read as a table; the same events come from the stream."""
    log = new_path(spark, "change-log")
    change_events(spark, d).write.parquet(log)
    low, high = (F.lit(day).cast("timestamp_ntz") for day in ("2024-01-10", "2024-01-12"))
    schema = change_events(spark, d).schema
    in_range = lambda rows: rows.where(scans.touched(["cluster_time"], low, high)).select("doc_id", "seq")
    stream, out = in_range(scans.change_log(spark, log, schema, stream=True, max_files=2)), new_path(spark, "change-range")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    batch = in_range(scans.change_log(spark, log, schema))
    streamed = spark.read.schema(batch.schema).parquet(out)
    return batch.intersectAll(streamed).unionAll(batch.exceptAll(streamed).unionAll(streamed.exceptAll(batch)))  # what only one has would show
