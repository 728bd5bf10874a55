"""Streams that remember versions: late and repeated changes go before they are written."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tabiya.operators.changes import DELETE, INDEX, UPDATE
from tabiya.sources.scans import change_log
from tabiya.streaming import jobs
from tabiya.streaming.collection import Collection
from tabiya.streaming.guard import SETTINGS, Guard, newer_only, settings
from tabiya.streaming.ingest import ingest

EVENTS = "doc_id string, cluster_time long, seq int, op string, other string, value int, likes int, has_value boolean, has_likes boolean"
DOCUMENT = "_id string, other string, value int, likes int, version struct<t:long,seq:long>, deleted boolean"


def _guard(**more):
    gives = F.filter(F.array(F.when(F.col("has_value"), F.lit("value")), F.when(F.col("has_likes"), F.lit("likes"))), lambda c: c.isNotNull())
    return Guard(deletion=F.col("op") == DELETE, partial=F.col("op") == UPDATE, gives=gives, **more)


def _translate(rows):
    version = F.struct(F.col("cluster_time").alias("t"), F.col("seq").cast("long").alias("seq")).alias("version")
    return rows.select(F.col("doc_id").alias("_id"), "other", "value", "likes", "has_value", "has_likes", version, F.col("op").alias("action"))


def _history(rng, n):
    rows = []
    for at in range(n):
        op, given = rng.choice([INDEX, INDEX, UPDATE, UPDATE, DELETE]), (rng.random() < 0.6, rng.random() < 0.6)
        new = None if op == DELETE else at
        rows.append((rng.choice(["a", "b", "c", "d", "e", None]), None if at < 2 else at // 3, at, op, f"o{at}" if op == INDEX else None, new, new, *given))
    return rows


def _folded(rows):
    out = {}
    for _id, t, seq, op, other, value, likes, has_value, has_likes in sorted((r for r in rows if r[0]), key=lambda r: (-1 if r[1] is None else r[1], r[2])):
        if op == INDEX:
            out[_id] = [other, value, likes]
        elif op == DELETE:
            out.pop(_id, None)
        elif _id in out:
            old = out[_id]
            out[_id] = [old[0], value if has_value else old[1], likes if has_likes else old[2]]
    return out


class _Log:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.schema = spark, str(folder), spark.createDataFrame([], EVENTS).schema
        self.collection = Collection(spark, f"{folder}/docs", spark.createDataFrame([], DOCUMENT).schema, ("value", "likes"))

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def run(self, name="c", translate=_translate, **more):
        events = change_log(self.spark, f"{self.folder}/log", self.schema, stream=True, max_files=1)
        ingest(events, self.collection, translate, f"{self.folder}/{name}", last_only=False, guard=_guard(**more)).awaitTermination()

    def shown(self):
        return {r["_id"]: [r.other, r.value, r.likes] for r in self.collection.documents().collect()}


def test_late_and_repeated_changes_are_not_written(spark, tmp_path):
    rng, log = random.Random(11), _Log(spark, tmp_path)
    rows = _history(rng, 60)
    shuffled = rng.sample(rows, 60)
    log.add(shuffled[:30])
    log.run()
    assert log.shown() == _folded(shuffled[:30])
    log.add(shuffled[30:])
    log.run()  # the stream is taken up again, with its memory
    assert log.shown() == _folded(rows)
    written = log.collection.tables("delta")
    log.add(rng.sample(rows, 60))
    log.run()
    assert log.collection.tables("delta") == written and log.shown() == _folded(rows)
    log.collection.compact()
    log.run("anew", seed=True)  # a new checkpoint that starts from the collection
    assert log.collection.tables("delta") == written
    newer = ("a", 1000, 1, INDEX, "x", 1, 2, True, True)
    log.add([newer, newer, ("a", 999, 1, DELETE, None, None, None, False, False)])
    log.run("anew", seed=True)
    assert log.shown() == _folded([*rows, newer]) and 1 <= log.collection.delta_rows(set(log.collection.tables("delta")) - set(written)) <= 2
    log.run("forgetful")  # without a seed changes pass, and versions still decide
    assert log.shown() == _folded([*rows, newer])
    assert all(spark.conf.get(name, None) != value for name, value in SETTINGS.items())


def test_a_batch_that_fails_is_not_remembered(spark, tmp_path):
    log, failing = _Log(spark, tmp_path), [True]
    rows = _history(random.Random(5), 20)
    log.add(rows)

    def translate(batch):
        if failing:
            raise ValueError("in the middle of a batch")
        return _translate(batch)

    with pytest.raises(StreamingQueryException):
        log.run(translate=translate)
    assert log.shown() == {}
    failing.clear()
    log.run(translate=translate)
    assert log.shown() == _folded(rows) and len(log.collection.tables("delta")) == 1


def test_events_that_do_not_count_are_not_remembered(spark, tmp_path):
    at = datetime(2020, 1, 1)
    doc = "struct<text:string,topic_id:string,user_id:string,troll:boolean,created_at:timestamp,erased_at:timestamp>"
    schema = spark.createDataFrame([], f"doc_id string, cluster_time timestamp, seq long, op string, full_document {doc}").schema
    topics = spark.createDataFrame([("t", "Topic")], "_id string, name string")
    collection = jobs.FORUM.collection(spark, str(tmp_path / "posts"))
    post = lambda text, erased=None: (text, "t", "u", False, at, erased)
    for row in [("p", at, 5, "update", post("x" * 5001)), ("p", at, 3, "update", post("short")), ("p", at, 2, "update", post("older")), ("q", at, 1, "insert", post("q")), ("q", at, 4, "update", post("q", at))]:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        events = change_log(spark, str(tmp_path / "log"), schema, stream=True)
        jobs.watch(jobs.FORUM, events, lambda name: topics, collection, str(tmp_path / "c"), remember=timedelta(days=1)).awaitTermination()
    assert [(r["_id"], r.body) for r in collection.documents().collect()] == [("p", "short")]
    assert len(collection.tables("delta")) == 3


def test_versions_that_can_not_be_guarded(spark):
    events = spark.createDataFrame([], "doc_id string, cluster_time string, seq long")
    with pytest.raises(ValueError):
        from tabiya.streaming.guard import newer_only

        newer_only(events, Guard())


def test_python_sees_three_values_of_an_event_and_gives_it_back_whole(spark, tmp_path):
    schema = spark.createDataFrame([], "doc_id long, cluster_time timestamp, seq long, n long, b byte, f float, x double, d decimal(20,3), t timestamp_ntz, day date, raw binary, s string, tags array<string>, m map<string,int>, doc struct<a:long,inner:struct<v:string>>").schema
    at = datetime(2024, 1, 16, 1, 2, 3, 456789)
    rows = [
        (1, at, 1, (1 << 62) + 1, -1, 0.1, float("nan"), None, at, at.date(), b"\\x00\\xff", "", ["a", None], {"k": None}, ((1 << 60) + 1, ("v",))),
        (1, at, 2, None, None, None, float("-inf"), None, None, None, None, None, None, None, None),
        (2, None, -5, -(1 << 63), 127, None, 1e-310, None, None, None, b"", "\\u2028\\n", [], {}, (None, (None,))),
        (2, None, -6, 0, 0, None, None, None, None, None, None, "late", None, None, (None, None)),
    ]
    spark.createDataFrame(rows, schema).withColumn("d", F.when(F.col("seq") > 0, F.lit("12345678901234567.120").cast("decimal(20,3)"))).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream, out = change_log(spark, str(tmp_path / "log"), schema, stream=True), str(tmp_path / "out")
    with settings(spark):
        passed = newer_only(stream, Guard())
        passed.writeStream.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (r.doc_id, r.seq)
    got = sorted(spark.read.parquet(out).collect(), key=key)
    want = sorted((r for r in spark.read.schema(schema).parquet(str(tmp_path / "log")).collect() if r.s != "late"), key=key)
    assert repr(got) == repr(want)
