import itertools
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tabiya.operators.changes import DELETE, INDEX, UPDATE, last_per_document
from tabiya.sources.collections import SPECS, create, write
from tabiya.operators.fulltext import TextIndex
from tabiya.operators.search import UblogQuery, search
from tabiya.sources.scans import change_log
from tabiya.sources.sinks import quantiles
from tabiya.streaming import jobs
from tabiya.streaming.collection import Collection
from tabiya.streaming.ingest import ingest, run_id

SCHEMA = "doc_id string, cluster_time long, seq long, op string, value int"


def _translate(last):
    version = F.struct("cluster_time", "seq").alias("version")
    return last.select(F.col("doc_id").alias("_id"), "value", version, F.when(F.col("op") == "delete", DELETE).otherwise(INDEX).alias("action"))


def _rows(n, start=0):
    return [(f"d{i * 7 % 11}" if i % 13 else None, i // 2, i, "delete" if i % 5 == 0 else "update", i) for i in range(start, start + n)]


def test_stream_equals_batch_also_after_a_restart(spark, tmp_path):
    log, schema = str(tmp_path / "log"), spark.createDataFrame([], SCHEMA).schema
    document = spark.createDataFrame([], "_id string, value int, version struct<cluster_time:long,seq:long>, deleted boolean").schema
    collection = Collection(spark, str(tmp_path / "docs"), document)
    assert collection.documents().count() == 0
    everything = []
    for start in (0, 40):
        rows = _rows(40, start)
        everything += rows
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(log)
        ingest(change_log(spark, log, schema, stream=True, max_files=1), collection, _translate, str(tmp_path / "checkpoint")).awaitTermination()
        last = last_per_document(spark.createDataFrame(everything, schema))
        want = {(r.doc_id, r.value) for r in last.where("op <> 'delete'").collect()}
        assert {(r["_id"], r.value) for r in collection.documents().collect()} == want
    shown = lambda: {(r["_id"], r.value) for r in collection.documents().collect()}
    old = _translate(last_per_document(spark.createDataFrame(_rows(9), schema)))
    collection.apply(old)  # changes that arrive late
    assert shown() == want
    n = len(collection.tables("delta"))
    collection.apply(old.limit(0), 7, "again")
    collection.apply(old.limit(0), 7, "again")  # a batch that is run again takes its own place
    assert len(collection.tables("delta")) == n + 1
    collection.compact()
    assert shown() == want and collection.bases() == [0]
    late = spark.createDataFrame([("d1", 1000, 1000, "delete", 7), ("new", 1000, 1001, "update", 8)], schema)
    collection.apply(_translate(last_per_document(late)))
    assert shown() == {w for w in want if w[0] != "d1"} | {("new", 8)}
    collection.compact(forget_before=None)
    collection.drop_covered()
    assert shown() == {w for w in want if w[0] != "d1"} | {("new", 8)} and collection.tables("delta") == [] and collection.bases() == [1]
    assert collection.snapshot().where("deleted").count() > 0


@pytest.mark.parametrize("compacted", [False, True])
def test_a_start_at_a_time_keeps_what_is_there(spark, tmp_path, compacted):
    log, schema = str(tmp_path / "log"), spark.createDataFrame([], SCHEMA).schema
    collection = _collection(spark, tmp_path)
    spark.createDataFrame([("a", 1, 1, "update", 1), ("b", 2, 2, "update", 2)], schema).write.parquet(log)
    events = change_log(spark, log, schema, stream=True)
    ingest(events, collection, _translate, str(tmp_path / "c1")).awaitTermination()
    if compacted:
        collection.compact()
    spark.createDataFrame([("z", 9, 9, "update", 3)], schema).write.mode("append").parquet(log)
    ingest(events, collection, _translate, str(tmp_path / "c2"), since=5).awaitTermination()
    assert {(r["_id"], r.value) for r in collection.documents().collect()} == {("a", 1), ("b", 2), ("z", 3)}
    assert run_id(spark, str(tmp_path / "c1")) == run_id(spark, str(tmp_path / "c1")) != run_id(spark, str(tmp_path / "c2"))


def _collection(spark, tmp_path, updatable=()):
    document = spark.createDataFrame([], "_id string, value int, version struct<cluster_time:long,seq:long>, deleted boolean").schema
    return Collection(spark, str(tmp_path / "docs"), document, updatable)


def test_partial_updates_in_any_order(spark, tmp_path):
    """Changes in every order of batches, with compactions between, give what a fold by version gives."""
    schema = "_id string, other string, value int, likes int, version long, action string, has_value boolean, has_likes boolean"
    document = spark.createDataFrame([], "_id string, other string, value int, likes int, version long, deleted boolean").schema
    rng = random.Random(3)
    for order in range(3):
        changes = []
        for version in range(30):
            action = rng.choice([INDEX, UPDATE, UPDATE, DELETE] if version > 4 else [INDEX, UPDATE])
            given = (rng.random() < 0.6, rng.random() < 0.6)
            changes.append((rng.choice("abcd"), f"o{version}" if action == INDEX else None, version if action != DELETE else None, -version if action != DELETE else None, version, action, *given))
        want = {}
        for row in changes:
            if row[5] == INDEX:
                want[row[0]] = [row[1], row[2], row[3]]
            elif row[5] == DELETE:
                want.pop(row[0], None)
            elif row[0] in want:
                want[row[0]] = [want[row[0]][0], row[2] if row[6] else want[row[0]][1], row[3] if row[7] else want[row[0]][2]]
        collection = Collection(spark, str(tmp_path / f"docs{order}"), document, ("value", "likes"))
        rng.shuffle(changes)
        for i in range(0, 30, 10):
            collection.apply(spark.createDataFrame(changes[i : i + 10], schema), i, "run")
            if order:
                collection.compact()
        assert {r["_id"]: [r.other, r.value, r.likes] for r in collection.documents().collect()} == want
        collection.compact(forget_before=100)
        assert {r["_id"]: [r.other, r.value, r.likes] for r in collection.documents().collect()} == want


def test_intervals_are_consecutive_and_polling_resumes(spark, tmp_path):
    day = lambda n: datetime(2020, 1, n, tzinfo=timezone.utc)
    times, waits = iter([day(3), day(3), day(5), day(9)]), []
    assert list(jobs.intervals(day(1), timedelta(hours=1), day(8), times.__next__, waits.append)) == [(day(1), day(3)), (day(3), day(5)), (day(5), day(8))]
    assert waits == [3600, 3600, 3600]
    teams = spark.createDataFrame([(str(n), "n", "d", n, n != 2, day(n), None, None) for n in range(1, 8)], "_id string, name string, description string, nb_members int, enabled boolean, created_at timestamp, updated_at timestamp, erased_at timestamp")
    collection = jobs.TEAM.collection(spark, str(tmp_path / "teams"))
    polled = lambda since, until: jobs.poll(jobs.TEAM, lambda name: teams, collection, timedelta(days=1), since, until, now=itertools.repeat(until).__next__, wait=lambda s: None)
    polled(day(1), day(4))
    assert {r["_id"] for r in collection.documents().collect()} == {"1", "3"} and collection.position("team") == day(4).isoformat()
    polled(None, day(6))
    assert {r["_id"] for r in collection.documents().collect()} == {"1", "3", "4", "5"}
    assert {r.action: r.n for r in jobs.index(jobs.TEAM, lambda name: teams, collection, F.lit(day(1)), dry=True).collect()} == {"index": 6, "delete": 1}


def test_lengths_count_for_indexed_posts_only(spark):
    at = datetime(2020, 1, 1)
    post = lambda text, erased=None: (text, "t", "u", False, at, erased)
    rows = [("p1", at, 1, "insert", post("x" * 5000)), ("p2", at, 2, "insert", post("x" * 5001)), ("p3", at, 3, "delete", None), ("p4", at, 4, "update", post("y", at))]
    doc = "struct<text:string,topic_id:string,user_id:string,troll:boolean,created_at:timestamp,erased_at:timestamp>"
    events = spark.createDataFrame(rows, f"doc_id string, cluster_time timestamp, seq long, op string, full_document {doc}")
    topics = spark.createDataFrame([("t", "Topic")], "_id string, name string")
    got = {r["_id"]: (r.action, r.topic) for r in jobs.FORUM.events(events, lambda name: topics).collect()}
    assert got == {"p1": ("index", "Topic"), "p3": ("delete", None), "p4": ("delete", None)}


def test_explicit_start_and_dry_run(spark, tmp_path):
    log, schema, seen = str(tmp_path / "log"), spark.createDataFrame([], SCHEMA).schema, []
    spark.createDataFrame(_rows(30), schema).write.parquet(log)
    count = lambda counts, batch: seen.append({r.action: r.n for r in counts.collect()})
    document = spark.createDataFrame([], "_id string, value int, version struct<cluster_time:long,seq:long>, deleted boolean").schema
    collection = Collection(spark, str(tmp_path / "docs"), document)
    ingest(change_log(spark, log, schema, stream=True), collection, _translate, str(tmp_path / "c"), since=14, dry_run=count).awaitTermination()
    assert sum(seen[0].values()) == len({r[0] for r in _rows(30) if r[1] >= 14 and r[0]}) and collection.tables("delta") == []


def test_collection_layout(spark, tmp_path):
    path, spec = str(tmp_path / "game"), SPECS["game"]
    create(spark, spec, path)
    assert spark.read.parquet(path).count() == 0
    rows = spark.range(500).select(*[F.col("id").cast("string").alias("_id") if f.name == "_id" else (F.col("id") * 10).alias("date") if f.name == "date" else F.lit(None).cast(f.dataType).alias(f.name) for f in spec.schema.fields])
    write(rows, spec, path, partitions=2)
    create(spark, spec, path)  # what is there stays
    back = spark.read.parquet(path).select("date", F.input_file_name().alias("file"))
    assert back.count() == 500 and back.select("file").distinct().count() == 2
    for file in [r.file for r in back.select("file").distinct().collect()]:
        dates = [r.date for r in spark.read.parquet(file).select("date").collect()]
        assert dates == sorted(dates, reverse=True)
    create(spark, spec, path, replace=True)
    assert spark.read.parquet(path).count() == 0
    assert spec.of_role("date") == ["date"]


def test_an_index_follows_its_collection(spark, tmp_path):
    posts = lambda rows: spark.createDataFrame([(i, t, "en", 0, 5, 1, n, a) for i, t, n, a in rows], "_id string, text string, language string, likes short, date long, quality short, n long, action string").withColumn("version", F.struct(F.lit(datetime(2020, 1, 1)).alias("t"), F.col("n").alias("seq"))).drop("n")
    collection, index = jobs.UBLOG.collection(spark, str(tmp_path / "posts")), TextIndex(spark, str(tmp_path / "index"), UblogQuery.index)
    found = lambda text: {r["_id"] for r in search(collection.documents(), UblogQuery(text), index=index).collect()}
    collection.apply(posts([("a", "tiny river", 1, INDEX), ("b", "tiny boat", 2, INDEX)]))
    jobs.follow(index, collection)
    assert found("tiny") == {"a", "b"}
    collection.apply(posts([("a", None, 3, DELETE), ("c", "tiny river", 4, INDEX), ("b", "other boat", 5, INDEX)]))
    collection.compact()
    jobs.follow(jobs.follow(index, collection), collection)
    assert found("tiny") == found("river") == {"c"} and found("boat") == {"b"} and index.generations() == [0, 1]
    collection.drop_covered()
    collection.apply(posts([("d", "tiny", 6, INDEX)]))
    assert jobs.follow(index, collection).generations() == [0, 1, 2] and found("tiny") == {"c", "d"}
    collection.apply(posts([("e", "tiny", 7, INDEX)]))
    collection.compact()
    collection.drop_covered()
    collection.apply(posts([("f", "tiny", 8, INDEX)]))
    with pytest.raises(ValueError):
        jobs.follow(index, collection)
    anew = TextIndex(spark, str(tmp_path / "anew"), UblogQuery.index)  # built when changes are only in the base
    jobs.follow(anew, collection)
    collection.apply(posts([("g", "tiny", 9, INDEX)]))
    assert jobs.follow(anew, collection).generations() == [0, 1]
    assert {r["_id"] for r in search(collection.documents(), UblogQuery("tiny"), index=anew).collect()} == {"c", "d", "e", "f", "g"}


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = random.Random(4)
    rows = [(g, v) for g in "abc" for v in [rng.choice([rng.random() * 50, float(rng.randrange(4))]) for _ in range(rng.randrange(1, 400))]] + [("one", 7.0), ("same", 2.0), ("same", 2.0), ("none", None), ("a", None)]
    got = {r.g: (r.low, r.mid, r.high) for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "v", {"low": 0.0, "mid": 0.5, "high": 0.93}, "g", buckets=7).collect()}
    for g in ("a", "b", "c", "one", "same"):
        assert got[g] == pytest.approx([np.quantile([v for k, v in rows if k == g and v is not None], q) for q in (0, 0.5, 0.93)])
    assert "none" not in got
