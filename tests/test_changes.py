import random

from pyspark.sql import functions as F

from tabiya.operators import changes as ch
from tabiya.sources import scans


def _events(spark, rows):
    return spark.createDataFrame(rows, "seq long, value int, doc_id string, cluster_time long")


def test_last_per_document_equals_a_fold(spark):
    rng = random.Random(1)
    for size in (0, 1, 30, 300):
        rows = [(i, rng.randrange(9), rng.choice(["a", "b", "c", "d", None]), i // 3) for i in range(size)]
        last = {}
        for row in rows:
            if row[2] is not None:
                last[row[2]] = row
        got = ch.last_per_document(_events(spark, rows))
        assert sorted(map(tuple, got.collect())) == sorted(last.values())
        assert sorted(map(tuple, ch.last_per_document(got).collect())) == sorted(last.values())
        mapped = ch.last_per_document(_events(spark, rows).withColumn("m", F.create_map("doc_id", "value")).where("doc_id IS NOT NULL"))
        assert {(r.seq, r.m[r.doc_id]) for r in mapped.collect()} == {(r[0], r[1]) for r in last.values()}
    assert ch.last_per_document(_events(spark, [(1, 1, None, 1)])).isEmpty()


def test_apply_is_ordered_and_repeatable(spark):
    schema = "_id string, name string, likes int"
    base = spark.createDataFrame([("a", "A", 1), ("b", "B", 2), ("c", "C", 3)], schema)
    ups = spark.createDataFrame([("b", "B2", 20), ("d", "D", 4), ("e", "E", 5)], schema)
    parts = spark.createDataFrame([("a", None, True), ("d", 40, True), ("c", 9, False), ("zz", 1, True)], "_id string, likes int, has_likes boolean")
    dels = spark.createDataFrame([("e",), ("missing",)], "_id string")
    once = ch.apply_changes(base, ups, parts, dels, ["likes"])
    want = [("a", "A", None), ("b", "B2", 20), ("c", "C", 3), ("d", "D", 40)]
    assert sorted(map(tuple, once.collect()), key=str) == want
    assert sorted(map(tuple, ch.apply_changes(once, ups, parts, dels, ["likes"]).collect()), key=str) == want
    assert sorted(map(tuple, ch.apply_changes(base).collect())) == sorted(map(tuple, base.collect()))


def test_versions_never_go_back(spark):
    base = spark.createDataFrame([("a", 1, 10, False), ("b", 1, 10, True)], "_id string, v int, version int, deleted boolean")
    changes = spark.createDataFrame([("a", 2, 9, "index"), ("b", 2, 5, "index"), ("c", 3, 1, "index"), ("d", 4, 1, "delete")], "_id string, v int, version int, action string")
    got = {r["_id"]: (r.v, r.deleted) for r in ch.merge_versions(base, changes).collect()}
    assert got == {"a": (1, False), "b": (1, True), "c": (3, False), "d": (4, True)}


def test_deletes_of_games_and_lengths(spark):
    doc = "struct<status:int,source:int,players:array<string>,text:string>"
    rows = [(1, "g1", 1, "update", (30, None, ["x"], None)), (2, "g2", 1, "update", (20, 1, ["x"], None)), (3, "g3", 1, "update", (31, 7, ["x"], None)), (4, "g4", 1, "delete", None), (5, "g5", 1, "insert", (30, 1, ["x"], None)), (6, "g6", 1, "update", (30, 1, [], None))]
    events = spark.createDataFrame(rows, f"seq long, doc_id string, cluster_time long, op string, full_document {doc}")
    got = lambda parity: {r.doc_id: r.action for r in scans.game_changes(events, parity).collect()}
    assert got(False) == {"g1": "index", "g4": "delete"} and got(True) == {"g1": "index"}
    posts = [(1, "p1", 1, "insert", (0, 0, [], "short")), (2, "p2", 1, "insert", (0, 0, [], "too long")), (3, "p3", 1, "delete", None)]
    kept = scans.changes(spark.createDataFrame(posts, events.schema), "forum", F.lit(False), longest=5)
    assert {r.doc_id: r.action for r in kept.collect()} == {"p1": "index", "p3": "delete"}
