"""Lookups by bitmaps and lists against plain scans, over a changed collection."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabiya.operators.changes import DELETE, INDEX
from tabiya.operators.keywords import KeywordIndex, asked_of_lists, matching, matching_count, matching_each
from tabiya.operators.search import GameQuery, count
from tabiya.sources.collections import SPECS
from tabiya.streaming import jobs
from tabiya.streaming.collection import Collection


def test_lookups_equal_scans(spark, tmp_path):
    rng, spec = random.Random(5), SPECS["game"]
    users, pick = ["ann", "bob", "cat", None], lambda *values: rng.choice(values)

    def rows(ids, seq):
        out = []
        for i in ids:
            own = {"_id": str(i), "status": pick(30, 31, 32, 34, None), "perf": pick(1, 2, 3, None), "winner_color": pick(1, 2, 3), "source": pick(1, 3), "turns": rng.randrange(90), "rated": pick(True, False, None), "analysed": pick(True, False), "clock_inc": pick(0, 3), "white_user": pick(*users), "black_user": pick(*users), "date": i}
            out.append((*[own.get(f.name) for f in spec.schema.fields], seq, INDEX))
        return spark.createDataFrame(out, StructType([*spec.schema.fields, StructField("seq", LongType()), StructField("action", StringType())]))

    stamped = lambda frame: frame.withColumn("version", F.struct(F.timestamp_seconds(F.lit(0)).alias("t"), F.col("seq"))).drop("seq")
    collection = Collection(spark, str(tmp_path / "games"), jobs.GAME.schema(), (), None, buckets=4)
    collection.apply(stamped(rows(range(300), 0)))
    collection.compact()
    index = KeywordIndex(spark, str(tmp_path / "keywords")).follow(collection)
    asked = [
        GameQuery(user1="ann"), GameQuery(user1="ann", user2="bob"), GameQuery(user1="cat", user2="cat"), GameQuery(rated=True, perf=[1, 3]), GameQuery(status=34, source=1), GameQuery(status=31, analysed=False, source=3, clock_inc=3, winner_color=2),
        GameQuery(winner="bob", loser="ann"), GameQuery(white_user="ANN", black_user="bob", turns=(10, 60)), GameQuery(user1="bob", perf=[2], rated=True), GameQuery(turns=(1, 5)), GameQuery(user1="nobody"),
    ]

    def same(queries):
        for query in queries:
            want = {r["_id"] for r in query.matches(collection.documents()).collect()}
            got = [r["_id"] for r in matching(collection, index, query).collect()]
            assert len(got) == len(want) and set(got) == want, query
            assert matching_count(collection, index, query).first()["count"] == count(collection.documents(), query).first()["count"] == len(want)

    same(asked)
    assert [asked_of_lists(q)[2] for q in asked] == [True, True, False, True, True, True, False, False, True, False, True]
    plan = index.ids({}, [[("white_user", "ann")]])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(value,ann)" in plan and "/numbers" not in plan
    collection.apply(stamped(rows([*range(0, 40), *range(300, 310)], 1)))
    collection.apply(stamped(rows(range(50, 60), 2)).withColumn("action", F.lit(DELETE)))
    same([asked[i] for i in (1, 3, 6, 8)])
    collection.compact()
    with pytest.raises(ValueError):
        matching(collection, index, asked[0])
    index.follow(collection)
    same([asked[i] for i in (0, 3, 6)])


def test_only_rewritten_buckets_are_indexed_anew(spark, tmp_path):
    spec = SPECS["game"]
    stored = StructType([*spec.schema.fields, StructField("seq", LongType()), StructField("action", StringType())])
    collection = Collection(spark, str(tmp_path / "games"), jobs.GAME.schema(), (), None, buckets=16)

    def applied(ids, seq, rated):
        own = lambda i: {"_id": str(i), "status": 30, "perf": 1, "rated": rated, "white_user": f"u{i % 7}", "black_user": "v", "date": i}
        rows = spark.createDataFrame([(*[own(i).get(f.name) for f in spec.schema.fields], seq, INDEX) for i in ids], stored)
        collection.apply(rows.withColumn("version", F.struct(F.timestamp_seconds(F.lit(0)).alias("t"), F.col("seq"))).drop("seq"))
        return collection.compact()

    applied(range(400), 0, True)
    index = KeywordIndex(spark, str(tmp_path / "keywords")).follow(collection)
    assert len(index.used) == 16 and {p for p, _ in index.used} == {0}
    changed, rated = applied([3], 1, False), set(map(str, range(400))) - {"3"}
    index.follow(collection)
    assert len(changed) == 1 and [home for part, home in index.used if part == 1] == changed
    assert index._part("numbers", 1).count() == collection.base_documents().join(index._part("numbers", 1), "_id", "left_semi").count() < 80
    found = lambda query: {r["_id"] for r in matching(collection, index, query).collect()}
    assert found(GameQuery(rated=True)) == rated and matching_count(collection, index, GameQuery(rated=True)).first()["count"] == 399
    assert found(GameQuery(user1="u3", rated=False)) == {"3"} and found(GameQuery(white_user="u3", rated=True)) == {str(i) for i in range(400) if i % 7 == 3 and i != 3}
    assert index.follow(collection).parts() == [0, 1]  # nothing new, no part
    for seq in range(2, 6):  # small parts are taken over, so that few are in use
        applied([seq * 31], seq, False)
        index.follow(collection)
        rated -= {str(seq * 31)}
    assert found(GameQuery(rated=True)) == rated and len({p for p, _ in index.used}) <= 4
    index.drop_unused(collection)
    assert set(index.parts()) == {p for p, _ in index.used} and found(GameQuery(rated=True)) == rated


def test_several_queries_merge_the_changes_once(spark, tmp_path):
    collection = jobs.GAME.collection(spark, str(tmp_path / "games"))
    names = SPECS["game"].schema.names

    def applied(ids, seq, **more):
        given = {"rated": F.col("id") % 2 == 0, "perf": F.col("id") % 3, "turns": F.col("id") % 90, "white_user": F.concat(F.lit("u"), (F.col("id") % 7).cast("string")), "date": F.col("id")} | more
        kinds = {f.name: f.dataType for f in SPECS["game"].schema.fields}
        columns = [(F.col("id").cast("string") if c == "_id" else given.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in names]
        version = F.struct(F.timestamp_seconds(F.lit(0)).alias("t"), F.lit(seq).cast("long").alias("seq")).alias("version")
        collection.apply(spark.range(*ids).select(*columns, version, F.lit(INDEX).alias("action")))

    applied((0, 200), 0)
    collection.compact(buckets=4)
    applied((150, 220), 1, rated=F.lit(True))
    index = KeywordIndex(spark, str(tmp_path / "keywords")).follow(collection)
    asked = {"user": GameQuery(user1="u3"), "flags": GameQuery(rated=True, perf=[1]), "both": GameQuery(user1="u3", turns=(40, None)), "range": GameQuery(turns=(80, None)), "won": GameQuery(winner="u3")}
    found = matching_each(collection, index, asked)
    want = {(name, r["_id"]) for name, q in asked.items() for r in q.matches(collection.documents()).collect()}
    rows = [(r.asked, r["_id"]) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) > 100
    lines = lambda *names: sum("max_by(" in line for line in matching_each(collection, index, {k: asked[k] for k in names})._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert lines("user", "both", "won") == lines("user") == 1
