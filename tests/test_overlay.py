"""Collections whose deltas are laid over buckets: reads, compactions, pages, exports."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tabiya.operators.changes import DELETE, INDEX, UPDATE
from tabiya.operators.paging import after, newest_page, page
from tabiya.operators.search import GameQuery, count, search
from tabiya.sources.collections import SPECS
from tabiya.streaming import collection as co, jobs
from tabiya.streaming.collection import Collection

CHANGES = "_id string, other string, value int, likes int, version long, action string, has_value boolean, has_likes boolean"


def _collection(spark, path, **more):
    document = spark.createDataFrame([], "_id string, other string, value int, likes int, version long, deleted boolean").schema
    return Collection(spark, path, document, ("value", "likes"), **more)


def _history(rng, n, ids):
    rows = []
    for version in range(n):
        action = rng.choice([INDEX, INDEX, UPDATE, UPDATE, DELETE])
        given = None if action == DELETE else version
        rows.append((f"d{rng.randrange(ids)}", f"o{version}" if action == INDEX else None, given, given, version, action, rng.random() < 0.6, rng.random() < 0.6))
    return rows


def _folded(rows):
    out = {}
    for _id, other, value, likes, _, action, has_value, has_likes in rows:
        if action == INDEX:
            out[_id] = [other, value, likes]
        elif action == DELETE:
            out.pop(_id, None)
        elif _id in out:
            out[_id] = [out[_id][0], value if has_value else out[_id][1], likes if has_likes else out[_id][2]]
    return out


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_overlay_equals_a_fold_over_random_histories(spark, tmp_path, monkeypatch, broadcast):
    """Whether touched ids are broadcast or filtered by bits, with compactions between, in any order of batches."""
    monkeypatch.setattr(co, "BROADCAST_IDS", broadcast)
    rng = random.Random(broadcast)
    for case in range(2):
        rows = _history(rng, 120, 40)
        collection = _collection(spark, str(tmp_path / f"c{case}"), buckets=4)
        batches = [rows[i : i + 30] for i in range(0, 120, 30)]
        if case:
            rng.shuffle(batches)
        for i, batch in enumerate(batches):
            collection.apply(spark.createDataFrame(batch, CHANGES), i, "run")
            if i in (0, 1):
                collection.compact()
        shown = lambda: {r["_id"]: [r.other, r.value, r.likes] for r in collection.documents().collect()}  # noqa: B023, E731
        assert shown() == _folded(rows) and len(collection.open_deltas()[0]) == 2
        assert {r["_id"]: r.likes for r in collection.documents().where("likes > 50").select("_id", "likes").collect()} == {k: v[2] for k, v in _folded(rows).items() if v[2] is not None and v[2] > 50}
        collection.compact(buckets=8)
        assert shown() == _folded(rows) and {r.buckets for r in collection.manifest()} == {8}
        collection.compact(forget_before=10**6)
        collection.drop_covered()
        assert shown() == _folded(rows) and collection.snapshot().where("deleted").count() == 0 and len(collection.bases()) == 1


def test_no_id_passes_the_filter_unseen(spark):
    ids = spark.range(3000).select((F.col("id") * 7).cast("string").alias("_id"))
    maybe = spark.range(21_000).select(F.col("id").cast("string").alias("_id")).where(co.maybe_in(ids, 3000))
    assert maybe.join(ids, "_id", "left_semi").count() == 3000 and maybe.count() < 4000


def _games(spark, tmp_path, n=4000, buckets=8):
    spec = SPECS["game"]
    collection = Collection(spark, str(tmp_path / "games"), jobs.GAME.schema(), (), spec, buckets=buckets)
    i = F.col("id")
    own = {"_id": i.cast("string"), "date": i * 10, "turns": (i % 90).cast("short"), "rated": i % 2 == 0, "perf": (i % 5).cast("int"), "white_user": F.concat(F.lit("u"), i % 50)}
    moment = F.struct(F.timestamp_seconds(i).alias("t"), i.alias("seq")).alias("version")
    made = lambda ids: ids.select(*[own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in spec.schema.fields], moment, F.lit(INDEX).alias("action"))
    collection.apply(made(spark.range(n)))
    collection.compact()
    return collection, made


def _plan(frame):
    frame.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_of_a_changed_collection_reach_its_files(spark, tmp_path):
    collection, made = _games(spark, tmp_path)
    collection.apply(made(spark.range(100, 110)).withColumn("turns", F.lit(1).cast("short")))
    found = search(collection.documents(), GameQuery(turns=(80, 85), rated=True), 0, 12)
    plan = _plan(found)
    pruned = [x for x in re.findall(r"PushedFilters: (.*?), ReadSchema: (.*)", plan) if "turns" in x[0]]
    assert pruned and all("GreaterThanOrEqual(turns,80)" in f and "EqualTo(rated,true)" in f and "white_user" not in s and "average_rating" not in s for f, s in pruned)
    assert all("white_user" not in s for s in re.findall(r"ReadSchema: (.*)", plan))  # nor is another column read to be merged
    direct = _plan(collection.documents().where("turns >= 80").select("_id"))
    above, base = direct.split("LeftAnti")[0], direct.split("LeftAnti")[1].split("BroadcastExchange")[0]  # the other side is the ids
    assert "GreaterThanOrEqual(turns,80)" in base and "Exchange" not in above + base
    fits = [i for i in range(4000) if i % 2 == 0 and 80 <= i % 90 <= 85 and not 100 <= i < 110]
    assert [int(r["_id"]) for r in found.collect()] == sorted(fits, reverse=True)[:12]
    assert count(collection.documents(), GameQuery(turns=(80, 85), rated=True)).first()["count"] == len(fits)


def test_a_compaction_rewrites_what_changed_and_disturbs_no_reader(spark, tmp_path):
    collection, made = _games(spark, tmp_path, buckets=16)
    reader, files = collection.documents().select("_id", "turns"), lambda n: sum(f.endswith(".parquet") for _, _, names in os.walk(tmp_path / "games" / f"data={n}") for f in names)
    assert files(0) == 16
    collection.apply(made(spark.range(5, 8)).withColumn("turns", F.lit(77).cast("short")))
    written = collection.compact()
    assert 1 <= len(written) <= 3 and files(1) == len(written)
    assert {r.data for r in collection.manifest()} == {0, 1} and sum(r.rows for r in collection.manifest()) == 4000
    assert {r.turns for r in reader.where("_id IN ('5', '6', '7')").collect()} == {5, 6, 7} and reader.count() == 4000
    assert {r.turns for r in collection.documents().where("_id IN ('5', '6', '7')").collect()} == {77}
    assert collection.compact() == []
    collection.drop_covered()
    assert files(0) == 16 - len(written) and collection.documents().count() == 4000


def test_pages_of_the_newest_read_few_rows(spark, tmp_path):
    n = 400_000
    collection, made = _games(spark, tmp_path, n, buckets=4)
    collection.apply(made(spark.range(10, 20)).withColumn("date", F.lit(10**9)))
    collection.apply(made(spark.range(n - 5, n - 3)).withColumn("action", F.lit(DELETE)).withColumn("version", F.struct(F.timestamp_seconds(F.lit(10**9)).alias("t"), F.lit(1).cast("long").alias("seq"))))
    asked = GameQuery(rated=True, perf=[1, 2, 3])
    dates = {i: 10**9 if 10 <= i < 20 else i * 10 for i in range(n) if not n - 5 <= i < n - 3 and i % 2 == 0 and i % 5 in (1, 2, 3)}
    want = sorted(dates, key=lambda i: (-dates[i], str(i)))
    got = newest_page(collection, asked.matches, "date", 0, 12).collect()
    assert [int(r["_id"]) for r in got] == want[:12]
    last = got[-1]
    assert [int(r["_id"]) for r in newest_page(collection, asked.matches, "date", 0, 12, behind=(last.date, last["_id"])).collect()] == want[12:24]
    assert [int(r["_id"]) for r in newest_page(collection, asked.matches, "date", 30, 5).collect()] == want[30:35]
    assert newest_page(collection, lambda rows: rows.where("white_user = 'nobody'"), "date").count() == 0
    rare = newest_page(collection, lambda rows: rows.where("_id IN ('3', '5')"), "date", 0, 12).collect()
    assert [r["_id"] for r in rare] == ["5", "3"]
    read = asked.matches(collection._base_rows(collection.manifest())).where(F.col("date") >= 10 * (n - 500)).select("_id")
    read.collect()
    scanned = read._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().get("numOutputRows").get().value()
    assert scanned < n / 4  # of a file sorted by date only the pages that may have such dates are read


def test_a_page_after_a_key_is_the_rest(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(str(i), rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for i in range(60)], "_id string, a int, b string")
    for keys in ([(F.col("a"), True), (F.col("b"), False)], [(F.col("a"), False)]):
        everything, behind, seen = [r["_id"] for r in page(rows, keys, 0, 100).collect()], None, []
        while found := page(rows, keys, 0, 7, behind).collect():
            seen += [r["_id"] for r in found]
            behind = (*[found[-1][n] for n in ("a", "b")[: len(keys)]], found[-1]["_id"])
        assert seen == everything and len(seen) == 60
    assert rows.where(after([(F.col("a"), True)], (None, "zzz"))).count() == 0


def test_buckets_follow_the_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(co, "BUCKET_ROWS", 50)
    collection = _collection(spark, str(tmp_path / "c"))
    rows = lambda low, high: spark.range(low, high).select(F.col("id").cast("string").alias("_id"), F.lit("o").alias("other"), F.lit(1).alias("value"), F.lit(1).alias("likes"), F.col("id").alias("version"), F.lit(INDEX).alias("action"))
    sizes = []
    for low, high in ((0, 40), (40, 120), (120, 1000), (1000, 1001)):
        collection.apply(rows(low, high))
        collection.compact()
        sizes.append(collection.manifest()[0].buckets)
    assert sizes == [1, 1, 32, 32] and collection.documents().count() == 1001
    assert all(r.marks is None for r in collection.manifest())


def test_buckets_follow_the_bytes_of_wide_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(co, "BUCKET_BYTES", 20_000)
    collection = _collection(spark, str(tmp_path / "wide"))
    rng, sizes = random.Random(3), []
    for batch, n in ((0, 100), (1, 10), (2, 700)):
        rows = [(f"d{batch}-{i}", rng.randbytes(500).hex(), 1, 1, batch, INDEX, True, True) for i in range(n)]
        collection.apply(spark.createDataFrame(rows, CHANGES), batch, "run")
        written = collection.compact()
        sizes.append(collection.manifest()[0].buckets)
        if batch == 1:
            assert len(written) < sizes[-1]
    assert sizes[0] == sizes[1] >= 4 and sizes[2] > sizes[1]
    assert collection.documents().count() == 810 and max(r.rows for r in collection.manifest()) < 100
