"""Streams that are stopped in the middle of a batch."""

from datetime import datetime, timedelta, timezone

import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from tabiya.sources import sinks
from tabiya.sources.shared import read_text, write_text
from tabiya.streaming import jobs


def test_an_export_has_each_row_once_also_when_a_batch_is_run_again(spark, tmp_path, monkeypatch):
    source, out, checkpoint = str(tmp_path / "source"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    spark.range(10).repartition(3).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    real, failed = sinks.write_csv, []

    def fails_after_its_write(rows, path, append=False):
        real(rows, path, append)
        if len(failed) < 2:
            failed.append(path)
            raise RuntimeError("stopped")

    monkeypatch.setattr(sinks, "write_csv", fails_after_its_write)
    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            sinks.export_stream(stream(), out, checkpoint).awaitTermination()
    sinks.export_stream(stream(), out, checkpoint).awaitTermination()
    assert failed[0] == failed[1] and sorted(r.id for r in sinks.exported(spark, out, "id long").collect()) == list(range(10))
    spark.range(10, 15).write.mode("append").parquet(source)
    sinks.export_stream(stream(), out, checkpoint).awaitTermination()
    assert sorted(r.id for r in sinks.exported(spark, out, "id long").collect()) == list(range(15))
    assert sinks.exported(spark, str(tmp_path / "nothing"), "id long").count() == 0


def _studies(spark, day):
    rows = [(str(n), f"S{n}", "-", "ann", {"bob": "w"}, ["t"], n, "public", None, None, day(n), None) for n in range(1, 9)]
    schema = "_id string, name string, description string, owner_id string, members map<string,string>, topics array<string>, likes int, visibility string, rank timestamp, origin string, created_at timestamp, updated_at timestamp"
    log = "ts timestamp, ns string, op string, o struct<_id:string,diff:struct<u:struct<likes:int,rank:timestamp>>>, o2 struct<_id:string>"
    tables = {
        "studies": spark.createDataFrame(rows, schema),
        "chapters": spark.createDataFrame([], "_id string, study_id string, name string, description string, tags array<string>"),
        "study_log": spark.createDataFrame([(day(4), "db.study", "d", ("2", None), None), (day(6), "db.study", "u", (None, ((77, None),)), ("1",))], log),
    }
    return tables.__getitem__


def test_a_study_watch_is_a_stream_that_goes_on_in_the_middle_of_a_batch(spark, tmp_path, monkeypatch):
    day = lambda n: datetime(2020, 1, n, tzinfo=timezone.utc)
    tables, collection, checkpoint = _studies(spark, day), jobs.STUDY.collection(spark, str(tmp_path / "docs")), str(tmp_path / "checkpoint")
    watched = lambda until, **more: jobs.watch(jobs.STUDY, None, tables, collection, checkpoint, day(1), until=until, **more).awaitTermination()
    shown = lambda: {r["_id"]: r.likes for r in collection.documents().collect()}
    watched(day(3))
    assert shown() == {"1": 1, "2": 2}
    real = type(collection).apply

    def applies_and_fails(self, *args):
        real(self, *args)
        raise RuntimeError("stopped")

    monkeypatch.setattr(type(collection), "apply", applies_and_fails)
    with pytest.raises(Exception, match="stopped"):
        watched(day(5))
    monkeypatch.setattr(type(collection), "apply", real)
    n = len(collection.tables("delta"))
    watched(day(5) + timedelta(hours=1))  # the interval that was begun
    assert shown() == {"1": 1, "3": 3, "4": 4} and len(collection.tables("delta")) == n
    watched(day(5) + timedelta(hours=1))  # and the next
    assert shown() == {"1": 1, "3": 3, "4": 4, "5": 5} and len(collection.tables("delta")) == n + 1
    watched(day(20))
    assert shown() == {"1": 77, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8}
    n = len(collection.tables("delta"))
    watched(day(20))  # nothing is left
    assert len(collection.tables("delta")) == n


def test_a_small_file_is_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "small")
    assert read_text(spark, path) is None
    write_text(spark, path, "one")
    write_text(spark, path, "two")
    assert read_text(spark, path) == "two" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["small"]
    open(path, "w").close()
    assert read_text(spark, path) is None


def test_files_of_an_exported_stream_do_not_grow_with_it(spark, tmp_path, monkeypatch):
    from tabiya.plans import jobs as plans

    monkeypatch.setattr(plans, "new_path", lambda spark, label: str(tmp_path / label))
    monkeypatch.setattr(plans, "EXPORT_ROWS", 100, raising=False)
    found = plans.csv_export_stream(spark, SMALL).count()
    per_file = [r["count"] for r in spark.read.parquet(str(tmp_path / "csv-source")).groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == found and max(per_file) < found / 5
    assert len(list((tmp_path / "csv-stream").glob("part=*"))) == 3
