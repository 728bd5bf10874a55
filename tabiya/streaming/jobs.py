"""Whole collection jobs: records or change events to documents, applied to a collection.

A job knows one collection. Its `scan` reads the records touched in a half-open time range; its events come from a
change log. Both give records with `action` and `version`, and one function makes documents of them with the lookups
they need: topics, bot accounts, chapters. `index` runs a job once, `watch` keeps it running: as a stream of change
events, or, for studies, as scans of consecutive intervals.

`tables` gives a table by its name; it is asked anew for each batch, so lookups are as fresh as the batch.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructType, TimestampType

from tabiya.functions import games as g
from tabiya.operators import translate as tr
from tabiya.operators.changes import DELETE, INDEX, UPDATE, action, action_counts
from tabiya.operators.enrich import bot_accounts, looked_up, with_bot_flags, with_chapters, with_topic
from tabiya.operators.fulltext import TextIndex
from tabiya.sources import scans
from tabiya.sources.collections import SPECS
from tabiya.sources.intervals import interval_stream
from tabiya.sources.shared import run_id
from tabiya.streaming.collection import Collection
from tabiya.streaming.guard import Guard
from tabiya.streaming.ingest import ingest

Tables = Callable[[str], DataFrame]
VERSION = "struct<t:timestamp,seq:long>"


def _version(when: Column, seq: Column | None = None) -> Column:
    return F.struct(when.cast("timestamp").alias("t"), (F.lit(0) if seq is None else seq).cast("long").alias("seq")).alias("version")


def _latest(*times: str) -> Column:
    return _version(F.greatest(*[F.col(t) for t in times]) if len(times) > 1 else F.col(times[0]))


def _changes(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Documents to be indexed, and the ids of the records to be deleted."""
    gone = records.where(F.col("action") == DELETE).select("_id", "version", "action")
    return documents.withColumn("action", F.lit(INDEX)).unionByName(gone, allowMissingColumns=True)


def _live(records: DataFrame) -> DataFrame:
    return records.where(F.col("action") == INDEX)


def forum_changes(records: DataFrame, tables: Tables) -> DataFrame:
    topics = looked_up(tables("topics"), records, "topic_id")
    return _changes(tr.posts(with_topic(_live(records), topics), "version"), records)


def team_changes(records: DataFrame, tables: Tables) -> DataFrame:
    return _changes(tr.teams(_live(records), "version"), records)


def ublog_changes(records: DataFrame, tables: Tables) -> DataFrame:
    return _changes(tr.ublogs(_live(records), "version"), records)


def game_changes(records: DataFrame, tables: Tables) -> DataFrame:
    """With the bots of the moment; records may have a `back_rank`."""
    rows = _live(records).withColumn("white_user", g.player(F.col("players"), 1)).withColumn("black_user", g.player(F.col("players"), 2))
    rows = g.with_start_number(rows) if "back_rank" in rows.columns else rows.withColumn("chess960_pos", F.lit(g.NO_START))
    return _changes(tr.games(with_bot_flags(rows, bot_accounts(tables("accounts"))), "version"), records)


def study_changes(records: DataFrame, tables: Tables) -> DataFrame:
    chapters = looked_up(tables("chapters"), _live(records), "_id", "study_id")
    rows = with_chapters(_live(records), chapters, F.struct("_id", "name", "description", "tags"))
    return _changes(tr.studies(rows, "version"), records)


def _study_log(tables: Tables, since: object, until: object | None) -> DataFrame:
    """Deletions, and likes and ranks, of the log in a range."""
    log = tables("study_log")
    seq = F.col("seq") if "seq" in log.columns else None
    gone = scans.deleted_studies(log, since, until).select("_id", _version(F.col("ts"), seq), F.lit(DELETE).alias("action"))
    liked = scans.study_likes(log, since, until).select("_id", "likes", F.date_format("rank", "yyyy-MM-dd HH:mm:ss").alias("rank"), "has_likes", "has_rank", _version(F.col("ts"), seq), F.lit(UPDATE).alias("action"))
    return gone.unionByName(liked, allowMissingColumns=True)


@dataclass(frozen=True)
class Job:
    """records: scan of a range, with action and version. changes: records to documents with action and version.
    dead: of a change event's document, whether it is to be deleted."""

    name: str
    records: Callable[[Tables, object, object | None], DataFrame]
    changes: Callable[[DataFrame, Tables], DataFrame]
    dead: Callable[[Column], Column] | None = None
    longest: int | None = None
    updatable: tuple[str, ...] = ()
    log: Callable[[Tables, object, object | None], DataFrame] | None = None
    parity: bool = field(default=False, kw_only=True)

    def schema(self) -> StructType:
        """The stored documents: the collection's columns with version and deleted."""
        return StructType(list(SPECS[self.name].schema.fields)).add("version", StructType().add("t", TimestampType()).add("seq", LongType())).add("deleted", BooleanType())

    def collection(self, spark: SparkSession, path: str) -> Collection:
        return Collection(spark, path, self.schema(), self.updatable, SPECS[self.name])

    def scan(self, tables: Tables, since: object, until: object | None = None) -> DataFrame:
        """All changes of a range: documents to be indexed, ids to be deleted, partial updates."""
        found = self.changes(self.records(tables, since, until), tables)
        return found if self.log is None else found.unionByName(self.log(tables, since, until), allowMissingColumns=True)

    def guard(self, events: DataFrame, horizon: timedelta, seed: bool) -> Guard:
        """What a stream of the job's events remembers: events that are no changes of the collection don't count."""
        counts = scans.counted_games(events, self.parity) if self.name == "game" else scans.counted(events, self.name, self.longest)
        dead = F.lit(False) if self.name == "game" else self.dead(F.col("full_document"))
        return Guard(counts, action(F.col("op"), dead) == DELETE, horizon=horizon, seed=seed)

    def events(self, events: DataFrame, tables: Tables) -> DataFrame:
        """The same of change events (op, cluster_time, seq, doc_id, full_document)."""
        if self.name == "game":
            last = scans.game_changes(events, self.parity)
        else:
            last = scans.changes(events, self.name, self.dead(F.col("full_document")), self.longest)
        known = [c for c in last.schema["full_document"].dataType.names if c != "_id"]
        rows = last.select(F.col("doc_id").alias("_id"), *[F.col(f"full_document.{c}").alias(c) for c in known], _version(F.col("cluster_time"), F.col("seq")), "action")
        return self.changes(rows, tables)


def _timed(rows: DataFrame, *times: str) -> DataFrame:
    return rows.withColumn("version", _latest(*times))


FORUM = Job(
    "forum", lambda t, since, until: _timed(scans.forum_posts(t("posts"), since, until), "created_at", "updated_at", "erased_at"), forum_changes,
    lambda doc: doc["erased_at"].isNotNull(), scans.MAX_POST,
)
TEAM = Job("team", lambda t, since, until: _timed(scans.teams(t("teams"), since, until), "created_at", "updated_at", "erased_at"), team_changes, lambda doc: ~doc["enabled"])
UBLOG = Job("ublog", lambda t, since, until: _timed(scans.ublogs(t("ublogs"), since, until), "lived.at"), ublog_changes, lambda doc: ~doc["live"] | (doc["automod"]["quality"] == 0))
GAME = Job("game", lambda t, since, until: _timed(scans.games(t("games"), since, until), "created_at").withColumn("action", F.lit(INDEX)), game_changes)
STUDY = Job(
    "study", lambda t, since, until: _timed(scans.studies(t("studies"), since, until), "created_at", "updated_at").withColumn("action", F.lit(INDEX)), study_changes,
    updatable=("likes", "rank"), log=_study_log,
)
JOBS = {job.name: job for job in (FORUM, GAME, STUDY, TEAM, UBLOG)}


def index(job: Job, tables: Tables, collection: Collection, since: object, until: object | None = None, dry: bool = False) -> DataFrame | None:
    """Everything touched in [since, until) applied to the collection; with `dry`, what would be done, by action."""
    changes = job.scan(tables, since, until)
    if dry:
        return action_counts(changes)
    collection.apply(changes, run=uuid.uuid4().hex)
    return None


def index_all(jobs: list[tuple[Job, Tables, Collection]], since: object, until: object | None = None, dry: bool = False) -> DataFrame | None:
    """Several collections; with `dry`, counts by collection and action."""
    found = [(job.name, index(job, tables, collection, since, until, dry)) for job, tables, collection in jobs]
    counts = [frame.select(F.lit(name).alias("collection"), "*") for name, frame in found if frame is not None]
    return reduce(DataFrame.unionByName, counts) if counts else None


def follow(index: TextIndex, collection: Collection) -> TextIndex:
    """Brings a stored text index up to a collection: the first time of all its documents, then of those that the
    deltas since then are about. Deltas may only be dropped once the indexes of a collection have followed them."""
    deltas = set(collection.tables("delta"))
    if not index.states():
        return index.build(collection.documents(), deltas.union(*map(collection.covered, collection.bases()[-1:])))
    known = index.followed()
    new = deltas - known
    if not new:
        return index
    if lost := set().union(*map(collection.covered, collection.bases())) - known - deltas:
        raise ValueError(f"{len(lost)} deltas were dropped before the index had them; build it anew")
    documents, ids = collection.documents(), collection.touched(new)
    return index.update(documents.join(ids, "_id", "left_semi"), ids.join(documents.select("_id"), "_id", "left_anti"), new)


def intervals(since: datetime, every: timedelta, until: datetime | None = None, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc), wait: Callable[[float], None] = time.sleep) -> Iterator[tuple[datetime, datetime]]:
    """Consecutive half-open intervals: the first from `since` to now, each other from there to now, `every` later."""
    start = since
    while until is None or start < until:
        end = now() if until is None else min(now(), until)
        if end > start:
            yield start, end
            start = end
        if until is None or start < until:
            wait(every.total_seconds())


def poll(job: Job, tables: Tables, collection: Collection, every: timedelta, since: datetime | None = None, until: datetime | None = None, **clock: Callable) -> None:
    """Scans of consecutive intervals. Where it left off is kept with the collection, after each interval is applied,
    and is where the next call starts unless `since` is given."""
    kept = collection.position(job.name)
    start = since or (datetime.fromisoformat(kept) if kept else datetime.now(timezone.utc))
    for low, high in intervals(start, every, until, **clock):
        index(job, tables, collection, F.lit(low), F.lit(high))
        collection.set_position(job.name, high.isoformat())


def watch_intervals(job: Job, tables: Tables, collection: Collection, checkpoint: str, since: datetime | None = None, until: datetime | None = None, every: str | None = None, dry_run: Callable | None = None) -> StreamingQuery:
    """A job's scans of consecutive intervals as a stream. A new checkpoint starts at `since`, by default now; where the
    query left off is in the checkpoint, and a batch that is run again scans the same interval and overwrites its delta."""
    spark, run = collection.spark, run_id(collection.spark, checkpoint)

    def body(batch: DataFrame, number: int) -> None:
        for low, high in batch.collect():  # one row
            changes = job.scan(tables, F.lit(low), F.lit(high))
            dry_run(action_counts(changes), number) if dry_run else collection.apply(changes, number, run)

    stream = interval_stream(spark, since or datetime.now(timezone.utc), until)
    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watch(
    job: Job, events: DataFrame | None, tables: Tables, collection: Collection, checkpoint: str, since: object = None, every: str | None = None, dry_run: Callable | None = None, until: datetime | None = None,
    remember: timedelta | None = None, seed: bool = False,
) -> StreamingQuery:
    """A job's change events as a stream (see `ingest`); the operations and lengths that count are the job's. Jobs that
    have no events, as that of studies, scan consecutive intervals until `until` instead. With `remember`, changes that
    the stream had within that time, or newer ones of the same document, are dropped before they are written."""
    if job.log is not None:
        return watch_intervals(job, tables, collection, checkpoint, since, until, every, dry_run)
    guard = None if remember is None else job.guard(events, remember, seed)
    return ingest(events, collection, lambda batch: job.events(batch, tables), checkpoint, since, dry_run, every, last_only=False, guard=guard)
