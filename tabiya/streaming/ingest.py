"""Continuous ingest: a stream of changes kept applied to a collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabiya.operators.changes import action_counts, last_per_document
from tabiya.sources.shared import run_id
from tabiya.streaming.collection import Collection
from tabiya.streaming.guard import Guard, newer_only, settings

__all__ = ["Collection", "ingest", "run_all", "run_id"]


def ingest(
    events: DataFrame,
    collection: Collection,
    translate: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    since: object = None,
    dry_run: Callable[[DataFrame, int], None] | None = None,
    every: str | None = None,
    last_only: bool = True,
    guard: Guard | None = None,
) -> StreamingQuery:
    """Starts the query: last change per document, translation (which gives _id, the documents' columns, version and
    action), and the batch applied. Tables that `translate` reads are read again in each batch. Without `every` what is
    there is worked off and the query ends. Where it left off is in the checkpoint; to start at a time instead, give
    `since` and a new checkpoint: what the collection has stays, and events that it has already change nothing. Logs
    with partial updates need `last_only=False`: a batch's earlier changes of a document then count too. With a `guard`
    changes that the stream has had already are not written; what passes is written once beside the checkpoint, since a
    batch is read several times and its state must not be, and a batch of which nothing passes leaves no delta."""
    if since is not None:
        events = events.where(events["cluster_time"] >= since)
    run, passed = run_id(events.sparkSession, checkpoint), f"{checkpoint.rstrip('/')}/_passed"

    def body(batch: DataFrame, number: int) -> None:
        if guard:
            batch.write.mode("overwrite").parquet(passed)
            batch = events.sparkSession.read.schema(batch.schema).parquet(passed)
            if batch.isEmpty():
                return
        changes = translate(last_per_document(batch) if last_only else batch)
        dry_run(action_counts(changes), number) if dry_run else collection.apply(changes, number, run)

    def started(rows: DataFrame) -> StreamingQuery:
        writer = rows.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).outputMode("update" if guard else "append").start()

    if guard is None:
        return started(events)
    with settings(events.sparkSession):
        return started(newer_only(events, guard, collection))


def run_all(starts: list[Callable[[], StreamingQuery]], timeout: int | None = None) -> list[StreamingQuery]:
    """Several collections at once; returns when all bounded queries are done (others run on after `timeout`)."""
    running = [start() for start in starts]
    for query in running:
        query.awaitTermination(timeout) if timeout else query.awaitTermination()
    return running
