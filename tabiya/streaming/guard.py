"""A stream's memory of versions: changes that are late or repeated go before they are written.

The state has, for each document, the moment of its newest whole change (or deletion) and those of the columns that
partial updates gave since; a moment is the version, as integers, and the kind of change, as `Collection` orders them,
written as digits that sort as the numbers do.
A change passes if it is newer than what the state has of the document or, for a partial update, of one of its columns.
What doesn't pass would change nothing when the collection is read, so the guard saves work and never decides a result:
a document that it has forgotten (its changes rested for longer than `horizon` by the clock) passes and is left to the
versions. Nothing is dropped for its age alone, as a watermark would.

State lies in RocksDB, a row for each document seen within the horizon, so it is bounded by disk, not by memory. Rows of
a document pass one by one, so one with very many changes in a batch costs time in one task but no memory; how many
there are in a batch is bounded by the files of a batch (`change_log`). Each value of a row costs Python more than the
comparison, so a row has three: the key, what the change is, and the event, packed as a variant. With `seed` a new checkpoint starts from the
versions that the collection has (a scan of ids and moments alone); else with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, DayTimeIntervalType, IntegralType, MapType, StringType, StructType, TimestampNTZType, TimestampType, VariantType, YearMonthIntervalType

from tabiya.streaming.collection import Collection

#: Settings of a guarded stream. Batches without data would follow one another for ever, since state that expires by the
#: clock always asks for another; what has expired goes with the next batch that has data.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: The name under which a whole change is kept beside the columns of partial updates.
WHOLE = ""
SEEN = StructType().add("moments", MapType(StringType(), StringType()))
#: Stands behind the moment of a partial update and between the columns that it gives.
GIVES = "\n"
#: A missing part of a version is older than any.
LEAST = -(1 << 63)
KINDS = {"whole": 0, "partial": 1, "deletion": 2}


@dataclass(frozen=True)
class Guard:
    """counts: which events are changes at all; others pass neither the guard nor into its memory. deletion, partial:
    of an event, what kind of change it is; gives: the columns that a partial update gives. version: the event columns
    that make its version, integers or timestamps, in the order of the collection's. seed: start a new checkpoint from
    the versions that the collection has."""

    counts: Column | None = None
    deletion: Column | None = None
    partial: Column | None = None
    gives: Column | None = None
    key: str = "doc_id"
    version: tuple[str, ...] = ("cluster_time", "seq")
    horizon: timedelta = timedelta(days=7)
    seed: bool = False


def _whole_number(value: Column, kind: DataType) -> Column:
    if isinstance(kind, TimestampNTZType):
        value, kind = F.convert_timezone(F.lit("UTC"), F.lit("UTC"), value).cast("string").cast("timestamp"), TimestampType()
    if isinstance(kind, TimestampType):
        value = F.unix_micros(value)
    elif not isinstance(kind, IntegralType):
        raise ValueError(f"a version of {kind.simpleString()} can't be guarded, only integers and timestamps")
    return F.coalesce(value.cast("long"), F.lit(LEAST))


class _Memory(StatefulProcessor):
    def __init__(self, horizon: timedelta):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", SEEN, int(self.horizon.total_seconds() * 1000))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        known = {name: moment for name, moment in dict(initialState["moments"]).items() if moment is not None}
        if known:
            self.seen.update((known,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found = self.seen.get()
        known, changed = dict(found[0]) if found else {}, False
        for _, change, event in rows:
            moment, *gives = change.split(GIVES)
            whole = known.get(WHOLE)
            newer = [n for n in (filter(None, gives) if gives else [WHOLE]) if all(at is None or moment > at for at in (whole, known.get(n)))]
            if not newer:
                continue
            changed = True
            if not gives:
                known = {n: at for n, at in known.items() if at > moment}
            known.update((n, moment) for n in newer)
            yield Row(_event=event)
        if changed:
            self.seen.update((known,))


def _digits(number: Column) -> Column:
    """A long as sixteen digits whose order is that of the numbers."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(LEAST))), 16, "0")


def _change(events: DataFrame, guard: Guard) -> Column:
    """The moment of each event and, of a partial update, the columns that it gives."""
    holds = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    kind = F.when(holds(guard.deletion), KINDS["deletion"]).when(holds(guard.partial), KINDS["partial"]).otherwise(KINDS["whole"])
    moment = F.concat(*[_digits(_whole_number(events[c], events.schema[c].dataType)) for c in guard.version], _digits(kind.cast("long")))
    gives = F.lit("") if guard.gives is None else F.coalesce(F.array_join(guard.gives, GIVES), F.lit(""))
    partial = kind == KINDS["partial"]
    # without `gives` a partial update counts as a whole change
    return F.when(partial & F.lit(guard.gives is not None), F.concat(moment, F.lit(GIVES), gives)).otherwise(moment).alias("_change")


def _packs(kind: DataType) -> bool:
    """Whether a variant holds values of a type as they are."""
    if isinstance(kind, StructType):
        return all(_packs(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _packs(kind.elementType)
    if isinstance(kind, MapType):
        return isinstance(kind.keyType, StringType) and _packs(kind.valueType)
    return not isinstance(kind, (DayTimeIntervalType, YearMonthIntervalType))


def known_versions(collection: Collection) -> DataFrame:
    """The moments that a collection has of each document, as the guard's memory has them."""
    def numbers(at: Column) -> Column:
        version = collection.schema["version"].dataType
        parts = [_whole_number(at["version"][f.name], f.dataType) for f in version.fields] if isinstance(version, StructType) else [_whole_number(at["version"], version)]
        return F.when(at.isNotNull(), F.concat(*map(_digits, parts), _digits(at["kind"].cast("long"))))

    named = {WHOLE: "_at"} | {name: f"_at_{name}" for name in collection.updatable}
    moments = F.create_map(*[x for name, at in named.items() for x in (F.lit(name), numbers(F.col(at)))])
    return collection.moments().select("_id", moments.alias("moments"))


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside are run with SETTINGS; the session has its own again afterwards."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def newer_only(events: DataFrame, guard: Guard, collection: Collection | None = None) -> DataFrame:
    """The events of a stream that may change a document; start it inside `settings`. Events without a document go."""
    counted = events.where(F.col(guard.key).isNotNull())
    counted = counted if guard.counts is None else counted.where(guard.counts)
    event, packs = F.struct(*[F.col(c) for c in events.columns]), _packs(events.schema)
    tagged = counted.select(guard.key, _change(events, guard), (F.to_variant_object(event) if packs else event).alias("_event")).groupBy(guard.key)
    seed = known_versions(collection).withColumnRenamed("_id", guard.key).groupBy(guard.key) if guard.seed and collection is not None else None
    passed = tagged.transformWithState(_Memory(guard.horizon), StructType().add("_event", VariantType() if packs else events.schema), "Update", "ProcessingTime", seed)
    return passed.select(F.col("_event").cast(events.schema).alias("_event")).select("_event.*")
