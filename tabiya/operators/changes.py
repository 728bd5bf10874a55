"""Change logs applied to collections: the last change of a document, upserts, partial updates, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDEX, UPDATE, DELETE = "index", "update", "delete"


def last_per_document(events: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("cluster_time", "seq")) -> DataFrame:
    """The last event of each document; events without a document go. As a maximum, not a sorted window, so that
    events are combined before the shuffle and a document with very many of them is no large group; only the order is
    compared, so other columns may be of any type, also maps."""
    rest = [c for c in events.columns if c not in (key, *order)]
    last = [F.max(F.struct(*order)).alias("_last"), *([F.max_by(F.struct(*rest), F.struct(*order)).alias("_rest")] if rest else [])]
    found = events.where(F.col(key).isNotNull()).groupBy(key).agg(*last)
    return found.select(*[F.col(key) if c == key else F.col(f"_last.{c}") if c in order else F.col(f"_rest.{c}") for c in events.columns])


def action(op: Column, dead: Column) -> Column:
    """What is to be done: deleted and dead documents are deleted, others indexed."""
    return F.when((op == DELETE) | F.coalesce(dead, F.lit(False)), F.lit(DELETE)).otherwise(F.lit(INDEX))


def upsert(base: DataFrame, rows: DataFrame, key: str = "_id") -> DataFrame:
    """Whole documents replaced or added."""
    return base.join(rows.select(key), key, "left_anti").unionByName(rows.select(*base.columns))


def partial_update(base: DataFrame, rows: DataFrame, fields: list[str], key: str = "_id") -> DataFrame:
    """Given fields merged into documents that exist; unknown ids change nothing. `has_<field>` in rows says that a
    field is given, since a given null isn't a missing field."""
    given = rows.select(F.col(key), *[F.col(f).alias(f"_new_{f}") for f in fields], *[F.col(f"has_{f}").alias(f"_has_{f}") for f in fields])
    joined = base.join(given, key, "left")
    merged = {f: F.when(F.coalesce(F.col(f"_has_{f}"), F.lit(False)), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}
    return joined.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in base.columns])


def delete(base: DataFrame, ids: DataFrame, key: str = "_id") -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


def apply_changes(base: DataFrame, upserts: DataFrame | None = None, updates: DataFrame | None = None, deletes: DataFrame | None = None, fields: list[str] | None = None, key: str = "_id") -> DataFrame:
    """One batch: upserts, then partial updates, then deletes. Applying it twice changes nothing more."""
    out = base if upserts is None else upsert(base, upserts, key)
    out = out if updates is None else partial_update(out, updates, fields or [], key)
    return out if deletes is None else delete(out, deletes, key)


def merge_versions(base: DataFrame, changes: DataFrame, key: str = "_id", version: str = "version") -> DataFrame:
    """The collection after changes (its columns and `action`), each applied only if it is not older than what is
    stored; a deletion leaves a row with `deleted`, so that an older change can't bring the document back."""
    new = changes.withColumn("deleted", F.col("action") == DELETE).drop("action")
    both = base.withColumn("_rank", F.lit(0)).unionByName(new.select(*base.columns).withColumn("_rank", F.lit(1)))
    return last_per_document(both, key, (version, "_rank")).drop("_rank")


def merged(**frames: DataFrame) -> DataFrame:
    """Frames as one, each row with its frame's name as `action`."""
    named = [frame.withColumn("action", F.lit(name)) for name, frame in frames.items()]
    out = named[0]
    for frame in named[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def split_actions(changes: DataFrame, names: tuple[str, ...] = (INDEX, UPDATE, DELETE)) -> dict[str, DataFrame]:
    return {name: changes.where(F.col("action") == name).drop("action") for name in names}


def action_counts(changes: DataFrame) -> DataFrame:
    """Also the dry run: what a batch would do, without doing it."""
    return changes.groupBy("action").agg(F.count("*").alias("n"))


def batch_time(events: DataFrame, time: str = "cluster_time", seq: str = "seq") -> DataFrame:
    """The latest time in a batch, and the time of its last event in arrival order."""
    return events.agg(F.max(time).alias("latest"), F.max_by(time, seq).alias("of_last"))
