"""Inverted lookup of exact fields: whose games, and which have these values, answered without reading the documents.

Documents are numbered once. Of a field with few values (a flag, a status) each value has a bitmap over the numbers, in
buckets of 32,768 bits, so several values are an OR and several fields an AND of bitmaps, and a count is a count of bits.
Of a field with many values (a user) each value has the list of its documents, sorted by value, so a look-up reads its
values and nothing else. What is asked beyond these fields is asked of the documents that the lists leave.

An index follows the buckets of a collection's base. It consists of parts; a part is of some buckets, each as one
compaction wrote it, so after a compaction only the buckets that it rewrote are read, into a new part. A new part also
takes over the buckets of parts that have no more documents than it has itself, so there are as many parts as the
logarithm of the documents, and each document is read anew that often. What a part has of buckets that were rewritten
since is left out when it is read. Open deltas are laid over the answers as they are over the base: documents that they
are about are taken out and asked by themselves.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tabiya.operators.search import GameQuery, count
from tabiya.sources.shared import completed
from tabiya.streaming.collection import BROADCAST_IDS, Collection

#: Fields of games that have bitmaps, and those that have lists.
FLAGS, USERS = ("perf", "status", "source", "rated", "winner_color", "analysed", "clock_inc"), ("white_user", "black_user")


#: What a part has: the bucket `home` as the compaction `data` wrote it.
HOMES = StructType().add("home", IntegerType()).add("data", IntegerType())
#: A bitmap is of one part, one home, and one bucket of 32,768 numbers.
PLACE = ["part", "home", "bucket"]


class KeywordIndex:
    """Tables below a path, each in `part=<n>`: `numbers` (n, home, bucket, position, _id), `bitmaps` (field, value,
    home, bucket, bits), `lists` (field, value, n, home, bucket, position, _id), and `homes`, written last: a part
    without it doesn't count."""

    def __init__(self, spark: SparkSession, path: str, flags: tuple[str, ...] = FLAGS, lists: tuple[str, ...] = USERS):
        self.spark, self.path, self.flags, self.lists = spark, path.rstrip("/"), flags, lists
        self.used: list[tuple[int, int]] = []

    def parts(self) -> list[int]:
        return sorted(map(int, completed(self.spark, f"{self.path}/homes", "part")))

    def _held(self) -> dict[tuple[int, int], int]:
        """The newest part that has a bucket as a compaction wrote it: MOST_BUCKETS rows for each part at most."""
        parts = self.parts()
        rows = self.spark.read.schema(HOMES).option("basePath", f"{self.path}/homes").parquet(*[f"{self.path}/homes/part={n}" for n in parts]).collect() if parts else []
        held: dict[tuple[int, int], int] = {}
        for r in sorted(rows, key=lambda r: r.part):
            held[r.home, r.data] = r.part
        return held

    def at(self, collection: Collection) -> KeywordIndex:
        """The index as it stands for the newest base, which it must have followed."""
        held, manifest = self._held(), collection.manifest()
        if any((r.bucket, r.data) not in held for r in manifest):
            raise ValueError("the collection was compacted since the index followed it")
        self.used = [(held[r.bucket, r.data], r.bucket) for r in manifest]
        return self

    def follow(self, collection: Collection) -> KeywordIndex:
        """Brings the index up to the newest base; a state that it has is left as it is."""
        held, manifest = self._held(), collection.manifest()
        new = [r for r in manifest if (r.bucket, r.data) not in held]
        if new:
            older: dict[int, list] = {}
            for r in manifest:
                if (r.bucket, r.data) in held:
                    older.setdefault(held[r.bucket, r.data], []).append(r)
            for rows in sorted(older.values(), key=lambda rows: sum(r.rows for r in rows)):
                if sum(r.rows for r in rows) > sum(r.rows for r in new):
                    break
                new += rows
            part = max(self.parts(), default=-1) + 1
            self._build(part, collection.bucket_documents(new))
            homes = self.spark.createDataFrame([(r.bucket, r.data) for r in new], HOMES)
            homes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/homes/part={part}")
        return self.at(collection)

    def drop_unused(self, collection: Collection) -> None:
        """Deletes the parts that have nothing of the newest base; no reader may still be at an older one."""
        used = {part for part, _ in self.at(collection).used}
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        for part in self.parts():
            for kind in ("homes", "lists", "bitmaps", "numbers") if part not in used else ():
                path = at(f"{self.path}/{kind}/part={part}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _part(self, kind: str, *parts: int) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/part={n}" for n in parts])

    def _read(self, kind: str) -> DataFrame:
        """Of each part what is in use: at most MOST_BUCKETS pairs, which are broadcast."""
        if not self.used:
            raise ValueError("an index must follow a collection that has a base before it is read")
        used = self.spark.createDataFrame(self.used, "part int, home int")
        return self._part(kind, *sorted({part for part, _ in self.used})).join(F.broadcast(used), ["part", "home"], "left_semi")

    def _build(self, part: int, documents: DataFrame) -> None:
        write = lambda frame, kind: frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{kind}/part={part}")
        n = F.col("n")
        numbered = documents.select("_id", F.col("_bucket").alias("home"), *self.flags, *self.lists).withColumn("n", F.monotonically_increasing_id())
        write(numbered.select("*", F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("position")), "numbers")
        rows = self._part("numbers", part).drop("part")
        each = lambda fields: F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f")
        flags = rows.select("home", "bucket", "position", each(self.flags)).select("f.field", "f.value", "home", "bucket", "position").where("value IS NOT NULL")
        order = ["field", "value", "home", "bucket"]
        write(flags.groupBy(*order).agg(F.bitmap_construct_agg("position").alias("bits")).repartitionByRange(*order).sortWithinPartitions(*order), "bitmaps")
        lists = rows.select("n", "home", "bucket", "position", "_id", each(self.lists)).select("f.field", "f.value", "n", "home", "bucket", "position", "_id").where("value IS NOT NULL")
        write(lists.repartitionByRange("value", "field", "n").sortWithinPartitions("value", "field", "n"), "lists")

    def bitmaps(self, conditions: dict[str, list[str]]) -> DataFrame:
        """Place and bits of the documents that have one of the values in each field."""
        asked = reduce(Column.__or__, [(F.col("field") == field) & F.col("value").isin(values) for field, values in conditions.items()])
        either = self._read("bitmaps").where(asked).groupBy("field", *PLACE).agg(F.bitmap_or_agg("bits").alias("bits"))
        both = either.groupBy(*PLACE).agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("fields"))
        return both.where(F.col("fields") == len(conditions)).drop("fields")

    def listed(self, wanted: list[list[tuple[str, str]]]) -> DataFrame:
        """Numbers and ids of the documents that, for each of the lists of (field, value), have one of them."""
        values = sorted({value for one in wanted for _, value in one})
        rows = self._read("lists").where(F.col("value").isin(values))
        has = lambda field, value: F.max(((F.col("field") == field) & (F.col("value") == value)).cast("int"))
        met = [reduce(F.greatest, [has(*pair) for pair in one]) if len(one) > 1 else has(*one[0]) for one in wanted]
        found = rows.groupBy("n", *PLACE, "position", "_id").agg(*[m.alias(f"m{i}") for i, m in enumerate(met)])
        return found.where(reduce(Column.__and__, [F.col(f"m{i}") == 1 for i in range(len(met))])).select("n", *PLACE, "position", "_id")

    def ids(self, conditions: dict[str, list[str]], wanted: list[list[tuple[str, str]]]) -> DataFrame:
        """_id of the documents that meet all."""
        rows = self.listed(wanted) if wanted else self._read("numbers").select(*PLACE, "position", "_id")
        if conditions:
            byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            rows = rows.join(self.bitmaps(conditions), PLACE).where(F.getbit(byte, (F.col("position") % 8).cast("int")) == 1)
        return rows.select("_id")

    def count(self, conditions: dict[str, list[str]], wanted: list[list[tuple[str, str]]]) -> DataFrame:
        if wanted:
            return self.ids(conditions, wanted).agg(F.count("*").alias("count"))
        return self.bitmaps(conditions).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("count"))


def asked_of_lists(query: GameQuery) -> tuple[dict[str, list[str]], list[list[tuple[str, str]]], bool]:
    """What a query asks of bitmaps and of lists, and whether that is all it asks."""
    from tabiya.functions.predicates import DRAWN_GROUP, DRAWN_STATUS

    text = lambda value: str(value).lower() if isinstance(value, bool) else str(value)
    status = None if query.status is None else list(DRAWN_GROUP) if query.status == DRAWN_STATUS else [query.status]
    given = {"perf": query.perf or None, "status": status} | {name: None if (value := getattr(query, name)) is None else [value] for name in ("source", "rated", "winner_color", "analysed", "clock_inc")}
    conditions = {field: [text(v) for v in values] for field, values in given.items() if values is not None}
    white, black = USERS
    wanted = [[(side, user)] for side, user in ((white, query.white_user and query.white_user.lower()), (black, query.black_user and query.black_user.lower())) if user]
    players = [u for u in (query.user1, query.user2) if u is not None]
    wanted += [[(white, u), (black, u)] for u in players]
    others = [u for u in (query.winner, query.loser) if u is not None]  # of which side, the documents say
    wanted += [[(white, u), (black, u)] for u in others]
    ranges = (query.turns, query.average_rating, query.ai_level, query.date, query.duration)
    same = len(players) == 2 and players[0] == players[1]  # one user on both sides
    whole = not others and not same and query.has_ai is None and query.clock_init is None and all(r == (None, None) for r in ranges)
    return conditions, wanted, whole


def _named(documents: DataFrame, queries: Mapping[str, GameQuery]) -> DataFrame:
    """asked and _id: a row for each query that a document meets, by the query's name, in one pass."""
    met = F.filter(F.array(*[F.when(q.predicate(), F.lit(name)) for name, q in queries.items()]), lambda name: name.isNotNull())
    return documents.select(F.explode(met).alias("asked"), "_id")


def matching_each(collection: Collection, index: KeywordIndex, queries: Mapping[str, GameQuery]) -> DataFrame:
    """asked and _id of the games that match each of some queries, by the queries' names. Changes are merged and asked
    once for all of them, as are the base's documents where lists and bitmaps don't answer the whole question; `index`
    has followed the collection's newest base."""
    asked = {name: asked_of_lists(q) for name, q in queries.items()}
    looked = {name: q for name, q in queries.items() if any(asked[name][:2])}
    others = {name: q for name, q in queries.items() if name not in looked}
    parts = [_named(collection.documents(), others)] if others else []
    if looked:
        index.at(collection)
        ids = lambda whole: [index.ids(*asked[name][:2]).select(F.lit(name).alias("asked"), "_id") for name in looked if asked[name][2] == whole]
        found, partly = ids(True), ids(False)
        if partly:
            left = reduce(DataFrame.unionByName, partly)
            few = left.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
            rows = collection.base_documents().join(F.broadcast(left) if few else left, "_id")
            met = [(F.col("asked") == name) & q.predicate() for name, q in looked.items() if not asked[name][2]]
            found.append(rows.where(reduce(Column.__or__, met)).select("asked", "_id"))
        rows = reduce(DataFrame.unionByName, found)
        touched, changed = collection.touched_documents()
        parts.append(rows if touched is None else rows.join(touched, "_id", "left_anti").select("asked", "_id"))
        if changed is not None:
            parts.append(_named(changed, looked))
    return reduce(DataFrame.unionByName, parts)


def matching(collection: Collection, index: KeywordIndex, query: GameQuery) -> DataFrame:
    """_id of the games that match; `index` has followed the collection's newest base."""
    return matching_each(collection, index, {"": query}).select("_id")


def matching_count(collection: Collection, index: KeywordIndex, query: GameQuery) -> DataFrame:
    """`count` of what `matching` gives; from bitmaps alone where the query asks nothing else and no delta is open."""
    conditions, wanted, whole = asked_of_lists(query)
    touched, changed = collection.touched_documents()
    if not whole or not (conditions or wanted):
        return matching(collection, index, query).agg(F.count("*").alias("count"))
    index.at(collection)
    if touched is None:
        return index.count(conditions, wanted)
    # Bits of all documents, less those that changes are about as they were, and those as they are now.
    before = collection.base_documents().join(touched, "_id", "left_semi")
    parts = [index.count(conditions, wanted), count(before, query).select((-F.col("count")).alias("count")), count(changed, query)]
    return reduce(DataFrame.unionByName, parts).agg(F.sum("count").alias("count"))
