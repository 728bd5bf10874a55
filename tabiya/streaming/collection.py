"""A collection that changes are applied to: a folder of Parquet tables that only ever get more.

`delta=<run>-<batch>` holds the changes of one batch. A base is a state of the documents: they lie in buckets by a hash
of their id, and `base=<n>`, its manifest, names for each bucket the compaction that wrote it (`data=<m>/_bucket=<b>`);
`covers=<n>` names the deltas that are in it. Only tables with `_SUCCESS` count, and the manifest is written last.

Applying a batch writes its changes and nothing else, so its cost doesn't depend on the size of the collection.
`compact`, a batch job to be run now and then, rewrites the buckets that open deltas have changes of, and names the
others as they are; who reads by an older manifest isn't disturbed. Reading lays the open deltas over the newest base:
documents that no open delta is about come straight from their files, so filters and columns reach these and nothing of
them is shuffled; only the others, from the buckets that have some, are merged with the changes. The ids that are
touched are broadcast while a count says that they are few; beyond that a filter of bits of bounded size (two hashes of
each id) says which documents may be touched, and those that only may be are merged with themselves.

A run is one stream (or one batch job) with an id of its own, so that several of them, also one that starts anew, never
write to the same place; a batch that is replayed overwrites its own delta. What wins is decided by versions, never by
the order of files: a document has the columns of its newest whole version, and a column that partial updates may change
has its own newest value, of whichever change. Of two changes with one version the kinds decide (ORDER), and of two
whole documents with one version the one that was applied later by the clock of the driver. Deleted documents stay as
rows, so that older changes can't bring them back, until a compaction drops those older than a given version.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from tabiya.operators.changes import DELETE, UPDATE
from tabiya.sources.collections import CollectionSpec
from tabiya.sources.shared import completed, read_text, write_text

#: Changes with one version are ordered as a batch is: whole documents, partial updates, deletions.
ORDER = {UPDATE: 1, DELETE: 2}
#: Documents of a bucket and bytes of its files, when a collection is dealt into buckets; buckets at most; a bucket may
#: grow by this factor before all are dealt anew. Ids that may be broadcast; bits of the filter of more ids than that, at
#: most.
BUCKET_ROWS, BUCKET_BYTES, MOST_BUCKETS, GROWTH = 500_000, 1 << 26, 1 << 14, 4
BROADCAST_IDS, FILTER_BITS = 1_000_000, 1 << 27
#: A manifest's rows: a bucket, the compaction that wrote it, how many buckets there are, documents in it, and quantiles
#: of the column that files are sorted by.
MANIFEST = StructType().add("bucket", IntegerType()).add("data", IntegerType()).add("buckets", IntegerType()).add("rows", LongType()).add("marks", ArrayType(LongType()))
MARKS = 16


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int")


def maybe_in(ids: DataFrame, n: int) -> Column:
    """Whether a row's `_id` may be one of `ids`, about n of them: true for these, false for nearly all others. The
    filter is an array of 64-bit words, 16 bits for each id up to FILTER_BITS, made once for a plan."""
    bits = min(FILTER_BITS, 1 << max(6, (16 * n - 1).bit_length()))
    places = [F.pmod(F.xxhash64("_id"), F.lit(bits)), F.pmod(F.xxhash64(F.col("_id"), F.lit(1)), F.lit(bits))]
    words = ids.select(F.explode(F.array(*places)).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
    every = ids.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left").select("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    row = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda e: e["bits"]).alias("words"))
    found = row.scalar()
    there = [F.getbit(F.get(found, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in places]
    return there[0] & there[1]


class Collection:
    """Paths are Hadoop's, so any shared store will do."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, updatable: tuple[str, ...] = (), layout: CollectionSpec | None = None, buckets: int | None = None):
        """schema: the documents' columns with `_id`, `version` and `deleted`; updatable: those of them that partial
        updates may change; layout: how files are sorted and compressed; buckets: of bases, by default as many as the
        documents ask for."""
        self.layout, self.buckets = layout, buckets
        self.spark, self.path, self.schema, self.updatable = spark, path.rstrip("/"), schema, tuple(updatable)
        self.fixed = [c for c in schema.names if c not in ("_id", "version", "deleted", *updatable)]
        moment = StructType().add(schema["version"]).add("kind", IntegerType()).add("applied", LongType())
        self.stored = StructType([f for f in schema.fields if f.name != "version"]).add("_at", moment)
        for name in self.updatable:
            self.stored = self.stored.add(f"_at_{name}", moment)

    # Files

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def tables(self, kind: str) -> list[str]:
        """Names of the completed tables of a kind."""
        return completed(self.spark, self.path, kind)

    def bases(self) -> list[int]:
        return sorted(map(int, self.tables("base")))

    def covered(self, base: int) -> set[str]:
        """The deltas that are in a base: names, as few as there are deltas."""
        return {r["delta"] for r in self.spark.read.schema("delta string").parquet(f"{self.path}/covers={base}").collect()}

    def manifest(self, base: int | None = None) -> list[Row]:
        """A row for each bucket that has documents, of the newest base by default."""
        known = self.bases() if base is None else [base]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/base={known[-1]}").collect() if known else []

    def open_deltas(self) -> tuple[list[str], list[str]]:
        """The deltas that the newest base doesn't have, and all that there are."""
        base, seen = self.bases()[-1:], self.tables("delta")
        covered = self.covered(base[0]) if base else set()
        return [d for d in seen if d not in covered], seen

    # Reading

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(*paths) if paths else self.spark.createDataFrame([], self.stored)

    def _base_rows(self, manifest: list[Row], only: set[int] | None = None) -> DataFrame:
        return self._read([f"{self.path}/data={r.data}/_bucket={r.bucket}" for r in manifest if only is None or r.bucket in only])

    def _delta_rows(self, deltas: list[str]) -> DataFrame:
        return self._read([f"{self.path}/delta={d}" for d in deltas])

    def _merged(self, rows: DataFrame, every_column: bool = False) -> DataFrame:
        """One row for each document, in stored columns. Nothing is collected for a document: each column is a
        maximum, so rows are combined before the shuffle, and columns that nobody asks for aren't read. Where all are
        asked for (`every_column`) they travel together. Updates of unknown documents are kept, without `_at`."""
        fixed = [*self.fixed, "deleted"]
        whole = [F.max_by(F.struct(*fixed), "_at").alias("_whole")] if every_column else [F.max_by(c, "_at").alias(c) for c in fixed]
        newest = [*whole, F.max("_at").alias("_at")]
        for name in self.updatable:
            newest += [F.max_by(name, f"_at_{name}").alias(name), F.max(f"_at_{name}").alias(f"_at_{name}")]
        found = rows.groupBy("_id").agg(*newest)
        return found.select(*[F.col(f"_whole.{c}").alias(c) if every_column and c in fixed else F.col(c) for c in self.stored.names])

    def _layers(self) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """The base's rows that no open delta is about, and the ids and the rows, merged, of those that some are."""
        manifest, (open_, _) = self.manifest(), self.open_deltas()
        base, changes = self._base_rows(manifest), self._delta_rows(open_)
        if not open_:
            return base, None, None
        ids = changes.select("_id").distinct()
        if not manifest:
            return base, ids, self._merged(changes)
        counts = {r.bucket: r.n for r in changes.groupBy(bucket_of(manifest[0].buckets).alias("bucket")).agg(F.count("*").alias("n")).collect()}  # MOST_BUCKETS rows
        some = self._base_rows(manifest, set(counts))
        if sum(counts.values()) <= BROADCAST_IDS:
            ids = F.broadcast(ids)
            untouched, touched = base.join(ids, "_id", "left_anti"), some.join(ids, "_id", "left_semi")
        else:
            maybe = maybe_in(ids, sum(counts.values()))
            untouched, touched, ids = base.where(~maybe), some.where(maybe), None
        return untouched, ids, self._merged(touched.unionByName(changes))

    def _laid_over(self) -> DataFrame:
        """The newest base with the open deltas laid over it, in stored columns."""
        untouched, _, merged = self._layers()
        return untouched if merged is None else untouched.unionByName(merged)

    def _shown(self, rows: DataFrame) -> DataFrame:
        """Documents that are there; updates of unknown ones are neither deleted nor not deleted."""
        return rows.where("NOT deleted").select(*[c for c in self.schema.names if c not in ("version", "deleted")])

    def base_documents(self) -> DataFrame:
        """The documents of the newest base, without open deltas."""
        return self._shown(self._base_rows(self.manifest()))

    def bucket_documents(self, rows: list[Row]) -> DataFrame:
        """The documents of some buckets of a manifest, with `_bucket`."""
        paths = [f"{self.path}/data={r.data}/_bucket={r.bucket}" for r in rows]
        found = self.spark.read.schema(StructType([*self.stored.fields]).add("_bucket", IntegerType())).option("basePath", self.path).parquet(*paths)
        return found.where("NOT deleted").select(*[c for c in self.schema.names if c not in ("version", "deleted")], "_bucket")

    def touched_documents(self) -> tuple[DataFrame | None, DataFrame | None]:
        """The ids that open deltas are about, and those of these documents that are there, as they now are."""
        _, ids, merged = self._layers()
        if merged is None:
            return None, None
        ids = self._delta_rows(self.open_deltas()[0]).select("_id").distinct() if ids is None else ids
        return ids, self._shown(merged.join(ids, "_id", "left_semi"))

    def moments(self) -> DataFrame:
        """`_id`, `_at` and each `_at_<column>` of every document, also of deleted and of unknown ones."""
        return self._laid_over().select("_id", "_at", *[f"_at_{c}" for c in self.updatable])

    def snapshot(self) -> DataFrame:
        """The newest version of each document, deleted ones as rows with `deleted`."""
        rows = self._laid_over().where("_at IS NOT NULL")
        return rows.select(*[F.col("_at.version").alias(c) if c == "version" else F.col(c) for c in self.schema.names])

    def documents(self) -> DataFrame:
        """The documents as they are."""
        return self._shown(self._laid_over())

    def touched(self, deltas: set[str]) -> DataFrame:
        """_id of the documents that some deltas are about."""
        return self.spark.read.schema(self.stored).parquet(*[f"{self.path}/delta={d}" for d in sorted(deltas)]).select("_id").distinct()

    def delta_rows(self, deltas: set[str]) -> int:
        """How many changes some deltas hold, from the footers of their files."""
        return self._delta_rows(sorted(deltas)).count()

    # Writing

    def apply(self, changes: DataFrame, batch: int = 0, run: str | None = None) -> None:
        """One batch of changes: the documents' columns, version and action; of an update the columns for which
        `has_<column>` holds. Without `run` the batch is a run of its own."""
        kind = F.coalesce(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])[F.col("action")], F.lit(0))
        moment = F.struct("version", kind.alias("kind"), F.lit(time.time_ns() // 1000).alias("applied"))
        partial = F.col("action") == UPDATE
        given = lambda c: F.col(f"has_{c}") if f"has_{c}" in changes.columns else F.lit(False)
        new: dict[str, Column] = {"deleted": F.col("action") == DELETE, "_at": F.when(~partial, moment)}
        for name in self.updatable:
            new[f"_at_{name}"] = F.when(~partial | F.coalesce(given(name), F.lit(False)), moment)
        rows = changes.where("_id IS NOT NULL").select(*[(new[f.name] if f.name in new else F.col(f.name)).cast(f.dataType).alias(f.name) for f in self.stored.fields])
        rows.write.mode("overwrite").parquet(f"{self.path}/delta={run or uuid.uuid4().hex}-{batch}")

    def compact(self, forget_before: object = None, buckets: int | None = None) -> list[int]:
        """A new base of everything so far, without the deletions, and the updates of unknown documents, whose version
        is below `forget_before`. Buckets without changes stay as they are; all are dealt anew where `buckets` asks for
        another number or they have grown too large. The buckets that were written are returned."""
        old, (open_, seen) = self.manifest(), self.open_deltas()
        if not seen and not old:
            return []
        changes, before = self._delta_rows(open_), old[0].buckets if old else 0
        rows_in_all, bytes_in_all = sum(r.rows for r in old) + changes.count(), self._bytes(old, open_)
        full = max(-(-rows_in_all // BUCKET_ROWS), -(-bytes_in_all // BUCKET_BYTES))  # buckets that would be full
        fitting = min(MOST_BUCKETS, 1 << max(0, full - 1).bit_length())
        wanted = buckets or self.buckets or (fitting if not before or full > GROWTH * before else before)
        bucket, kept = bucket_of(wanted), {}
        if wanted == before:
            touched = changes.select(bucket.alias("b"))
            if forget_before is not None:
                touched = touched.unionByName(self._base_rows(old).where(~self._kept(forget_before)).select(bucket.alias("b")))
            changed = {r.b for r in touched.distinct().collect()}  # MOST_BUCKETS numbers
            kept = {r.bucket: r for r in old if r.bucket not in changed}
        rows = self._merged(self._base_rows([r for r in old if r.bucket not in kept]).unionByName(changes), every_column=True)
        if forget_before is not None:
            rows = rows.where(self._kept(forget_before))
        n = max(self.bases(), default=-1) + 1
        self._write_buckets(rows.withColumn("_bucket", bucket), n)
        new = self._measured(n, wanted).unionByName(self.spark.createDataFrame([(*r[:2], wanted, *r[3:]) for r in kept.values()], MANIFEST))
        self.spark.createDataFrame([(d,) for d in seen], "delta string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/covers={n}")
        new.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base={n}")
        return sorted(r.bucket for r in self.manifest(n) if r.data == n)

    def _bytes(self, manifest: list[Row], deltas: list[str]) -> int:
        """Of the files of a base's buckets and of some deltas."""
        path, files = self._files()
        length = lambda name: files.getContentSummary(path(f"{self.path}/{name}")).getLength()
        used, found = {f"data={r.data}/_bucket={r.bucket}" for r in manifest}, 0
        for n in {r.data for r in manifest}:
            listed = files.listFiles(path(f"{self.path}/data={n}"), True)
            while listed.hasNext():
                file = listed.next()
                found += file.getLen() if f"data={n}/{file.getPath().getParent().getName()}" in used else 0
        return found + sum(length(f"delta={d}") for d in deltas)

    def _write_buckets(self, rows: DataFrame, n: int) -> None:
        order = [F.col("_bucket"), *([F.col(self.layout.sort).desc_nulls_last()] if self.layout and self.layout.sort else [])]
        codec = self.layout.compression if self.layout else "snappy"
        rows.repartition("_bucket").sortWithinPartitions(*order).write.mode("overwrite").option("compression", codec).partitionBy("_bucket").parquet(f"{self.path}/data={n}")

    def _measured(self, n: int, buckets: int) -> DataFrame:
        """The manifest's rows of the buckets that a compaction wrote, from the files' sort column alone."""
        written = self.spark.read.schema(StructType([*self.stored.fields]).add("_bucket", IntegerType())).parquet(f"{self.path}/data={n}")
        sort = self.layout.sort if self.layout else None
        marks = F.percentile_approx(F.col(sort).cast("long"), [i / MARKS for i in range(MARKS + 1)], 1000) if sort else F.lit(None)
        return written.groupBy(F.col("_bucket").alias("bucket")).agg(F.count("*").alias("rows"), marks.cast("array<long>").alias("marks")).select("bucket", F.lit(n).alias("data"), F.lit(buckets).alias("buckets"), "rows", "marks")

    def _kept(self, forget_before: object) -> Column:
        moments = ["_at", *[f"_at_{c}" for c in self.updatable]]
        recent = [F.coalesce(F.col(f"{m}.version") >= F.lit(forget_before), F.lit(False)) for m in moments]
        some = recent[0]
        for other in recent[1:]:
            some = some | other
        return some | (F.col("_at").isNotNull() & ~F.col("deleted"))

    def drop_covered(self) -> None:
        """Deletes what the newest base has made superfluous; no reader may still be at an older state."""
        path, files = self._files()
        for base in self.bases()[-1:]:
            used = {f"data={r.data}/_bucket={r.bucket}" for r in self.manifest(base)}
            found = files.globStatus(path(f"{self.path}/data=*/_bucket=*")) or []
            written = [f"{f.getPath().getParent().getName()}/{f.getPath().getName()}" for f in found]
            old = [f"delta={d}" for d in self.covered(base)] + [f"{kind}={n}" for n in self.bases()[:-1] for kind in ("base", "covers")]
            for name in [*old, *[w for w in written if w not in used]]:
                files.delete(path(f"{self.path}/{name}"), True)

    # Where a polling job is

    def position(self, job: str) -> str | None:
        return read_text(self.spark, f"{self.path}/position={job}")

    def set_position(self, job: str, value: str) -> None:
        write_text(self.spark, f"{self.path}/position={job}", value)
