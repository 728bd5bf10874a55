"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

A line's key is the line stripped and lower-cased; keys of at least MIN_CHARS code points that MIN_DOCS documents hold
lose their lines everywhere but in the largest document that holds them. Keys are 128-bit hashes.

The state is three tables. `references` says how often each document holds each key; documents are inserted by adding
their counts and deleted by taking them away, so any sequence of both gives the state of the documents that are there.
`holders` has, for keys that reach MIN_DOCS, the number and the largest of the documents. `filters` has a cuckoo filter
for each shard of keys, with just the keys of `holders`; there are as many shards as the keys need at KEYS_A_SHARD. Each
table is a first part and what later changes added: a change recounts the keys it touches only, and writes its own
references, the holders that became others, and the filters of the shards these are in. A filter that has become too
full is built anew from its shard's keys, and all are once the keys have outgrown the shards. `compacted` makes one part
of many.

To dedup documents, each of their references is sent to the filter of its shard, at any size, and only the few that may
be common are joined with the exact table. References are counted by shard, and a shard with many is dealt over a task
for each LEAST_REFERENCES, or as many as its filter has slots (so that copies of filters stay small against what they are
asked), as are the keys it is then joined with; so a line that every document holds is no large group. A task holds one
filter at a time and streams the references by it.

Defined results: a null or empty text is one empty line; a null id counts for no key, and its common lines all go;
rows with one id are one document; a text that loses all lines becomes empty and stays; ties can't occur, as the
largest id is unique; a table without rows gives none; extra columns are carried along, but for those of `dedup` that
have the name of one of its results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabiya.llm.common import SPACES, table, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Common keys for which a shard is made, least number of shards, references of a shard for which it gets a further task
#: at least, and the share of a filter's slots beyond which it is built anew.
KEYS_A_SHARD, LEAST_SHARDS, LEAST_REFERENCES, FULL = 1 << 15, 64, 2048, 0.9
BLANKS = SPACES.encode()
KEY, RESULTS = ["hi", "lo"], ("n_lines", "n_dropped", "kept_sha256")


def split_keys(text: str | None) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the 16-byte key of each (None: too short)."""
    import xxhash

    raw = (text or "").encode()
    keys = [line.strip(BLANKS) for line in raw.lower().split(b"\n")]  # bytes.lower() changes A-Z only
    long = [len(k) >= MIN_CHARS and (k.isascii() or len(k.decode()) >= MIN_CHARS) for k in keys]
    return raw.split(b"\n"), [xxhash.xxh3_128_digest(k) if ok else None for k, ok in zip(keys, long, strict=True)]


class CuckooFilter:
    """16-bit fingerprints in buckets of four. What finds no place goes to a stash, so nothing is ever missed."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None, stash: list[tuple[int, int]] | None = None):
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.8)))))
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self.stash = [] if stash is None else stash

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = ((lo >> np.uint64(48)) | np.uint64(1)).astype(np.uint64)  # never 0, which is an empty slot
        first = (hi >> np.uint64(8)) & mask
        return mark.astype(np.uint16), first.astype(np.int64), (first ^ ((mark * np.uint64(0x5BD1E995)) & mask)).astype(np.int64)

    def _other(self, place: int, mark: int) -> int:
        return place ^ ((mark * 0x5BD1E995) & (len(self.table) - 1))

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        marks, first, second = self._places(hi, lo)
        for mark, a, b in zip(marks.tolist(), first.tolist(), second.tolist(), strict=True):
            for kick in range(self.KICKS):
                place = next((p for p in (a, b) if not self.table[p].all()), None)
                if place is not None:
                    self.table[place, int(np.argmin(self.table[place] != 0))] = mark
                    break
                slot = kick % self.SLOTS
                mark, self.table[b, slot] = int(self.table[b, slot]), mark
                a, b = b, self._other(b, mark)
            else:
                self.stash.append((b, mark))

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        marks, first, second = self._places(hi, lo)
        for mark, a, b in zip(marks.tolist(), first.tolist(), second.tolist(), strict=True):
            place = next((p for p in (a, b) if (self.table[p] == mark).any()), None)
            if place is not None:
                self.table[place, int(np.argmax(self.table[place] == mark))] = 0
            else:
                self.stash.remove(next(s for s in self.stash if s[1] == mark and s[0] in (a, b)))

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        marks, first, second = self._places(hi, lo)
        found = (self.table[first] == marks[:, None]).any(axis=1) | (self.table[second] == marks[:, None]).any(axis=1)
        if self.stash:
            stashed = np.array([place << 16 | mark for place, mark in self.stash])
            found |= np.isin(first << 16 | marks, stashed) | np.isin(second << 16 | marks, stashed)
        return found

    def to_bytes(self) -> bytes:
        return np.array([len(self.table), len(self.stash), *[x for s in self.stash for x in s]], "<i8").tobytes() + self.table.astype("<u2").tobytes()

    @staticmethod
    def from_bytes(blob: bytes) -> CuckooFilter:
        buckets, n = np.frombuffer(blob, "<i8", 2)
        stash = np.frombuffer(blob, "<i8", 2 * n, 16).reshape(-1, 2).tolist()
        return CuckooFilter(0, np.frombuffer(blob, "<u2", -1, 16 + 16 * int(n)).reshape(int(buckets), CuckooFilter.SLOTS).copy(), [tuple(s) for s in stash])


def _own(docs: DataFrame) -> Column:
    """Tells the rows without an id apart by their text."""
    return F.when(F.col("doc_id").cast("long").isNull(), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def references(docs: DataFrame) -> DataFrame:
    """hi, lo, doc_id, own and refs: how many rows of a document hold a key (once each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                found = {k for k in split_keys(text)[1] if k is not None}
                at += [row] * len(found)
                keys += found
            hi, lo = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2).T
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.ones(len(at), np.int64))], names=[*KEY, "doc_id", "own", "refs"])

    return docs.select(F.col("doc_id").cast("long"), _own(docs).alias("own"), F.col("text").cast("string")).mapInArrow(run, "hi long, lo long, doc_id long, own string, refs long")


def counted(refs: DataFrame) -> DataFrame:
    """n_docs and max_doc of every key. The first grouping is by key and document, the second combines before its
    shuffle, so a key that every document holds is nowhere in one task."""
    held = refs.where("doc_id IS NOT NULL").groupBy(*KEY, "doc_id").agg(F.sum("refs").alias("refs")).where("refs > 0")
    return held.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _shard(shards: int) -> Column:
    return F.pmod("hi", F.lit(shards)).cast("int").alias("shard")


def _hashes(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return frame["hi"].to_numpy(np.int64).view(np.uint64), frame["lo"].to_numpy(np.int64).view(np.uint64)


FILTERS = "shard int, n_keys long, slots long, blob binary"


def _filter_row(shard: int, n_keys: int, made: CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame({"shard": np.array([shard], np.int32), "n_keys": [n_keys], "slots": [made.table.size], "blob": [made.to_bytes()]})


def build_filters(held: DataFrame, shards: int) -> DataFrame:
    def build(keys: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter(len(keys))
        made.insert(*_hashes(keys))
        return _filter_row(keys["shard"].iloc[0], len(keys), made)

    return held.select(*KEY, _shard(shards)).groupBy("shard").applyInPandas(build, FILTERS)


def update_filters(filters: DataFrame, changes: DataFrame, held: DataFrame, shards: int) -> DataFrame:
    """New filters of the shards that `changes` (hi, lo, came) are in: keys that came are inserted, the others deleted.
    Filters that would be too full are built anew, of twice the size, from the keys in `held`."""
    changes = changes.select(*KEY, "came", _shard(shards))
    turned = changes.groupBy("shard").agg(F.sum(F.when(F.col("came"), 1).otherwise(-1)).alias("more"))
    after = filters.join(turned, "shard", "right").select("shard", "blob", F.coalesce("n_keys", F.lit(0)).alias("n_keys"), "more", (F.coalesce(F.col("n_keys") + F.col("more"), F.col("more")) > FULL * F.coalesce("slots", F.lit(0))).alias("full"))
    after = written(after, "line-filters-before")
    all_keys = held.select(*KEY, F.lit(None).cast("boolean").alias("came"), _shard(shards)).join(after.where("full").select("shard"), "shard", "left_semi")
    rows = changes.join(after.where("NOT full").select("shard"), "shard", "left_semi").unionByName(all_keys)

    def change(key: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if old["full"].iloc[0]:
            made = CuckooFilter(2 * len(keys))
            made.insert(*_hashes(keys))
            return _filter_row(key[0], len(keys), made)
        made, came = CuckooFilter.from_bytes(old["blob"].iloc[0]), keys["came"].astype(bool)
        made.delete(*_hashes(keys[~came]))
        made.insert(*_hashes(keys[came]))
        return _filter_row(key[0], int(old["n_keys"].iloc[0] + old["more"].iloc[0]), made)

    return after.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(change, FILTERS)


def _newest(parts: tuple[DataFrame, ...], by: list[str]) -> DataFrame:
    """Of tables with the same keys, each key's row in the last table that has it."""
    if len(parts) == 1:
        return parts[0]
    rest = [c for c in parts[0].columns if c not in by]
    rows = reduce(DataFrame.unionByName, [part.withColumn("_part", F.lit(i)) for i, part in enumerate(parts)])
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "_part").alias("_row")).select(*by, "_row.*")


@dataclass(frozen=True)
class LineIndex:
    """The state, as the parts of its three tables; every change gives a new one, so that an older one can be gone
    back to."""

    reference_parts: tuple[DataFrame, ...]
    holder_parts: tuple[DataFrame, ...]
    filter_parts: tuple[DataFrame, ...]
    shards: int

    @staticmethod
    def _of(refs: DataFrame) -> LineIndex:
        held = written(counted(refs).where(F.col("n_docs") >= MIN_DOCS), "line-holders")
        shards = max(LEAST_SHARDS, 1 << (held.count() // KEYS_A_SHARD).bit_length())
        return LineIndex((refs,), (held,), (written(build_filters(held, shards), "line-filters"),), shards)

    @staticmethod
    def of(docs: DataFrame) -> LineIndex:
        return LineIndex._of(written(references(docs), "line-references"))

    @property
    def references(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.reference_parts)

    @property
    def holders(self) -> DataFrame:
        return _newest(self.holder_parts, KEY).where(F.col("n_docs") >= MIN_DOCS)

    @property
    def filters(self) -> DataFrame:
        return _newest(self.filter_parts, ["shard"])

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        change = written(references(docs).withColumn("refs", F.lit(sign).cast("long") * F.col("refs")), "line-references")
        touched = written(change.where("doc_id IS NOT NULL").select(*KEY).distinct(), "line-touched")
        new = replace(self, reference_parts=(*self.reference_parts, change))
        now = touched.join(counted(new.references.join(touched, KEY, "left_semi")), KEY, "left").select(*KEY, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "max_doc")
        was = self.holders.select(*KEY, F.col("n_docs").alias("old_docs"), F.col("max_doc").alias("old_max"))
        both = now.join(was, KEY, "left").withColumn("came", F.when(F.col("n_docs") >= MIN_DOCS, F.when(F.col("old_docs").isNull(), True)).otherwise(F.when(F.col("old_docs").isNotNull(), False)))
        same = F.col("n_docs").eqNullSafe(F.col("old_docs")) & F.col("max_doc").eqNullSafe(F.col("old_max"))
        others = written(both.where((F.col("old_docs").isNotNull() | (F.col("n_docs") >= MIN_DOCS)) & ~same).select(*KEY, "n_docs", "max_doc", "came"), "line-holders")
        new = replace(new, holder_parts=(*self.holder_parts, others.drop("came")))
        filters = written(update_filters(self.filters, others.where("came IS NOT NULL"), new.holders, self.shards), "line-filters")
        new = replace(new, filter_parts=(*self.filter_parts, filters))
        n_keys = new.filters.agg(F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n")).first()["n"]
        return new.compacted() if n_keys > 4 * self.shards * KEYS_A_SHARD else new

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Without these documents, which were inserted with the same texts."""
        return self._changed(docs, -1)

    def compacted(self) -> LineIndex:
        """The same state in one part, with shards for the keys there now."""
        refs = self.references.groupBy(*KEY, "doc_id", "own").agg(F.sum("refs").alias("refs")).where("refs <> 0")
        return LineIndex._of(written(refs, "line-references"))

    def salts(self, refs: DataFrame) -> DataFrame:
        """shard and the number of tasks it is dealt over: a row for each shard, of which there are as many as the
        common keys need, so it may be broadcast."""
        many = refs.groupBy(_shard(self.shards)).agg(F.count("*").alias("n"))
        each = F.greatest(F.lit(LEAST_REFERENCES), F.coalesce("slots", F.lit(0)))
        return written(many.join(self.filters.select("shard", "slots"), "shard", "left").select("shard", F.ceil(F.col("n") / each).cast("int").alias("salts")), "line-salts")

    def _dealt(self, rows: DataFrame, salts: DataFrame) -> DataFrame:
        """rows of a shard, once for each of its tasks."""
        return rows.join(F.broadcast(salts), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def maybe_common(self, refs: DataFrame, salts: DataFrame) -> DataFrame:
        """hi, lo, doc_id, own and salt of those references that the filters don't rule out."""
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        salt = F.pmod(F.xxhash64("doc_id", "own"), "salts").cast("int").alias("salt")
        asked = refs.select(*KEY, "doc_id", "own", _shard(self.shards)).join(F.broadcast(salts), "shard")
        asked = asked.select(*KEY, "doc_id", "own", "shard", salt, none("binary", "blob"))
        filters = self._dealt(self.filters, salts).select(none("long", "hi"), none("long", "lo"), none("long", "doc_id"), none("string", "own"), "shard", "salt", "blob")
        rows = filters.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, made = None, None
            for batch in batches:
                own = np.stack([batch.column(i).to_numpy() for i in (4, 5)], axis=1)
                hi, lo = (batch.column(i).fill_null(0).to_numpy().view(np.uint64) for i in (0, 1))
                opens = np.flatnonzero(batch.column(6).is_valid().to_numpy(zero_copy_only=False)).tolist()
                keep = np.zeros(batch.num_rows, bool)
                for start, end in zip([0, *(i + 1 for i in opens)], [*opens, batch.num_rows], strict=True):
                    if start:
                        place, made = own[start - 1], CuckooFilter.from_bytes(batch.column(6)[start - 1].as_py())
                    if made is not None and start < end:
                        here = (own[start:end] == place).all(axis=1)
                        keep[start:end] = here & made.contains(hi[start:end], lo[start:end])
                yield batch.select(["hi", "lo", "doc_id", "own", "salt"]).filter(pa.array(keep))

        return rows.mapInArrow(run, "hi long, lo long, doc_id long, own string, salt int")

    def drops(self, refs: DataFrame) -> DataFrame:
        """doc_id, own and the keys whose lines a document loses."""
        salts = self.salts(refs)
        held = self._dealt(self.holders.select("*", _shard(self.shards)), salts).drop("shard")
        lost = self.maybe_common(refs, salts).join(held, [*KEY, "salt"]).where("doc_id IS NULL OR doc_id <> max_doc")
        return lost.groupBy("doc_id", "own").agg(F.collect_set(F.struct(*KEY)).alias("_line_lost"))


def _deduped(docs: DataFrame, index: LineIndex, refs: DataFrame | None) -> DataFrame:
    """All columns of docs, the text with the lines it keeps, and the results under names of their own."""
    lost = index.drops(references(docs) if refs is None else refs).withColumnRenamed("doc_id", "_line_doc").withColumnRenamed("own", "_line_own")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_line_doc")) & _own(docs).eqNullSafe(F.col("_line_own"))
    rows = docs.join(lost, same, "left").select(*docs.columns, F.col("_line_lost.hi").alias("_line_hi"), F.col("_line_lost.lo").alias("_line_lo"))
    place, n_own = docs.columns.index("text"), len(docs.columns)
    out = StructType(list(docs.schema.fields)).add("_line_n_lines", "long").add("_line_n_dropped", "long").add("_line_kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, dropped, sums = [], [], [], []
            for text, hi, lo in zip(*[batch.column(i).to_pylist() for i in (place, n_own, n_own + 1)], strict=True):
                lines, kept = None, (text or "").encode()
                n = kept.count(b"\n") + 1
                if hi:
                    gone = {np.array(pair, "<i8").tobytes() for pair in zip(hi, lo, strict=True)}
                    lines, keys = split_keys(text)
                    lines = [line for line, key in zip(lines, keys, strict=True) if key not in gone]
                    kept = b"\n".join(lines)
                texts.append(text if lines is None else kept.decode())
                counts.append(n)
                dropped.append(0 if lines is None else n - len(lines))
                sums.append(hashlib.sha256(kept).hexdigest())
            own = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(n_own)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums, pa.string())], names=out.names)

    return rows.mapInArrow(run, out)


def dedup(docs: DataFrame, index: LineIndex, refs: DataFrame | None = None) -> DataFrame:
    """The columns of docs, the text with the lines it keeps, and n_lines, n_dropped and kept_sha256."""
    rows = _deduped(docs, index, refs)
    return rows.select(*[c for c in docs.columns if c not in RESULTS], *[F.col(f"_line_{c}").alias(c) for c in RESULTS])


def deduped_documents(docs: DataFrame) -> DataFrame:
    """The documents with the lines they keep, in the columns they came with."""
    index = LineIndex.of(docs)
    return _deduped(docs, index, index.references).select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex.of(docs)
    return dedup(docs, index, index.references).select("doc_id", *RESULTS)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT r, doc_id, i, line, k.top IS NOT NULL AND (doc_id IS NULL OR doc_id <> k.top) AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY r, doc_id
"""
