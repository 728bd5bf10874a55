"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, as connected components of the links.

A document's set is its distinct five-word shingles. Two documents link at Jaccard similarity of at least 80/100.

1. Classes. Documents with equal sets become one class (equal 128-bit hashes of the set); copies never meet as pairs.
2. Frequencies. Each task sends its shingles as sorted blobs to shards by hash; a shard counts in how many documents
   each occurs. Two structures of bounded size come back, broadcast: a Bloom filter of shingles in two documents or
   more, and the most frequent shingles with the logarithm of their frequency. Both are sized by the number of shingles
   counted, up to a bound of 200 MB together. They only order and prune; when the bound makes them too small for the
   corpus the result stays exact and more is compared.
3. Prefixes. A set is ordered from rare to frequent. If two sets link, their prefixes of n - ceil(0.8 n) + l shingles
   share at least l. Each document chooses its own l: a longer prefix is scanned more but leaves fewer candidates, and
   the estimated cost of both decides. A pair must share the smaller l of the two. Shingles of one document alone are
   never sent.
4. Stars. In each shingle's list, members meet only the list's least member, so a group of thousands of near copies
   makes as many pairs as members. What verifies is joined to components.
5. Rest. Lists whose members are still in several components are compared in full, members of different components
   only. Short lists are joined. Long ones (many documents close to one another that don't link) are dealt in blocks;
   a group compares two blocks by bitmaps of the sets, whose common bits bound what two sets can share, and emits only
   pairs that may still link; groups are dealt by ranges of their keys, so tasks get equally many entries. Pairs that share enough prefix shingles and fit in size are verified. Then components
   are final: every pair of documents that could link was verified or was already in one component.

Defined results: words are split at blanks after lower-casing A-Z; fewer than five words are one shingle; a text
without words, or null, has the empty set and links with nothing; rows with a null id keep it and are in the component
of their text; repeated rows are one class; a table without rows gives none; other columns are not read. Hash
collisions of 64-bit shingles inside a pair, or 128-bit sets, could change a result; at 10^11 documents the chance of
any is about 10^-9.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import table, written

WORDS, PERCENT = 5, 80
#: Least and most logarithms of the Bloom filter's bits (16 to 128 MB) and of the shingles in the table of frequent ones
#: (9 to 72 MB): bounds of the broadcasts.
BLOOM_BITS, FREQUENT = (27, 30), (20, 23)
#: Shingles a task gathers before it sends them; bits of a shingle that are counted.
FLUSH, COUNTED_BITS = 2_000_000, 48
#: Shingles whose frequencies a task looks up at once.
LOOKED_UP = 200_000
#: Prefix lengthenings to choose from, and the cost of verifying a candidate against scanning a list entry.
LENGTHENINGS, VERIFY_COST = (1, 2, 3, 4, 6, 8), 8.0
#: Members of a list that is joined; members of a block of a longer one; least and most bits of a set's bitmap.
SHORT_LIST, BLOCK, BITMAP_BITS = 32, 512, (512, 1 << 16)
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words."""
    size = len(h) - n + 1
    s = h[:size].copy()
    for k in range(1, n):
        s ^= s >> _SHIFT
        s *= _MIX
        s += h[k : k + size]
    s ^= s >> np.uint64(31)
    s *= _MIX
    return s ^ (s >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    return np.unique(_mixed(hashes, min(WORDS, len(words))))


def set_key(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def first_pass(docs: DataFrame, shards: int, row: str | None = None) -> DataFrame:
    """Rows with `uid` (the column `row`, if given) are documents (doc_id, n, key); rows with `shard` are blobs of
    shingles to be counted."""
    names = ["uid", "doc_id", "n", "key", "shard", "steps", "wide", "counts"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.bool_(), pa.binary())
    width = np.uint64(COUNTED_BITS - shards.bit_length() + 1)

    def rows(**columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), kind) for name, kind in zip(names, types, strict=True)], names=names)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        prints, counts = np.unique(np.concatenate(held) >> np.uint64(64 - COUNTED_BITS), return_counts=True)
        ends = np.searchsorted(prints >> width, np.arange(shards + 1, dtype=np.uint64))
        for shard in range(shards):
            a, b = ends[shard], ends[shard + 1]
            if a < b:
                steps = np.diff(prints[a:b], prepend=np.uint64(shard) << width)
                wide = bool(steps.max() >= 1 << 32)
                yield rows(shard=[shard], steps=[steps.astype("<u8" if wide else "<u4").tobytes()], wide=[wide], counts=[np.minimum(counts[a:b], 65535).astype("<u2").tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid, held, gathered, seen = TaskContext.get().partitionId() << 32, [], 0, set()
        for batch in batches:
            sizes, keys = [], []
            for value in batch.column(1):
                s = shingle_set(value.as_py())
                key = set_key(s)
                sizes.append(len(s))
                keys.append(key)
                if len(s) and key not in seen:
                    seen.add(key)
                    held.append(s)
                    gathered += len(s)
                if gathered >= FLUSH:
                    yield from flush(held)
                    held, gathered, seen = [], 0, set()
            n = batch.num_rows
            yield rows(uid=batch.column(2).to_pylist() if row else list(range(uid, uid + n)), doc_id=batch.column(0).to_pylist(), n=sizes, key=keys)
            uid += n
        if held:
            yield from flush(held)

    schema = "uid long, doc_id long, n long, key binary, shard int, steps binary, wide boolean, counts binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.col(row)] if row else [])).mapInArrow(run, schema)


@dataclass(frozen=True)
class Frequencies:
    """What every task knows about frequencies: of bounded size whatever the corpus."""

    shards: int
    bits: int
    bloom: np.ndarray
    frequent: np.ndarray
    levels: np.ndarray

    @staticmethod
    def places(prints: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Two bits of the filter, inside the slice of the shingle's shard."""
        size = np.uint64(bits // shards)
        start = (prints >> np.uint64(COUNTED_BITS - shards.bit_length() + 1)) * size
        return start + prints % size, start + ((prints * _MIX) >> np.uint64(17)) % size

    def level(self, shingles: np.ndarray) -> np.ndarray:
        """0: in one document; 1: in more; from 2 on the logarithm of the frequency of the most frequent."""
        prints = shingles >> np.uint64(64 - COUNTED_BITS)
        a, b = self.places(prints, self.shards, self.bits)
        bit = lambda p: (self.bloom[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        level = (bit(a) & bit(b)).astype(np.int64)
        at = np.flatnonzero(level)
        if len(at) and len(self.frequent):
            place = np.minimum(np.searchsorted(self.frequent, prints[at]), len(self.frequent) - 1)
            hit = self.frequent[place] == prints[at]
            level[at[hit]] = self.levels[place[hit]]
        return level


def sizes(shingles: int) -> tuple[int, int]:
    """Bits of the filter, about one for each shingle, and length of the frequent table, one for every 128 of them."""
    within = lambda n, bounds: 1 << min(bounds[1], max(bounds[0], max(0, n - 1).bit_length()))
    return within(shingles, BLOOM_BITS), within(shingles >> 7, FREQUENT)


def frequencies(first: DataFrame, shards: int) -> Frequencies:
    """Counts the blobs of every shard; what is collected has the bounded size of the two structures."""
    bits, frequent_most = sizes(first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    size, most = bits // shards, max(1, frequent_most // shards)
    width = COUNTED_BITS - shards.bit_length() + 1

    def count(blobs: pd.DataFrame) -> pd.DataFrame:
        shard = int(blobs["shard"].iloc[0])
        base = np.uint64(shard) << np.uint64(width)
        prints = np.concatenate([np.cumsum(np.frombuffer(s, "<u8" if w else "<u4").astype(np.uint64)) + base for s, w in zip(blobs["steps"], blobs["wide"], strict=True)])
        counts = np.concatenate([np.frombuffer(c, "<u2") for c in blobs["counts"]]).astype(np.int64)
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        prints, counts = prints[starts], np.add.reduceat(counts, starts)
        shared = counts > 1
        prints, counts = prints[shared], counts[shared]
        marked = np.zeros(size, bool)
        for place in Frequencies.places(prints, shards, bits):
            marked[(place - np.uint64(shard * size)).astype(np.int64)] = True
        top = np.sort(np.argsort(-counts, kind="stable")[:most])
        top = top[counts[top] >= 4]
        return pd.DataFrame({"shard": [shard], "bits": [np.packbits(marked, bitorder="little").tobytes()], "frequent": [prints[top].tobytes()], "levels": [np.log2(counts[top]).astype(np.uint8).tobytes()]})

    blobs = first.where("shard IS NOT NULL").select("shard", "steps", "wide", "counts")
    parts = sorted(blobs.groupBy("shard").applyInPandas(count, "shard int, bits binary, frequent binary, levels binary").collect(), key=lambda r: r["shard"])
    bloom = np.zeros(bits // 8, np.uint8)
    for r in parts:
        bloom[r["shard"] * size // 8 : (r["shard"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    frequent = np.frombuffer(b"".join(bytes(r["frequent"]) for r in parts), np.uint64)
    return Frequencies(shards, bits, bloom, frequent, np.frombuffer(b"".join(bytes(r["levels"]) for r in parts), np.uint8))


def least_overlap(n: int) -> int:
    """ceil(0.8 n): what a set of n shares with any set it links with."""
    return -(-PERCENT * n // 100)


def adaptive_prefix(s: np.ndarray, levels: np.ndarray) -> tuple[int, np.ndarray]:
    """The lengthening chosen for a set, and the shingles of its prefix that other documents may have."""
    n = len(s)
    order = np.lexsort((s, levels))
    cost = np.concatenate([[0.0], np.cumsum(np.where(levels[order] > 0, np.exp2(levels[order]), 0.0))])
    length = lambda more: n - least_overlap(n) + more
    more = min((m for m in LENGTHENINGS if m <= least_overlap(n)), key=lambda m: cost[length(m)] * (1 + VERIFY_COST / m))
    prefix = order[: length(more)]
    return more, s[prefix[levels[prefix] > 0]]


def bitmap(s: np.ndarray) -> bytes:
    """About eight bits or more for each shingle, one of them set."""
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], 1 << (8 * len(s) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def may_link(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one block, or of two, that fit in size, are in different components, and share few enough bits apart:
    a bit that only one of two sets has is a shingle the other lacks. A pair is emitted in the first only of the long
    lists that both are in, with their number."""
    group = group.sort_values("node").reset_index(drop=True)
    node, n, label, more = (group[c].to_numpy() for c in ("node", "n", "label", "more"))
    own, size = group["block"].to_numpy(), group["bitmap"].map(len).to_numpy()
    two, here, lists = group["low_block"].iloc[0] != group["high_block"].iloc[0], group["shingle"].iloc[0], [frozenset(x) for x in group["lists"]]
    out = []
    for length in np.unique(size):  # sizes within a quarter of each other have bitmaps of one length or the next
        maps = {i: np.unpackbits(np.frombuffer(group["bitmap"][i], np.uint8).reshape(-1, length), axis=1, bitorder="little").max(axis=0) for i in np.flatnonzero((size == length) | (size == 2 * length))}
        left, right = np.flatnonzero(size == length), np.array(list(maps))
        x, y = (np.stack([maps[i] for i in side]).astype(np.float32) for side in (left, right))
        common = x @ y.T
        most = np.minimum(n[left][:, None] - (x.sum(axis=1)[:, None] - common), n[right][None, :] - (y.sum(axis=1)[None, :] - common))
        ok = (100 + PERCENT) * most >= PERCENT * (n[left][:, None] + n[right][None, :])
        ok &= label[left][:, None] != label[right][None, :]
        ok &= (size[right] != length)[None, :] | (left[:, None] < right[None, :])
        ok &= (own[left][:, None] != own[right][None, :]) if two else True
        i, j = np.nonzero(ok)
        i, j = left[i], right[j]
        both = [lists[a] & lists[b] for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        first = np.array([min(c) == here for c in both], bool)
        i, j, shared = i[first], j[first], np.array([len(c) for c in both], np.int64)[first]
        out.append(pd.DataFrame({"a": np.where(label[i] < label[j], node[i], node[j]), "b": np.where(label[i] < label[j], node[j], node[i]), "more": more[i], "more_b": more[j], "shared": shared}))
    return pd.concat(out)


def prefixes(docs: DataFrame, known: Frequencies) -> DataFrame:
    """key, n, more, prefix and shingles of the sets that share a prefix shingle with some document."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    signed = lambda a: pa.array(a.view(np.int64))

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), signed(np.concatenate([np.zeros(0, np.uint64), *arrays])))

    def chosen(sets: list[np.ndarray], keys: list[bytes]) -> pa.RecordBatch:
        levels = np.split(sent.value.level(np.concatenate([np.zeros(0, np.uint64), *sets])), np.cumsum([len(s) for s in sets])[:-1]) if sets else []
        found = [(key, s, *adaptive_prefix(s, level)) for key, s, level in zip(keys, sets, levels, strict=True)]
        found = [f for f in found if len(f[3])]
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.binary()), pa.array([len(f[1]) for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), lists([f[3] for f in found]), lists([f[1] for f in found]), pa.array([bitmap(f[1]) for f in found], pa.binary())],
            names=["key", "n", "more", "prefix", "shingles", "bitmap"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sets, keys, held = [], [], 0
            for value in batch.column(0):
                s = shingle_set(value.as_py())
                key = set_key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    sets.append(s)
                    keys.append(key)
                    held += len(s)
                if held >= LOOKED_UP:
                    yield chosen(sets, keys)
                    sets, keys, held = [], [], 0
            yield chosen(sets, keys)
            if len(seen) > 1_000_000:
                seen.clear()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "key binary, n long, more int, prefix array<long>, shingles array<long>, bitmap binary")


def _fits(a: str, b: str) -> Column:
    return (F.col(b) * 100 >= F.col(a) * PERCENT) & (F.col(a) * 100 >= F.col(b) * PERCENT)


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that link."""
    sets = lambda side: nodes.select(F.col("node").alias(side), F.col("shingles").alias(f"s_{side}"))
    both = pairs.select("a", "b").join(sets("a"), "a").join(sets("b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    union = F.size("s_a") + F.size("s_b") - shared
    return both.where(100 * shared >= PERCENT * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and the least node of its component, for nodes that have links. Labels are lowered to the least label of
    the neighbours, then each label is replaced by its own label, until nothing changes; jumping halves the distance to
    the least node, so chains take a number of rounds logarithmic in their length."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lowered.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = written(lowered.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        if after.where("old <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def near_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, class_size and component of every row of docs. component is the uid of a
    row of the component, so it tells components apart where ids are null or repeated. A column of docs with a
    different long in every row can be named to be the uid."""
    partitions = docs.rdd.getNumPartitions()
    shards = 1 << min(18, max(6, (2 * partitions - 1).bit_length()))
    first = written(first_pass(docs, shards, row), "shingles")
    rows = first.where("uid IS NOT NULL").select("uid", "doc_id", "n", "key")
    classes = written(rows.where("n > 0").groupBy("key").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least_doc"), F.count("*").alias("class_size")), "classes")
    found = prefixes(docs, frequencies(first, shards)).groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "more", "prefix", "shingles", "bitmap")])
    nodes = written(found.join(classes.select("key", "node"), "key").drop("key"), "nodes")
    entries = nodes.select("node", "n", "more", F.explode("prefix").alias("shingle"))

    least = entries.groupBy("shingle").agg(F.min(F.struct("node", "n", "more")).alias("b"), F.count("*").alias("many")).where("many > 1")
    stars = entries.join(least, "shingle").where(F.col("node") != F.col("b.node"))
    stars = stars.select(F.col("node").alias("a"), "n", "more", F.col("b.node").alias("b"), F.col("b.n").alias("n_b"), F.col("b.more").alias("more_b"), F.lit(1).cast("long").alias("shared")).where(_fits("n", "n_b"))
    enough = lambda pairs: pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min(F.least("more", "more_b")).alias("needed")).where("shared >= needed")
    star_links = written(verified(enough(stars), nodes), "star-links")
    labels = components(star_links)

    placed = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = written(placed, "entries")
    open_lists = placed.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("many")).where("low <> high").select("shingle", "many")
    still = written(placed.join(open_lists, "shingle"), "open-entries")
    short = still.where(F.col("many") <= SHORT_LIST).drop("many")
    other = short.select("shingle", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("more").alias("more_b"), F.col("label").alias("label_b"))
    joined = short.withColumnRenamed("node", "a").join(other, "shingle").where((F.col("label") < F.col("label_b")) & _fits("n", "n_b"))
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    long = still.where(F.col("many") > SHORT_LIST).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    lists = long.groupBy("node").agg(F.collect_set("shingle").alias("lists"))  # at most a prefix
    long = long.join(nodes.select("node", "bitmap").join(lists, "node"), "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    long = long.withColumn("low_block", F.least("block", "with")).withColumn("high_block", F.greatest("block", "with"))
    pair = ["shingle", "low_block", "high_block"]
    dealt = written(long.select(*pair, "block", "node", "n", "more", "label", "bitmap", "lists"), "block-entries").repartitionByRange(*pair)
    met = dealt.groupBy(*pair).applyInPandas(may_link, "a long, b long, more int, more_b int, shared long")
    rest = joined.select("a", "b", "more", "more_b", F.lit(1).cast("long").alias("shared")).unionByName(met)
    rest_links = written(verified(enough(rest), nodes), "rest-links")
    final = components(star_links.unionByName(rest_links))

    reached = final.join(classes.select("node", "least_doc"), "node")
    ids = reached.groupBy("label").agg(F.min("least_doc").alias("component_id"))
    of_class = classes.join(final.join(ids, "label").select("node", "label", "component_id"), "node", "left").select("key", "class_size", F.coalesce("component_id", "least_doc").alias("component_id"), F.coalesce("label", "node").alias("component"))
    linked = rows.where("n > 0").join(of_class, "key").select("uid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size", "component")
    alone = rows.where("n = 0").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"), F.col("uid").alias("component"))
    return linked.unionByName(alone)


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns it came with: the one with the least id, null ids last, and of rows
    that repeat that id the first. Rows with an empty set all stay."""
    row = "_representatives_row"
    rows = written(docs.select("*", F.monotonically_increasing_id().alias(row)), "rows")
    found = written(near_duplicates(rows, row).select("uid", "doc_id", "component"), "components")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")).alias("least")).select(F.col("least.uid").alias("uid"))
    dropped = found.join(kept, "uid", "left_anti").select(F.col("uid").alias(row))
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "class_size")
