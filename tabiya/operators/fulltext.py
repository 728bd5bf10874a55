"""Full-text search over collections: postings, matching and BM25, as joins and aggregations.

Postings are rows (_id, field, element, term, tf, length): one row for a term in a field, where element is the place in
an array of structs (-1 outside arrays). A search can make them of the collection as it goes, or read a `TextIndex`,
where they are stored sorted by term: it then reads the terms it asks for and nothing else, whatever the collection's
size. Query words are a handful, so they travel as literals; matches are grouped by document, never collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field as of
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.functions.analysis import counted_words, english_tokens, joined_words, standard_tokens
from tabiya.sources.shared import completed

K1, B = 1.2, 0.75
#: Documents of a part, whose postings of a word are a block; words with fewer postings in a segment have no bounds kept.
PART_DOCS, BLOCK_LEAST = 512, 1024
#: Rows that a task sorts and a file has, about.
TASK_ROWS = 1 << 20
#: Segments of one level that are merged; changed ids up to which an update asks for their lengths one by one; share of
#: the largest segment's postings that others may have before all are merged.
FANOUT, FEW_IDS, LARGEST_SHARE = 3, 1000, 0.5
Query = list[list[str]]  #: positions of a query, each a list of alternative terms


@dataclass(frozen=True)
class Postings:
    """rows: the postings; where they were made just now, `first` is one of each field's. lengths: (_id, field, element, length), a row for each field that has words; or `known`:
    field, n_docs and total length, as a stored index has them."""

    rows: DataFrame
    lengths: DataFrame | None = None
    known: DataFrame | None = None

    def plus(self, other: Postings) -> Postings:
        return Postings(self.rows.unionByName(other.rows), self.lengths.unionByName(other.lengths))

    def statistics(self) -> DataFrame:
        """field, n_docs and total: over all documents, a row for each field."""
        if self.known is not None:
            return self.known
        return self.lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("length").cast("long").alias("total"))


COLUMNS = ("_id", "field", "element", "term", "tf", "length")


def _counted(rows: DataFrame, english: bool) -> Postings:
    """rows (_id, field, element, text) to postings. The words of a field are counted in its row."""
    tokens = english_tokens if english else standard_tokens
    words = rows.select("_id", "field", "element", joined_words(F.col("text")).alias("words"))
    length = F.explode(F.array(F.size(tokens(F.col("text"))))).alias("length")  # no filter passes below: texts are taken apart once
    lengths = rows.select("_id", "field", "element", length).where("length > 0")
    return Postings(counted_words(words, english), lengths)


def postings(collection: DataFrame, fields: Mapping[str, Column], english: bool = True) -> Postings:
    """Postings of the named text columns; array columns count as one text of all their elements."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), column.alias("text")) for name, column in fields.items()])).alias("f")
    return _counted(collection.select("_id", each).select("_id", "f.field", F.lit(-1).alias("element"), "f.text"), english)


def element_postings(collection: DataFrame, array: str, fields: Mapping[str, Callable[[Column], Column]], english: bool = True) -> Postings:
    """Postings of text fields inside an array of structs; they carry the element's place, so that conditions can be
    asked of one and the same element."""
    elements = collection.select("_id", F.posexplode(array).alias("element", "e"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), of(F.col("e")).alias("text")) for name, of in fields.items()])).alias("f")
    return _counted(elements.select("_id", "element", each).select("_id", "f.field", "element", "f.text"), english)


def element_values(collection: DataFrame, array: str, fields: Mapping[str, Callable[[Column], Column]]) -> Postings:
    """Postings of exact fields inside an array of structs: a value that isn't null is one word as it is."""
    elements = collection.select("_id", F.posexplode(array).alias("element", "e"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), of_(F.col("e")).alias("value")) for name, of_ in fields.items()])).alias("f")
    rows = elements.select("_id", "element", each).where("f.value IS NOT NULL").select("_id", "f.field", "element", F.col("f.value").alias("term"), F.lit(1).cast("long").alias("tf"), F.lit(1).alias("length"), F.lit(True).alias("first"))
    return Postings(rows, rows.select("_id", "field", "element", "length"))


@dataclass(frozen=True)
class Segment:
    """A stored set of postings: of the generations of changes from `first` to `last`. parts: into how many parts its
    documents are dealt by a hash of their id."""

    first: int
    last: int
    level: int
    rows: int
    parts: int

    @property
    def name(self) -> str:
        return f"{self.first}-{self.last}"


STATE = "first int, last int, level int, rows long, parts int"


def segments_to_merge(segments: list[Segment]) -> int:
    """How many of the youngest segments are to become one; 0 for none."""
    if len(segments) <= FANOUT:
        return 0
    if sum(g.rows for g in segments[1:]) > LARGEST_SHARE * segments[0].rows:
        return len(segments)
    return FANOUT if len({g.level for g in segments[-FANOUT:]}) == 1 else 0


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int")


class TextIndex:
    """Stored postings that follow a collection. Generation 0 is of all documents; each later one has the postings of
    the documents that changed, and the ids of these and of the deleted, which hide what older generations have of
    them. FANOUT segments of one level are merged into one of the next, so there are few of them however many updates
    there were (about twice the logarithm of their number to that base), and all are merged when the younger ones have
    half as many postings as the oldest. A `state` names the segments that make up the index; older states, and what
    only they name, stay readable until `drop_merged`.

    Postings are sorted by term, part and id over files of even size, so a search's IN filter on the term skips all
    others, and a word that is in every document is spread over several files. A word's postings in a part are a block;
    of frequent words the greatest count and the least length of each block are kept (`blocks`), which bound the scores
    of its documents. Statistics are a row for each field, brought forward with each state: an update reads the lengths
    of the documents that it changes, sorted by id, and nothing else of the older segments."""

    def __init__(self, spark: SparkSession, path: str, make: Callable[[DataFrame], Postings]):
        """make: the postings of a collection (or of the part of it that changed)."""
        self.spark, self.path, self.make = spark, path.rstrip("/"), make

    # States and segments

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def states(self) -> list[int]:
        """Those that are complete: the list of segments is written last."""
        return sorted(map(int, completed(self.spark, self.path, "state")))

    def segments(self) -> list[Segment]:
        """Of the newest state, from the oldest to the youngest."""
        known = self.states()
        rows = self.spark.read.schema(STATE).parquet(f"{self.path}/state={known[-1]}").collect() if known else []
        return sorted((Segment(*r) for r in rows), key=lambda g: g.first)

    def generations(self) -> list[int]:
        """The last generation of each segment."""
        return [g.last for g in self.segments()]

    def _read(self, kind: str, segment: Segment) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}={segment.name}")

    def _write(self, frame: DataFrame, kind: str, name: object) -> None:
        frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{kind}={name}")

    def _commit(self, segments: list[Segment], statistics: DataFrame) -> None:
        n = max(self.states(), default=-1) + 1
        self._write(statistics.coalesce(1), "statistics", n)
        rows = [(g.first, g.last, g.level, g.rows, g.parts) for g in segments]
        self._write(self.spark.createDataFrame(rows, STATE).coalesce(1), "state", n)

    def _statistics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/statistics={self.states()[-1]}")

    def _hidden(self, segments: list[Segment]) -> DataFrame | None:
        """_id and the place of the youngest of these segments that changed it."""
        younger = [self._read("changed", g).withColumn("_youngest", F.lit(i)) for i, g in enumerate(segments) if i]
        return reduce(DataFrame.unionByName, younger).groupBy("_id").agg(F.max("_youngest").alias("_youngest")) if younger else None

    def _current(self, kind: str, segments: list[Segment], narrow: Callable[[DataFrame, Segment], DataFrame] = lambda rows, g: rows) -> DataFrame:
        """The rows of some segments that no younger one of them hides; narrow: what of each is asked for."""
        rows = reduce(DataFrame.unionByName, [narrow(self._read(kind, g), g).withColumn("_place", F.lit(i)) for i, g in enumerate(segments)])
        hidden = self._hidden(segments)
        if hidden is not None:
            rows = rows.join(hidden, "_id", "left").where("_youngest IS NULL OR _place >= _youngest").drop("_youngest")
        return rows.drop("_place")

    # Building, updating, merging

    def build(self, collection: DataFrame, names: Iterable[str] = ()) -> TextIndex:
        """names: of changes that are in the collection, where the index follows one."""
        made = self._store(self.make(collection), 0, names)
        self._commit([made], self._sums(made))
        return self

    def update(self, changed: DataFrame, deleted: DataFrame | None = None, names: Iterable[str] = ()) -> TextIndex:
        """The documents as they now are, and the ids of those that are gone."""
        segments = self.segments()
        generation = segments[-1].last + 1
        ids = changed.select("_id") if deleted is None else changed.select("_id").unionByName(deleted.select("_id"))
        self._write(ids.distinct(), "changed", f"{generation}-{generation}")
        made = self._store(self.make(changed), generation, names)
        ids = self._read("changed", made)
        few = [r["_id"] for r in ids.limit(FEW_IDS + 1).collect()]
        of_these = (lambda rows, g: rows.where(F.col("_id").isin(few))) if len(few) <= FEW_IDS else (lambda rows, g: rows.join(ids, "_id", "left_semi"))
        minus = self._current("lengths", segments, of_these).select("field", (-F.col("n_docs")).alias("n_docs"), (-F.col("total")).alias("total"))
        both = self._statistics().unionByName(self._sums(made)).unionByName(minus).groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"))
        self._commit([*segments, made], both.where("n_docs > 0"))
        self._merge_where_due()
        return self

    def _sums(self, segment: Segment) -> DataFrame:
        return self._read("lengths", segment).groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"))

    def _merge_where_due(self) -> None:
        while n := segments_to_merge(self.segments()):
            self.merge(n)

    def merge(self, n: int) -> None:
        """The n youngest segments as one; of all segments, one without anything hidden."""
        segments = self.segments()
        old = segments[-n:]
        first, last, all_ = old[0].first, old[-1].last, n == len(segments)
        name = f"{first}-{last}"
        if not all_:
            self._write(reduce(DataFrame.unionByName, [self._read("changed", g) for g in old]).distinct(), "changed", name)
        self._write(reduce(DataFrame.unionByName, [self._read("names", g) for g in old]).distinct().coalesce(1), "names", name)
        self._write(self._current("lengths", old).repartitionByRange("_id").sortWithinPartitions("_id"), "lengths", name)
        made = self._stored(self._current("postings", old).drop("part"), sum(g.rows for g in old), Segment(first, last, old[0].level if all_ else old[-1].level + 1, 0, 0))
        self._commit([*segments[:-n], made], self._statistics())

    def drop_merged(self) -> None:
        """Deletes what only older states name; no reader may still be at one."""
        path, files = self._files()
        used, newest = {g.name for g in self.segments()}, self.states()[-1]
        for found in files.listStatus(path(self.path)):
            kind, _, name = found.getPath().getName().partition("=")
            if (kind in ("state", "statistics") and int(name) != newest) or (kind in ("postings", "lengths", "changed", "names", "blocks") and name not in used):
                files.delete(found.getPath(), True)

    def followed(self) -> set[str]:
        """Names of the changes that are in the index, where it follows a collection."""
        names = [self._read("names", g) for g in self.segments()]
        return {r["name"] for r in reduce(DataFrame.unionByName, names).distinct().collect()} if names else set()

    def _store(self, made: Postings, generation: int, names: Iterable[str]) -> Segment:
        """Words are counted once, into a table that lengths and postings are then made of."""
        name = f"{generation}-{generation}"
        self._write(self.spark.createDataFrame([(n,) for n in sorted(names)], "name string").coalesce(1), "names", name)
        self._write(made.rows.select(*COLUMNS, "first"), "words", name)
        words = self.spark.read.parquet(f"{self.path}/words={name}")
        fields = words.where("first").select("_id", "field", "length")
        tasks = max(1, math.ceil(4 * fields.count() / TASK_ROWS))  # a row of a hash table is larger than one of a sort
        per_document = fields.repartitionByRange(tasks, "_id").groupBy("_id", "field").agg(F.count("*").alias("n_docs"), F.sum("length").cast("long").alias("total"))  # no further exchange
        self._write(per_document.sortWithinPartitions("_id"), "lengths", name)
        found = self._stored(words, words.count(), Segment(generation, generation, 0 if generation else 1 << 20, 0, 0))
        path, files = self._files()
        files.delete(path(f"{self.path}/words={name}"), True)
        return found

    def _stored(self, rows: DataFrame, n: int, segment: Segment) -> Segment:
        """Postings and their blocks' bounds; the lengths are there already. n: how many rows there are, about; they are
        dealt over tasks by their number, since what a partition has in bytes says little of packed words."""
        documents = self._read("lengths", segment).count()
        parts = 1 << max(0, math.ceil(documents / PART_DOCS) - 1).bit_length()
        dealt = rows.select(*COLUMNS, part_of(parts).alias("part"))
        tasks = max(1, math.ceil(n / TASK_ROWS))
        self._write(dealt.repartitionByRange(tasks, "term", "part", "_id").sortWithinPartitions("term", "part", "_id"), "postings", segment.name)
        stored = self._read("postings", segment)
        frequent = stored.groupBy("term", "field").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK_LEAST).select("term", "field")
        often = stored.join(F.broadcast(frequent), ["term", "field"], "left_semi")  # at most a row for BLOCK_LEAST postings
        blocks = often.groupBy("term", "field", "part").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"))
        self._write(blocks.repartitionByRange("term", "part").sortWithinPartitions("term", "part"), "blocks", segment.name)
        return Segment(segment.first, segment.last, segment.level, stored.count(), parts)

    # Reading

    def postings(self) -> Postings:
        return Postings(self._current("postings", self.segments()).drop("part"), known=self._statistics())

    def top(self, required: Query, optional: Query, field: str, k: int, eligible: DataFrame | None = None, rounds: tuple[float, ...] = (0.97, 0.8)) -> Top:
        """What `required_and_optional` gives, with scores, of the documents that can be among the k best of `eligible`
        (a table with their `_id`; by default all), ties with the last of them included.

        Parts whose blocks allow the highest scores are read first, those above a quantile of the bounds; the k-th score
        found so far rules out all parts whose bound is lower; and so on, until none is left that may have a better one.
        Blocks that aren't read are those of parts that were ruled out."""
        segments, query, n = self.segments(), required + optional, len(required)
        places = [(t, p) for p, group in enumerate(query) for t in group]
        wanted, position = sorted({t for t, _ in places}), F.filter(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in places]), lambda e: e["t"] == F.col("term"))
        asked = lambda rows: rows.where(F.col("term").isin(wanted) & (F.col("field") == field))
        about = {r["field"]: (r["n_docs"], r["total"]) for r in self._statistics().collect()}
        if not wanted or field not in about:
            return Top(self.spark.createDataFrame([], self._read("postings", segments[0]).select("_id").schema.add("_score", "double")))
        n_docs, mean = about[field][0], about[field][1] / about[field][0]
        # Bounds of each part, from the blocks of frequent words and the postings of the others.
        bounds = None
        for i, g in enumerate(segments):
            kept = asked(self._read("blocks", g)).select("term", "part", "n", "most", "least")
            frequent = {r["term"] for r in kept.select("term").distinct().collect()}
            rare = [t for t in wanted if t not in frequent]
            few = self._read("postings", g).where(F.col("term").isin(rare) & (F.col("field") == field)) if rare else None
            rows = kept if few is None else kept.unionByName(few.groupBy("term", "part").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least")).select("term", "part", "n", "most", "least"))
            rows = rows.withColumn("segment", F.lit(i))
            bounds = rows if bounds is None else bounds.unionByName(rows)
        placed = bounds.select("segment", "part", "n", "most", "least", F.explode(position).alias("at"))
        by_position = placed.groupBy("segment", "part", F.col("at.p").alias("position")).agg(F.sum("n").alias("n"), F.sum("most").alias("most"), F.min("least").alias("least"))
        often = {r["position"]: r["n"] for r in by_position.groupBy("position").agg(F.sum("n").alias("n")).collect()}
        for p, less in self._hidden_counts(segments, asked, position).items():
            often[p] -= less
        idf = {p: math.log(1 + (n_docs - m + 0.5) / (m + 0.5)) for p, m in often.items()}
        if any(p not in idf for p in range(n)):
            return Top(self.spark.createDataFrame([], self._read("postings", segments[0]).select("_id").schema.add("_score", "double")))
        weight = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))
        idf_of = reduce(lambda made, kv: made.when(F.col("position") == kv[0], F.lit(kv[1])), idf.items(), F.when(F.lit(False), F.lit(0.0)))
        must = F.sum((F.col("position") < n).cast("int"))
        parts = by_position.groupBy("segment", "part").agg(F.sum(idf_of * weight(F.col("most"), F.col("least")) * (1 + 1e-12)).alias("bound"), must.alias("must"), F.count("*").alias("blocks"))
        parts = parts.where(F.col("must") == n).drop("must")

        def scored(chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
            """Exact scores of all documents of the chosen parts."""
            rows = self._current("postings", segments, lambda rows, g: chosen(asked(rows).withColumn("segment", F.lit(segments.index(g)))).drop("segment"))
            each = rows.select("_id", "tf", "length", F.explode(position).alias("at")).groupBy("_id", F.col("at.p").alias("position"), "length").agg(F.sum("tf").alias("tf"))
            found = each.groupBy("_id").agg(must.alias("must"), F.sum(idf_of * weight(F.col("tf"), F.col("length"))).alias("_score"))
            return found.where(F.col("must") == n).select("_id", "_score")

        def kth(found: DataFrame) -> float | None:
            fit = found if eligible is None else found.join(eligible.select("_id"), "_id", "left_semi")
            best = fit.orderBy(F.col("_score").desc()).limit(k).agg(F.min("_score").alias("s"), F.count("*").alias("n")).first()
            return best["s"] if best["n"] == k else None

        least, steps = None, parts.agg(F.percentile_approx("bound", list(rounds), 1000).alias("q")).first()["q"] or []
        for bound in steps:
            if least is not None and least >= bound:
                break
            found = kth(scored(lambda rows: rows.join(parts.where(F.col("bound") >= bound).select("segment", "part"), ["segment", "part"], "left_semi")))  # noqa: B023
            least = found if least is None else max(least, found if found is not None else least)
        left = parts if least is None else parts.where(F.col("bound") >= least)
        rows = scored(lambda rows: rows.join(left.select("segment", "part"), ["segment", "part"], "left_semi"))
        return Top(rows if least is None else rows.where(F.col("_score") >= least), parts, left)

    def _hidden_counts(self, segments: list[Segment], asked: Callable[[DataFrame], DataFrame], position: Column) -> dict[int, int]:
        """How many postings of each position are hidden: only parts with hidden ids are looked at."""
        hidden = self._hidden(segments)
        if hidden is None:
            return {}
        found = []
        for i, g in enumerate(segments[:-1]):
            ids = hidden.where(F.col("_youngest") > i).select("_id", part_of(g.parts).alias("part"))
            rows = asked(self._read("postings", g)).join(ids, ["part", "_id"], "left_semi")
            found.append(rows.select(F.explode(position).alias("at")).groupBy(F.col("at.p").alias("position")).agg(F.count("*").alias("n")))
        return {r["position"]: r["n"] for r in reduce(DataFrame.unionByName, found).groupBy("position").agg(F.sum("n").alias("n")).collect()}


@dataclass(frozen=True)
class Top:
    """rows: _id and _score. parts, read: the parts that hold asked words and those of them that were read to the end,
    with their bounds and numbers of blocks."""

    rows: DataFrame
    parts: DataFrame | None = of(default=None, repr=False)
    read: DataFrame | None = of(default=None, repr=False)


Index = Postings | TextIndex


def _of(index: Index) -> Postings:
    return index.postings() if isinstance(index, TextIndex) else index


def hits(index: Index, query: Query, fields: Mapping[str, float]) -> DataFrame:
    """(_id, field, element, position, tf, length, boost): where the query's positions occur. The terms reach the scan
    as an IN filter. A position without terms occurs nowhere."""
    wanted = sorted({term for group in query for term in group})
    places = [F.struct(F.lit(t).alias("t"), F.lit(p).cast("int").alias("p")) for p, group in enumerate(query) for t in group]
    position = F.filter(F.array(*places) if places else F.array().cast("array<struct<t:string,p:int>>"), lambda e: e["t"] == F.col("term"))
    boost = reduce(lambda acc, kv: acc.when(F.col("field") == kv[0], F.lit(float(kv[1]))), fields.items(), F.when(F.lit(False), F.lit(0.0)))
    found = _of(index).rows.where((F.col("term").isin(wanted) if wanted else F.lit(False)) & F.col("field").isin(list(fields)))
    rows = found.select("_id", "field", "element", "tf", "length", boost.alias("boost"), F.explode(position).alias("at")).select("*", F.col("at.p").alias("position"))
    return rows.groupBy("_id", "field", "element", "position", "length", "boost").agg(F.sum("tf").alias("tf"))


def position_scores(index: Index, query: Query, fields: Mapping[str, float]) -> DataFrame:
    """(_id, field, element, position, score): BM25 of each query position in each field, with boosts. Statistics are
    global: documents with the field, its mean length, and the documents in which a position occurs (a synonym group
    is one position)."""
    index = _of(index)
    found = hits(index, query, fields)
    about = index.statistics().select("field", "n_docs", (F.col("total") / F.col("n_docs")).alias("mean_length"))
    often = found.groupBy("field", "position").agg(F.count("*").alias("n_with"))
    idf = F.log(1 + (F.col("n_docs") - F.col("n_with") + 0.5) / (F.col("n_with") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    rows = found.join(F.broadcast(about), "field").join(F.broadcast(often), ["field", "position"])  # a row for each field, and for each query position
    return rows.select("_id", "field", "element", "position", (F.col("boost") * idf * weight).alias("score"))


def scored_fields(index: Index, query: Query, fields: Mapping[str, float]) -> DataFrame:
    """(_id, field, element, matched, score): positions found in a field, and their scores together."""
    return position_scores(index, query, fields).groupBy("_id", "field", "element").agg(F.count("*").alias("matched"), F.sum("score").alias("score"))


def best_field(index: Index, query: Query, fields: Mapping[str, float], every_word: bool = False) -> DataFrame:
    """(_id, _score) by the best field; with every_word, all positions must be in one and the same field."""
    rows = scored_fields(index, query, fields)
    rows = rows.where(F.col("matched") == len(query)) if every_word else rows
    return rows.groupBy("_id").agg(F.max("score").alias("_score"))


def every_word_somewhere(index: Index, query: Query, fields: Mapping[str, float], exact: DataFrame | None = None) -> DataFrame:
    """(_id) of documents in which each position occurs in some field, or is given with the id in `exact`
    (_id, position). One grouping for all words."""
    found = hits(index, query, fields).select("_id", "position")
    found = found if exact is None else found.unionByName(exact.select("_id", "position"))
    return found.groupBy("_id").agg(F.countDistinct("position").alias("n")).where(F.col("n") == len(query)).select("_id")


def in_one_element(index: Index, query: Query, fields: Mapping[str, float]) -> DataFrame:
    """(_id, element) of elements in which some position occurs in some field."""
    return hits(index, query, fields).select("_id", "element").distinct()


def element_conditions(index: Index, conditions: Mapping[str, tuple[list[str], Query]], test: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """(_id, element) of elements for which `test` holds. A condition (fields, query) is met if some position of its
    query occurs in one of its fields; test gets a function from its name to that. All are asked in one pass, and an
    element has as many rows as conditions at most."""
    asked = [(field, term, name) for name, (fields, query) in conditions.items() for field in fields for group in query for term in group]
    places = [F.struct(F.lit(f).alias("f"), F.lit(t).alias("t"), F.lit(n).alias("n")) for f, t, n in asked]
    names = F.filter(F.array(*places) if places else F.array().cast("array<struct<f:string,t:string,n:string>>"), lambda e: (e["f"] == F.col("field")) & (e["t"] == F.col("term")))
    found = _of(index).rows.where((F.col("term").isin(sorted({t for _, t, _ in asked})) & F.col("field").isin(sorted({f for f, _, _ in asked}))) if asked else F.lit(False))
    met = found.select("_id", "element", F.explode(names).alias("c")).groupBy("_id", "element").agg(F.collect_set("c.n").alias("met"))
    return met.where(test(lambda name: F.array_contains("met", name))).select("_id", "element")


def required_and_optional(index: Index, required: Query, optional: Query, field: str, scored: bool = True) -> DataFrame:
    """(_id, _score) of documents with all required positions; if there is none, with at least one optional one.
    Optional positions add to the score. Without `scored` nothing is scored."""
    n = len(required)
    query = required + optional if scored or not n else required
    found = position_scores(index, query, {field: 1.0}) if scored else hits(index, query, {field: 1.0}).withColumn("score", F.lit(0.0))
    grouped = found.groupBy("_id").agg(F.sum((F.col("position") < n).cast("int")).alias("must"), F.sum("score").alias("_score"))
    return grouped.where(F.col("must") == n).select("_id", *(["_score"] if scored else []))
