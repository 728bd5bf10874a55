"""Mixing sources to target weights along a curriculum whose weights change with time.

Each source has a target of words. Sources weigh 5, 2, 1, repeating in code-point order (null last); a target stops
at `most` times the source's size and the excess is shared again by weight. The result of sharing again and again is
one level L with target = min(most * size, L * weight), found from sums over the sources sorted by cap / weight.

Inside a source, documents stand in a seeded order. The source is read in whole passes, then in a last pass that ends
where its target is reached, inside a document if need be; so the words taken are the target rounded. Each reading
gets a training position: a source's weight over training time runs linearly from `opening` to 2 - `opening`, its
integral is the source's cumulative demand, and inverting that demand at the reading's cumulative words gives the
time at which those words are due. Readings are range-sorted by that position.

The cumulative words come from a prefix sum in two steps: sums of 4096 buckets of the seeded order, then running sums
inside a bucket, so a source with a third of all rows is spread over 4096 groups. Everything is DataFrame operations.

Defined results: a null text has size 0; a null source is a source of its own; documents of size 0 are never taken;
rows equal in id and size share the order arbitrarily, which leaves the set of result rows the same; if no document
has a word, all targets are 0; extra columns are carried only by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabiya.llm.common import SPACE_CLASS, table, words, written

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"
#: Share of a source's mean weight at the start of training, by place: early, even and late sources.
OPENINGS = (1.5, 1.0, 0.5)
BROADCAST_SOURCES = 10_000
#: Internal columns carry this prefix, so that they clash with none of the caller's.
P = "_mix_"


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def sized(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, with the words of the text, the source's key and the place in the seeded order."""
    size = F.size(words(F.col("text"))).cast("long")
    rows = docs.select(*keep, F.col("doc_id").alias(f"{P}id"), _source_key(F.col("source")).alias(f"{P}source"), size.alias(f"{P}size"))
    order = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(f"{P}id").cast("string"), F.lit("")), F.col(f"{P}size").cast("string")).cast("binary"))
    return rows.withColumn(f"{P}order", order).withColumn(f"{P}bucket", F.substring(f"{P}order", 1, 3))


def source_plan(buckets: DataFrame) -> DataFrame:
    """For each source: size, target, words to take, whole passes, rest of the last pass and opening. One row for
    each source, so the windows over all of them hold as many rows as there are sources."""
    w = F.when(F.col("place") % 3 == 1, WEIGHTS[0]).when(F.col("place") % 3 == 2, WEIGHTS[1]).otherwise(WEIGHTS[2])
    opening = F.when(F.col("place") % 3 == 1, OPENINGS[0]).when(F.col("place") % 3 == 2, OPENINGS[1]).otherwise(OPENINGS[2])
    sources = buckets.groupBy(f"{P}source").agg(F.sum("words").alias("size"))
    placed = sources.withColumn("place", F.row_number().over(Window.orderBy(f"{P}source"))).withColumn("w", w).withColumn("opening", opening)
    by_cap = Window.orderBy(F.col("size") / F.col("w"), f"{P}source").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    capped = placed.select(
        "*", (MOST * F.col("size")).alias("cap"), F.sum("size").over(all_rows).alias("total"), F.sum("w").over(all_rows).alias("all_w"),
        F.coalesce(MOST * F.sum("size").over(by_cap), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("w").over(by_cap), F.lit(0)).alias("w_before"),
    )
    level = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("all_w") - F.col("w_before"))
    levelled = capped.withColumn("own_level", level).withColumn(
        "level", F.min(F.when(F.col("own_level") * F.col("w") <= F.col("cap"), F.struct("cap_before", "own_level"))).over(all_rows)["own_level"]
    )
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))
    take = F.floor(F.col("target") + 0.5).cast("long")
    return (
        levelled.withColumn("target", target).withColumn("take", take)
        .select(
            f"{P}source", F.col("size").alias(f"{P}source_size"), F.col("target").alias(f"{P}target"), F.col("take").alias(f"{P}take"), F.col("opening").alias(f"{P}opening"),
            F.when(F.col("size") > 0, F.expr("take div size")).otherwise(0).cast("long").alias(f"{P}passes"),
            F.when(F.col("size") > 0, F.col("take") % F.col("size")).otherwise(0).cast("long").alias(f"{P}rest"),
        )
    )


def readings(rows: DataFrame) -> DataFrame:
    """rows of `sized` with the plan of their source and `_mix_readings`: an array of (words, position)."""
    buckets = written(rows.groupBy(f"{P}source", f"{P}bucket").agg(F.sum(f"{P}size").alias("words")), "mix-buckets")
    plan = written(source_plan(buckets), "mix-plan")
    few = F.broadcast if plan.count() <= BROADCAST_SOURCES else (lambda frame: frame)
    before = Window.partitionBy(f"{P}source").orderBy(f"{P}bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(f"{P}source", f"{P}bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias(f"{P}offset"))
    inside = Window.partitionBy(f"{P}source", f"{P}bucket").orderBy(f"{P}order", f"{P}id", f"{P}size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(f"{P}before", F.coalesce(F.sum(f"{P}size").over(inside), F.lit(0)))
    placed = summed.join(offsets, [f"{P}source", f"{P}bucket"]).join(few(plan), f"{P}source").withColumn(f"{P}before", F.col(f"{P}before") + F.col(f"{P}offset"))
    last = F.least(F.greatest(F.col(f"{P}rest") - F.col(f"{P}before"), F.lit(0)), F.col(f"{P}size"))
    a = F.col(f"{P}opening")

    def due(done: Column) -> Column:
        """The time t with a t + (1 - a) t^2 = done, the share of the source's words read so far."""
        return F.when(a == 1.0, done).otherwise((F.sqrt(a * a + 4 * (1 - a) * done) - a) / (2 * (1 - a)))

    def reading(pass_no: Column) -> Column:
        taken = F.when(pass_no < F.col(f"{P}passes"), F.col(f"{P}size")).otherwise(last)
        done = (pass_no * F.col(f"{P}source_size") + F.col(f"{P}before") + taken / 2) / F.greatest(F.col(f"{P}take"), F.lit(1))
        return F.struct(taken.alias("words"), due(done).alias("position"))

    passes = F.sequence(F.lit(0).cast("long"), F.col(f"{P}passes"))
    return placed.withColumn(f"{P}readings", F.filter(F.transform(passes, reading), lambda r: r["words"] > 0))


def mix(docs: DataFrame, written_first: bool = True) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, n_readings and first_position (null if
    none), range-sorted by that position. Documents without one are spread by the seeded order."""
    rows = sized(docs, ())
    read = readings(written(rows, "mix-sizes") if written_first else rows)
    positions = F.transform(f"{P}readings", lambda r: r["position"])
    out = read.select(
        F.col(f"{P}id").alias("doc_id"), F.col(f"{P}size").alias("size"), F.col(f"{P}source_size").alias("source_size"), F.col(f"{P}target").alias("target"),
        F.aggregate(f"{P}readings", F.lit(0).cast("long"), lambda n, r: n + r["words"]).alias("taken"),
        F.size(f"{P}readings").alias("n_readings"), F.round(F.array_min(positions), 6).alias("first_position"), f"{P}order",
    )
    by = [F.col("first_position").asc_nulls_last(), F.col(f"{P}order")]
    return out.repartitionByRange(*by).sortWithinPartitions(*by).drop(f"{P}order")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents in training order, a row for each reading, with their own columns; a last reading that ends
    inside a document has the text up to there."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias(f"{P}row")
    read = readings(sized(docs.select(row, "doc_id", "source", "text"), (f"{P}row",)))
    each = read.select(f"{P}row", f"{P}size", F.explode(f"{P}readings").alias(f"{P}r"))
    pieces = F.regexp_extract_all(F.col(f"{P}row.text"), F.lit(rf"[{SPACE_CLASS}]*[^{SPACE_CLASS}]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col(f"{P}r.words").cast("int")), "")
    text = F.when(F.col(f"{P}r.words") == F.col(f"{P}size"), F.col(f"{P}row.text")).otherwise(cut)
    ordered = each.withColumn(f"{P}text", text).repartitionByRange(f"{P}r.position").sortWithinPartitions(f"{P}r.position")
    return ordered.select(*[(F.col(f"{P}text") if c == "text" else F.col(f"{P}row.`{c}`")).alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '~') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
o AS (SELECT *, md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR) AS ord FROM d),
z AS (SELECT s, sum(size)::BIGINT AS z FROM d GROUP BY s),
p AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT] AS w, [1.5, 1.0, 0.5][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT]::DOUBLE AS a FROM z),
c AS (SELECT *, sum(z) OVER () AS total, sum(w) OVER () AS all_w,
        coalesce(3 * sum(z) OVER r, 0) AS cap_before, coalesce(sum(w) OVER r, 0) AS w_before
      FROM p WINDOW r AS (ORDER BY z::DOUBLE / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - cap_before)::DOUBLE / (all_w - w_before)::DOUBLE AS own FROM c),
t AS (SELECT s, z, a, least((3 * z)::DOUBLE, (SELECT arg_min(own, cap_before) FROM v WHERE own * w <= 3 * z) * w) AS target FROM v),
k AS (SELECT *, floor(target + 0.5)::BIGINT AS take, CASE WHEN z > 0 THEN floor(target + 0.5)::BIGINT // z ELSE 0 END AS passes,
        CASE WHEN z > 0 THEN floor(target + 0.5)::BIGINT % z ELSE 0 END AS rest FROM t),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM o JOIN k USING (s)),
e AS (SELECT *, least(greatest(rest - before, 0), size) AS part FROM b),
f AS (SELECT *, CASE WHEN passes > 0 THEN size ELSE part END AS first FROM e),
g AS (SELECT *, (before + first / 2) / take AS done FROM f)
SELECT doc_id, size, z AS source_size, target, (passes * size + part)::BIGINT AS taken,
  (CASE WHEN size > 0 THEN passes ELSE 0 END + (part > 0)::INT)::INT AS n_readings,
  round(CASE WHEN first > 0 THEN CASE WHEN a = 1.0 THEN done ELSE (sqrt(a * a + 4 * (1 - a) * done) - a) / (2 * (1 - a)) END END, 6) AS first_position
FROM g
"""
