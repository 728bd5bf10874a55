"""Exact top-k inner-product search with vector-approximation files.

Vectors are stored twice: exactly, a row each, and as cells: blocks of vectors whose components are quantised to a few
bits on the block's own grid. The scan reads cells only. A cell bounds the score: the middle of the cell gives it up to
the query's components times half a cell.

The scan goes in rounds. In a round, groups of query blocks meet groups of cell blocks; a meeting keeps, for a query,
what can still be among its k best by these bounds. After a round, the k-th largest lower bound of a query over all
cells so far prunes what is kept and goes into the next round with the query, which meets as many cells as all before
it together. So a round leaves about k pairs of a query, and there are as many rounds as the number of groups has
binary digits: the pairs grow with the queries, not with the queries times the table.

Exact vectors are then read in order of their bounds, also in rounds: first the k most promising of each query, which
gives a k-th exact score, then twice as many of those whose bound still reaches it, until no query has any; nothing
else can enter, so the result is certain.

A meeting holds at most QUERIES_A_GROUP blocks of queries and CELLS_A_GROUP blocks of cells; no side is broadcast and
nothing is collected.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows
without an id; vectors of different length don't meet; a query with fewer than k candidates gets all; equal scores are
ordered by smaller id; repeated rows are candidates of their own, and only the query's own row is left out; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabiya.llm.common import table, written

BITS, BLOCK, QUERY_BLOCK, CELLS_A_GROUP, QUERIES_A_GROUP = 6, 2048, 1024, 8, 4


def scaled(rows: DataFrame, by: float = 64.0, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """row, vec_id, dim and v: floor(by * x) of every component, for the rows that take part."""
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    fit = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("e")).withColumnRenamed("e", column)
    fit = fit.where(F.col("vec_id").isNotNull() & (F.size(column) > 0) & F.coalesce(whole, F.lit(False)))
    return fit.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.size(column).alias("dim"), F.transform(column, lambda x: F.floor(F.lit(by) * x.cast("double")).cast("long")).alias("v")
    )


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """number, dim, row numbers and vectors of blocks of equal dim; columns are row, dim, v."""
    number, held = 0, {}
    for batch in batches:
        rows, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        values, ends = batch.column(2).flatten().to_numpy(), np.cumsum(dims)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            vectors = values[(ends[at] - dim)[:, None] + np.arange(dim)]
            r, v = held.pop(int(dim), (rows[:0], vectors[:0]))
            r, v = np.concatenate([r, rows[at]]), np.concatenate([v, vectors])
            while len(r) >= size:
                yield number, int(dim), r[:size], v[:size]
                number, r, v = number + 1, r[size:], v[size:]
            held[int(dim)] = (r, v)
    for dim, (r, v) in held.items():
        if len(r):
            yield number, dim, r, v
            number += 1


CELLS = "block long, dim int, n int, rows binary, low binary, step binary, cells binary"


def cells(vectors: DataFrame, bits: int = BITS, size: int = BLOCK) -> DataFrame:
    """The approximation file: a row for each block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for number, dim, rows, v in _blocks(batches, size):
            low, high = v.min(axis=0), v.max(axis=0)
            step = np.maximum(1, -(-(high - low + 1) >> bits))
            cell = ((v - low) // step).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": [part + number], "dim": pa.array([dim], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "rows": [rows.astype("<i8").tobytes()], "low": [low.astype("<i8").tobytes()], "step": [step.astype("<i8").tobytes()], "cells": [cell.tobytes()]})

    return vectors.select("row", "dim", "v").mapInArrow(run, CELLS)


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for number, dim, rows, v in _blocks(batches, size):
            yield pa.RecordBatch.from_pydict({"query_block": [part + number], "dim": pa.array([dim], pa.int32()), "q_rows": [rows.astype("<i8").tobytes()], "q": [v.astype("<i8").tobytes()]})

    few = max(1, queries.count() // (4 * size))
    return queries.select("row", "dim", "v").repartition(few, "row").mapInArrow(run, "query_block long, dim int, q_rows binary, q binary")


PAIRS = "query_block long, place int, q_row long, row long, low double, high double"


def _meet(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The pairs that the bounds leave, of some blocks of queries and some blocks of cells."""
        out = [pd.DataFrame({"query_block": np.array([], np.int64), "place": np.array([], np.int32), "q_row": np.array([], np.int64), "row": np.array([], np.int64), "low": np.array([], float), "high": np.array([], float)})]
        for one in left.itertuples():
            q_rows, dim = np.frombuffer(one.q_rows, "<i8"), one.dim
            q = np.frombuffer(one.q, "<i8").reshape(-1, dim).astype(float)
            size, best, least, held = np.abs(q), np.full((len(q), k), -np.inf), np.full(len(q), -np.inf), []
            if one.places is not None:
                least[np.asarray(one.places, np.int64)] = one.bounds
            for b in right[right["dim"] == dim].itertuples():
                rows, low, step = (np.frombuffer(x, "<i8") for x in (b.rows, b.low, b.step))
                cell = np.frombuffer(b.cells, np.uint8).reshape(-1, dim)
                half = (step - 1) / 2
                middle = low + half + cell * step
                slack = 1e-9 * (size @ (np.abs(middle).max(axis=0) + half))
                reach = (size @ half + slack)[:, None]
                score = q @ middle.T
                score[q_rows[:, None] == rows[None, :]] = -np.inf  # a query's own row
                top = np.partition(score, -k, axis=1)[:, -k:] if score.shape[1] > k else score
                best = np.partition(np.concatenate([best, top - reach], axis=1), -k, axis=1)[:, -k:]
                least = np.maximum(least, best.min(axis=1))
                qi, ri = np.nonzero((score + reach >= least[:, None]) & np.isfinite(score))
                held.append((qi, rows[ri], score[qi, ri], reach[qi, 0]))
            for qi, rows, score, reach in held:
                ok = score + reach >= least[qi]
                out.append(pd.DataFrame({"query_block": one.query_block, "place": qi[ok].astype(np.int32), "q_row": q_rows[qi[ok]], "row": rows[ok], "low": (score - reach)[ok], "high": (score + reach)[ok]}))
        return pd.concat(out)

    return run


def _kth(pairs: DataFrame, by: str, k: int, keys: tuple[str, ...] = ("q_row",)) -> DataFrame:
    """The k-th largest value of each query that has so many."""
    first = pairs.select(*keys, by, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(by).desc())).alias("n")).where(F.col("n") <= k)
    return first.groupBy(*keys).agg(F.count("*").alias("n"), F.min(by).cast("double").alias("least")).where(F.col("n") == k).drop("n")


def _pruned(pairs: DataFrame, kth: DataFrame) -> DataFrame:
    return pairs.join(kth.select("q_row", "least"), "q_row", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).drop("least")


def possible_pairs(q_blocks: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """The pairs of a query and a vector that the bounds over all cells leave."""
    n_groups = max(1, -(-approximate.count() // CELLS_A_GROUP))
    n_sides = max(1, -(-q_blocks.count() // QUERIES_A_GROUP))
    grouped = lambda block, n, name: F.pmod(F.xxhash64(block), F.lit(n)).cast("int").alias(name)
    sides = F.explode(F.sequence(F.lit(0), F.lit(n_sides - 1))).alias("side")
    cells_of, queries_of = approximate.select("*", grouped("block", n_groups, "g")), q_blocks.select("*", grouped("query_block", n_sides, "side"))
    found = q_blocks.sparkSession.createDataFrame([], PAIRS)
    at, width = 0, 1
    while at < n_groups:
        last = min(n_groups, at + width) - 1
        kth = _kth(found, "low", k, ("query_block", "place", "q_row"))
        bounds = kth.groupBy("query_block").agg(F.sort_array(F.collect_list(F.struct("place", "least"))).alias("b")).select("query_block", F.col("b.place").alias("places"), F.col("b.least").alias("bounds"))
        left = queries_of.join(bounds, "query_block", "left").select("*", F.explode(F.sequence(F.lit(at), F.lit(last))).alias("g"))
        right = cells_of.where(F.col("g").between(at, last)).select("*", sides)
        met = left.groupBy("side", "g").cogroup(right.groupBy("side", "g")).applyInPandas(_meet(k), PAIRS)
        together = written(found.unionByName(met), "pairs-met")
        found = written(_pruned(together, _kth(together, "low", k)), "pairs")
        at, width = last + 1, last + 1
    return found


def search(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each query row among all other rows of `scaled` vectors."""
    exact = written(vectors, "vectors")
    queries = written(exact.where(is_query), "queries")
    pairs = possible_pairs(written(query_blocks(queries), "query-blocks"), written(cells(exact), "cells"), k)
    by_bound = Window.partitionBy("q_row").orderBy(F.col("high").desc(), "row")
    ordered = written(pairs.select("q_row", "row", "high", F.row_number().over(by_bound).alias("nth")), "pairs-by-bound")
    asked = queries.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    product = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
    read = lambda some: some.join(exact.select("row", "vec_id", "v"), "row").join(asked, "q_row").select("q_row", "query_id", "vec_id", product.alias("score"))
    best = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id")
    first, last = 1, k
    scored, left = read(ordered.where(F.col("nth") <= last)), ordered
    while True:
        scored = written(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "scored")
        left = written(_pruned(left.where(F.col("nth") > last), _kth(scored, "score", k)), "pairs-left")
        if left.isEmpty():
            return scored.select("query_id", "rank", "vec_id", "score")
        first, last = last + 1, 3 * last
        scored = scored.drop("rank").unionByName(read(left.where(F.col("nth").between(first, last))))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(scaled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


ORACLE = r"""
WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.k <> c.k AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
