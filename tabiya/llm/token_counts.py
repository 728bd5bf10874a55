"""Token counts of the documents in flat token files, found by scanning for the end-of-document id.

A flat file is nothing but ids, documents ended by a separator id; no index says where they lie. It is read as blocks
of fixed size, cut wherever they fall. A task searches a block with one vectorised comparison and keeps four numbers
(ids, separators, ids before the first and after the last separator) and the lengths between separators. A prefix scan
over a file's blocks, in running sums, then gives each block the number of documents before it and the place where the
document that is open at its start began; that stitches documents that span blocks, however many. The scan looks at the
four numbers only, in two levels: over runs of RUN blocks, and inside each run; lengths are joined to its result.

Files are tables of (file, block, ids binary) in the shared folder, or real files (`flat_files`), of which each task
opens the shared path and reads its own ranges only, so one file of any size is spread over many tasks. Ids that don't
fit in the files' width are an error, never cut.

Defined results: ids after a file's last separator form a last document with `ended` false; without such ids there is
none; an empty document (two separators in a row) counts 0; a null text is an empty document; repeated rows are
separate documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabiya.llm.common import table, written
from tabiya.llm.tokens import encoded, vocabulary_path

#: The vocabulary's end-of-text id, which no text's own ids contain; ids in a block; bytes of an id.
SEPARATOR, BLOCK_IDS, DTYPE = 50_256, 1 << 17, "<u2"
RUN = 4096


def flat_table(docs: DataFrame, path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Documents tokenised into one flat file for each task. Rows either have `ids` (a block) or `doc_ids` (the names
    of the file's documents from `block` on, which the scan doesn't read)."""
    path = path or vocabulary_path()
    schema = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, block, named, held, bytes_held = TaskContext.get().partitionId(), 0, 0, [], 0
        end, full = np.array([SEPARATOR], DTYPE).tobytes(), block_ids * np.dtype(DTYPE).itemsize
        row = lambda number, ids, names: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((file, number, ids, names), schema, strict=True)], schema=schema)
        for batch in batches:
            for ids in encoded(batch.column(1).to_pylist(), path):
                held += [narrowed(np.frombuffer(ids, "<u4")), end]
                bytes_held += len(held[-2]) + len(end)
                if bytes_held >= full:
                    joined, at = b"".join(held), 0
                    while len(joined) - at >= full:
                        yield row(block, joined[at : at + full], None)
                        at, block = at + full, block + 1
                    held, bytes_held = [joined[at:]], len(joined) - at
            yield row(named, None, batch.column(0).to_pylist())
            named += batch.num_rows
        if bytes_held:
            yield row(block, b"".join(held), None)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file int, block long, ids binary, doc_ids array<long>")


def narrowed(ids: np.ndarray) -> bytes:
    """The ids in the files' width."""
    if len(ids) and ids.max() > np.iinfo(DTYPE).max:
        raise ValueError(f"token id {ids.max()} does not fit in {DTYPE}")
    return ids.astype(DTYPE).tobytes()


def flat_files(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, dtype: str = DTYPE, blocks_a_task: int = 64) -> DataFrame:
    """Real flat files as (file, block, ids). Sizes come from a listing; the ranges are dealt over tasks, which read
    them from the shared path by Arrow's file systems."""
    width = block_ids * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select(F.col("path").alias("file"), "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {width})")).alias("block"))
    tasks = max(1, files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / width)), F.lit(0)).alias("n")).first()["n"] // blocks_a_task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, length, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, inside = fs.FileSystem.from_uri(file)
                with store.open_input_file(inside) as opened:
                    ids = opened.read_at(min(width, length - block * width), block * width)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([ids], pa.binary())], names=["file", "block", "ids"])

    return ranges.repartition(int(tasks), "file", "block").mapInArrow(run, "file string, block long, ids binary")


def scan(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """file, ordinal (from 0), n_tokens (without the separator) and ended, for each document of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(ids), np.flatnonzero(ids == separator)) for ids in (np.frombuffer(b or b"", dtype) for b in batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([len(at) for _, at in found], pa.int64()),
                    pa.array([int(at[0]) if len(at) else n for n, at in found], pa.int64()), pa.array([n - int(at[-1]) - 1 if len(at) else n for n, at in found], pa.int64()),
                    pa.array([(np.diff(at) - 1).tolist() for _, at in found], pa.list_(pa.int64())),
                ],
                names=["file", "block", "n", "separators", "lead", "tail", "between"],
            )

    kind = blocks.schema["file"].dataType.simpleString()
    found = blocks.select("file", F.col("block").cast("long"), "ids").mapInArrow(run, f"file {kind}, block long, n long, separators long, lead long, tail long, between array<long>")
    found = written(found, "scanned")
    numbers = found.select("file", "block", "n", "separators", "tail", F.floor(F.col("block") / RUN).alias("run"))
    inside, over_runs = Window.partitionBy("file", "run").orderBy("block"), Window.partitionBy("file").orderBy("run")
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda name, window: F.coalesce(F.sum(name).over(before(window)), F.lit(0))
    # Places are counted from the run's beginning first; `past` is the one behind the last separator.
    local = numbers.withColumn("in_run", running("n", inside)).withColumn("docs_in_run", running("separators", inside))
    local = local.withColumn("past", F.when(F.col("separators") > 0, F.col("in_run") + F.col("n") - F.col("tail")))
    local = local.withColumn("opened_in_run", F.last("past", ignorenulls=True).over(before(inside))).withColumn("ends_run", F.lead("block").over(inside).isNull())
    runs = local.groupBy("file", "run").agg(F.sum("n").alias("run_n"), F.sum("separators").alias("run_separators"), F.max("past").alias("run_past"))
    runs = runs.withColumn("run_start", running("run_n", over_runs)).withColumn("run_first", running("run_separators", over_runs))
    runs = runs.withColumn("run_opened", F.coalesce(F.last(F.col("run_start") + F.col("run_past"), ignorenulls=True).over(before(over_runs)), F.lit(0))).withColumn("last_run", F.lead("run").over(over_runs).isNull())
    placed = local.join(runs.select("file", "run", "run_start", "run_first", "run_opened", "last_run"), ["file", "run"]).select(
        "file", "block", (F.col("run_start") + F.col("in_run")).alias("start"), (F.col("run_first") + F.col("docs_in_run")).alias("first"), (F.col("run_start") + F.col("past")).alias("past"),
        F.coalesce(F.col("run_start") + F.col("opened_in_run"), "run_opened").alias("opened"), (F.col("ends_run") & F.col("last_run")).alias("is_last"),
    )
    placed = found.select("file", "block", "n", "separators", "lead", "between").join(placed, ["file", "block"])
    end = F.col("start") + F.col("n")
    open_at_end = end - F.coalesce("past", "opened")
    entry = lambda n, ended: F.struct(n.alias("n"), F.lit(ended).alias("ended"))
    nothing = F.array().cast("array<struct<n:bigint,ended:boolean>>")
    ended = F.when(F.col("separators") > 0, F.concat(F.array(entry(F.col("start") + F.col("lead") - F.col("opened"), True)), F.transform("between", lambda n: entry(n, True))))
    last = F.when(F.col("is_last") & (open_at_end > 0), F.array(entry(open_at_end, False)))
    docs = placed.select("file", "first", F.posexplode(F.concat(F.coalesce(ended, nothing), F.coalesce(last, nothing))).alias("at", "d"))
    return docs.select("file", (F.col("first") + F.col("at")).alias("ordinal"), F.col("d.n").alias("n_tokens"), F.col("d.ended").alias("ended"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat files written from all documents, scanned, and the counts given their documents' ids back."""
    flat = written(flat_table(table(spark, sf_dir, "documents").select("doc_id", "text")), "flat")
    counted = scan(flat.where("ids IS NOT NULL").select("file", "block", "ids"))
    names = flat.where("doc_ids IS NOT NULL").select("file", "block", F.posexplode("doc_ids").alias("at", "doc_id"))
    names = names.select("file", (F.col("block") + F.col("at")).alias("ordinal"), "doc_id")
    return counted.join(names, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
