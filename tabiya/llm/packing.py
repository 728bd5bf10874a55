"""Hierarchical packing of documents into sequences of several context sizes.

A document is its token ids and a final id 0. Whole windows of the longest size are sequences by themselves. What
remains of a document (shorter than a window) is routed to the smallest context size that holds it. Remainders of the
longest tier open a window each; the gaps they leave are filled, to the last token, from the shorter tiers, shortest
first, cutting where a gap ends. What the gaps don't need is packed into windows of its own tier, each tier's last
unfilled window passing on to the next longer tier. Where the shorter tiers can't fill all gaps, only the longest
remainders open windows, as many as all the tokens need, and the others fill them. So at most a few sequences of the
whole corpus are padded. Sequences of a tier are dealt into steps of equally many tokens.

How it scales: tokenising is the one pass over the texts. It writes, for each document, the checksums of its whole
windows, and the ids of its remainder, with the remainder's rank among those of equal length in its task. The counts
by task and length turn these into ranks over the corpus. Everything else follows from the number of remainders of
each length, at most 1,023 numbers: where a remainder stands on the line of all fillers, and which gap is there, is
arithmetic in the second pass, which neither sorts nor groups documents.

Defined results: a null or empty text is the one id 0; repeated rows are separate documents; a null doc_id stays null;
a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabiya.llm.common import table, written
from tabiya.llm.tokens import encoded, vocabulary_path

#: Context sizes, powers of two, shortest first. Tokens in a step. Rows of the rank table that may be broadcast.
TIERS, STEP_TOKENS, BROADCAST_RANKS = (256, 512, 1024), 8192, 500_000
END = b"\0\0\0\0"


def tokenised(docs: DataFrame, path: str, size: int) -> DataFrame:
    """One row for each document, with what the second pass needs of it."""
    schema = "part int, doc_id long, doc_tokens long, full_before long, full_crcs array<long>, rest int, rest_rank long, rest_crc long, rest_ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, full_before, ranks = TaskContext.get().partitionId(), 0, [0] * size
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), path), strict=True):
                ids += END
                n = len(ids) // 4
                full = n // size
                crcs = [zlib.crc32(ids[k * 4 * size : (k + 1) * 4 * size]) for k in range(full)]
                rest = ids[full * 4 * size :]
                length = n - full * size
                out.append((part, doc_id, n, full_before, crcs, length, ranks[length], zlib.crc32(rest), rest))
                full_before += full
                ranks[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TOKENISED, strict=True)], names=NAMES) if out else EMPTY

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


TOKENISED = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.binary())
NAMES = ["part", "doc_id", "doc_tokens", "full_before", "full_crcs", "rest", "rest_rank", "rest_crc", "rest_ids"]
EMPTY = pa.RecordBatch.from_arrays([pa.array([], t) for t in TOKENISED], names=NAMES)


@dataclass(frozen=True)
class Layout:
    """Where everything goes, from the number of remainders of each length."""

    tiers: tuple[int, ...]
    n_full: int
    hosts: np.ndarray  #: by length: how many remainders open a window
    host_base: np.ndarray  #: by length: windows opened by longer remainders
    line_base: np.ndarray  #: by length: where its first filler stands on the line of all fillers
    gap_start: np.ndarray  #: by host length, longest first: where its first gap stands on that line
    gap_length: np.ndarray  #: the host length belonging to it
    gaps: int  #: tokens in all gaps
    tier_start: tuple[int, ...]  #: by shorter tier: where its windows begin on the line
    tier_first: tuple[int, ...]  #: by shorter tier: number of its first sequence

    @property
    def size(self) -> int:
        return self.tiers[-1]

    @staticmethod
    def of(counts: dict[int, int], n_full: int, tiers: tuple[int, ...]) -> Layout:
        size, short = tiers[-1], tiers[-2]
        n = np.zeros(size, np.int64)
        for length, many in counts.items():
            n[length] = many
        lengths = np.arange(size)
        tokens, hosts = n * lengths, np.where(lengths > short, n, 0)
        if (hosts * (size - lengths)).sum() > tokens[: short + 1].sum():  # too few fillers: fewer windows
            windows = -(-int(tokens.sum()) // size)
            longer = np.concatenate([np.cumsum(n[::-1])[::-1][1:], [0]])
            hosts = np.clip(windows - longer, 0, n)
        fillers = (n - hosts) * lengths
        descending = [int(k) for k in lengths[::-1] if hosts[k]]
        gap = np.array([hosts[k] * (size - k) for k in descending], np.int64)
        gap_start = np.concatenate([[0], np.cumsum(gap)]).astype(np.int64)
        at, first, starts, firsts = min(int(gap_start[-1]), int(fillers.sum())), n_full + int(hosts.sum()), [], []
        for tier in tiers[:-1]:
            starts.append(at)
            firsts.append(first)
            region = int(fillers.sum()) if tier == short else int(fillers[: tier + 1].sum())
            windows = max(0, region - at) // tier if tier != short else -(-max(0, region - at) // tier)
            at, first = at + windows * tier, first + windows
        return Layout(
            tiers, n_full, hosts, np.cumsum(hosts[::-1])[::-1] - hosts, np.cumsum(fillers) - fillers, gap_start, np.array(descending, np.int64), int(gap_start[-1]), tuple(starts), tuple(firsts)
        )

    def at(self, x: int) -> tuple[int, int, int, int]:
        """For a place on the line of fillers: sequence, offset in it, context size, tokens to the end of the gap."""
        if x < self.gaps:
            k = int(np.searchsorted(self.gap_start, x, "right")) - 1
            length = int(self.gap_length[k])
            host, inside = divmod(x - int(self.gap_start[k]), self.size - length)
            return self.n_full + int(self.host_base[length]) + host, length + inside, self.size, self.size - length - inside
        k = len(self.tier_start) - 1
        while x < self.tier_start[k]:
            k -= 1
        window, inside = divmod(x - self.tier_start[k], self.tiers[k])
        return self.tier_first[k] + window, inside, self.tiers[k], self.tiers[k] - inside

    def rest(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Pieces of the remainder of this length and rank: from, length, sequence, offset, context size."""
        if rank < self.hosts[length]:
            yield 0, length, self.n_full + int(self.host_base[length]) + rank, 0, self.size
            return
        x, done = int(self.line_base[length]) + (rank - int(self.hosts[length])) * length, 0
        while done < length:
            sequence, offset, tier, room = self.at(x + done)
            taken = min(room, length - done)
            yield done, taken, sequence, offset, tier
            done += taken

    def step(self, sequence: int, tier: int) -> int:
        """Sequences of one context size are dealt into steps of equally many tokens, steps numbered by size."""
        first = 0 if tier == self.size else self.tier_first[self.tiers.index(tier)]
        return (sequence - first) // max(1, STEP_TOKENS // tier)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context_size int, step long"
PIECE_TYPES = (pa.int64(),) * 7 + (pa.int32(), pa.int64())


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """The pieces of all documents: which span of which document stands where in which sequence."""
    size = tiers[-1]
    rows = written(tokenised(docs, path or vocabulary_path(), size), "tokens")
    counts = written(rows.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.size("full_crcs")).alias("full")), "rest-counts")
    by_length = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    n_full = counts.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("n")).first()["n"]
    by_length.pop(0, None)
    layout = rows.sparkSession.sparkContext.broadcast(Layout.of(by_length, n_full, tiers))
    of_length = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("full").alias("full"))
    parts = parts.select("part", F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("full_offset"))
    ranks = counts.select("part", "rest", F.coalesce(F.sum("n").over(of_length), F.lit(0)).alias("rank_offset"))
    few = F.broadcast if counts.count() <= BROADCAST_RANKS else (lambda frame: frame)
    ranked = rows.join(few(ranks.join(parts, "part")), ["part", "rest"])
    columns = ["doc_id", "doc_tokens", "full_crcs", "rest", "rest_crc", "rest_ids", (F.col("full_before") + F.col("full_offset")).alias("full_at"), (F.col("rest_rank") + F.col("rank_offset")).alias("rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Layout = layout.value
        for batch in batches:
            out: list[tuple] = []
            for doc_id, n, crcs, rest, crc, ids, full_at, rank in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for k, full_crc in enumerate(crcs):
                    out.append((doc_id, k * size, size, full_crc, n, full_at + k, 0, size, plan.step(full_at + k, size)))
                for start, taken, sequence, offset, tier in plan.rest(rest, rank) if rest else ():
                    piece = crc if taken == rest else zlib.crc32(ids[4 * start : 4 * (start + taken)])
                    out.append((doc_id, len(crcs) * size + start, taken, piece, n, sequence, offset, tier, plan.step(sequence, tier)))
            names = [c.split()[0] for c in PIECES.split(", ")]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECE_TYPES, strict=True)], names=names)

    return ranked.select(*columns).mapInArrow(run, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
