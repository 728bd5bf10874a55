"""Fill-in-middle transformation: each document cut in prefix, middle and suffix, which are put in another order.

Where a document is cut is said in units (code points, or words), which texts don't index. So a text is chunked where a
rolling hash of its last bytes says, and a chunk's summary says what matters of it: how many units begin in it, whether
a sentinel is in it, and its ends, from which units and sentinels across a boundary are told. Summaries combine like
sums: the running counts of a document's chunks say how many units it has and in which chunk a cut falls, and that
chunk alone is looked at closely. Boundaries depend on content, so a passage that many documents share gives the same
chunks in all of them, wherever it stands; a task keeps summaries by content (a look-up compares all bytes, so no two
chunks are ever taken for each other) in a table of bounded size, and looks at each such chunk once.

Where cuts fall is a function of the document's id and a seed: reruns and lost executors change nothing.

Defined results: a null text is an empty one; an empty text, and one that holds a sentinel, stays plain; bytes that are
no UTF-8 count as what their leading bytes say; a null id is hashed as an empty one; equal rows give equal rows; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import SPACES, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Bytes of a chunk at least and at most; a boundary falls on one in 2**BITS places; bytes that the rolling hash sees
#: (a power of two); bytes of chunks that a task keeps.
LEAST, MOST, BITS, WINDOW, KEPT_BYTES = 256, 8192, 10, 16, 48 << 20
_TABLE = np.array([zlib.crc32(bytes([b, b ^ 0x5A])) for b in range(256)], np.uint32)
_BLANK = np.isin(np.arange(256), list(SPACES.encode()))


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of some bytes end. The hash of a place is the sum of its last WINDOW bytes' values, each shifted
    by its distance; it is made for all places at once, by doubling the window."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    hashes, width = _TABLE[data], 1
    while width < WINDOW:
        more = hashes.copy()
        more[width:] += hashes[:-width] << np.uint32(width)
        hashes, width = more, 2 * width
    places = (np.flatnonzero(hashes >> np.uint32(32 - BITS) == 0) + 1).tolist()
    ends, at = [], 0
    while n - at > LEAST:
        i = bisect_right(places, at + LEAST - 1)
        at = min(places[i] if i < len(places) else n, at + MOST, n)
        ends.append(at)
    return ends if at == n else [*ends, n]


def unit_starts(data: np.ndarray, unit: str, inside: bool = False) -> np.ndarray:
    """Where units begin: at all bytes that continue no code point, or at a word's first byte; `inside`: the byte before
    is one of a word."""
    if unit == "point":
        return np.flatnonzero((data & 0xC0) != 0x80)
    word = ~_BLANK[data]
    return np.flatnonzero(word & ~np.concatenate([[inside], word[:-1]])) if len(data) else np.zeros(0, np.int64)


class Summaries(dict):
    """Chunk to (units that begin in it, sentinel in it, first two bytes, last two bytes, begins and ends in a word)."""

    def __init__(self, unit: str = "point"):
        super().__init__()
        self.unit, self.held, self.looked_at = unit, 0, 0

    def __missing__(self, chunk: bytes) -> tuple[int, bool, bytes, bytes, bool, bool]:
        if self.held + len(chunk) > KEPT_BYTES:
            self.clear()
            self.held = 0
        self.held += len(chunk)
        self.looked_at += 1
        data = np.frombuffer(chunk, np.uint8)
        ends = (not _BLANK[data[0]], not _BLANK[data[-1]]) if self.unit == "word" else (False, False)
        found = self[chunk] = (len(unit_starts(data, self.unit)), any(m in chunk for m in _MARKS), chunk[:2], chunk[-2:], *ends)
        return found


class Document:
    """A text by its chunks: how many units it has, whether it holds a sentinel, and where its units begin."""

    def __init__(self, text: bytes, summaries: Summaries):
        self.text, self.unit = text, summaries.unit
        self.ends = chunk_ends(np.frombuffer(text, np.uint8))
        found = [summaries[text[a:b]] for a, b in zip([0, *self.ends], self.ends, strict=False)]
        self.marked, tail, self.inside, counts = False, b"", [False], []
        for units, marked, head, end, opens, closes in found:
            across = tail + head  # four bytes at most: a sentinel has three
            self.marked = self.marked or marked or any(m in across for m in _MARKS)
            tail = (tail + end)[-2:] if len(end) < 2 else end
            counts.append(units - (opens and self.inside[-1]))
            self.inside.append(closes)
        self.before = [0, *accumulate(counts)]
        self.n = self.before[-1]

    def offset(self, units: int) -> int:
        """The place after so many units: where the next begins, or the text ends."""
        if units == 0:
            return 0
        if units >= self.n:
            return len(self.text)
        i = bisect_right(self.before, units) - 1
        start = self.ends[i - 1] if i else 0
        chunk = np.frombuffer(self.text, np.uint8)[start : self.ends[i]]
        return start + int(unit_starts(chunk, self.unit, self.inside[i])[units - self.before[i]])


def choices(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    """The four numbers that decide about a document."""
    hexes = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(hexes[i : i + 8], 16) for i in (0, 8, 16, 24))


def filled(docs: DataFrame, seed: str = "1", changed: int = 90, suffix_first: int = 20, unit: str = "point") -> DataFrame:
    """doc_id, n (units), form (psm, spm or plain), prefix_units, middle_units (null if plain) and output, the text in
    its new order. changed: how many of a hundred documents are reordered; suffix_first: of these in the form spm."""

    def made(doc_id: int | None, text: bytes, summaries: Summaries) -> tuple:
        doc = Document(text, summaries)
        h1, h2, h3, h4 = choices(doc_id, seed)
        if not text or doc.marked or h3 % 100 >= changed:
            return doc.n, "plain", None, None, text
        low, high = sorted((h1 % (doc.n + 1), h2 % (doc.n + 1)))
        a, b = doc.offset(low), doc.offset(high)
        pre, mid, suf = text[:a], text[a:b], text[b:]
        spm = h4 % 100 < suffix_first
        parts = (SUFFIX.encode(), suf, PREFIX.encode(), pre) if spm else (PREFIX.encode(), pre, SUFFIX.encode(), suf)
        return doc.n, "spm" if spm else "psm", low, high - low, b"".join((*parts, MIDDLE.encode(), mid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries(unit)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            out = [made(doc_id, text or b"", summaries) for doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that was made into `output`. No part holds a sentinel, and none can arise where a part meets one."""
    between = lambda low, high: F.substring(output, low, high - low)
    second = lambda mark: F.instr(output, mark)
    middle = F.locate(MIDDLE, output, 1)
    rest = F.substring(output, middle + 3, F.length(output))
    psm = F.concat(between(F.lit(4), second(SUFFIX)), rest, between(second(SUFFIX) + 3, middle))
    spm = F.concat(between(second(PREFIX) + 3, middle), rest, between(F.lit(4), second(PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = filled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, length(t)::BIGINT AS n, [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT FOR i IN range(4)] AS x FROM d),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS low, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS high,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, t[:low] AS pre, t[low + 1:high] AS mid, t[high + 1:] AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
