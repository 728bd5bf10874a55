"""WARC archives: pages written as records, and a sequential reader of such files.

An archive is a file with one gzip member for each record. A task reads one from its start to its end, in pieces of
bounded size: zlib inflates incrementally, a member's end is a record's end, `Content-Length` says how long the block
is, and what follows it must be the two empty lines of the format. Digests of block and payload are computed as the
bytes pass and compared with those that the record names. What is wrong with a record is its `error`; after a damaged
member the reader goes on at the next that can be inflated, so one bad record costs no others.

Payloads that occur several times are stored once: of equal ones the last page's record is the response, the others
are revisits that refer to it (profile identical-payload-digest) and hold its HTTP header only. Who refers to whom is
an aggregation by digest, in which copies are combined before the shuffle; payloads are shuffled only where there are
too many groups of copies to broadcast. Tasks write files of their own with names of their own in the shared folder; a
file counts if it is in the manifest, so a task that runs twice leaves no record twice.

Defined results: a null payload is an empty one; a null url has no target line; blanks and control characters of a url
are percent-encoded; null page ids come after all others; of repeated rows one is the response; an empty table gives no
records, and no files; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import table, written
from tabiya.sources.shared import new_path

#: Payloads shorter than this are always stored; compressed bytes of an archive; bytes read at a time; longest header.
LEAST_SHARED, ARCHIVE_BYTES, PIECE, LONGEST_HEADER = 1000, 256 << 20, 1 << 18, 1 << 20
DATE, ID = "2024-01-01T00:00:00Z", "urn:x-page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _GZIP = b"\r\n\r\n", b"\x1f\x8b\x08"
RECORDS = "file string, offset long, type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def bare(label: str | None) -> str | None:
    """A digest line's SHA-1 in lower-case hex; None if it isn't one."""
    name, _, value = (label or "").partition(":")
    if name.strip().lower() != "sha1":
        return None
    value = value.strip()
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def encoded_uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(kind: str, record_id: str, block: bytes, content_type: str, **more: str | None) -> bytes:
    """A record as one gzip member; `more` gives further lines, `_` for `-` in their names."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, **{n.replace("_", "-"): v for n, v in more.items() if v is not None}}
    lines |= {"WARC-Block-Digest": labelled(hashlib.sha1(block).digest()), "Content-Type": content_type, "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in lines.items()) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode()) + deflate.compress(block) + deflate.compress(_END) + deflate.flush()


def page_record(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    about = {"WARC_Target_URI": None if url is None else encoded_uri(url), "WARC_Payload_Digest": labelled(hashlib.sha1(payload).digest())}
    if refers_to is None:
        return record("response", record_id, http + payload, "application/http; msgtype=response", **about)
    return record("revisit", record_id, http, "application/http; msgtype=response", WARC_Refers_To=f"<{refers_to}>", WARC_Profile=REVISIT_PROFILE, **about)


# Writing


def page_id_of(record_id: Column) -> Column:
    return F.substring_index(record_id, ":", -1).try_cast("long")


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """record_id, url, payload and refers_to (the record of an equal payload that is stored, else null)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = plain.select("*", F.monotonically_increasing_id().alias("row"), F.sha2("payload", 256).alias("digest"), F.length("payload").alias("size"))
    rows = written(rows, "pages")  # from here on a row's number is fixed
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("top"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1").select("digest", "top"), "copies")
    record_id = lambda row, page: F.concat(F.lit(ID), row.cast("string"), F.lit(":"), F.coalesce(page.cast("string"), F.lit("")))
    refers = F.when(F.col("top.row") != F.col("row"), record_id(F.col("top.row"), F.col("top.page_id")))
    return rows.join(groups, "digest", "left").select(record_id(F.col("row"), F.col("page_id")).alias("record_id"), "url", "payload", refers.alias("refers_to"))


def write(rows: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of record_id, url, payload and refers_to in a folder that all tasks reach; the manifest (file, records,
    bytes) is returned."""
    folder = folder or new_path(rows.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out, path, records, size = None, "", 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])
        store, inside = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        try:
            for batch in batches:
                for record_id, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if out is None:
                        store.create_dir(inside, recursive=True)
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out, path, records = store.open_output_stream(f"{inside}/{name}", compression=None), f"{folder}/{name}", 0
                        size = out.write(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", "application/warc-fields"))
                    size += out.write(page_record(record_id, url, payload, refers_to))
                    records += 1
                    if size >= archive_bytes:
                        out.close()
                        yield row()
                        out = None
            if out is not None:
                out.close()
                yield row()
                out = None
        finally:
            if out is not None:
                out.close()

    return written(rows.select("record_id", "url", "payload", "refers_to").mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


# Reading


@dataclass
class Record:
    """A record while its bytes pass; `keep`: whether its payload is kept."""

    offset: int
    keep: bool
    lines: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    errors: list[str] = field(default_factory=list)

    def __post_init__(self):
        self._head, self._http_head, self._rest, self._payload = b"", None, b"", []
        self._left = -1  # bytes of the block to come; -1 before it begins
        self._block, self._digest = hashlib.sha1(), hashlib.sha1()

    @staticmethod
    def _lines(head: bytes) -> tuple[str, dict[str, str]]:
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        return first, {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines if ":" in line)}

    def feed(self, data: bytes) -> None:
        if self._left < 0:
            self._head += data
            end = self._head.find(_END)
            if end < 0:
                if len(self._head) > LONGEST_HEADER:
                    raise ValueError("no end of the header")
                return
            version, self.lines = self._lines(self._head[:end])
            if not version.startswith("WARC/"):
                raise ValueError("no WARC header")
            length = self.lines.get("content-length", "")
            if not length.isdecimal():
                raise ValueError("no content length")
            data, self._head, self._left = self._head[end + 4 :], b"", int(length)
            self._http_head = b"" if self.lines.get("content-type", "").startswith("application/http") else None
        block, more = data[: self._left], data[self._left :]
        self._left -= len(block)
        self._rest += more[: 5 - len(self._rest)]  # four bytes end a record; one more is too many
        if block:
            self._block.update(block)
            self._take(block)

    def _take(self, block: bytes) -> None:
        if self._http_head is not None:
            self._http_head += block
            end = self._http_head.find(_END)
            if end < 0:
                return
            self.http, block, self._http_head = self._lines(self._http_head[:end])[1], self._http_head[end + 4 :], None
        self.payload_bytes += len(block)
        self._digest.update(block)
        if self.keep:
            self._payload.append(block)

    def finish(self) -> Record:
        if self._left != 0:
            raise ValueError("the block is shorter than its content length" if self._left > 0 else "no end of the header")
        if self._rest != _END:
            self.errors.append("the record does not end after its block")
        if (named := self.lines.get("warc-block-digest")) and bare(named) not in (None, self._block.hexdigest()):
            self.errors.append("block digest differs")
        named = bare(self.lines.get("warc-payload-digest"))
        if self.type == "revisit":  # its payload is another record's, of which it has digest and HTTP header
            length = self.http.get("content-length", "")
            self.payload_bytes = int(length) if length.isdecimal() else 0
            self.payload_digest, self._payload = named, None
        else:
            self.payload_digest = self._digest.hexdigest()
            if named not in (None, self.payload_digest):
                self.errors.append("payload digest differs")
        return self

    @property
    def type(self) -> str | None:
        return self.lines.get("warc-type")

    def row(self) -> tuple:
        of = lambda name: None if (value := self.lines.get(name)) is None else value.removeprefix("<").removesuffix(">")
        payload = b"".join(self._payload) if self.keep and self._payload is not None else None
        return self.offset, self.type, of("warc-record-id"), self.lines.get("warc-target-uri"), of("warc-refers-to"), self.payload_bytes, self.payload_digest, payload, "; ".join(self.errors) or None


def records(archive: BinaryIO, keep: bool = True, piece: int = PIECE) -> Iterator[tuple]:
    """The records of an archive in order, as tuples of RECORDS without the file. A member that can't be read gives one
    with nothing but its offset and the error."""
    held, at, over = b"", 0, False

    def more() -> bool:
        nonlocal held, over
        read = b"" if over else archive.read(piece)
        over = over or not read
        held += read
        return bool(read)

    while held or more():
        start, record, inflate = at, Record(at, keep), zlib.decompressobj(wbits=31)
        try:
            while not inflate.eof:
                there = bool(held) or more()
                given = held
                out = inflate.decompress(given, 4 * piece)
                held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                at += len(given) - len(held)
                record.feed(out)
                if not (there or out or inflate.eof):
                    raise ValueError("the archive ends inside a record")
            yield record.finish().row()
        except (zlib.error, ValueError) as wrong:
            yield start, None, None, None, None, None, None, None, f"unreadable record: {wrong}"
            if inflate.eof:
                continue  # the member itself is whole
            if start == at and held:  # not this beginning again
                held, at = held[1:], at + 1
            while (found := held.find(_GZIP)) < 0:
                at, held = at + max(0, len(held) - 2), held[-2:]
                if not more():
                    held = b""
                    break
            if held:
                held, at = held[found:], at + found


def read(files: DataFrame, keep: bool = True) -> DataFrame:
    """RECORDS of archives: `files` has a row with its `file` for each. Archives are dealt over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        names = [c.split()[0] for c in RECORDS.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, inside = fs.FileSystem.from_uri(file if "://" in file else f"file://{file}")
                held, size = [], 0
                with store.open_input_stream(inside, compression=None) as archive:
                    for found in records(archive, keep):
                        held.append((file, *found))
                        size += 200 + len(found[7] or b"")
                        if size > 4 << 20:
                            yield made(held)
                            held, size = [], 0
                if held:
                    yield made(held)

    paths = files.select("file")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, RECORDS)


def resolved(found: DataFrame) -> DataFrame:
    """Records with the payloads of revisits, taken from the records that they refer to (null where there is none)."""
    stored = found.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload").alias("_stored"), F.col("payload_digest").alias("_digest"))
    joined = found.where("type = 'revisit'").join(stored, "refers_to", "left")
    theirs = F.when(F.col("_digest") == F.col("payload_digest"), F.col("_stored"))
    return found.where("type <> 'revisit' OR type IS NULL").unionByName(joined.select(*[theirs.alias(c) if c == "payload" else F.col(c) for c in found.columns]))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; a record with an error stops the query."""
    found = read(write(with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"))), keep=False)
    sound = found.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "file", "error")).cast("boolean")).otherwise(F.col("type") != "warcinfo"))
    return sound.select(
        page_id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_id_of(F.col("refers_to")).alias("refers_to"),
    )


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, sha256(h) AS k FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page_id DESC NULLS LAST) AS nth, max(page_id) OVER (PARTITION BY k) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 1000 OR nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND nth > 1 THEN top END AS refers_to
FROM r
"""
