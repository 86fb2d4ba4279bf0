"""WARC archives: a writer with revisit records and a reader that salvages.

*Writing.*  Each task writes gzip archives, one member a record, into the shared
folder through Arrow's file systems, and returns the names of its files; only
files that a finished task has named are read, so a task that is run again does
no harm.  Of equal payloads one record is a response and the others revisit it.

*Reading.*  A record passes if its member decompresses, its version line and
headers parse, its block has the length and end that it states, and block and
payload have the digests (SHA-1) that are stated.  After a failure the reader looks for the next place
where a gzip member or a version line begins a record that passes, goes on
there, and reports the bytes between as a quarantined gap.  A member may hold
several records; of one that breaks off, those that passed and were followed by
another are kept (damage shows there by digests alone).  One pass over the archives yields records and gaps, as two
kinds of rows of one table.

*Foreign archives.*  Records of any type are read (warcinfo, request, metadata and
others as much as response and revisit), without a digest or with one of another
kind, and with ids of any form: a page id is known only from ids of our form.

Defined cases.  A null payload is empty; null urls are written without target.
Of equal payloads of at least ``least`` bytes the row with the largest
``page_id`` is the response; of repeated rows with that id, one.  A null id
counts as the smallest.  Record ids are made of page id, payload digest and, for
repeated rows, a number, so they differ.  Pages have no date of their own, so all
records have the one given.  Payloads may hold version lines or gzip magic.  Headers
(urls are among them) and payloads of any length are read; a block longer than
``HELD_BYTES`` passes by under running digests, and the reader goes back to its
begin if a check fails.  An empty table writes no archive.  Other columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import parallelism, scratch, small_batches, table, text_of, written

VERSION = b"WARC/1.1\r\n"
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 64 << 20
#: What the reader fetches at a time, the longest block that it holds whole, and the longest name of a header.
CHUNK, HELD_BYTES, NAME_BYTES = 1 << 20, 1 << 26, 256
SALTS = 62
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def base32_sha1(payload: bytes) -> str:
    return base32_of(hashlib.sha1(payload))


def record_id(page_id: int | None, digest: str, copy: int = 1) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{f':{copy}' if copy > 1 else ''}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, copy: int = 1, date: str = DATE) -> bytes:
    """One record, uncompressed.  A revisit has the HTTP header alone, with the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, digest = head if revisit else head + payload, base32_sha1(payload)
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    """``block`` is None where it is longer than ``HELD_BYTES``; the rest is known of all."""

    offset: int
    headers: dict[str, str]
    block: bytes | None
    head: bytes
    payload_bytes: int
    payload_digest: str
    length: int


@dataclass
class Gap:
    """Bytes that no record could be read from."""

    start: int
    end: int
    reason: str


class Malformed(ValueError):
    pass


class Broken(Malformed):
    """A member that doesn't decompress to its end."""


class _Ahead:
    """A source that can seek, seen through a buffer that only moves on."""

    def __init__(self, source, length: int | None = None):
        self.source, self.length, self.base, self.data, self.ended = source, length, 0, bytearray(), False

    def fetch(self) -> bool:
        if not self.ended:
            self.source.seek(self.base + len(self.data))
            more = self.source.read(CHUNK)
            self.ended = not more
            self.data += more
        return not self.ended

    def has(self, n: int) -> bool:
        while len(self.data) < n and self.fetch():
            pass
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        """Moves on, past the buffer too."""
        if n > len(self.data):
            self.ended = False
        self.base += n
        del self.data[:n]

    def view(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from a position, from the buffer, or past it once that is long; none at the end."""
        i = at - self.base
        if 0 <= i <= len(self.data):
            if i == len(self.data) < HELD_BYTES:
                self.fetch()
            if i < len(self.data):
                return bytes(self.data[i : i + n])
        self.source.seek(at)
        return self.source.read(n)


def _headers(ahead: _Ahead) -> tuple[dict[str, str], int]:
    """Headers after the version line, and where the block begins.  Values have no bound; what isn't a header line is refused at once."""
    headers, at, seen = {}, 10, 10
    while True:
        end = ahead.data.find(b"\r\n", seen)
        if end == at:
            return headers, end + 2
        begin = ahead.data[at : end if end >= 0 else len(ahead.data)][: NAME_BYTES + 2]
        if not (named := re.match(rb"([^\x00-\x20\x7f:]+)[ \t]*:", begin)) and (end >= 0 or len(begin) > NAME_BYTES):
            raise Malformed("a header without colon")
        if end < 0:
            seen = max(at, len(ahead.data) - 1)
            if not ahead.fetch():
                raise Malformed("headers without end")
            continue
        headers[named[1].decode("latin-1").lower()] = bytes(ahead.data[at + named.end() : end]).strip().decode("utf-8", "replace")
        at = seen = end + 2


def parse(ahead: _Ahead) -> Record:
    """The record at the buffer's start.  A block up to ``HELD_BYTES`` is held, a longer one only passes by."""
    if not re.match(rb"WARC/\d\.\d\r\n", ahead.data[:10]):
        raise Malformed("no version line")
    headers, begin = _headers(ahead)
    stated = headers.get("content-length", "")
    if not stated.isascii() or not stated.isdigit() or len(stated) > 18:
        raise Malformed("no valid length")
    size = int(stated)
    stop = begin + size
    unended = Malformed("the block doesn't end where it should")
    if ahead.length is not None and ahead.base + stop + 4 > ahead.length:
        raise unended
    held = size <= HELD_BYTES
    if held:
        ahead.has(stop + 4)
        if ahead.data[stop : stop + 4] != b"\r\n\r\n":
            raise unended
    whole, payload, head, payload_bytes, found = hashlib.sha1(), hashlib.sha1(), bytearray(), 0, False
    at, left = ahead.base + begin, size
    while left:
        piece = ahead.view(at, min(CHUNK, left))
        if not piece:
            raise unended
        at, left = at + len(piece), left - len(piece)
        whole.update(piece)
        if not found and len(head) <= HELD_BYTES:
            head += piece
            if found := (cut := head.find(b"\r\n\r\n", max(0, len(head) - len(piece) - 3))) >= 0:
                piece = bytes(head[cut + 4 :])
                del head[cut:]
        if found:
            payload.update(piece)
            payload_bytes += len(piece)
    if not held:
        end = b""
        while len(end) < 4 and (piece := ahead.view(at + len(end), 4 - len(end))):
            end += piece
        if end != b"\r\n\r\n":
            raise unended
    if (digest := headers.get("warc-block-digest", "")).startswith("sha1:") and base32_of(whole) != digest[5:]:
        raise Malformed("the block has another digest")
    if headers.get("warc-type") == "response" and (digest := headers.get("warc-payload-digest", "")).startswith("sha1:"):
        if base32_of(payload) != digest[5:]:
            raise Malformed("the payload has another digest")
    return Record(ahead.base, headers, bytes(ahead.data[begin:stop]) if held else None, bytes(head), payload_bytes, base32_of(payload), stop + 4)


class _Member:
    """What the gzip member at a buffer's start decompresses to; going back begins it anew."""

    def __init__(self, outer: _Ahead):
        self.outer, self.start = outer, outer.base
        self.restart()

    def restart(self) -> None:
        self.unzip, self.fed, self.at = zlib.decompressobj(31), self.start, 0

    def read(self, n: int) -> bytes:
        while not self.unzip.eof:
            piece = self.unzip.unconsumed_tail
            if not piece:
                piece = self.outer.view(self.fed, CHUNK)
                if not piece:
                    raise Broken("a member without end")
                self.fed += len(piece)
            try:
                out = self.unzip.decompress(piece, n)
            except zlib.error as error:
                raise Broken(f"a broken member: {error}") from None
            if out:
                self.at += len(out)
                return out
        return b""

    def seek(self, at: int) -> None:
        if at < self.at:
            self.restart()
        while self.at < at and self.read(min(CHUNK, at - self.at)):
            pass

    def position(self) -> int:
        """How far the archive is read; at a member's end what is left over is in both of the tails."""
        return self.fed - len(self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail)


def _member(ahead: _Ahead) -> Iterator[Record | Gap]:
    """Records and gaps in the member at the buffer's start, which is dropped as its records pass."""
    member, begin = _Member(ahead), ahead.base
    inner, held, start, reason, at = _Ahead(member), None, None, "", begin

    def lost() -> Gap:
        return Gap(begin, member.position(), f"bytes {start} to {inner.base} of a member's content: {reason}")

    while inner.has(1):
        try:
            inner.has(10)
            found = parse(inner)
        except Broken:
            raise
        except Malformed as error:
            if start is None:
                start, reason = inner.base, str(error)
            inner.drop(1)
            _skip(inner, rb"WARC/\d")
            continue
        if held is not None:
            # What is surely read needs no second look.
            ahead.drop(at - ahead.base)
            yield held
        if start is not None:
            yield lost()
            start = None
        held, found.offset, at = found, begin, member.position()
        inner.drop(found.length)
    # The member is whole: its checksum was checked at its end.
    last = None if start is None else lost()
    ahead.drop(member.position() - ahead.base)
    yield from (x for x in (held, last) if x is not None)


def _plain(ahead: _Ahead) -> Iterator[Record]:
    found = parse(ahead)
    ahead.drop(found.length)
    yield found


def read(file: io.RawIOBase) -> Iterator[Record | Gap]:
    """Records of an archive (which can seek), compressed by member or plain, and the gaps between them."""
    ahead, start, reason = _Ahead(file, file.seek(0, io.SEEK_END)), None, ""
    while ahead.has(1):
        ahead.has(10)
        try:
            if ahead.data[:3] == b"\x1f\x8b\x08":
                found = _member(ahead)
            elif ahead.data[:5] == b"WARC/":
                found = _plain(ahead)
            else:
                raise Malformed("neither a member nor a version line")
            before = ahead.base
            item = next(found, None)
            if start is not None:
                yield Gap(start, before, reason)
                start = None
            if item is not None:
                yield item
                yield from found
        except Malformed as error:
            if start is None:
                start, reason = ahead.base, str(error)
            ahead.drop(1)
            _skip(ahead)
    if start is not None:
        yield Gap(start, ahead.base, reason)


def _skip(ahead: _Ahead, begins: bytes = rb"\x1f\x8b\x08|WARC/\d") -> None:
    """Drop bytes up to the next place where a record may begin."""
    while True:
        found = re.search(begins, ahead.data)
        if found:
            ahead.drop(found.start())
            return
        ahead.drop(max(0, len(ahead.data) - 5))  # a beginning may be cut by the buffer's end
        if not ahead.fetch():
            ahead.drop(len(ahead.data))
            return


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html, keeper, revisit, copy``: which page answers for each payload; ``copy`` counts repeated rows.

    Payloads become digests before anything is grouped; a digest's keeper goes to
    its pages by salt, so a payload that a third of all pages share is dealt out.
    """
    html = F.encode(text_of("html"), "UTF-8")
    sigs = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("size"))
    sigs = sigs.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    groups = sigs.groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.max("size").alias("size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")
    )
    groups = groups.withColumn("salt", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> shiftright(salts, i) & 1L = 1L)"))).select("digest", "salt", "keeper")
    answers = sigs.join(groups, ["digest", "salt"]).select("page_id", "digest", "keeper", (F.col("size") >= least).alias("shared")).distinct()
    # Joined by a key that is never null, so that the window below needs no other shuffle of the texts.
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    answers = answers.select(key.alias("key"), "digest", "keeper", "shared")
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of("html").alias("html"), F.unhex(F.sha1(html)).alias("digest"))
    joined = given.withColumn("key", key).join(answers, ["key", "digest"])
    first = F.row_number().over(Window.partitionBy("key", "digest").orderBy("url"))
    revisit = F.col("shared") & ~(F.col("page_id").eqNullSafe(F.col("keeper")) & (first == 1))
    return joined.withColumns({"revisit": revisit, "copy": first}).select("page_id", "url", "html", "keeper", "revisit", "copy")


def write(assigned: DataFrame, folder: str, most: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """``path, n_records, n_bytes`` of the archives written, one or more a task."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        context, out, name, seq, n, size = TaskContext.get(), None, "", 0, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])

        for batch in batches:
            for page_id, url, html, keeper, revisit, copy in zip(*(batch.column(i) for i in range(6)), strict=True):
                if out is None:
                    name, n, size = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{seq:03d}.warc.gz", 0, 0
                    # Else the name's suffix would have the stream compressed as a whole once more.
                    out, seq = store.open_output_stream(f"{root}/{name}", compression=None), seq + 1
                data = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), keeper.as_py(), revisit.as_py(), copy.as_py(), date)
                data = gzip.compress(data, 6, mtime=0)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= most:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return assigned.mapInArrow(run, "path string, n_records long, n_bytes long")


#: What a pass over archives yields: for a record what its headers say, for a gap where it is and why.
ITEM = (
    "kind string, path string, start long, end long, reason string, record_id string, record_type string, target string, "
    "payload_digest string, payload_bytes long, page_id long, refers_to long"
)
_NAMES = [c.split()[0] for c in ITEM.split(", ")]
_TYPES = [pa.int64() if c.endswith("long") else pa.string() for c in ITEM.split(", ")]


def page_of(name: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d{1,19}):", name or "")
    return int(found[1]) if found else None


def described(path: str, item: Record | Gap) -> tuple:
    """A row of ``ITEM``."""
    if isinstance(item, Gap):
        return ("gap", path, item.start, item.end, item.reason, *[None] * 7)
    h = item.headers
    kind, digest = h.get("warc-type"), h.get("warc-payload-digest")
    size = None
    if kind == "response" or kind == "revisit":
        stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,18})", item.head)
        # A revisit's payload is elsewhere; how long it is its HTTP header tells.
        size = item.payload_bytes if kind == "response" else int(stated[1]) if stated else None
    name = h.get("warc-record-id")
    return ("record", path, item.offset, None, None, name, kind, h.get("warc-target-uri"), digest and digest.removeprefix("sha1:"), size, page_of(name), page_of(h.get("warc-refers-to")))


def salvage(manifest: DataFrame, folder: str) -> DataFrame:
    """``ITEM`` rows of every archive in the manifest (a column ``path``), opened where the task runs."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                with store.open_input_file(f"{root}/{path}") as file:
                    for item in read(file):
                        held.append(described(path, item))
                        if len(held) >= 1000:
                            yield _batch(held)
                            held = []
                if held:
                    yield _batch(held)

    n = parallelism(manifest.sparkSession)
    return manifest.select("path").repartition(n, "path").mapInArrow(run, ITEM)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def records(items: DataFrame) -> DataFrame:
    """The records among ``ITEM`` rows."""
    return items.where("kind = 'record'").drop("kind", "end", "reason")


def gaps(items: DataFrame) -> DataFrame:
    """``path, start, end, reason``: the log of quarantined bytes."""
    return items.where("kind = 'gap'").select("path", "start", "end", "reason")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    folder = scratch(spark, "warc")
    manifest = written(write(roles(table(spark, sf_dir, "pages")), folder), "warc-manifest")
    items = written(salvage(manifest, folder), "warc-items")
    # The log of gaps stays in the shared folder beside the archives; these have none unless storage damaged them.
    gaps(items).write.parquet(f"{folder}-gaps")
    found = records(items).where("page_id is not null or record_id like '<urn:page::%'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * i::INT + 1, 5))::INT >> s) & 31), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
