"""Legacy archive converter: ARC to WARC, and reading WARC files back.

An ARC file begins with a version block, whose second line names the version and whose third the fields of the header
lines: five for version 1, ten for version 2. Each record is such a line, as many bytes as its last field declares, and
a line feed. The converter reads lines by the version's fields and bodies by their declared lengths, record by record
from a stream (gzip or not), and gives each record what WARC asks for and ARC lacks: an identifier (a name-based UUID of
the archive's name and the record's offset, so that a second conversion gives the same), an ISO timestamp, a type and
SHA-1 digests of block and payload. Of equal payloads one record is a response, the first by a rank that the caller may
give or else by date, and the others are revisits of it, without the payload.

An archive is read twice: for the digests, by which it is found who revisits whom, and to be written. Payloads never
cross the network but to and from the shared store; a task that writes gets, with the name of an archive, the list of
its revisits. WARC files are compressed record by record and written under a name of the task's own; the list of files
that tasks return, kept by Spark's committer, says which of them count, so a task that runs again leaves no record twice.

Cases: null html is the empty payload; a null URL becomes about:blank; white space in a URL is percent-encoded; a null
page_id ranks after all others; rows that share a page_id are records of their own, each with its payload; of rows that
repeat page_id and payload one is the response; a truncated or malformed ARC record ends its archive with an error that
names the offset; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import new_path, small_batches, written

#: The fields of the header lines by version, as the ARC format gives them.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Uncompressed bytes after which a new archive begins.
ARC_BYTES = 8 << 20
WARC_BYTES = 64 << 20
#: The longest header line of a record.
_LINE = 1 << 20
CRAWL_DATE = "20240101000000"
_SPACES = {9: "%09", 10: "%0A", 11: "%0B", 12: "%0C", 13: "%0D", 32: "%20", 133: "%C2%85", 160: "%C2%A0"}


class MalformedArchive(ValueError):
    pass


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    status: int | None
    block: bytes
    offset: int = 0


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC -----------------------------------------------------------------------------------------------------------


class ArcWriter:
    """Writes an archive to a stream, compressed record by record."""

    def __init__(self, stream, version: int, name: str, date: str = CRAWL_DATE, packed: bool = True):
        self.stream, self.version, self.name, self.packed, self.offset = stream, version, name, packed, 0
        about = f"{version} 0 quire\n{' '.join(FIELDS[version])}\n".encode()
        self._put({"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-"}, about)

    def _put(self, values: dict[str, str], body: bytes) -> int:
        values |= {"Location": "-", "Offset": str(self.offset), "Filename": self.name, "Archive-length": str(len(body))}
        raw = " ".join(values[f] for f in FIELDS[self.version]).encode() + b"\n" + body + b"\n"
        if self.packed:
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            self.stream.write(packer.compress(raw) + packer.flush())
        else:
            self.stream.write(raw)
        at, self.offset = self.offset, self.offset + len(raw)
        return at

    def add(self, r: ArcRecord) -> int:
        """Writes a record; returns its offset in the uncompressed archive."""
        return self._put({"URL": r.url, "IP-address": r.ip, "Archive-date": r.date, "Content-type": r.mime, "Result-code": str(r.status or 200), "Checksum": sha1(r.block)}, r.block)


def write_arc(records: Iterable[ArcRecord], version: int = 1, name: str = "pages.arc", date: str = CRAWL_DATE) -> bytes:
    """An uncompressed ARC archive."""
    out = io.BytesIO()
    writer = ArcWriter(out, version, name, date, packed=False)
    for r in records:
        writer.add(r)
    return out.getvalue()


def read_arc(source: bytes | io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records of an archive, the version block excepted, one at a time."""
    stream = io.BufferedReader(io.BytesIO(source)) if isinstance(source, bytes) else source
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 18)
    at, version = 0, 0
    while line := stream.readline(_LINE):
        if line == b"\n":  # records may be apart by more than one line feed
            at += 1
            continue
        if not line.endswith(b"\n"):
            raise MalformedArchive(f"header line not ended at {at}")
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if not values[-1].isdigit():
            raise MalformedArchive(f"no declared length at {at}")
        body = stream.read(int(values[-1]))
        if len(body) != int(values[-1]):
            raise MalformedArchive(f"{len(body)} of {values[-1]} declared bytes at {at}")
        if not version:
            if not values[0].startswith("filedesc://"):
                raise MalformedArchive(f"no version block at {at}")
            declared = body.split(b"\n", 1)[0].split(b" ")[0]
            version = int(declared) if declared in (b"1", b"2") else 0
            if not version:
                raise MalformedArchive(f"version {declared!r} is not known")
        else:
            if len(values) != len(FIELDS[version]):
                raise MalformedArchive(f"{len(values)} of {len(FIELDS[version])} fields at {at}")
            field = dict(zip(FIELDS[version], values, strict=True))
            status = field.get("Result-code", "")
            yield ArcRecord(field["URL"], field["IP-address"], field["Archive-date"], field["Content-type"], int(status) if status.isdigit() else None, body, at)
        at += len(line) + len(body)


# --- WARC ----------------------------------------------------------------------------------------------------------


def timestamp(date: str) -> str:
    """ISO form of an ARC date of up to 14 digits; what is missing is the smallest possible."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP message; a block that is none is all payload."""
    if block.startswith(b"HTTP/") and (end := block.find(b"\r\n\r\n")) >= 0:
        return block[: end + 4], block[end + 4 :]
    return b"", block


def head_value(head: bytes, name: str) -> str | None:
    wanted = name.lower().encode() + b":"
    for line in head.split(b"\r\n")[1:]:
        if line[: len(wanted)].lower() == wanted:
            return line[len(wanted) :].strip().decode("utf-8", "replace")
    return None


def warc_record(identifier: str, url: str, date: str, head: bytes, payload: bytes, digest: str, original: tuple[str, str, str] | None) -> bytes:
    """A response or resource record, or with `original` (its record's id, URL and date) a revisit of it."""
    kind = "revisit" if original else "response" if head else "resource"
    block = head if original else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {timestamp(date)}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}"]
    if original:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {original[0]}", f"WARC-Refers-To-Target-URI: {original[1]}", f"WARC-Refers-To-Date: {original[2]}"]
    lines += ["Content-Type: application/http; msgtype=response" if head else "Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise MalformedArchive(f"no record begins with {line[:20]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise MalformedArchive("a record ends early")
        yield headers, block


# --- Spark ---------------------------------------------------------------------------------------------------------

_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _spread(files: DataFrame) -> DataFrame:
    """files (path and others), a partition for each as far as hashes allow."""
    return files.repartition(max(1, files.count()), "path")


_PAGES = "path string, offset long, record_id string, page_id long"


def pages_to_arc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) to ARC archives in `folder`, version 1 of even and version 2 of odd page_ids.

    Returns where each page lies, and the identifier that its record will have: path, offset, record_id, page_id.
    """

    def build(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        open_: dict[int, ArcWriter] = {}
        rows: list[tuple] = []
        for b in batches:
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                body = (html or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                version = 2 if (page_id or 0) % 2 else 1
                if (writer := open_.get(version)) is None:
                    path = f"{base}/{uuid.uuid4().hex}.arc.gz"
                    writer = open_[version] = ArcWriter(store.open_output_stream(path, compression=None), version, path)
                at = writer.add(ArcRecord((url or "about:blank").translate(_SPACES), "0.0.0.0", CRAWL_DATE, "text/html", 200, head.encode() + body))
                rows.append((writer.name, at, record_id(writer.name, at), page_id))
                if writer.offset >= ARC_BYTES:
                    open_.pop(version).stream.close()
                if len(rows) >= 5000:
                    yield _batch(rows, _PAGES)
                    rows = []
        for writer in open_.values():
            writer.stream.close()
        yield _batch(rows, _PAGES)

    return written(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(build, _PAGES), "arc-pages")


_RECORDS = "path string, offset long, url string, date string, payload_bytes long, digest string"


def arc_records(archives: DataFrame, folder: str) -> DataFrame:
    """What identifies the records of ARC archives (path): where they lie, URL, date, size and digest of the payload."""

    def parse(batches):
        store, _ = _store(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as raw:
                    for r in read_arc(io.BufferedReader(raw, 1 << 18)):
                        payload = http_parts(r.block)[1]
                        rows.append((path, r.offset, r.url, r.date, len(payload), sha1(payload)))
                        if len(rows) == 5000:
                            yield _batch(rows, _RECORDS)
                            rows = []
                yield _batch(rows, _RECORDS)

    return written(_spread(archives.select("path")).mapInArrow(parse, _RECORDS), "arc-records")


def convert(archives: DataFrame, folder: str, min_bytes: int = 0, ranks: DataFrame | None = None) -> DataFrame:
    """Writes the records of ARC archives (path) as WARC files in `folder`; returns path, records and bytes of each file.

    Payloads of fewer than min_bytes are never revisited. Of equal payloads the record of the smallest rank (path, offset,
    rank; none ranks last) is the response; without ranks, or among equal ones, the first by date, path and offset.
    """
    archives = archives.select("path").distinct()
    known = arc_records(archives, folder).where(F.col("payload_bytes") >= min_bytes)
    known = known.join(ranks.select("path", "offset", "rank"), ["path", "offset"], "left") if ranks is not None else known.withColumn("rank", F.lit(None).cast("long"))
    known = written(known, "arc-known")
    order = F.struct(F.col("rank").isNull().alias("none"), "rank", "date", "path", "offset", "url")
    first = known.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = known.join(first, "digest").where((F.col("path") != F.col("first.path")) | (F.col("offset") != F.col("first.offset")))
    # the revisits of an archive: no more than it has records
    of = F.struct("offset", F.col("first.path").alias("of_path"), F.col("first.offset").alias("of_offset"), F.col("first.url").alias("of_url"), F.col("first.date").alias("of_date"))
    listed = archives.join(later.groupBy("path").agg(F.collect_list(of).alias("later")), "path", "left")

    def write(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        stream, name, n, size, done = None, "", 0, 0, []
        for b in batches:
            for path, again in zip(b.column("path").to_pylist(), b.column("later").to_pylist(), strict=True):
                originals = {x["offset"]: (record_id(x["of_path"], x["of_offset"]), x["of_url"], timestamp(x["of_date"])) for x in again or ()}
                with store.open_input_stream(path, compression=None) as raw:
                    for r in read_arc(io.BufferedReader(raw, 1 << 18)):
                        if stream is None:
                            name, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                            stream = store.open_output_stream(name, compression=None)
                        head, payload = http_parts(r.block)
                        made = warc_record(record_id(path, r.offset), r.url, r.date, head, payload, sha1(payload), originals.get(r.offset))
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        stream.write(packer.compress(made) + packer.flush())
                        n, size = n + 1, size + len(made)
                        if size >= WARC_BYTES:
                            stream.close()
                            stream = None
                            done.append((name, n, size))
        if stream is not None:
            stream.close()
            done.append((name, n, size))
        yield _batch(done, "path string, records long, bytes long")

    return written(_spread(written(listed, "arc-listed")).mapInArrow(write, "path string, records long, bytes long"), "warc-files")


_READ = "record_id string, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to_id string"


def read_back(files: DataFrame, folder: str) -> DataFrame:
    """The records of WARC files: digests and sizes of payloads from their bytes; a revisit has none, and its size is null (see resolved)."""

    def read(batches):
        store, _ = _store(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 18)) as unpacked:
                    for headers, block in read_warc(io.BufferedReader(unpacked, 1 << 18)):
                        payload = http_parts(block)[1]
                        kind = headers["warc-type"]
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        n = None if kind == "revisit" else len(payload)
                        if n is not None and sha1(payload) != digest:
                            raise MalformedArchive(f"a payload of {path} isn't what its digest says")
                        rows.append((headers["warc-record-id"], headers["warc-target-uri"], headers["warc-date"], n, digest, kind, headers.get("warc-refers-to")))
                        if len(rows) == 5000:
                            yield _batch(rows, _READ)
                            rows = []
                yield _batch(rows, _READ)

    return _spread(files.select("path")).mapInArrow(read, _READ)


def resolved(records: DataFrame) -> DataFrame:
    """Records of read_back(), in which each revisit has the payload size of the record that it refers to, and its page_id as refers_to."""
    again, page = F.col("record_type") == "revisit", F.col("page_id") if "page_id" in records.columns else F.lit(None).cast("long")
    others = records.where(~again)
    targets = others.select(F.col("record_id").alias("refers_to_id"), page.alias("refers_to"), F.col("payload_bytes").alias("_size"))
    revisits = records.where(again).drop("payload_bytes").join(targets, "refers_to_id", "left").withColumnRenamed("_size", "payload_bytes")
    return others.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages through ARC into WARC files and back: a row for each page, with refers_to, the page of the response."""
    small_batches(pages.sparkSession)
    folder = new_path(pages.sparkSession, "warc")
    places = pages_to_arc(pages, folder)
    files = convert(places.select("path"), folder, min_bytes, places.withColumnRenamed("page_id", "rank"))
    # a list of files grows into records: what Spark takes for their size would have them broadcast
    records = written(read_back(files, folder).hint("merge").join(places.select("record_id", "page_id"), "record_id"), "warc-records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date")
