"""WARC records in ZIP packages: writer and range reader.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.tsv`` with offset and length of each. The reader fetches the end of the file, parses the end
record, the ZIP64 records where present and the central directory, finds where a stored member's bytes begin,
reads the index member, and then reads record ranges straight from the package; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, open_store, slots, small_batches, stored

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
#: A revisit is worth it from so many payload bytes on.
LEAST_BYTES = 1000
#: A task starts another package beyond this size.
PACKAGE_BYTES = 256 << 20
_DATE = "2024-01-01T00:00:00Z"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, digest: str, n_bytes: int, refers_to, payload: bytes) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head alone."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": _DATE,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(n_bytes),
    }
    if refers_to is None:
        body += payload
    else:
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": record_id(refers_to),
            "X-Refers-To-Page-ID": str(refers_to),
        }
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (behind the HTTP head) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class _Package:
    """A ZIP package that is being written to a stream: records are appended, the index follows at the end."""

    def __init__(self, folder: str):
        files, where = open_store(folder)
        files.create_dir(where, recursive=True)
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        self.sink = files.open_output_stream(f"{where}/{self.path.rpartition('/')[2]}")
        self.zip = zipfile.ZipFile(_Forward(self.sink), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, data: bytes) -> None:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = press.compress(data) + press.flush()
        self.member.write(packed)
        self.lines.append(f"{self.at}\t{len(packed)}")
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            index.write("\n".join(self.lines).encode())
        self.zip.close()
        self.sink.close()
        return self.path, len(self.lines)


class _Forward:
    """A stream for zipfile that can only be written forward."""

    def __init__(self, sink):
        self.write, self.flush = sink.write, sink.flush

    def seekable(self) -> bool:
        return False


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                package = package or _Package(folder)
                payload = b"" if row["refers_to"] is not None else (row["html"] or "").encode()
                package.add(record(row["page_id"], row["url"], row["digest"], row["n_bytes"], row["refers_to"], payload))
                if package.at > PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return write


def directory(read, size: int) -> dict[str, tuple[int, int]]:
    """(first byte, length) of each stored member of a ZIP file, from ``read(offset, length)``."""
    tail_at = max(0, size - 66_000)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP file")
    entries, length, offset = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<Q", tail, locator + 8)
        entries, length, offset = struct.unpack_from("<QQQ", read(end64, 56), 32)
    central, at, members = read(offset, length), 0, {}
    for _ in range(entries):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, packed, plain, n_name, n_extra, n_note, start = struct.unpack_from("<H8xII3H8xI", central, at + 10)[:7]
        name = central[at + 46 : at + 46 + n_name].decode()
        extra, end_extra = at + 46 + n_name, at + 46 + n_name + n_extra
        while extra + 4 <= end_extra:
            kind, n = struct.unpack_from("<HH", central, extra)
            if kind == 1:
                big = iter(struct.unpack_from(f"<{n // 8}Q", central, extra + 4))
                plain = next(big) if plain == 0xFFFFFFFF else plain
                packed = next(big) if packed == 0xFFFFFFFF else packed
                start = next(big) if start == 0xFFFFFFFF else start
            extra += 4 + n
        at = end_extra + n_note
        if method == 0:
            n_name, n_extra = struct.unpack_from("<HH", read(start, 30), 26)
            members[name] = (start + 30 + n_name + n_extra, packed)
    return members


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record places of packages: (path, offset, length) from their directories and index members."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, where = open_store(path)
            with files.open_input_file(where) as data:
                members = directory(lambda at, n: data.read_at(n, at), data.size())
                base, _ = members[ARCHIVE]
                begin, n = members[INDEX]
                lines = [line.split("\t") for line in data.read_at(n, begin).decode().splitlines()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(lines), pa.string()), pa.array([base + int(o) for o, _ in lines], pa.int64()), pa.array([int(k) for _, k in lines], pa.int64())],
                names=["path", "offset", "length"],
            )


RECORDS = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, record_id string, payload binary"


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, now = None, ""
        for batch in batches:
            out = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != now:
                    files, where = open_store(path)
                    opened, now = files.open_input_file(where), path
                fields, payload = parse_record(zlib.decompress(opened.read_at(length, offset), 31))
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                    raise ValueError(f"damaged payload at {offset} of {path}")
                out.append((fields["X-Page-ID"] or None, fields["WARC-Target-URI"], fields["WARC-Type"], fields.get("X-Refers-To-Page-ID"),
                            int(fields["X-Payload-Length"]), digest, fields["WARC-Record-ID"], None if revisit or not with_payload else payload))
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = zip(*out) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return read


def write_packages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, folder: str | None = None
) -> DataFrame:
    """Write a record for every row, a package or more per task; return (path, records) of the packages.

    The payload is the html in UTF-8, null being empty. Of rows with equal payloads of at least ``least_bytes``
    the one with the largest id is the response and the others revisit it; if rows repeat that id, all of them
    are responses. Rows with a null id are responses. White space in urls becomes single spaces, null an empty
    string. An empty table writes nothing. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    folder = folder or new_path(pages.sparkSession, "packages")
    data = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    rows = rows.withColumns({"digest": F.sha1(data), "n_bytes": F.octet_length(data)})
    keyed = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.sha1(data).alias("digest"), F.octet_length(data).alias("n_bytes")).filter(F.col("n_bytes") >= least_bytes)
    copies = keyed.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first")
    # a payload that very many pages share is joined without the payload, and the pages then by their own id
    revisits = keyed.join(stored(copies, "copies"), "digest").filter("page_id < first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    marked = rows.join(stored(revisits, "revisits"), ["page_id", "digest"], "left")
    ready = marked.select("page_id", "url", "html", "digest", "n_bytes", "refers_to")
    return stored(ready.mapInArrow(_writer(folder), "path string, records long").filter("path is not null"), "package_list")


def read_packages(spark: SparkSession, packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the packages in column ``path``; ids come back as strings, payload is null for revisits.

    Digest and length of each response are checked against its payload. Places are dealt out in ranges, so
    several tasks read one large package.
    """
    places = packages.select("path").repartition("path").mapInArrow(_locate, "path string, offset long, length long")
    block = F.floor(F.col("offset") / F.lit(16 << 20))
    dealt = places.repartition("path", block).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(_reader(with_payload), RECORDS)
