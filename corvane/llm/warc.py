"""WARC archives: writer, monolithic-gzip normaliser with a sidecar offset index, and reader.

write() makes one gzip stream over many records, as careless tools do. normalise() inflates such a
stream once, from front to back in bounded memory, rewrites every record as a gzip member of its own
and writes a sidecar index (offset, length, type, record id) beside it. read() takes the offsets from the
sidecar, fetches the members, and measures and hashes the payloads; what disagrees with a head or
with the index is an error. A revisit has no payload, so its length and digest are those that it states,
and check_revisits() holds them against those measured in the response that it refers to. Files lie in the shared
folder, under names of their own for each attempt of a task; only files that a task has returned
are ever read, so a lost or repeated task leaves no mix.

Duplicates: of records with equal payloads of at least min_bytes, each with the largest page_id (ties: all of
them) is the response, the others are revisits of it. Null html is an empty payload, null url is
left out, null page_id is never the largest unless the group has no other. Repeated rows are records of their own,
each with its own record id. Very long payloads are written and read one at a time. An empty table gives no archive
and no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm.common import quoted, schema, scratch, slices, stored

#: Bytes of records in one archive.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_duplicates(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1, row (a number of its own), refers_to and refers_row (the response's page_id and row; null for responses).

    pages is a table, read alike each time. Payloads are equal if SHA-1 and another hash are. Groups are made of hashes and numbers alone; payloads meet only the marks of their own
    row, so a page that everyone serves is dealt out like others.
    """
    payload = F.coalesce(F.col(quoted(html)).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(quoted(page_id)).cast("long").alias("page_id"), F.col(quoted(url)).cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    light = rows.select("page_id", "row", "sha1", F.xxhash64("payload").alias("beside"), F.octet_length("payload").alias("size"))
    groups = light.where(F.col("size") >= min_bytes).groupBy("sha1", "beside").agg(F.max("page_id").alias("last"), F.max_by("row", "page_id").alias("last_row"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    marks = light.join(groups, ["sha1", "beside"]).where(revisit).select("row", F.col("last").alias("refers_to"), F.col("last_row").alias("refers_row"))
    return rows.join(marks, "row", "left").select("page_id", "url", "payload", "sha1", "row", "refers_to", "refers_row")


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{row}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, row: int, refers_to: int | None, refers_row: int | None, date: str) -> bytes:
    """One record; a revisit has the HTTP head alone, whose Content-Length is that of the full payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head + payload if refers_to is None else head
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, row)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()))
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, refers_row)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _inflated(stream) -> Iterator[bytes]:
    """The content of a gzip stream of any number of members."""
    inflate = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            if data := inflate.decompress(raw, CHUNK):
                yield data
            raw = inflate.unconsumed_tail
            if inflate.eof:
                raw = inflate.unused_data
                inflate = zlib.decompressobj(31)
            elif not raw:
                break
    if tail := inflate.flush():
        yield tail


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Head fields and raw bytes of each record of a gzip stream."""
    buffer, chunks = bytearray(), _inflated(stream)

    def more() -> bool:
        data = next(chunks, None)
        if data is not None:
            buffer.extend(data)
        return data is not None

    while True:
        while (at := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("the archive ends within a record")
                return
        fields = parse_head(bytes(buffer[:at]))
        size = at + 4 + int(fields["content-length"]) + 4
        while len(buffer) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(buffer[:size])
        del buffer[:size]


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of mark_duplicates() as gzip streams; returns the path of each archive."""

    def run(batches):
        files, _ = _open(folder)
        base = _open(folder)[1]
        files.create_dir(base)
        out = deflate = path = None
        size = 0

        def close():
            out.write(deflate.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        for batch in batches:
            for piece in slices(batch, "payload"):
                for r in piece.to_pylist():
                    if out is None:
                        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                        out, deflate, size = files.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                    raw = record(**r, date=date)
                    out.write(deflate.compress(raw))
                    size += len(raw)
                    if size >= archive_bytes:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return rows.mapInArrow(run, schema("path string"))


def normalise(paths: DataFrame, folder: str, level: int = 4, keep: bool = False) -> DataFrame:
    """Rewrite each archive with a member for every record, beside a sidecar index; returns the path of each new archive and its number of records.

    A new archive is named after its source, and its index gets its name last. Unless they are kept, sources go as soon as theirs is whole; a task that is
    run again then finds the new archive.
    """

    def run(batches):
        files, base = _open(folder)
        exists = lambda path: files.get_file_info(path).type == pafs.FileType.File
        done = lambda target, n: pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], names=["path", "records"])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                target = f"{base}/{path.rpartition('/')[2].removesuffix('.warc.gz')}.members.warc.gz"
                if not exists(path) and exists(target + ".idx"):  # an attempt that was lost had done all
                    yield done(target, sum(1 for _ in read_index(files, target)))
                    continue
                own, n, at = f"{target}.{uuid.uuid4().hex}", 0, 0
                with files.open_input_stream(path, compression=None) as source, files.open_output_stream(own, compression=None) as out, files.open_output_stream(own + ".idx", compression=None) as side:
                    for fields, raw in records(source):
                        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = deflate.compress(raw) + deflate.flush()
                        out.write(member)
                        side.write(f"{at}\t{len(member)}\t{fields['warc-type']}\t{fields['warc-record-id']}\n".encode())
                        at += len(member)
                        n += 1
                files.move(own, target)
                files.move(own + ".idx", target + ".idx")
                if not keep:
                    files.delete_file(path)
                yield done(target, n)

    return paths.mapInArrow(run, schema("path string, records long"))


def read_index(files: pafs.FileSystem, path: str) -> Iterator[tuple[int, int, str, str]]:
    """Offset, length, type and record id of each record of an archive, from its sidecar index."""
    with files.open_input_stream(path + ".idx", compression=None) as f:
        left = b""
        while raw := f.read(CHUNK):
            *lines, left = (left + raw).split(b"\n")
            for line in lines:
                offset, length, kind, name = line.decode().split("\t")
                yield int(offset), int(length), kind, name


def parse_record(raw: bytes, kind: str, name: str) -> tuple[dict[str, str], int, str, bytes]:
    """Head fields, payload length, payload digest and payload of a record, which the index says is of this type and id.

    Length and digest of a response are measured in its payload; those of a revisit are what it states.
    """
    end = raw.index(b"\r\n\r\n")
    fields = parse_head(raw[:end])
    block = raw[end + 4 : -4]
    if (fields["warc-type"], fields["warc-record-id"]) != (kind, name) or int(fields["content-length"]) != len(block):
        raise ValueError(f"the index does not fit the record {fields['warc-record-id']}")
    cut = block.index(b"\r\n\r\n") + 4
    size, digest = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", block[:cut])[1]), fields["warc-payload-digest"].removeprefix("sha1:")
    payload = block[cut:]
    if kind == "response":
        measured = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if measured != (size, digest):
            raise ValueError(f"the payload of {name} is damaged")
    return fields, size, digest, payload


def read(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of archives (path), found by their sidecars: record_id, page_id, url, record_type, payload_bytes, payload_digest, refers_id, refers_to and, if asked for, payload."""
    spec = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_id string, refers_to long"
    out = schema(spec + ", payload binary" * payload)
    arrow = to_arrow_schema(out)
    number = re.compile(r"<urn:page:(-?\d+):\d+>")

    def page_of(name):
        found = number.fullmatch(name or "")
        return found and int(found[1])

    def rows_of(files, path):
        with files.open_input_file(path) as source:
            for offset, length, kind, name in read_index(files, path):
                source.seek(offset)
                fields, size, digest, content = parse_record(zlib.decompress(source.read(length), 31), kind, name)
                of = fields.get("warc-refers-to")
                yield (name, page_of(name), fields.get("warc-target-uri"), kind, size, digest, of, page_of(of)) + (content,) * payload

    def run(batches):
        files, _ = _open(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for row in rows_of(files, path):
                    rows.append(row)
                    held += len(row[-1]) if payload else 0
                    if len(rows) >= 5_000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return archives.select("path").mapInArrow(run, out)


def check_revisits(rows: DataFrame) -> None:
    """An error unless each revisit of rows states the length and digest that were measured in the response that it refers to."""
    stated = rows.where("record_type = 'revisit'").groupBy("refers_id", "payload_bytes", "payload_digest").count().drop("count")
    found = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), "payload_bytes", "payload_digest")
    for r in stated.join(found, ["refers_id", "payload_bytes", "payload_digest"], "left_anti").limit(1).collect():
        raise ValueError(f"no response {r.refers_id} of {r.payload_bytes} bytes and digest {r.payload_digest}")


def round_trip(pages: DataFrame, folder: str | None = None, payload: bool = False, **columns) -> DataFrame:
    """Write pages as archives, normalise them, read every record back and check the revisits. Without a folder of their own the archives go afterwards."""
    own = folder is None
    folder = scratch(pages.sparkSession, "warc") if own else folder
    rows = stored(read(normalise(write(mark_duplicates(pages, **columns), folder), folder), folder, payload))
    check_revisits(rows)
    if own:
        target = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
    return rows
