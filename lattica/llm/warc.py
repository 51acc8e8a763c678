"""WARC archives as a Python data source, and the archiving of pages with revisit records.

Files are gzip members, one per record; each member carries the ``sl`` extra field of the WARC standard's annex on
gzip (its compressed and uncompressed length), so a reader passes over a record without inflating its payload, and
reads the headers of a record by inflating only its beginning.  Members of other writers, without that field, are
inflated to find their end.

Files that aren't gzip are read as plain records, of which only headers are read where payloads aren't wanted.

Reading: partitions of about ``split_bytes``, which are groups of small files, or ranges of one file between the cut
points that its writer has put beside it (``.cuts``; a file without is one partition at the least); equality, IN and null filters on
``record_type`` and on header columns are pushed down and judged on the parsed headers; a payload is decoded only
for records that pass, and only if the schema asked for has a ``payload`` column.
Writing: each task writes files of about ``roll_bytes`` under a pending name, and the driver renames those of the
tasks that counted, so tasks that are run twice leave no record twice.

Null payloads count as empty.  Header values that are null are left out.  Line breaks in values become spaces.
Repeated rows are archived as the rows they are; rows of one page_id share a record id, and a null page_id is
``none``, which no record refers to unless it alone has a payload.  Of equal payloads the smallest page_id is the
response, and every other page_id a revisit.  An empty table makes an archive without records.  Columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from lattica.llm.common import fresh_path

#: Column of the data source for each header; fixed values of the format (the last is this writer's own).
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
    "payload_length": "X-Payload-Length",
}
LONGS = {"content_length", "payload_length"}
SCHEMA = ", ".join(f"{c} {'long' if c in LONGS else 'string'}" for c in HEADERS) + ", payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 64 << 20
ROLL_BYTES = 128 << 20
#: How far apart the cut points are that a writer notes, and the ending of the file of them.
CUT_BYTES = 4 << 20
CUTS = ".cuts"
#: How much of a member is inflated at first to find its headers.
PEEK = 4096
#: Over how many salts the copies of one payload are dealt in the join with their first: so many, and one more for so many pages.
SALTS, SALT_ROWS = 32, 1 << 20


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member with the ``sl`` extra field."""
    squeezer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeezer.compress(record) + squeezer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(values: dict[str, object], payload: bytes | None) -> bytes:
    body = payload or b""
    lines = ["WARC/1.1"] + [f"{HEADERS[k]}: {re.sub(r'[\r\n]+', ' ', str(v))}" for k, v in values.items() if v is not None and k != "content_length"]
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode("utf-8", "replace") + body + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, object]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    found = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
    return {c: (int(v) if v is not None and v.isdigit() else None) if c in LONGS else v for c, v in found.items()}


def skip_length(head: bytes) -> int:
    """The whole length of a member by its ``sl`` field; 0 if it has none."""
    if head[:2] != b"\x1f\x8b" or not head[3] & 4:
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= end <= len(head):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"sl" and size == 8:
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return 0


Record = tuple[dict[str, object], bytes | None]


def records(path: str, wanted, payload: bool, start: int = 0, end: int | None = None) -> Iterator[Record]:
    """Headers of each record for which ``wanted(headers)``, and its payload if asked for; of the range that begins at a record."""
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        end = f.size() if end is None else end
        if start < end and f.read_at(2, start) != b"\x1f\x8b":
            yield from plain_records(f, wanted, payload, start, end)
        else:
            yield from member_records(f, wanted, payload, start, end)


def plain_records(f, wanted, payload: bool, at: int, end: int) -> Iterator[Record]:
    while at < end:
        f.seek(at)
        plain = f.read(PEEK)
        while b"\r\n\r\n" not in plain and (more := f.read(PEEK)):
            plain += more
        head, gap, body = plain.partition(b"\r\n\r\n")
        if not gap:
            if plain.strip():
                raise ValueError(f"no record at byte {at}")
            return
        headers = parse_headers(head)
        length = headers["content_length"] or 0
        if wanted(headers):
            yield headers, (body[:length] + (f.read(length - len(body)) if length > len(body) else b"") if payload else None)
        at += len(head) + 4 + length + 4


def member_records(f, wanted, payload: bool, at: int, end: int) -> Iterator[Record]:
    while at < end:
        f.seek(at)
        chunk = f.read(PEEK)
        size, inflate = skip_length(chunk), zlib.decompressobj(31)
        plain = inflate.decompress(chunk)
        taken = len(chunk)
        while b"\r\n\r\n" not in plain and not inflate.eof:
            more = f.read(PEEK)
            if not more:
                break
            taken += len(more)
            plain += inflate.decompress(more)
        head, _, body = plain.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        keep = wanted(headers)
        length = headers["content_length"] or 0
        if not size or (keep and payload):
            rest = [body]
            got = len(body)
            while not inflate.eof:
                more = f.read(max(PEEK, size - taken) if size else 1 << 20)
                if not more:
                    break
                taken += len(more)
                part = inflate.decompress(more)
                if got < length:  # beyond that only the record's end is left
                    rest.append(part)
                got += len(part)
            size = size or taken - len(inflate.unused_data)
            body = b"".join(rest)[:length]
        if keep:
            yield headers, body if payload else None
        at += size


@dataclass
class Files(InputPartition):
    """(path, start, end) of each range; an end of None is the file's."""

    ranges: list[tuple[str, int, int | None]]

    def __init__(self, ranges: list[tuple[str, int, int | None]]):
        super().__init__(tuple(ranges))
        self.ranges = ranges


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.names = options["path"], schema.fieldNames()
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, tuple(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, ()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, name = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(name, recursive=False, allow_not_found=True)) if fs.get_file_info(name).type != pafs.FileType.File else [fs.get_file_info(name)]
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else "file://" if "://" in self.path or self.path.startswith("file:") else ""
        there = {i.path for i in found}
        groups: list[list[tuple[str, int, int | None]]] = []
        room = 0
        for info in sorted((i for i in found if i.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path)), key=lambda i: i.path):
            cuts: list[int] = []
            if info.size > self.split and info.path + CUTS in there:
                with fs.open_input_file(info.path + CUTS) as f:
                    cuts = json.loads(f.read())
            edges = [0]
            for cut in cuts:
                if cut - edges[-1] >= self.split:
                    edges.append(cut)
            for a, b in zip(edges, [*edges[1:], info.size], strict=True):
                if not groups or room < b - a:
                    groups.append([])
                    room = self.split
                groups[-1].append((prefix + info.path, a, b))
                room -= b - a
        return [Files(g) for g in groups] or [Files([])]

    def wanted(self, headers: dict[str, object]) -> bool:
        return all(headers[c] is not None and (not values or headers[c] in values) for c, values in self.tests)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, start, end in partition.ranges:
            for headers, payload in records(path, self.wanted, "payload" in self.names, start, end):
                yield tuple(payload if c == "payload" else headers.get(c) for c in self.names)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.roll, self.level = options["path"], int(options.get("roll_bytes", ROLL_BYTES)), int(options.get("level", 6))
        self.cut = int(options.get("cut_bytes", CUT_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(f"{root}/_pending", recursive=True)
        paths: list[str] = []
        out, size, cuts = None, 0, []

        def close() -> None:
            out.close()
            with fs.open_output_stream(paths[-1] + CUTS) as f:
                f.write(json.dumps(cuts).encode())

        for batch in iterator:
            columns = [c for c in HEADERS if c in batch.schema.names]
            values = [batch.column(c).to_pylist() for c in columns]
            payloads = batch.column("payload") if "payload" in batch.schema.names else None
            for i in range(batch.num_rows):
                if out is None or size >= self.roll:
                    if out is not None:
                        close()
                    paths.append(f"{root}/_pending/{uuid.uuid4().hex}.warc.gz")
                    out, size, cuts = fs.open_output_stream(paths[-1], compression=None), 0, []
                if size - (cuts[-1] if cuts else 0) >= self.cut:
                    cuts.append(size)
                packed = member(record_bytes({c: v[i] for c, v in zip(columns, values, strict=True)}, payloads[i].as_py() if payloads is not None else None), self.level)
                out.write(packed)
                size += len(packed)
        if out is not None:
            close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for p in m.paths if m else ():
                for q in (p + CUTS, p):  # cuts without a file do no harm
                    fs.move(q, f"{root}/{q.rsplit('/', 1)[1]}")
        if fs.get_file_info(f"{root}/_pending").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_pending")  # with what tasks that didn't count have left

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            for p in m.paths if m else ():
                fs.delete_file(p + CUTS)
                fs.delete_file(p)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, schema: str = SCHEMA, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def base32_of_hex(digest: pd.Series) -> pd.Series:
    return digest.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())


def as_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A record per page: of pages with equal payloads of at least ``min_bytes`` the smallest page_id is the response.

    Payloads are compared by their SHA-1 and length.  The copies of a payload are counted before any shuffle and dealt
    over salts, whose number grows with the table, in the join that tells each its first, so a payload that many pages share is no hot key.
    """
    salts = SALTS + pages.count() // SALT_ROWS
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumns(
        {"sha1": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")}
    )
    firsts = (
        page.where(F.col("payload_length") >= min_bytes)
        .groupBy("sha1", "payload_length")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("sha1", "payload_length", "first_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    dealt = page.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    joined = dealt.join(firsts, ["sha1", "payload_length", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha1:"), F.pandas_udf(base32_of_hex, "string")("sha1")).alias("payload_digest"),
        F.when(revisit, urn("first_id")).alias("refers_to"),
        F.when(revisit, REVISIT_PROFILE).alias("profile"),
        F.lit("text/html").alias("content_type"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the pages as WARC files into ``path``."""
    register(pages.sparkSession)
    as_records(pages, min_bytes).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive the pages into the shared folder and read them back.

    Length and digest of a response are those of the payload that the archive holds; a revisit's payload is elsewhere,
    so its headers tell them.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    archive(pages, path, min_bytes)
    id_of = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    number = lambda c: F.when(id_of(c) != "", id_of(c).cast("long"))
    headers = ", ".join(f"{c} {'long' if c in LONGS else 'string'}" for c in HEADERS)
    columns = ("record_id", "payload_length", "payload_digest", "record_type", "refers_to")
    responses = (
        read(spark, path, f"{headers}, payload binary").where("record_type = 'response'")
        .withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.pandas_udf(base32_of_hex, "string")(F.sha1("payload"))})
    )
    revisits = read(spark, path, headers).where("record_type = 'revisit'").withColumn("payload_digest", F.substring_index("payload_digest", ":", -1))
    found = responses.select(*columns).union(revisits.select(*columns))
    return found.select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )
