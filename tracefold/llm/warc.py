"""WARC: archives of compressed records, written by tasks and read back in splits.

Every record is a gzip member of its own. `write` gives each task an archive; a file
is written under another name and renamed when it is whole, so an attempt that is lost
leaves no archive and one that runs again replaces it. Records of equal payloads of at
least `smallest` bytes are stored once: the one with the largest id is a `response`,
the others are `revisit` records that refer to it and have no payload. Of rows with that id and
payload the one with the smallest URL, and then one of the equal ones, is the response.

`read` cuts files into ranges of bytes. A task looks for gzip magic in its range and
checks each candidate by decoding the header of the record in it, since magic may also
stand in compressed bytes. From the first record on it goes from member to member, to
the last one that starts inside its range and however far that one reaches beyond it.
Each record has one owner, so ranges need not know of each other. Bytes between
members, members that hold no WARC record and records that are cut short are passed
over; the next member is looked for behind the place where reading failed. Payloads
are decoded and hashed in pieces, and kept only if asked for.

A NULL html is an empty payload, a NULL URL leaves the header out, and a record without
an id has none when read. URLs are written with blanks, control and non-ASCII
characters percent-encoded. Rows that repeat a page_id are records of their own. Other
columns are ignored. Tasks open archives through pyarrow's file systems (local or
mounted folders, HDFS, S3, GCS); tables are read by Spark as ever.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_keys, same, saved, shared_dir, table

SMALLEST = 1000  # bytes of a payload worth a revisit record
SPLIT = 32 << 20
DATE = "2024-01-01T00:00:00Z"
BROADCAST_COPIES = 100_000  # groups of equal payloads, of about 100 bytes each
SALT = 16
TASKS = 100_000  # at most, for the ranges of a read
MAGIC = b"\x1f\x8b\x08"
_WINDOW = 1 << 20  # bytes read from a file at once,
_PIECE = 1 << 14  # and given to the decoder
_OUTPUT = 8 << 20  # of kept payloads in a batch
_HEADER = 1 << 16  # no header is longer
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records ---------------------------------------------------------------------


def record_id(*parts) -> str:
    """The same id for the same parts, on every attempt."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _header(first: str, fields: list[tuple[str, str | int | None]]) -> bytes:
    lines = [first, *(f"{name}: {value}" for name, value in fields if value is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _uri(url: str | None) -> str | None:
    return None if url is None else urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~-._", errors="replace")


def digest_field(sha1: str) -> str:
    """A digest as archives have it, in base 32."""
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def digest_of(text: str) -> str | None:
    """Lower-case hex of a SHA-1 header in base 32 or hex."""
    kind, _, value = text.partition(":")
    if kind.lower() == "sha1" and re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    if kind.lower() == "sha1" and re.fullmatch("[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    return None


def member(content: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(content) + squeeze.flush()


def page_record(row: dict, number: str, date: str = DATE) -> bytes:
    """A page's record as a gzip member, from a row of `plan`; `number` tells equal rows apart."""
    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
    http = _header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if row["revisit"] else http + payload
    own = (row["page_id"], row["row"]) if row["referred"] else (row["page_id"], row["row"], number)
    fields = [
        ("WARC-Type", "revisit" if row["revisit"] else "response"),
        ("WARC-Record-ID", record_id(*own)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(row["url"])),
        ("WARC-Payload-Digest", digest_field(row["sha1"])),
        ("X-Page-ID", row["page_id"]),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if row["revisit"]:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(row["first_id"], row["first_row"])),
            ("WARC-Refers-To-Date", date),
        ]
    return member(_header("WARC/1.1", fields) + block + b"\r\n\r\n")


def info_record(name: str, date: str = DATE) -> bytes:
    """The record that opens an archive."""
    block = _header("software: tracefold", [("format", "WARC File Format 1.1")])[:-2]
    fields = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name)), ("WARC-Date", date),
        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block)),
    ]
    return member(_header("WARC/1.1", fields) + block + b"\r\n\r\n")


# --- writing ---------------------------------------------------------------------


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A path's file system, and the path in it."""
    local = re.fullmatch(r"(?:file:(?://(?=/))?)?(/.*)", path)
    if local:
        return pyarrow.fs.LocalFileSystem(), local.group(1)
    scheme, rest = path.split("://", 1)
    return pyarrow.fs.FileSystem.from_uri(f"{re.sub('s3[an]', 's3', scheme)}://{urllib.parse.quote(rest, safe='/:@')}")


def plan(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """What to write: (page_id, url, html, row, sha1, first_id, first_row, referred, revisit), a row per page.

    A revisit refers to the record of the row `first_row`, which is `referred` to.
    Only digests are grouped. The groups of several rows are broadcast if they are few;
    else the pages are joined with them, the copies of a payload in SALT shares.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(
        *pages.columns, F.concat_ws(":", *row_keys(pages)).alias("row"),
        F.sha1(html).alias("sha1"), F.when(F.octet_length(html) >= smallest, F.sha2(html, 256)).alias("sha2"),
    )
    # NULL ids come last
    newest_first = F.struct(F.col("page_id").isNull().alias("no"), (-F.col("page_id")).alias("minus"), "url", "row", "page_id", "equal")
    groups = keyed.where("sha2 is not null").groupBy("sha2", "page_id", "url", "row").agg(F.count("*").alias("equal"))
    groups = groups.groupBy("sha2").agg(F.sum("equal").alias("n"), F.min(newest_first).alias("first"))
    groups = saved(groups.where("n > 1").select(
        "sha2", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"), F.col("first.equal").alias("equal")
    ), "copies")
    if groups.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES:
        rows = keyed.join(F.broadcast(groups), "sha2", "left")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salt = F.pmod(F.xxhash64("page_id", "row"), F.lit(SALT)).cast("int")
        rows = keyed.withColumn("salt", salt).join(salted, ["sha2", "salt"], "left").drop("salt")
    referred = F.coalesce(F.col("row") == F.col("first_row"), F.lit(False))
    rows = rows.withColumn("referred", referred).withColumn("revisit", F.col("first_row").isNotNull() & ~F.col("referred"))
    if groups.where("equal > 1").limit(1).count():
        # Equal rows that are all first: one record of them is the response.
        twice = F.col("referred") & (F.col("equal") > 1)
        equal = rows.where(twice).dropDuplicates(["row"])
        equal = equal.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "equal"))).withColumn("referred", F.col("copy") == 1)
        rows = rows.where(~twice).unionByName(equal.withColumn("revisit", F.col("copy") > 1).drop("copy"))
    return rows.drop("sha2", "equal")


def write(pages: DataFrame, folder: str, smallest: int = SMALLEST, date: str = DATE) -> DataFrame:
    """Write archives of `pages` (page_id, url, html) below `folder`; gives (path, records, bytes) of each."""
    files, base = _file_system(folder)
    files.create_dir(base, recursive=True)
    archives = plan(pages, smallest).mapInArrow(
        lambda it: _write_archive(it, folder, date), "path string, records long, bytes long"
    )
    return saved(archives, "archives")


def _write_archive(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
    files, base = _file_system(folder)
    attempt, out, number = f"{base}/_{name}-{uuid.uuid4().hex}", None, 0
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for k in range(batch.num_rows):
            if out is None:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(attempt)
                out.write(info_record(name, date))
            out.write(page_record({c: v[k].as_py() for c, v in columns.items()}, f"{name}/{number}", date))
            number += 1
    if out is None:  # a task without rows has no archive
        return
    size = out.tell()
    out.close()
    whole = f"{base}/{name}"
    if files.get_file_info(whole).type == pyarrow.fs.FileType.File:  # of an attempt whose result was lost
        files.delete_file(whole)
    files.move(attempt, whole)
    yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([number]), pa.array([size])], ["path", "records", "bytes"])


# --- reading ---------------------------------------------------------------------


class _Window:
    """A file's bytes by place, read in large steps."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.start, self.held = file, 0, b""

    def piece(self, at: int, size: int = _PIECE) -> bytes:
        """Up to `size` bytes from `at`; b"" behind the end."""
        if not self.start <= at < self.start + len(self.held):
            self.start, self.held = at, self.file.read_at(_WINDOW, at)
        return self.held[at - self.start : at - self.start + size]

    def magic(self, at: int, end: int) -> int | None:
        """The first magic that starts in [at, end)."""
        while at < end:
            piece = self.piece(at, _WINDOW)
            if len(piece) < len(MAGIC):
                piece += self.piece(at + len(piece), len(MAGIC)) if piece else b""
                if len(piece) < len(MAGIC):
                    return None
            found = piece.find(MAGIC)
            if found >= 0:
                return at + found if at + found < end else None
            at += len(piece) - len(MAGIC) + 1
        return None


class _Member:
    """What a gzip member holds, piece by piece."""

    def __init__(self, window: _Window, at: int):
        self.window, self.at, self.inflate = window, at, zlib.decompressobj(31)

    def read(self) -> bytes:
        """The next piece, b"" at the end; an error if the member is damaged or cut short."""
        inflate = self.inflate
        while not inflate.eof:
            data = inflate.unconsumed_tail
            if not data:
                data = self.window.piece(self.at)
                self.at += len(data)
            out = inflate.decompress(data, 16 * _PIECE)
            if out:
                return out
            if not data and not inflate.eof:
                raise EOFError
        return b""

    def end(self) -> int:
        return self.at - len(self.inflate.unused_data)


def fields_of(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; lines that start with a blank go on with the one before."""
    out, name = {}, None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?\d{1,18}|-9\d{18}|\d{19}", text) and -(1 << 63) <= int(text) < 1 << 63 else None


def read_record(window: _Window, at: int, keep: bool) -> tuple[dict, int] | None:
    """The record in the member at `at` and where the member ends; None if there is no whole one."""
    try:
        content = _Member(window, at)
        head = b""
        while (end := head.find(b"\r\n\r\n")) < 0:
            piece = content.read()
            head += piece
            if not piece or not head.startswith(b"WARC/"[: len(head)]) or len(head) > _HEADER + 16 * _PIECE:
                return None
        if not head.startswith(b"WARC/"):
            return None
        fields = fields_of(head[:end].split(b"\r\n")[1:])
        left = _number(fields.get("content-length"))
        if left is None or left < 0 or "warc-type" not in fields:
            return None
        rest = head[end + 4 :]
        http = b"" if fields.get("content-type", "").lower().startswith("application/http") else None
        sha1, size, kept, sent = hashlib.sha1(), 0, [], {}
        while True:
            part, rest = rest[:left], b""
            left -= len(part)
            if http is not None:
                http += part
                end = http.find(b"\r\n\r\n")
                if end >= 0:
                    sent, part, http = fields_of(http[:end].split(b"\r\n")[1:]), http[end + 4 :], None
                elif len(http) > _HEADER or not left:  # no HTTP header after all
                    part, http = http, None
                else:
                    part = b""
            sha1.update(part)
            size += len(part)
            if keep:
                kept.append(part)
            rest = content.read()
            if not rest:
                break
    except (zlib.error, EOFError):
        return None
    if left:
        return None
    revisit = fields["warc-type"] == "revisit"
    stated = digest_of(fields.get("warc-payload-digest", ""))
    row = {
        "offset": at,
        "record_type": fields["warc-type"],
        "record_id": fields.get("warc-record-id"),
        "refers_to_id": fields.get("warc-refers-to"),
        "url": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "page_id": _number(fields.get("x-page-id")),
        "payload_bytes": _number(sent.get("content-length")) if revisit else size,
        "payload_digest": stated if revisit else sha1.hexdigest(),
        "sound": None if revisit or stated is None else stated == sha1.hexdigest(),
        "payload": b"".join(kept) if keep and not revisit else None,
    }
    return row, content.end()


def read_range(file: pa.NativeFile, start: int, end: int, keep: bool = False) -> Iterator[dict]:
    """The records that start in [start, end) of a file."""
    window, at = _Window(file), start
    while (found := window.magic(at, end)) is not None:
        whole = read_record(window, found, keep)
        if whole is None:
            at = found + 1
        else:
            row, at = whole
            yield row


_COLUMNS = {
    "path": "string", "offset": "long", "record_type": "string", "record_id": "string", "refers_to_id": "string", "url": "string",
    "date": "string", "page_id": "long", "payload_bytes": "long", "payload_digest": "string", "sound": "boolean", "payload": "binary",
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _read_ranges(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        arrays = [pa.array([row[c] for row in held], _ARROW[t]) for c, t in _COLUMNS.items()]
        return pa.record_batch(arrays, list(_COLUMNS))

    for ranges in batches:
        for path, start, end in zip(*(c.to_pylist() for c in ranges.columns)):
            files, inside = _file_system(path)
            size = 0
            with files.open_input_file(inside) as file:
                for row in read_range(file, start, end, keep):
                    held.append({"path": path, **row})
                    size += len(row["payload"] or b"")
                    if len(held) >= 5000 or size > _OUTPUT:
                        yield batch()
                        held.clear()
                        size = 0
    if held:
        yield batch()


def read(spark: SparkSession, folder: str, payload: bool = False, split: int = SPLIT) -> DataFrame:
    """All records of the archives in `folder`.

    (path, offset, record_type, record_id, refers_to_id, url, date, page_id,
    payload_bytes, payload_digest, sound, payload). `sound` says whether the payload
    has the digest that its header states, NULL if there is nothing to compare;
    `payload` is NULL unless asked for. A revisit's bytes and digest are those its
    headers state.
    """
    # only paths and lengths are read here
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")
    ranges = files.select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start")
    ).withColumn("end", F.col("start") + split)
    tasks = max(1, min(TASKS, files.agg(F.sum(F.ceil(F.col("length") / split))).head()[0] or 0))
    schema = ", ".join(f"`{c}` {t}" for c, t in _COLUMNS.items())
    return ranges.repartition(tasks).mapInArrow(lambda it: _read_ranges(it, payload), schema)


def resolve(records: DataFrame) -> DataFrame:
    """`records` with `refers_to`: the page_id of the response that a revisit refers to, by id and digest."""
    revisits = records.where("refers_to_id is not null")
    wanted = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()
    responses = records.where("record_type = 'response'").select("record_id", "page_id", "payload_digest").join(wanted, "record_id")
    # A response may have most of all revisits.
    responses = responses.select(
        F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("_digest"),
        F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"),
    )
    salted = revisits.withColumn("_share", F.pmod(F.xxhash64("path", "offset"), F.lit(SALT)).cast("int"))
    met = (
        (F.col("refers_to_id") == F.col("_id")) & (F.col("_share") == F.col("_salt")) & same(F.col("payload_digest"), F.col("_digest"))
    )
    resolved = salted.join(responses, met, "left").drop("_id", "_digest", "_salt", "_share")
    others = records.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    return others.unionByName(resolved)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/llm/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), folder)
    found = read(spark, folder)
    rows = resolve(saved(found.where("record_type in ('response', 'revisit')").drop("payload"), "records"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
with p as (
  select page_id, url, coalesce(html, '') as html from pages
), d as (
  select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest, html,
    row_number() over (partition by html order by page_id desc nulls last, url) as place,
    first_value(page_id) over (partition by html order by page_id desc nulls last, url) as first_id
  from p
)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and place > 1 then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and place > 1 then first_id end as refers_to
from d
"""
