"""Archives: written by tasks, read in splits, against the plain rules and Python's gzip."""

import gzip
import hashlib
import io
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracefold.llm import warc

SCHEMA = "page_id long, url string, html string, path string, offset int, row string"


def expected(pages):
    out = []
    for page_id, url, html, *_ in pages:
        payload = (html or "").encode()
        out.append([page_id, len(payload), hashlib.sha1(payload).hexdigest(), "response", None, url or ""])
    groups = {}
    for row in out:
        if row[1] >= 1000:
            groups.setdefault(row[2], []).append(row)
    for rows in groups.values():
        rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[5]))
        for row in rows[1:]:
            row[3], row[4] = "revisit", rows[0][0]
    return sorted((tuple(r[:5]) for r in out), key=str)


def pages(n=120):
    rng = random.Random(1)
    same = ["<p>" + "äx" * 700, "y" * 999, "z" * 1000, "é" * 500]
    rows = [(i, f"http://x.org/{i} ü\n", rng.choice(same) if i % 3 else f"<b>{i}" + "w" * rng.randrange(3000), "a", 1, "r") for i in range(n)]
    rows += [(900, None, None, "a", None, None), (901, "", "", "a", 1, "r"), (902, "u", "q" * 1_500_000, None, 1, "r"), (903, "v", "q" * 1_500_000, None, 1, "r")]
    rows += [(None, "n", same[0], "a", 1, "r"), (None, "n", "only here" * 200, "a", 1, "r"), (None, "m", "only here" * 200, "a", 1, "r")]
    rows += [(950, "b", "t" * 2000, "a", 1, "r"), (950, "a", "t" * 2000, "a", 1, "r"), (940, "a", "t" * 2000, "a", 1, "r")]
    rows += [(960, "e", "equal" * 300, "a", 1, "r")] * 3 + [(959, "e", "equal" * 300, "a", 1, "r")] + [(970, "s", "short", "a", 1, "r")] * 2
    return rows + [(-5, "neg", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 100, "a", 1, "r"), ((1 << 63) - 1, "max", "h", "a", 1, "r")]


@pytest.mark.parametrize("split", [1 << 25, 700, 64])
def test_rows(spark, tmp_path, split):
    rows = pages()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    folder = f"{tmp_path}/a b"
    written = warc.write(frame, folder)
    assert written.agg(F.sum("records")).head()[0] == len(rows)
    found = warc.read(spark, folder, payload=True, split=split).where("record_type <> 'warcinfo'")
    got = warc.resolve(found)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == expected(rows)
    assert found.where("record_type = 'response' and not sound").count() == 0
    kept = {(r["page_id"], r["payload"].decode()) for r in found.where("record_type = 'response'").collect()}
    assert kept <= {(r[0], r[2] or "") for r in rows}
    assert found.select("record_id").distinct().count() == len(rows)
    assert found.where("url = 'http://x.org/7%20%C3%BC%0A'").count() == 1


def test_shuffled_plan_is_the_same(spark, monkeypatch):
    rows = pages(40)
    frame = spark.createDataFrame(rows, SCHEMA)
    there = lambda: sorted(map(str, warc.plan(frame).collect()))
    broadcast = there()
    monkeypatch.setattr(warc, "BROADCAST_COPIES", 0)
    assert there() == broadcast


def test_archives_are_plain_gzip(spark, tmp_path):
    rows = pages(10)
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path))
    (file,) = [p for p in tmp_path.iterdir() if p.name.endswith(".warc.gz")]
    content = gzip.decompress(file.read_bytes())
    records = 0
    while content:
        head, _, rest = content.partition(b"\r\n\r\n")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head).group(1))
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest[size : size + 4] == b"\r\n\r\n"
        content = rest[size + 4 :]
        records += 1
    assert records == len(rows) + 1


def archive(number=30):
    """An archive with bytes between members, foreign members, magic in payloads and a last record cut short."""
    rng = random.Random(3)
    out, starts = io.BytesIO(), []
    for k in range(number):
        if k % 5 == 1:
            out.write(b"\0" * rng.randrange(9))
        if k % 5 == 2:
            out.write(warc.MAGIC + b"junk")
        if k % 5 == 3:
            out.write(gzip.compress(b"no record"))
        starts.append(out.tell())
        body = warc.MAGIC * 5 + rng.randbytes(rng.randrange(400)) + gzip.compress(b"WARC/1.0\r\n\r\n")
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{k}>\r\nX-Page-ID: {k}\r\n folded\r\ncontent-length: {len(body)}\r\n\r\n"
        whole = gzip.compress(head.encode() + body + b"\r\n\r\n", compresslevel=k % 2 * 9)
        out.write(whole if k < number - 1 else whole[:-9])
    return out.getvalue(), starts[:-1]


@pytest.mark.parametrize("split", [1, 17, 100, 1000, 1 << 20])
def test_every_record_has_one_owner(split):
    content, starts = archive()
    file = pa.BufferReader(content)
    found = [r["offset"] for at in range(0, len(content), split) for r in warc.read_range(file, at, at + split)]
    assert sorted(set(found)) == sorted(found)
    assert set(starts) <= set(found)
    # With level 0 the inner archive member stands in the file byte by byte, as a member of its own; it has no length and is none.
    assert found == starts


def test_damaged_record_is_passed_over():
    content, starts = archive()
    damaged = bytearray(content)
    damaged[starts[4] + 60] ^= 255
    found = [r["offset"] for r in warc.read_range(pa.BufferReader(bytes(damaged)), 0, len(damaged))]
    assert [s for s in starts if s != starts[4]] == found


def test_digests():
    hex_digest = hashlib.sha1(b"x").hexdigest()
    assert warc.digest_of(warc.digest_field(hex_digest)) == hex_digest == warc.digest_of("SHA1:" + hex_digest.upper())
    assert warc.digest_of("md5:00") is None and warc.digest_of("sha1:??") is None


def test_query(spark, tmp_path):
    rows = pages(50)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op13_warc(spark, str(tmp_path))
    assert got.dtypes == [
        ("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint"),
    ]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op13_warc(spark, f"{tmp_path}/none").count() == 0
