"""Archives written and read back, whole and chunk by chunk."""

import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from keepwell.llm.warc_chunks import CHUNK, plan_records, read_archives, records_of, write_archives

BIG = bytes(range(256)) * 1000
PAGES = [(1, "http://a/x", BIG), (2, "http://a/y", BIG), (9, None, BIG), (3, "u", b""), (4, "u", None), (5, "a\r\nb%", b"\r\n\r\nWARC/1.1\r\n\r\n"),
         (6, "s", b"x" * 999), (7, "s", b"x" * 999), (8, "s", b"x" * 1000), (10, "s", b"x" * 1000), (11, "long", b"z" * (3 * CHUNK)),
         (9, None, BIG), (12, "é", "é\u0000".encode() * 700)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, uri string, payload binary").repartition(3)


@pytest.mark.parametrize("chunk,file_bytes", [(CHUNK, 64 << 20), (100, 200), (4096, 1)])
def test_round_trip(spark, tmp_path, chunk, file_bytes):
    folder = f"file://{tmp_path}/arc"
    responses, revisits = plan_records(frame(spark, PAGES))
    files = write_archives(responses, revisits, folder, chunk=chunk, file_bytes=file_bytes)
    rows = read_archives(files, folder, chunk=chunk).collect()
    assert files.agg({"records": "sum"}).first()[0] == len(PAGES)
    assert not [p for p in (tmp_path / "arc").iterdir() if p.name.startswith("_open")]
    parts = defaultdict(list)
    for r in rows:
        parts[r.record_id].append(r)
    by_id = {i: p or b"" for i, _, p in PAGES}
    for i, payload in by_id.items():
        got = sorted(parts[f"<urn:record:{i}>"], key=lambda r: r.chunk_no)
        if i == 9:  # the row that stands twice is written twice
            got = got[::2]
        last = got[-1]
        assert last.last and last.n_bytes == len(payload) and last.sha1 == hashlib.sha1(payload).hexdigest()
        if i in (1, 2, 8):
            assert last.record_type == "revisit" and last.refers_to == f"<urn:record:{10 if i == 8 else 9}>"
            continue
        assert last.record_type == "response" and last.intact and b"".join(r.data for r in got) == payload
        at = b""
        for r in got:
            assert len(r.data) <= chunk
            at += r.data
            assert r.n_bytes == len(at) and r.sha1 == hashlib.sha1(at).hexdigest()
    assert {r.uri for r in parts["<urn:record:5>"]} == {"a\r\nb%"}


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    files = write_archives(*plan_records(frame(spark, [])), folder)
    assert read_archives(files, folder).collect() == []


def test_plain_and_cut_off_files():
    record = (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n")
    assert [r[5] for r in records_of(io.BytesIO(record * 2), 2, True)] == [b"ab", b"c"] * 2
    packed = gzip.compress(record) + gzip.compress(record)
    assert [r[5] for r in records_of(io.BytesIO(packed), 5, True)] == [b"abc"] * 2
    with pytest.raises(EOFError):
        list(records_of(io.BytesIO(packed[:-30]), 5, True))


def test_records_of_other_writers():
    def record(kind, block, *more, length=True):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, *([b"Content-Length: %d" % len(block)] if length else []), *more]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    http, info = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\npage", b"software: x\r\nformat: WARC"
    kinds = [(b"warcinfo", info, info), (b"request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b""), (b"response", http, b"page"),
             (b"metadata", b"a: b\r\n\r\nc", b"a: b\r\n\r\nc"), (b"resource", b"", b""), (b"response", b"no blank line", b"no blank line"),
             (b"response", b"", b""), (b"conversion", b"plain\r\n\r\ntext" * 9, b"plain\r\n\r\ntext" * 9)]
    archive = b"".join(record(k, block) for k, block, _ in kinds) + record(b"response", http, b"Content-Type: text/dns")
    archive += record(b"revisit", b"") + record(b"revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n")
    for data in (archive, gzip.compress(archive)):
        rows = list(records_of(io.BytesIO(data), 7, True))
        payloads, kept = [], b""
        for r in rows:
            kept += r[5]
            if r[8]:
                payloads.append((r[1].encode(), kept))
                kept = b""
        assert payloads == [(k, p) for k, _, p in kinds] + [(b"response", http), (b"revisit", b""), (b"revisit", b"")]
        assert [r[6] for r in rows[-2:]] == [None, 12] and all(r[9] for r in rows if r[8] and r[1] != "revisit")
    with pytest.raises(ValueError, match="Content-Length"):
        list(records_of(io.BytesIO(record(b"response", http, length=False)), 7, True))
    with pytest.raises(EOFError):
        list(records_of(io.BytesIO(record(b"warcinfo", info)[:-9]), 7, True))
