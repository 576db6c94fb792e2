import base64
import gzip
import hashlib
import io
import os

import pytest

from logweave.llm import warc
from logweave.llm.shared import shared_folder

SCHEMA = "page_id long, url string, html string, payload string, record_type int"
HTML = [None, "", "a", "<p>é 日本 🙂</p>" * 300, "WARC/1.1\r\n\r\nnot a record", "x" * 200_000, "a", "a", "same " * 50, "same " * 50]


def rows():
    out = [(i, f"http://h.example/{i}\r\nX: y" if i == 3 else f"http://h.example/{i}", h, "p", 1) for i, h in enumerate(HTML)]
    return out + [(7, "u", "a", "p", 1), (None, None, "a", "p", 1), (None, "u", "alone", "p", 1)]


def want():
    groups = {}
    for i, _, h, *_ in rows():
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h, *_ in rows():
        ids = [x for x in groups[h or ""] if x is not None]
        top = max(ids) if ids else None
        b = (h or "").encode()
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.mark.parametrize("split", [17, 300, 4 << 20])
def test_round_trip(pages, split):
    assert sorted(map(tuple, warc.round_trip(pages, split).collect()), key=str) == want()


def test_payloads_and_urls_come_back(spark, pages):
    manifest = warc.write(pages, shared_folder(spark, "warc"))
    got = warc.read(spark, manifest, 1000).collect()
    html = {h or "" for _, _, h, *_ in rows()}
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == html
    assert {r.url for r in got if r.page_id == 3} == {"http://h.example/3%20X:%20y"}
    for path in [r.path for r in manifest.collect()]:  # a plain gzip reader sees the records in a row
        data = gzip.decompress(open(warc.filesystem(path)[1], "rb").read())
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_false_magic_is_no_record():
    record = warc.record(1, "u", b"x" * 50, 50, warc.base32_sha1(b"x" * 50), True, None)
    data = warc.MAGIC + b"junk" + warc.MAGIC + record + b"\x1f" + record[:0] + warc.MAGIC
    read = lambda at, n: data[at:at + n]
    for cut in range(0, len(data), 3):
        parts = [list(warc.records_in(read, len(data), a, b)) for a, b in ((0, cut), (cut, len(data)))]
        assert sum(map(len, parts)) == 1


def test_paths():
    assert warc.filesystem("file:/tmp/x")[1] == warc.filesystem("file:///tmp/x")[1] == warc.filesystem("/tmp/x")[1] == "/tmp/x"
    assert os.path.isabs(warc.filesystem("file:/a")[1]) and io.BytesIO


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
