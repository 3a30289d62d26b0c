import hashlib
import io

import pytest
import zstandard

from tidewell.llm import warc
from tidewell.llm.files import open_input

PAGE = "<html><body>" + "lorem ipsum " * 30 + "</body></html>"


@pytest.fixture
def pages(spark):
    rows = [
        (5, "http://a/5", PAGE), (3, "http://a/3", PAGE), (9, None, PAGE), (1, "http://a/1", "short"), (2, "http://a/2", "short"), (4, "http://a/4", None),
        (6, "http://a/6\r\nX: y", ""), (None, "http://a/n", PAGE), (None, None, None), (7, "http://a/7", "é🙂" * 60), (7, "http://a/7", "é🙂" * 60),
        (8, "http://a/8", "<p>" + "word " * 60_000),
    ]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, first string")


def brute(rows):
    out = []
    for r in rows:
        raw = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "").encode() == raw and x.page_id is not None]
        first = min(same) if len(raw) >= 100 and same else None
        again = first is not None and r.page_id != first
        out.append((r.page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_round_trip(pages):
    archives = warc.archive(pages)
    found = [tuple(r) for r in warc.read(archives).collect()]
    assert sorted(found, key=repr) == brute(pages.collect())
    assert sum(r.records for r in archives.collect()) == pages.count()


def test_format(pages):
    one = pages.coalesce(1)
    archives = warc.archive(one).collect()
    with open_input(archives[0].uri) as stream:
        raw = stream.read()
    assert raw[:4] == b"\x5d\x2a\x4d\x18"
    size = int.from_bytes(raw[4:8], "little")
    made = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    body = io.BytesIO(raw[8 + size :])
    whole = zstandard.ZstdDecompressor(dict_data=made).stream_reader(body, read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ") and whole.count(b"WARC/1.1\r\n") == archives[0].records
    assert b"X: y\r\n" not in whole  # an address cannot add a field
    records = list(warc.frames(io.BytesIO(raw), block=50))
    assert b"".join(records) == whole
    fields, http, payload = warc.parse(records[0])
    assert int(fields["Content-Length"]) >= len(payload) and http["Content-Type"].startswith("text/html")


def test_dictionary_helps(spark):
    rows = [(i, f"http://h/{i}", f"<html><head><title>Page {i * 7919}</title><link rel=stylesheet href=/site.css></head><body>{i * i} items</body></html>") for i in range(600)]
    archives = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    alone = sum(len(zstandard.compress(warc.record(i, u, h.encode(), "0" * 64, None))) for i, u, h in rows)
    assert sum(a.bytes for a in archives) < 0.8 * alone


def test_damage_is_noticed(pages):
    uri = warc.archive(pages.coalesce(1)).first().uri
    with open_input(uri) as stream:
        raw = stream.read()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(io.BytesIO(raw[:-5])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"\0" * 20)))


def test_rolls_and_empty(pages, monkeypatch):
    assert warc.read(warc.archive(pages.where("false"))).count() == 0
