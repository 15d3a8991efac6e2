import base64
import gzip
import hashlib
import zlib

import pytest

from quarry.llm import warc

PAGES = "page_id long, url string, html string, sha1 string, archive int"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_normalise_monolithic_plain_and_mixed():
    parts = [warc.record(i, f"http://x/{i} y", f"<p>{i}</p>\r\n\r\nWARC/1.1".encode() * i, 9 if i == 3 else None) for i in range(6)]
    whole = b"".join(parts)
    for data in (gzip.compress(whole), whole, b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts[:2])) + gzip.compress(b"".join(parts[2:]))):
        for step in (1, 7, 4096):
            out, index = warc.normalise(data[i : i + step] for i in range(0, len(data), step))
            assert [gzip.decompress(out[x["offset"] : x["offset"] + x["length"]]) for x in index] == parts
            assert sum(x["length"] for x in index) == len(out) and index[0]["uri"] == "http://x/0%20y"
    assert warc.read_record(gzip.compress(parts[3])) == (3, len(b"<p>3</p>\r\n\r\nWARC/1.1" * 3), digest(b"<p>3</p>\r\n\r\nWARC/1.1" * 3), "revisit", 9)


def test_faults():
    one = warc.record(1, "u", b"body")
    for bad in (gzip.compress(one)[:-9], one[:-5], b"HTTP/1.1 200 OK\r\n\r\n", one.replace(b"Content-Length: ", b"Content-Length: 1", 1), b"WARC/1.1\r\nA: b\r\n\r\n", b"\x1f\x8b junk"):
        with pytest.raises(warc.WarcError):
            warc.normalise([bad])
    with pytest.raises(warc.WarcError):
        warc.read_record(gzip.compress(one.replace(b"body", b"BODY")))
    assert warc.normalise([]) == (b"", [])


@pytest.mark.parametrize(("size", "most"), [(300, 0), (warc.ARCHIVE, 100)])
def test_pages(spark, tmp_path, size, most, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    rows = [(1, "http://a", "same", "x", 1), (5, None, "same", "x", 1), (3, "b\n c", "same", None, None), (2, "u", None, None, None), (4, "u", "", None, None), (7, "u", "ü" * 3000, None, None), (8, "u", "alone", None, None), (8, "u", "alone", None, None), (8, "u", "other", None, None), (None, None, "nobody", None, None)]
    df = spark.createDataFrame(rows, PAGES)
    archives = warc.normalise_archives(warc.write_archives(df, size))
    got = sorted((tuple(r) for r in warc.read_archives(archives).collect()), key=str)
    want = []
    for page, _, html, *_ in rows:
        b = (html or "").encode()
        last = max((p for p, _, h, *_ in rows if (h or "").encode() == b and p is not None), default=page)
        want.append((page, len(b), digest(b), "response" if page == last else "revisit", None if page == last else last))
    assert got == sorted(want, key=str)
    warc.export(archives, str(tmp_path))
    for f in tmp_path.glob("*.warc.gz"):
        lines = f.with_name(f.name.replace(".warc.gz", ".idx")).read_text().splitlines()
        data = f.read_bytes()
        assert zlib.decompressobj(31).decompress(data).startswith(b"WARC/1.1") and len(lines) == data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")


def test_empty(spark):
    assert warc.read_archives(warc.normalise_archives(warc.write_archives(spark.createDataFrame([], PAGES)))).count() == 0
