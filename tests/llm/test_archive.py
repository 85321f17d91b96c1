import hashlib

import pytest
from llm.common import CLASHING, collected
from pyspark.sql import functions as F

from barograph.llm import archive


def lines(data):
    assert data.endswith(b"\n")
    return iter(data[:-1].split(b"\n"))


def arc(version, *records):
    out = archive.version_block(version, "x.arc") + b"\n"
    for url, kind, body in records:
        own = {"URL": url, "IP-address": "1.2.3.4", "Archive-date": "199703", "Content-type": kind}
        out += archive.header_line(version, own, len(body)) + body + b"\n"
    return out


@pytest.mark.parametrize("version", ["1", "2"])
def test_versions_and_lengths(version):
    payload = b"\x00\xff\r\n\r\nline\n\n\nWARC/1.1\r\n\r\n"
    http = b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\n" + payload
    data = arc(version, ("http://a/", "text/html", http), ("dns:a", "text/dns", b"19970101 1.2.3.4\n"))
    found = [archive.converted(r) for r in archive.arc_records(lines(data))]
    assert [r[3] for r in found] == ["warcinfo", "response", "resource"]
    assert found[1][0] == "7" and found[1][2] == "1997-03-01T00:00:00Z" and found[1][6] == payload
    assert found[1][8] == archive.sha1(payload) and found[1][9] == archive.sha1(http)
    assert len({r[10] for r in found}) == 3


def test_damage():
    with pytest.raises(ValueError):
        list(archive.arc_records(lines(arc("1") + b"http://a/ 1.2.3.4 1997 text/html\n")))
    with pytest.raises(ValueError):
        list(archive.arc_records(lines(arc("1") + b"http://a/ 1.2.3.4 1997 text/html 99\nshort\n")))


def test_round_trip(spark):
    big, other = "é" * 600, "x" * 999
    rows = [(1, "http://a b/", big), (2, None, big), (9, "u", big), (3, "u", other), (4, "u", other), (5, "u", None)]
    rows += [(6, "u", ""), (None, "u", big), (7, "u", "a\r\n\r\nb\n" * 300), (7, "u", "a\r\n\r\nb\n" * 300), (8, "", "\n" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.select("*", *[F.lit(c).alias(c) for c in CLASHING]).repartition(3)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        target = 9 if html == big and i in (1, 2) else None
        kind = "response" if target is None else "revisit"
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), kind, target))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collected(archive.archived(pages), *names) == sorted(want, key=repr)
    assert archive.archived(pages.limit(0)).collect() == []
