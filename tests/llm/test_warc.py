"""Archives: what is written is read again, and damage costs only the damaged records."""

import io

import pytest

from clausegrid.llm import warc


class Bytes:
    """The part of a random-access file that the reader uses."""

    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def archive(gzip, n=6):
    import gzip as gz
    import hashlib

    parts = []
    for i in range(n):
        payload = f"<p>{i}</p>".encode() * (40 + i)
        data = warc.record_bytes(i, f"http://x/{i}\n", payload, len(payload), hashlib.sha256(payload).hexdigest(), None)
        parts.append(gz.compress(data) if gzip else data)
    return parts


def read(data):
    rows = list(warc.salvage(Bytes(data), len(data)))
    pages = [r["page_id"] for r in rows if r["kind"] == "record"]
    gaps = [(r["offset"], r["length"]) for r in rows if r["kind"] == "gap"]
    return pages, gaps


@pytest.mark.parametrize("gzip", [True, False])
def test_whole(gzip):
    assert read(b"".join(archive(gzip))) == ([0, 1, 2, 3, 4, 5], [])
    assert read(b"") == ([], [])


@pytest.mark.parametrize("gzip", [True, False])
def test_flipped_cut_and_strange_bytes(gzip):
    parts = archive(gzip)
    size = [len(p) for p in parts]
    bad = bytearray(parts[1])
    bad[len(bad) - 15] ^= 0xFF
    assert read(parts[0] + bytes(bad) + parts[2]) == ([0, 2], [(size[0], size[1])])
    cut = parts[3][: size[3] // 2]
    assert read(cut + parts[4]) == ([4], [(0, len(cut))])
    assert read(parts[0] + cut) == ([0], [(size[0], len(cut))])
    junk = b"\x1f\x8b\x08 WARC/1.x junk \r\n"
    assert read(junk + parts[0] + junk + parts[5] + junk) == (
        [0, 5], [(0, len(junk)), (len(junk) + size[0], len(junk)), (2 * len(junk) + size[0] + size[5], len(junk))]
    )


def test_every_cut_loses_one_record_at_most():
    parts = archive(True, 3)
    whole = b"".join(parts)
    for k in range(0, len(whole), 7):
        pages, gaps = read(whole[:k] + whole[k + 5 :])
        assert len(pages) >= 1 and len(gaps) <= 1


def test_rows(spark, tmp_path):
    long = "x" * 150
    rows = [
        (5, "u", long, 1), (3, None, long, 2), (9, "u\r\nq", long, 3), (None, "n", long, 4), (7, "s", "short", 5),
        (8, "s", "short", 6), (1, "e", None, 7), (2, "e", "", 8), (3, "again", long, 9), (None, None, "é" * 80, 10), (4, "big", "ab" * 600_000, 11),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int")
    got = sorted(((r.page_id is None, r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect()), key=repr)
    want = [
        (False, 5, 150, "revisit", 3), (False, 3, 150, "response", None), (False, 9, 150, "revisit", 3), (True, None, 150, "revisit", 3),
        (False, 7, 5, "response", None), (False, 8, 5, "response", None), (False, 1, 0, "response", None), (False, 2, 0, "response", None),
        (False, 3, 150, "response", None), (True, None, 160, "response", None), (False, 4, 1_200_000, "response", None),
    ]
    assert got == sorted(want, key=repr)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_payloads_come_back(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<b>{i}</b>" * i) for i in range(50)], "page_id long, url string, html string")
    index = warc.write_archives(pages, gzip=False)
    back = warc.read_archives(index.select("file").distinct())
    assert {r.page_id: bytes(r.payload).decode() for r in back.collect()} == {i: f"<b>{i}</b>" * i for i in range(50)}


def test_reader_takes_pyarrow_files():
    import pyarrow as pa

    data = b"".join(archive(True))
    with pa.BufferReader(io.BytesIO(data).read()) as source:
        assert sum(r["kind"] == "record" for r in warc.salvage(source, source.size())) == 6
