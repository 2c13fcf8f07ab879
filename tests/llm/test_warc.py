"""WARC: round trip, and recovery after damage."""

import base64
import hashlib
import random
import zlib

import pytest

from millrace.llm import warc
from millrace.llm.common import shared_dir

PAGES = "page_id long, url string, html string, sha1 string, owner long"


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    owner = {}
    for i, _, html, *_ in rows:
        if i is not None:
            owner[html or ""] = max(i, owner.get(html or "", i))
    out = []
    for i, _, html, *_ in rows:
        data, own = (html or "").encode(), owner.get(html or "")
        revisit = own is not None and own != i and len(data) >= least
        out.append((i, len(data), sha(data), "revisit" if revisit else "response", own if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, file_bytes", [(0, 16_000_000), (5, 2000)])
def test_round_trip(spark, least, file_bytes):
    rnd = random.Random(2)
    rows = [(i, f"http://a/{i} b", rnd.choice([None, "", "same", f"page {i} é🙂" * rnd.randint(1, 300)]), "x", 1) for i in range(120)]
    rows += [rows[7], (None, None, "same", "x", 1), (None, "u", "alone", "x", 1)]
    folder = shared_dir(spark, "warc")
    files = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), folder, least_bytes=least, file_bytes=file_bytes).collect()
    assert sum(f["records"] for f in files) == len(rows)
    read = warc.read_warc(spark, folder).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read), key=str)
    assert got == expected(rows, least)
    assert all(sha(bytes(r["payload"])) == r["payload_digest"] for r in read if r["record_type"] == "response")


def test_shuffle_join_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, "u", f"p{i % 4}", "x", 1) for i in range(20)]
    folder = shared_dir(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, PAGES), folder)
    assert sorted(r["record_type"] for r in warc.read_warc(spark, folder).collect()) == ["response"] * 4 + ["revisit"] * 16


def member(i, plain):
    payload = f"payload {i} ".encode() * (i % 17)
    raw = warc.record(i, "http://a", payload, hashlib.sha1(payload).digest(), None, "2024-01-01T00:00:00Z")
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return raw if plain else c.compress(raw) + c.flush()


@pytest.mark.parametrize("seed", range(8))
def test_salvage_recovers_all_other_records(seed):
    rnd = random.Random(seed)
    parts = [member(i, rnd.random() < 0.4) for i in range(60)]
    starts = [sum(map(len, parts[:i])) for i in range(60)]
    data, hurt = bytearray(b"".join(parts)), set(rnd.sample(range(60), 6))
    for i in sorted(hurt, reverse=True):
        a, n = starts[i], len(parts[i])
        if rnd.random() < 0.5:
            data[a + n // 2] ^= 0x55
        else:
            del data[a + n // 3 : a + n // 2]
    found = list(warc.salvage(bytes(data)))
    ids = [warc._page(h["warc-record-id"]) for _, _, h, _ in found if h]
    assert set(range(60)) - set(ids) <= hurt and ids == sorted(ids) and len(ids) >= 54
    assert found[0][0] == 0 and found[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(found, found[1:]))


def test_junk_and_nothing(spark):
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"WARC/1.1 junk")) == [(0, 13, None, None)]
    folder = shared_dir(spark, "warc")
    assert warc.write_warc(spark.createDataFrame([], PAGES), folder).collect() == [] and warc.read_warc(spark, folder).collect() == []


def test_gaps_are_logged(spark, tmp_path):
    good = member(1, False)
    (tmp_path / "x.warc.gz").write_bytes(good[:-9] + good)
    rows = sorted((r["start"], r["end"], r["record_type"]) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert rows == [(0, len(good) - 9, "gap"), (len(good) - 9, 2 * len(good) - 9, "response")]


def zipped(raw):
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def test_several_records_in_a_member():
    """All are found, also behind a damaged one in the same member; the member's other bytes are gaps."""
    raw = [member(i, True) for i in range(12)]
    hurt = bytearray(raw[5])
    hurt[len(hurt) // 2] ^= 0x55
    data = zipped(b"".join(raw[:3])) + b"junk" + zipped(b"".join([*raw[3:5], bytes(hurt), *raw[6:9]])) + raw[9] + zipped(raw[10] + raw[11] + b"tail")
    found = list(warc.salvage(data))
    assert [warc._page(h["warc-record-id"]) for _, _, h, _ in found if h] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert sum(h is None for _, _, h, _ in found) == 3


def test_records_without_digest_and_of_other_types(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:5>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(info + plain)
    rows = sorted((r["record_type"], r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert rows == [("response", 5, 5, sha(b"hello")), ("warcinfo", None, 3, sha(b"abc"))]
