import hashlib
import os

import pytest
from small import table

from netsift.llm import warc as W

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = "page_id long, url string, html string, rid long, size string, header int"


def pages_of():
    rows = [(i, f"http://h/{i}", f"<p>{i} é</p>" * (i % 40)) for i in range(120)]
    rows += [(200 + i, "u", "same text " * 30) for i in range(40)] + [(150, "u", "same text " * 30)]
    rows += [(300, "u", FAKE * 20), (301, "u", "x" + FAKE), (302, "u", "\r\n\r\n" + FAKE[:-4]), (303, "u", "WARC/1.0\r\n" * 50),
             (304, "u", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n")]
    rows += [(400, None, None), (401, "a\r\nWARC-Type: x", ""), (None, "n", "null id"), (402, "u", "z" * 99), (403, "u", "z" * 99),
             (404, "u", "z" * 100), (405, "u", "z" * 100), (405, "u", "z" * 100), (500, "u", "long é " * 60000), (None, "n", "z" * 100)]
    return rows


def brute(rows):
    by, out = {}, []
    for n, (i, _, h) in enumerate(rows):
        b = (h or "").encode()
        by.setdefault(b, []).append((i is None, i or 0, n))
    for n, (i, _, h) in enumerate(rows):
        b = (h or "").encode()
        first = min(by[b])
        old = len(b) >= 100 and first[2] != n
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if old else "response", rows[first[2]][0] if old else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1 << 23, 700])
def test_written_and_read_back(spark, tmp_path, size):
    """With ranges shorter than many records, chains cross several of them."""
    rows = pages_of()
    df = table(spark, tmp_path, "pages", [(*r, 1, "x", 2) for r in rows], PAGES)
    W.write_warc(df, str(tmp_path / "w"))
    got = sorted(map(tuple, W.read_pages(spark, str(tmp_path / "w"), size).collect()), key=repr)
    assert got == brute(rows)


def test_payloads_and_headers(spark, tmp_path):
    rows = pages_of()
    W.write_warc(table(spark, tmp_path, "pages", [(*r, 1, "x", 2) for r in rows], PAGES), str(tmp_path / "w"))
    got = W.read_warc(spark, str(tmp_path / "w"), 5000).where("header['warc-type'] = 'response'").collect()
    assert {bytes(r.payload) for r in got} == {(h or "").encode() for _, _, h in rows}
    raw = b"".join(f.read_bytes() for f in (tmp_path / "w").glob("part-*"))
    assert raw.count(b"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ") == len(got)
    assert raw.count(b"WARC-Type: revisit") == raw.count(f"WARC-Profile: {W.PROFILE}".encode())
    assert any(r.header["warc-target-uri"] == "a%0D%0AWARC-Type: x" for r in got if "warc-target-uri" in r.header)


def test_damaged_files(spark, tmp_path):
    d = tmp_path / "w"
    d.mkdir()
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Page-ID: %d\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    whole = b"".join(one % i for i in range(9))
    (d / "cut.warc").write_bytes(whole[:-9])
    (d / "bad.warc").write_bytes(one % 20 + b"garbage" + one % 21)
    (d / "none.warc").write_bytes(b"not an archive")
    (d / "empty.warc").write_bytes(b"")
    for size in (1 << 20, 64):
        got = sorted(int(r.header["warc-page-id"]) for r in W.read_warc(spark, str(d), size).collect())
        assert got == [*range(8), 20]


def test_revisits_of_a_lost_response(spark, tmp_path):
    """The response lies behind the damage of another file; revisits that are whole stay."""
    d = tmp_path / "w"
    d.mkdir()
    response = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%s>\r\nWARC-Page-ID: %d\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    revisit = ("WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:%s>\r\nWARC-Page-ID: %d\r\nWARC-Payload-Digest: sha256:%s\r\n%s"
               "Content-Length: 0\r\n\r\n\r\n\r\n")
    (d / "a.warc").write_text(response % ("a", 1) + "garbage" + response % ("lost", 2), newline="")
    (d / "b.warc").write_text(revisit % ("c", 3, "00ff", "WARC-Refers-To: <urn:lost>\r\n") + revisit % ("d", 4, "x", "WARC-Refers-To: <urn:a>\r\n")
                              + revisit % ("e", 5, "11ee", ""), newline="")
    digest = hashlib.sha256(b"abcd").hexdigest()
    assert sorted(map(tuple, W.read_pages(spark, str(d)).collect())) == [
        (1, 4, digest, "response", None), (3, None, "00ff", "revisit", None), (4, 4, digest, "revisit", 1), (5, None, "11ee", "revisit", None)]


def test_empty(spark, tmp_path):
    assert W.report(table(spark, tmp_path, "pages", [], PAGES)).collect() == []
    os.mkdir(tmp_path / "none")
    assert W.read_warc(spark, str(tmp_path / "none")).collect() == []


def test_payloads_of_magics_in_linear_time(spark, tmp_path):
    """Eight megabytes of first lines, and of whole headers, in a payload; a url longer than a header may be."""
    import time
    rows = [(1, "u", "WARC/1.0\r\n" * 800_000), (2, "u", "WARC/1.0\r\nA: b\r\n" * 400_000), (3, "u" * 3_000_000, FAKE * 1000), (4, "u", "x")]
    df = table(spark, tmp_path, "pages", [(*r, 1, "x", 2) for r in rows], PAGES)
    W.write_warc(df, str(tmp_path / "w"))
    for size in (1 << 23, 1 << 20):
        at = time.time()
        got = sorted(map(tuple, W.read_pages(spark, str(tmp_path / "w"), size).collect()), key=repr)
        assert got == brute(rows) and time.time() - at < 25
    data = bytearray(rows[0][2].encode())
    at = time.time()
    assert list(W._candidates(data, len(data), lambda: b"")) == [] and time.time() - at < 5
