"""WARC files that are odd or damaged: every record is returned or reported."""

import pytest

from meridio.llm import warc


def record(i: int, extra: str = "", version: str = "1.0", body: bytes | None = None) -> bytes:
    body = f"page {i} ".encode() * 20 if body is None else body
    return f"WARC/{version}\r\nWARC-Type: response\r\nX-Row-ID: {i}\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def folder(tmp_path, **files: bytes) -> str:
    for name, data in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    return f"file://{tmp_path}"


def ids(df):
    return sorted(int(r.headers["X-Row-ID"]) for r in df.collect())


@pytest.mark.parametrize("size", [2000, 8 << 20])
def test_a_header_of_any_length(spark, tmp_path, size):
    data = b"".join(record(i, "X-Long: " + "v" * 70_000 + "\r\n" if i == 1 else "") for i in range(7))
    at = folder(tmp_path, a=data)
    assert ids(warc.read_records(spark, at, range_bytes=size)) == list(range(7))
    assert warc.damages(spark, at, range_bytes=size).count() == 0


def test_old_versions_and_missing_last_line_ends(spark, tmp_path):
    at = folder(tmp_path, a=b"".join(record(i, version="0.18") for i in range(3)), b=(record(3, version="1.1") + record(4))[:-4])
    assert ids(warc.read_records(spark, at)) == list(range(5))


@pytest.mark.parametrize("size", [400, 8 << 20])
def test_damage_is_reported_and_passed_over(spark, tmp_path, size):
    parts = [record(i) for i in range(6)]
    stray = parts[0] + b"oops" + b"".join(parts[1:])  # four stray bytes
    broken = b"".join(parts[:2]) + parts[2].replace(b"Content-Length", b"Kontent-Length") + b"".join(parts[3:])
    cut = b"".join(parts)[:-100]  # the last record lacks its end
    headless = b"garbage\r\n" + b"".join(parts)
    two = parts[0] + b"x" + parts[1] + parts[2] + b"yy" + b"".join(parts[3:])
    at = folder(tmp_path, stray=stray, broken=broken, cut=cut, headless=headless, two=two, sound=b"".join(parts), empty=b"")
    with pytest.raises(ValueError, match="6 damaged stretches"):
        warc.read_records(spark, at, range_bytes=size)
    got = {}
    for r in warc.read_records(spark, at, range_bytes=size, damage="skip").collect():
        got.setdefault(r.file.rsplit("/", 1)[1][:-5], []).append((int(r.headers["X-Row-ID"]), r.recovered))
    full = [(i, False) for i in range(6)]
    assert sorted(got["sound"]) == full
    assert sorted(got["stray"]) == [(0, False)] + [(i, True) for i in range(1, 6)]
    assert sorted(got["broken"]) == [(0, False), (1, False)] + [(i, True) for i in range(3, 6)]
    assert sorted(got["cut"]) == full[:5]
    assert sorted(got["headless"]) == [(i, True) for i in range(6)]
    assert sorted(got["two"]) == [(0, False)] + [(i, True) for i in range(1, 6)]
    lost = {(r.file.rsplit("/", 1)[1][:-5], r.offset): r.bytes_lost for r in warc.damages(spark, at, range_bytes=size).collect()}
    one = len(parts[0])
    assert lost == {
        ("stray", one): 4, ("broken", 2 * one): one, ("cut", 5 * one): one - 100, ("headless", 0): 9, ("two", one): 1, ("two", 3 * one + 1): 2,
    }


def test_odd_identifiers_and_addresses_come_back(spark, tmp_path):
    rows = [("a b", "http://x/ y"), (" lead", "http://x/%20\r\n"), ("né", "http://é/?q=a+b%41"), ("%", "+"), ("", ""), (None, None), ("line\nend", "tab\t")]
    pages = spark.createDataFrame([(a, b, "<p>") for a, b in rows], "page_id string, url string, html string")
    at = f"file://{tmp_path}/out"
    warc.write_pages(pages, at)
    assert sorted(((r.page_id, r.url) for r in warc.read_pages(spark, at).collect()), key=str) == sorted(rows, key=str)
