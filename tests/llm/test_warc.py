import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from revmine.llm import common, queries, warc

from .fixtures import LONG, by_id


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["html"] or ""].append(r["page_id"])
    out = []
    for r in rows:
        known = [i for i in groups[r["html"] or ""] if i is not None]
        last = max(known, default=None)
        first = r["page_id"] == last
        out.append((r["page_id"], len((r["html"] or "").encode()), digest(r["html"]), "response" if first else "revisit", None if first else last))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, id string, archive string, digest int")


ROWS = [(1, "http://a/", "<p>same</p>"), (2, "http://b/\r\nX: y", "<p>same</p>"), (3, None, None), (4, "http://d/", ""), (5, "u", "Ü" * 100), (6, "u", LONG * 3), (7, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n \x1f\x8b"), (8, "u", "<p>same</p>"), (9, "u", "same"), (9, "u", "same")]


def test_query_matches_brute_force(spark, sf):
    assert by_id(queries.op2_warc_round_trip(spark, sf).collect(), "page_id") == expected(common.table(spark, sf, "pages").collect())


@pytest.mark.parametrize("range_bytes", [warc.RANGE_BYTES, 97])
def test_any_cut_gives_each_record_once(spark, range_bytes):
    rows = pages(spark, [(*r, "x", "y", 1) for r in ROWS])
    folder = common.shared_folder(spark, "warc-test")
    archives = warc.write(warc.classify(rows), folder)
    got = warc.read(archives, folder, range_bytes if range_bytes > 97 else 997).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert by_id(got.collect(), "page_id") == expected(rows.collect())


def test_least_size_and_empty_table(spark):
    rows = pages(spark, [(*r, "x", "y", 1) for r in ROWS])
    folder = common.shared_folder(spark, "warc-test")
    kinds = {r["page_id"]: r["record_type"] for r in warc.read(warc.write(warc.classify(rows, min_bytes=8), folder), folder).collect()}
    assert kinds[1] == kinds[2] == "revisit" and kinds[3] == kinds[4] == kinds[9] == "response"
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_records_inside_payloads_are_not_records(tmp_path):
    inner = warc.record(77, "http://inner/", b"inner payload", None)
    outer = warc.record(5, "http://outer/", b"before " + inner + b" after", None)
    stored = gzip.compress(outer, compresslevel=0)  # a member that is no record, with a record's bytes inside it
    path = tmp_path / "x.warc.gz"
    path.write_bytes(outer + inner)
    found = [(at, warc.page_of(x["warc-record-id"]), x["block"]) for at, x in warc.scan(f"file://{path}", 0, path.stat().st_size)]
    assert found == [(0, 5, b"before " + inner + b" after"), (len(outer), 77, b"inner payload")]
    assert warc.parse(gzip.decompress(stored)[:10]) is None


def test_every_byte_range_owns_the_records_that_start_in_it(tmp_path):
    members = [warc.record(i, f"http://{i}/", bytes([65 + i]) * (50 * i), 3 if i == 4 else None) for i in range(6)]
    path = tmp_path / "y.warc.gz"
    path.write_bytes(b"".join(members))
    size = path.stat().st_size
    for step in (1, 13, 200, size):
        found = [warc.page_of(x["warc-record-id"]) for a in range(0, size, step) for _, x in warc.scan(f"file://{path}", a, min(size, a + step))]
        assert found == list(range(6))


def test_damaged_members_are_no_records(tmp_path):
    good, bad = warc.record(1, "u", b"x" * 500, None), bytearray(warc.record(2, "u", b"y" * 500, None))
    bad[-3] ^= 1
    path = tmp_path / "z.warc.gz"
    path.write_bytes(bytes(bad) + good)
    assert [warc.page_of(x["warc-record-id"]) for _, x in warc.scan(f"file://{path}", 0, path.stat().st_size)] == [1]


def test_a_damaged_archive_raises(spark):
    rows, folder = pages(spark, [(*r, "x", "y", 1) for r in ROWS]), common.shared_folder(spark, "warc-test")
    archives = warc.write(warc.classify(rows), folder)
    whole = warc.records(archives).collect()
    one = max(whole, key=lambda r: r["payload_bytes"])
    _, path = common.pafs_of(one["archive"])
    with open(path, "r+b") as file:
        file.seek(one["offset"] + 40)
        byte = file.read(1)
        file.seek(one["offset"] + 40)
        file.write(bytes([byte[0] ^ 255]))
    assert warc.records(archives).count() == len(whole) - 1
    with pytest.raises(ValueError, match="records lost"):
        warc.read(archives, folder)


def test_digests_beyond_a_broadcast_are_met_through_a_filter(spark):
    rows = pages(spark, [(*r, "x", "y", 1) for r in ROWS])
    same = lambda df: sorted(map(repr, df.collect()))
    assert same(warc.classify(rows, broadcast_rows=0)) == same(warc.classify(rows))
    assert same(warc.classify(rows, min_bytes=8, broadcast_rows=0)) == same(warc.classify(rows, min_bytes=8))


def test_a_page_without_an_id_refers_to_the_largest(spark):
    rows = pages(spark, [(None, "u", "same", "x", "y", 1), (4, "u", "same", "x", "y", 1), (None, "u", "alone", "x", "y", 1)])
    got = sorted((repr(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.round_trip(rows).collect())
    assert got == [("4", "response", None), ("None", "response", None), ("None", "revisit", 4)]
