import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revmine.llm import common, ogg, queries

from .fixtures import awkward, empty


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_page_checksum(data):
    assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [1, 64, 254, 255, 256, 4095, 4096, 4097, 65_280, 65_536, 300_000])
def test_round_trip_and_timestamps(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    read = ogg.read_media(ogg.write_media(payload))
    assert read.payload == payload and read.rate == ogg.RATE and read.seconds == n / ogg.RATE
    assert read.times[-1] == n / ogg.RATE and read.times == sorted(read.times)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 140_000), min_size=1, max_size=4))
def test_packets_over_many_pages(sizes):
    stream, end, packets = ogg.Stream(9), 0, []
    for n in sizes:
        end += n
        packets.append((bytes([n % 256]) * n, end))
    media = b"".join(stream.pages(packets, first=True, last=True))
    assert [x.data for x in ogg.demultiplex(media)[9]] == [d for d, _ in packets]
    assert all(len(p.lacing) <= 255 for p in ogg.read_pages(media))


def test_damage_is_found():
    media = ogg.write_media(bytes(range(256)) * 400)
    with pytest.raises(ValueError, match="checksum"):
        ogg.read_media(media[:9000] + bytes([media[9000] ^ 1]) + media[9001:])
    pages = [ogg.page_bytes(p) for p in ogg.read_pages(media)]
    with pytest.raises(ValueError, match="broken"):
        ogg.read_media(b"".join(pages[:3] + pages[4:]))
    with pytest.raises(ValueError, match="last page"):
        ogg.read_media(b"".join(pages[:-1]))
    with pytest.raises(ValueError):
        ogg.read_media(media[:-5])


def expected(text):
    data = (text or "").encode()
    payload = data + bytes(-len(data) % 64 if data else 64)
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def check(docs, got):
    want = sorted(((r["doc_id"], *expected(r["text"])) for r in docs), key=repr)
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=repr) == want
    media = {}
    for r in got:
        media.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in media.values())


def test_awkward_table_and_query(spark, sf):
    docs = awkward(spark)
    check(docs.collect(), ogg.round_trip(docs).collect())
    check(common.table(spark, sf, "documents").collect(), queries.op10_ogg_media(spark, sf).collect())
    assert ogg.round_trip(empty(spark)).collect() == []


def test_stored_form_is_what_the_digest_says(spark):
    docs = awkward(spark)
    stored = {r["doc_id"]: bytes(r["media"]) for r in ogg.encode(docs).collect()}
    for r in ogg.round_trip(docs).collect():
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[r["doc_id"]]), hashlib.sha256(stored[r["doc_id"]]).hexdigest())
