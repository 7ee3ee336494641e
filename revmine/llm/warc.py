"""WARC: records written as gzip members, and a splittable reader.

Writing: payloads are compared by SHA-1; of equal ones of ``min_bytes`` or more the record with the largest
id is the response, the others are revisits of it. Each task writes its records, one gzip member each, to an
archive in the shared folder and returns its name and size; only archives named by tasks that succeeded are read.

Reading: archives are cut into byte ranges that any task can scan alone. A task looks for the gzip magic in
its range, decompresses the beginning of each candidate, and takes it for a record only if WARC headers
follow and the whole member decompresses with a right CRC-32 and the announced length; a record belongs to
the range in which its member starts and is read on beyond the range's end.

Damage is never passed over in silence: ``read`` counts the records of each archive and raises ValueError where they are
fewer or more than were written, or where a payload fails its digest.

Defined cases: null html is an empty payload; a payload is held whole in its task, however long; rows that repeat the largest id with
the same payload are all responses; a null id is a response only where its group has no other; an empty table gives
an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common, rows

RANGE_BYTES, READ_BYTES = 4 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def classify(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 0, broadcast_rows: int = rows.BROADCAST_ROWS) -> DataFrame:
    """(id, url, html, refers_to): refers_to is set for revisits.

    Only digests are grouped, with maxima combined before the shuffle. A table of repeated digests beyond ``broadcast_rows``
    is met through a Bloom filter, so that only payloads that repeat are shuffled, and none of a digest with very many records.
    """
    own = pages.select(common.quoted(id_col).cast("long").alias("id"), common.quoted(url_col).cast("string").alias("url"), common.text_of(pages, payload_col).alias("html"))
    own = own.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    groups = own.filter(F.octet_length("html") >= min_bytes).groupBy(F.col("sha").alias("g")).agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = common.written(groups, common.shared_folder(pages.sparkSession, "warc"), "repeated")
    size, repeats = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    refers = F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    if size <= broadcast_rows:
        return own.join(F.broadcast(groups), F.col("sha") == F.col("g"), "left").select("id", "url", "html", refers)
    slots = bloom.slots_for(size)
    filter_ = bloom.hit(groups.select(F.xxhash64("g").alias("hash")), "hash", slots)
    marked = bloom.marked(own, F.xxhash64("sha"), filter_, slots, "may")
    most = max(1, repeats // 1000)  # at most 1,000 groups can have more rows
    hot = F.broadcast(groups.filter(F.col("n") > most).select(F.col("g").alias("h"), F.col("last").alias("hot_last")))
    met = marked.filter("may").join(hot, F.col("sha") == F.col("h"), "left")
    easy = met.filter("h is not null").withColumn("last", F.col("hot_last"))
    rest = met.filter("h is null").join(groups.filter(F.col("n") <= most), F.col("sha") == F.col("g"), "left")
    alone = marked.filter("NOT may").withColumn("last", F.lit(None).cast("long"))
    parts = [df.select("id", "url", "html", refers) for df in (alone, easy, rest)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has no block; its payload's length stands in an extension field."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"" if refers_to is not None else payload
    clean = lambda x: re.sub(r"[\x00-\x1f\x7f]", "", x)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(classified: DataFrame, folder: str) -> DataFrame:
    """Archives from (id, url, html, refers_to): (archive, bytes, records)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, count = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0

        def members() -> Iterator[bytes]:
            nonlocal count
            for some in batches:
                for page, url, html, refers_to in zip(*(some.column(c) for c in ("id", "url", "html", "refers_to"))):
                    count += 1
                    yield record(page.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py())

        size = common.write_bytes(uri, members())
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (uri, size, count)], ["archive", "bytes", "records"])

    return common.written(classified.select("id", "url", "html", "refers_to").mapInArrow(task, "archive string, bytes long, records long"), folder, "archives")


class Window:
    """The bytes of a range, and more of the file as members ask for them."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start = file, start
        file.seek(start)
        self.data = bytearray(file.read(size))

    def more(self) -> bool:
        self.file.seek(self.start + len(self.data))
        data = self.file.read(READ_BYTES)
        self.data += data
        return bool(data)

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The member that begins at byte ``at`` of the window, decompressed, and where it ends; None where none with WARC headers does."""
        unpack, out, head, now, step = zlib.decompressobj(31), [], b"", at, 1024
        try:
            while not unpack.eof:
                if now >= len(self.data) and not self.more():
                    return None
                part = self.data[now : now + step]
                now, step = now + len(part), 65_536
                out.append(unpack.decompress(part))
                if len(head) < 5:
                    head += out[-1][: 5 - len(head)]
                    if not b"WARC/".startswith(head):
                        return None
        except zlib.error:
            return None
        return b"".join(out), now - len(unpack.unused_data)


def parse(member: bytes) -> dict | None:
    """Headers and block of a record, if it is one."""
    end = member.find(b"\r\n\r\n")
    lines = member[:end].decode("utf-8", "replace").split("\r\n") if end > 0 else []
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("content-length", "")
    if not lines or not lines[0].startswith("WARC/") or not size.isdigit() or len(member) < end + 8 + int(size):
        return None
    return fields | {"block": member[end + 4 : end + 4 + int(size)]}


def scan(uri: str, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) for the records that start in a byte range; a record's own bytes are skipped."""
    system, path = common.pafs_of(uri)
    with system.open_input_file(path) as file:
        window, at = Window(file, start, end - start + len(MAGIC) - 1), 0
        while 0 <= (at := window.data.find(MAGIC, at)) < end - start:
            member = window.member(at)
            parsed = parse(member[0]) if member else None
            if parsed is None:
                at += 1
            else:
                yield start + at, parsed
                at = member[1]


def page_of(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    cut = archives.select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    return cut.select("archive", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))


def records(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records that the archives' readable members hold, whatever else is in them; payload_bytes and payload_digest are those of the full payload."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIELDS.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FIELDS.split(", ")]
        for part in (x for some in batches for x in some.to_pylist()):
            out = []
            for offset, x in scan(part["archive"], part["start"], part["end"]):
                revisit, digest, size = x["warc-type"] == "revisit", x["warc-payload-digest"].removeprefix("sha1:"), int(x["x-payload-length"])
                if not revisit:
                    size, found = len(x["block"]), base64.b32encode(hashlib.sha1(x["block"]).digest()).decode()
                    if found != digest:
                        raise ValueError(f"the payload at {offset} of {part['archive']} fails its digest")
                out.append((page_of(x["warc-record-id"]), x["warc-target-uri"], size, digest, x["warc-type"], page_of(x.get("warc-refers-to")), part["archive"], offset))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    return common.spread(ranges(archives, range_bytes), "archive", "start").mapInArrow(task, FIELDS)


def read(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As records(), written to a table in the folder (payloads stay in the archives) and held against what the writer counted."""
    found = common.written(records(archives, range_bytes), folder, "records")
    counts = found.groupBy(F.col("archive").alias("a")).agg(F.count(F.lit(1)).alias("found"))
    off = archives.join(counts, F.col("archive") == F.col("a"), "left").filter(F.coalesce("found", F.lit(0)) != F.col("records")).select("archive", "records", F.coalesce("found", F.lit(0)).alias("found")).limit(3).collect()
    if off:
        raise ValueError("records lost: " + "; ".join(f"{x['archive']} holds {x['found']} readable records of {x['records']}" for x in off))
    return found


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    folder = common.shared_folder(pages.sparkSession, "warc")
    return read(write(classify(pages, id_col, payload_col, url_col), folder), folder)
