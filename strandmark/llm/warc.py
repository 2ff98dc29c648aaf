"""WARC archives, and a two-level capture index over them.

Every page becomes a WARC/1.1 record in a gzip member of its own; records with a payload seen elsewhere are revisits. The
index sorts the captures by reversed-host keys into compressed blocks, and a sparse directory knows the first and last key of
each. A lookup searches the directory for its blocks, a block for its captures, and reads no more of an archive than those
ranges of bytes.

Spark's own writers and readers do all of the files: a gzip member ends with the high byte of its length, which is zero below
16 MB, so the text writer puts members one after the other with that byte as its line separator.

Fixed results: a null html is an empty payload. Of equal payloads of LEAST bytes or more, rows with the largest page_id are
responses (all of them, if that id is repeated), and the others revisits of it; null ids are below all others. A null url
has no target line and the key ''. Line breaks, tabs and NUL in a url are kept as %0A, %0D, %09 and %00. Empty tables give no
records. Columns other than page_id, url and html are never touched.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WRITING, portions, settings, shared_dir, small, written

#: Payload bytes from which equal payloads are stored once.
LEAST = 1000
#: Compressed bytes after which an archive is full, captures of a block of the index, and blocks that share an entry of the top of the directory.
ARCHIVE_BYTES, BLOCK, STRIDE = 4 << 20, 3000, 256
#: Raw bytes of a gzip member at most.
MEMBER = 8 << 20
DATE = "1970-01-01T00:00:00Z"
ESCAPED = {"\r": "%0D", "\n": "%0A", "\t": "%09", "\0": "%00"}
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_URL = re.compile(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", re.I)


def escaped(url: str) -> str:
    return re.sub(r"[\r\n\t\0]", lambda m: ESCAPED[m[0]], url)


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: the host reversed, in lower case; without scheme, user, usual ports and fragment."""
    if url is None:
        return ""
    m = _URL.match(url)
    if not m:
        return escaped(url.partition("#")[0])
    host, port, rest = m.groups()
    own = f":{port}" if port and port not in ("80", "443") else ""
    return escaped(",".join(reversed(host.lower().split("."))) + own + ")" + (rest if rest.startswith("/") else f"/{rest}"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record; a revisit, which has refers_to, holds the HTTP headers alone."""
    block = HTTP.format(len(payload)).encode() + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {escaped(url)}"] if url is not None else []
    lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def packed(raw: bytes) -> bytes:
    """gzip members of at most MEMBER bytes each, so that each ends with a zero."""
    out = []
    for a in range(0, len(raw), MEMBER):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(z.compress(raw[a : a + MEMBER]) + z.flush())
    return b"".join(out)


def unpacked(data) -> bytes:
    """The members of some bytes, one after the other."""
    return b"".join(raw for _, raw in members(data))


def members(data):
    """(end, bytes) of each gzip member."""
    view, at, step = memoryview(data), 0, 1 << 16
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            piece = view[at : at + step]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield at, b"".join(out)


def records(data):
    """(offset, length, headers, block) of each record of an archive; headers are a dict, a block is what Content-Length says."""
    start, raw = 0, b""
    for end, part in members(data):
        raw = raw + part if raw else part
        head, found, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]) if found else {}
        size = int(fields.get("Content-Length", -1))
        if not found or len(rest) < size + 4:
            continue  # goes on in the next member
        yield start, end - start, fields, rest[:size]
        start, raw = end, b""
    if raw:
        raise ValueError("an archive ends within a record")


def _id(name: str | None) -> int | None:
    found = re.search(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def write_archives(pages: DataFrame, path: str | None = None) -> str:
    """Writes the pages as WARC files (archive=N/*, gzip members) under the path, by default in the shared folder; gives the path.

    What is stored once is settled by digests: only those of several pages are joined back, by broadcast if they are few.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    shared = rows.where(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(shared, "shared")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).cast("bigint")

    def store(batches):
        task, number, held = TaskContext.get().partitionId(), 0, 0
        for batch in portions(batches, 64):
            out, archive = [], []
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url, html, digest, first = row
                out.append(packed(record(page_id, url, html.encode(), digest, first))[:-1])
                archive.append(task << 24 | number)
                held += len(out[-1])
                if held >= ARCHIVE_BYTES:
                    number, held = number + 1, 0
            yield pa.RecordBatch.from_pydict({"archive": pa.array(archive, pa.int64()), "data": pa.array(out, pa.binary())})

    with settings(spark, **WRITING):
        made = rows.join(small(shared), "digest", "left").select("page_id", "url", "html", "digest", refers_to.alias("refers_to")).mapInArrow(store, "archive bigint, data binary")
        made.select("archive", F.col("data").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\0").text(path)
    return path


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the files of write_archives(); one is about ARCHIVE_BYTES, or one record."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", r"archive=(\d+)/[^/]*$", 1).cast("bigint").alias("archive"), "content")


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """(block, first_key, last_key, n, data) of the captures of all archives in the order of their keys, a table.

    data is a compressed block of lines: key, archive, offset and length, with tabs between.
    """

    def scan(batches):
        for batch in batches:
            for archive, content in zip(batch["archive"].to_pylist(), batch["content"], strict=True):
                found = [(url_key(h.get("WARC-Target-URI")), start, size) for start, size, h, _ in records(content.as_buffer())]
                keys, starts, sizes = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "archive": pa.array([archive] * len(keys), pa.int64()), "start": pa.array(starts, pa.int64()), "size": pa.array(sizes, pa.int64())})

    def pack(batches):
        task, number, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            lines = "\n".join("\t".join(map(str, x)) for x in held)
            one = {"block": [task << 32 | number], "first_key": [held[0][0]], "last_key": [held[-1][0]], "n": [len(held)], "data": [zlib.compress(lines.encode())]}
            return pa.RecordBatch.from_pydict(one)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "archive", "start", "size")), strict=True):
                held.append(row)
                if len(held) == BLOCK:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    captures = written(archives(spark, path).mapInArrow(scan, "key string, archive bigint, start bigint, size bigint"), "captures")
    order = ["key", "archive", "start"]
    return written(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "block bigint, first_key string, last_key string, n bigint, data binary"), "index")


def top_of(index: DataFrame) -> list[str]:
    """First keys of every STRIDE-th block, in order; one for BLOCK * STRIDE captures, and more apart where that were over 100,000."""
    n = index.count()
    stride = max(STRIDE, n // 100_000)
    if n <= stride:
        return []
    # by hash instead of by rank: no order over all blocks is needed, only cuts that lie about evenly
    return sorted(r[0] for r in index.where(F.pmod(F.xxhash64("block"), F.lit(stride)) == 0).select("first_key").distinct().collect())


def lookup(index: DataFrame, urls: DataFrame) -> DataFrame:
    """(key, archive, start, size) of the captures of urls(url), by their keys; a capture once, however often its url is asked for."""
    cuts = top_of(index)

    def keyed(batches):
        for batch in portions(batches, 4096):
            keys = sorted({url_key(x) for x in batch["url"].to_pylist()})
            yield pa.RecordBatch.from_pydict({"slot": pa.array([bisect.bisect_right(cuts, k) for k in keys], pa.int64()), "key": pa.array(keys, pa.string())})

    def directory(batches):
        for batch in batches:
            rows = [(slot, first, last, block) for first, last, block in zip(*(batch[c].to_pylist() for c in ("first_key", "last_key", "block")), strict=True) for slot in range(bisect.bisect_right(cuts, first), bisect.bisect_right(cuts, last) + 1)]
            slots, firsts, lasts, blocks = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slots, pa.int64()), "first_key": pa.array(firsts, pa.string()), "last_key": pa.array(lasts, pa.string()), "block": pa.array(blocks, pa.int64())})

    def find(asked: pa.Table, part: pa.Table) -> pa.Table:
        part = part.sort_by([("first_key", "ascending"), ("last_key", "ascending")])
        first, last, block = (part[c].to_pylist() for c in ("first_key", "last_key", "block"))
        keys, at = [], []
        for key in asked["key"].to_pylist():
            # blocks are in order and don't overlap but in their ends, so those that hold a key are neighbours
            for i in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                keys.append(key)
                at.append(block[i])
        return pa.table({"block": pa.array(at, pa.int64()), "key": pa.array(keys, pa.string())})

    def search(asked: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        for data in block["data"].to_pylist():
            lines = [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]
            held = [x[0] for x in lines]
            for key in asked["key"].to_pylist():
                out += lines[bisect.bisect_left(held, key) : bisect.bisect_right(held, key)]
        keys, *rest = zip(*out, strict=True) if out else ((),) * 4
        return pa.table({"key": pa.array(keys, pa.string())} | {c: pa.array(map(int, x), pa.int64()) for c, x in zip(("archive", "start", "size"), rest, strict=True)})

    asked = urls.select("url").distinct().mapInArrow(keyed, "slot bigint, key string").distinct()
    parts = index.select("first_key", "last_key", "block").mapInArrow(directory, "slot bigint, first_key string, last_key string, block bigint")
    found = asked.groupBy("slot").cogroup(parts.groupBy("slot")).applyInArrow(find, "block bigint, key string")
    return found.groupBy("block").cogroup(index.select("block", "data").groupBy("block")).applyInArrow(search, "key string, archive bigint, start bigint, size bigint")


def fetch(spark: SparkSession, path: str, captures: DataFrame, payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of captures(archive, start, size), read from their ranges of the archives; a table.

    With payload, also the bytes of responses, null for revisits. A response whose bytes don't have its digest is an error.
    """
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if payload else "")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")[: 7 if payload else 6]

    def parse(head: dict, block: bytes) -> tuple:
        http, _, body = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http + b"\r\n")[1])
        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
        if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
            raise ValueError(f"{head['WARC-Record-ID']}: its bytes aren't those of its digest")
        return _id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, kind, _id(head.get("WARC-Refers-To")), body if kind == "response" else None

    def read(batches):
        for batch in batches:
            for content, ranges in zip(batch["content"], batch["ranges"].to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                ranges.sort(key=lambda r: r["start"])
                for a in range(0, len(ranges), 256):
                    rows = [parse(h, b) for r in ranges[a : a + 256] for _, _, h, b in records(data[r["start"] : r["start"] + r["size"]])]
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, v, k in zip(names, zip(*(r[: len(names)] for r in rows), strict=True), kinds, strict=False)})

    wanted = captures.groupBy("archive").agg(F.collect_list(F.struct("start", "size")).alias("ranges"))  # no more than an archive holds
    wanted = written(wanted, "wanted")
    return written(archives(spark, path).join(small(wanted), "archive").select("content", "ranges").mapInArrow(read, schema), "records")


def stored(pages: DataFrame) -> DataFrame:
    """fetch() of all pages: written as archives, indexed, looked up by their urls and read back."""
    spark = pages.sparkSession
    path = write_archives(pages)
    return fetch(spark, path, lookup(build_index(spark, path), pages.select("url")))


def replayed(found: DataFrame) -> DataFrame:
    """fetch(payload=True) with the payloads of revisits filled in from what they refer to, as far as that was fetched too."""
    own = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("_own"))
    return found.join(own, ["refers_to", "payload_digest"], "left").withColumn("payload", F.coalesce("payload", "_own")).select(found.columns)
