"""Web archives packaged as ZIP: written by tasks, read by range without extraction.

An archive is a ZIP file with stored members: ``archive/data.warc.gz``, in which
each record is a gzip member of its own, ``indexes/index.cdxj``, a line of JSON
with file, offset and length for each record, and ``datapackage.json``, which
lists both. The reader takes archives of others too, with several data members,
CDX or CDXJ indexes, compressed or not, or none. It parses the end record, the
ZIP64 end record and the central directory, finds where the stored members begin,
reads the indexes, and then single records by their byte range; data without an
index is read through by pieces. Nothing is unpacked to disk, and files are
opened through the filesystem that their URI names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, shared_dir
from quarrylens.operators.lineage import register

#: An archive is closed at so many bytes; records below this payload are never revisits.
ARCHIVE_BYTES, LEAST_REVISIT = 16 << 20, 100
DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
_INDEX = re.compile(r"(?i)(?:\A|/)[^/]+\.cdxj?(?:\.gz)?\Z")
_DATA = re.compile(r"(?i)\.warc(?:\.gz)?\Z")
#: Bytes of an archive that are read at once where it has no index.
PIECE = 1 << 18
CRLF = b"\r\n"


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def render(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, whose length is that of the full payload, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if kind == "response":
        block += payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A").strip()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Target-URI: {clean}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return CRLF.join(x.encode("utf-8", "surrogatepass") for x in head) + 2 * CRLF + block + 2 * CRLF


def package(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP archive of the compressed records, their index and a description, all stored; sizes and offsets are kept as ZIP64."""
    out, at, lines, data = io.BytesIO(), 0, [], hashlib.sha256()
    for name, body in records:
        about = {"url": name, "filename": DATA.rsplit("/", 1)[1], "offset": str(at), "length": str(len(body))}
        lines.append(f"{name} 20000101000000 {json.dumps(about)}\n")
        data.update(body)
        at += len(body)
    index = "".join(lines).encode()
    listed = [{"name": p.rsplit("/", 1)[1], "path": p, "hash": f"sha256:{h}", "bytes": n} for p, h, n in ((DATA, data.hexdigest(), at), (INDEX, hashlib.sha256(index).hexdigest(), len(index)))]
    about = json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": listed}).encode()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, parts in ((DATA, [d for _, d in records]), (INDEX, [index]), (ABOUT, [about])):
            with z.open(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
                for part in parts:
                    f.write(part)
    return out.getvalue()


class ZipReader:
    """Where the members of a ZIP file are; ``read(at, n)`` fetches a byte range of the file."""

    def __init__(self, read, size: int):
        self.read = read
        self.members: dict[str, tuple[int, int, int]] = {}
        tail_at = max(0, size - 65557 - 20)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22:
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP file")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        shift = tail_at + at - length - start  # bytes that stand before the archive
        if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) or tail[at - 20 : at - 16] == b"PK\6\7":
            if tail[at - 20 : at - 16] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            (end64,) = struct.unpack_from("<Q", tail, at - 12)
            raw = read(end64, 56)
            if raw[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", raw, 32)
            shift = end64 - length - start
        raw, pos = read(start + shift, length), 0
        for _ in range(count):
            if raw[pos : pos + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, pos + 8)
            packed, full = struct.unpack_from("<II", raw, pos + 20)
            n_name, n_extra, n_note = struct.unpack_from("<HHH", raw, pos + 28)
            (local,) = struct.unpack_from("<I", raw, pos + 42)
            name = raw[pos + 46 : pos + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = raw[pos + 46 + n_name : pos + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, e)
                if tag == 1:
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    local = wide.pop(0) if local == 0xFFFFFFFF else local
                e += 4 + n
            self.members[name] = (local + shift, packed, method)
            pos += 46 + n_name + n_extra + n_note

    def where(self, name: str) -> tuple[int, int]:
        """Where the data of a member begins, and its length as it is stored."""
        local, length, _ = self.members[name]
        raw = self.read(local, 30)
        if raw[:4] != b"PK\3\4":
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", raw, 26)
        return local + 30 + n_name + n_extra, length

    def stored(self, name: str) -> tuple[int, int]:
        """The same of a member of which ranges can be read."""
        if self.members[name][2]:
            raise ValueError(f"{name} is compressed; ranges of it cannot be read")
        return self.where(name)

    def whole(self, name: str) -> bytes:
        """A small member, such as an index, stored or deflated."""
        raw, method = self.read(*self.where(name)), self.members[name][2]
        if method not in (0, 8):
            raise ValueError(f"{name} is compressed by method {method}")
        return zlib.decompress(raw, -15) if method else raw


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP headers under "http", and payload of one record."""
    head, _, rest = raw.partition(2 * CRLF)
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(2 * CRLF)
    if not block.startswith(b"HTTP/"):
        http, payload = b"", block
    fields["http"] = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    fields["payload"] = payload
    return fields


def index_lines(raw: bytes) -> Iterator[tuple[str, int, int | None]]:
    """File, offset and length (where it is told) of the records in a CDXJ index, or a CDX index that names its columns."""
    columns = "N b a m s k r M S V g".split()
    for line in (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "surrogateescape").splitlines():
        if line.lstrip().startswith("CDX "):
            columns = line.split()[1:]
        elif "{" in line:
            x = json.loads(line[line.index("{") :])
            if "offset" in x:
                yield str(x.get("filename") or ""), int(x["offset"]), int(x["length"]) if x.get("length") else None
        elif line.strip() and not line.startswith("!"):
            x = dict(zip(columns, line.split(" ")))
            if x.get("V", "-") != "-":
                yield x.get("g", ""), int(x["V"]), int(x["S"]) if x.get("S", "-") != "-" else None


def ranges(z: ZipReader) -> tuple[dict[str, list[tuple[int, int]]], list[str]]:
    """Offset and length of the indexed records of each data member, in order, and the members that have no index.

    A record whose length no index tells goes on to the next one or the member's end.
    """
    data = [n for n in z.members if _DATA.search(n)]
    by_name: dict[str, list[str]] = {}
    for n in data:
        by_name.setdefault(n.rsplit("/", 1)[-1], []).append(n)
    found: dict[str, dict[int, int | None]] = {}
    for name in sorted(n for n in z.members if _INDEX.search(n)):
        for file, at, length in index_lines(z.whole(name)):
            of = [file] if file in z.members else by_name.get(file.rsplit("/", 1)[-1], []) if file else data
            if len(of) != 1:
                raise ValueError(f"{name} names a file that is not there, or not alone: {file!r}")
            here = found.setdefault(of[0], {})
            here[at] = here.get(at) or length
    out = {}
    for member, here in found.items():
        at = sorted(here)
        ends = [*at[1:], z.stored(member)[1]]
        out[member] = [(a, here[a] or e - a) for a, e in zip(at, ends)]
    return out, [n for n in data if n not in found]


def inflate(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def records(read, size: int, most: int = 1 << 20) -> Iterator[dict]:
    """All records of an archive, by the ranges in its indexes; ranges that follow one another are fetched up to ``most`` bytes at once."""
    z = ZipReader(read, size)
    indexed, rest = ranges(z)
    for member, lines in indexed.items():
        base, whole = z.stored(member)
        i = 0
        while i < len(lines):
            j, total = i, 0
            while j < len(lines) and (j == i or total + lines[j][1] <= most) and lines[j][0] == lines[i][0] + total:
                total += lines[j][1]
                j += 1
            if lines[i][0] + total > whole:
                raise ValueError("a range beyond its member")
            chunk, p = read(base + lines[i][0], total), 0
            for _, n in lines[i:j]:
                yield parse(inflate(chunk[p : p + n]))
                p += n
            i = j
    for member in rest:
        yield from read_through(read, *z.stored(member))


def read_through(read, base: int, whole: int) -> Iterator[dict]:
    """The records of a data member without an index: gzip members, or plain records one after the other, read by pieces."""
    at, held = 0, b""

    def more() -> bool:
        nonlocal at, held
        n = min(PIECE, whole - at)
        if n:
            held += read(base + at, n)
            at += n
        return n > 0

    while held or more():
        if len(held) < 2:
            more()
        if held[:2] == b"\x1f\x8b":
            one, parts = zlib.decompressobj(wbits=31), []
            while not one.eof:
                parts.append(one.decompress(held))
                held = one.unused_data
                if not one.eof and not more():
                    raise ValueError("a record is cut off")
            yield parse(b"".join(parts))
            continue
        held = held.lstrip(CRLF)
        while 2 * CRLF not in held and more():
            held = held.lstrip(CRLF)
        head, found, _ = held.partition(2 * CRLF)
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        if not found or not length:
            if held.strip():
                raise ValueError("what follows is no record")
            return
        n = len(head) + 4 + int(length[1])
        while len(held) < n and more():
            pass
        yield parse(held[:n])
        held = held[n:]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (pafs.LocalFileSystem(), uri)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of the pages (page_id, url, html) in ``folder``; returns their uri and size, written down before it returns.

    Of pages with equal payloads of at least LEAST_REVISIT bytes those with the
    smallest page_id are responses and others revisit them; without any page_id
    all are responses. A null html is an empty payload. Names are new for each
    attempt of a task, and only those of attempts that succeeded are returned.
    """
    full = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), full.alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    first = pages.where(F.col("size") >= LEAST_REVISIT).groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("of", "first")
    typed = pages.join(first, F.expr("digest = of"), "left").select("page_id", "url", "html", "digest", "size", F.when(F.expr("NOT page_id <=> first"), F.col("first")).alias("refers_to"))
    schema = pa.schema([("uri", pa.string()), ("size", pa.int64())])

    def save(fs, path: str, held: list) -> pa.RecordBatch:
        data = package(held)
        name = f"{path}/{uuid.uuid4().hex}.wacz"
        with fs.open_output_stream(name) as f:
            f.write(data)
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([len(data)], pa.int64())], schema=schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        held, total = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                kind = "revisit" if row["refers_to"] is not None else "response"
                raw = render(kind, row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["digest"], row["size"], row["refers_to"])
                packed = zlib.compressobj(3, wbits=31)
                data = packed.compress(raw) + packed.flush()
                held.append((record_id(row["page_id"]), data))
                total += len(data)
                if total >= ARCHIVE_BYTES:
                    yield save(fs, path, held)
                    held, total = [], 0
        if held:
            yield save(fs, path, held)

    return cut(typed.mapInArrow(run, "uri string, size long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record in the archives (uri, size).

    A response's length and digest are taken from its payload and must agree with
    its headers; a revisit has them from its headers.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def rows(uri: str, size: int) -> Iterator[tuple]:
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f:
            for r in records(lambda at, n: f.read_at(n, at), size):
                n, digest = int(r["http"]["content-length"]), r["warc-payload-digest"].removeprefix("sha256:")
                if r["warc-type"] == "response" and (len(r["payload"]) != n or hashlib.sha256(r["payload"]).hexdigest() != digest):
                    raise ValueError(f"a payload in {uri} is not what its header says")
                page, to = r["x-page-id"], r.get("x-refers-to-page-id")
                yield int(page) if page else None, n, digest, r["warc-type"], int(to) if to else None, r["warc-target-uri"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.to_pylist():
                held = []
                for row in rows(a["uri"], a["size"]):
                    held.append(row)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written to ZIP-packaged archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = f"{shared_dir(spark)}/quarrylens/archives-{uuid.uuid4().hex}"
    register(folder)  # clean() deletes it
    archives = write_archives(pages, folder)
    archives = archives.repartition(max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism)), "uri")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
