"""Legacy archive converter: ARC records to WARC archives.

An ARC file begins with a version block (`filedesc://`, whose body's first line is `1 0 origin` or `2 0 origin`, and whose
second line names the fields). In version 1 a record's header line is URL, IP, date, type and length; in version 2 it is
URL, IP, date, type, result code, checksum, location, offset, file name and length. The declared length counts the bytes that
follow the header line; a newline ends the record. The parser goes by those lengths alone, whatever the bytes are.

From each ARC record a WARC 1.1 record is made: the date becomes WARC-Date, `http` blocks become `response` records of type
application/http, the payload (what follows the HTTP header) gets its SHA-1 in base32, and the record id is a version 8 UUID
made of the record's number. Of records with equal payloads of at least a given size, the one with the smallest number stays
a response, the others become revisits (identical-payload-digest) that keep the HTTP header only and refer to it.

Other records become: the version block `warcinfo`; blocks without an HTTP header (dns:, ftp:, and http: ones that hold the body
alone) `resource` records of the type that the ARC header names. Only responses have revisits. A record's id is a version 8 UUID
made of its number, if its HTTP header has an X-Record-Number (as those that write_archives makes), else of the SHA-1 of its ARC
file's name, its offset and its URL.

read_arc reads folders of .arc and .arc.gz files (any number of gzip members) of either version; convert_archives makes WARC
files of them. Archives are ordinary uncompressed or gzip WARC files, each of FILE_BYTES or the record that goes beyond, so that
is what a reader holds. Records that are UTF-8 text are written by Spark's own text writer, into any file system it knows, one gzip
member a file; others, which it cannot write, by pyarrow's file systems, one gzip member a record.

Cases: null html is an empty payload; null url is `about:blank`; blanks and control characters in a url are
percent-encoded in headers. Rows of one page_id and payload whose page_id is smallest are all responses. Null page_id: an
unnumbered record; it revisits an equal payload that has a number, and is a response otherwise. An empty table writes an
archive without records. A page of any length is one record. Extra columns of pages are ignored, so their names do not clash.
"""

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import arrow_schema, bound_batches, discard, matching, new_folder, stored, table, utf8

#: Bytes of records from which on an archive file is complete; it bounds what a reader holds.
FILE_BYTES = 16 << 20
# Field names of the ARC versions' header lines, and WARC's revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_NUMBER = 1 << 63


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]|[^\x00-\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "about:blank"


def arc_file(version: int, records: Iterable[tuple[str, str, bytes]], name: str = "pages.arc") -> bytes:
    """An ARC file of (url, date as 14 digits, HTTP message) records."""
    body = f"{version} 0 skiff\n{ARC_FIELDS[version]}\n".encode()
    out = [_arc_line(version, f"filedesc://{name}", "20240101000000", "text/plain", len(body), 0, name), body, b"\n"]
    at = sum(map(len, out))
    for url, date, message in records:
        line = _arc_line(version, url, date, "text/html", len(message), at, name)
        out += [line, message, b"\n"]
        at += len(line) + len(message) + 1
    return b"".join(out)


def _arc_line(version: int, url: str, date: str, kind: str, length: int, offset: int, name: str) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{more} {length}\n".encode()


def parse_arc(data: bytes, all_records: bool = False) -> Iterator[dict]:
    """The records of an ARC file: the header line's fields, `offset`, `version`, and the bytes under `block`. The version block
    comes first, if all_records. A URL with blanks in it (they occur in old files) is what the other fields leave."""
    at, fields, version = 0, None, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        size = int(parts[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"record at {at} declares {size} bytes and has {len(block)}")
        first = parts[0].startswith("filedesc:")
        if fields is None and not first:
            raise ValueError("no version block")
        if first:  # also where files were joined
            version = int(block[: block.index(b" ")])
            names = ARC_FIELDS[version].split()
            fields, named = names, ARC_FIELDS[1 if len(parts) == 5 else 2].split()
        else:
            named = fields
            if len(parts) < len(fields):
                raise ValueError(f"version {version} header with {len(parts)} fields at {at}")
        if not first or all_records:
            extra = len(parts) - len(named)
            yield dict(zip(named, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True)) | {"block": block, "offset": at, "version": version}
        at = end + 1 + size


def record_id(number: int) -> str:
    """A version 8 UUID that holds the 64-bit number (NO_NUMBER for none in its last part)."""
    u = number & (2**64 - 1)
    return f"urn:uuid:{u >> 32:08x}-{u >> 16 & 0xFFFF:04x}-8{u >> 4 & 0xFFF:03x}-8{u & 0xF:01x}00-000000000000"


def number_of(uuid: str) -> int:
    h = uuid.removeprefix("urn:uuid:").replace("-", "")
    u = int(h[:12] + h[13:16] + h[17], 16)
    return u - (1 << 64) if u >= NO_NUMBER else u


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_message(number: int | None, payload: bytes) -> bytes:
    n = "-" if number is None else number
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Record-Number: {n}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """An HTTP message's header with its blank line, and its payload; None for what is not a message."""
    if not block.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def own_id(arc: dict, origin: str = "") -> tuple[str, int | None]:
    """The record's id, and its number if it has one."""
    message = http_parts(arc["block"])
    number = _headers(message[0]).get("x-record-number") if message else None
    if number and re.fullmatch(r"-?\d{1,19}", number):
        return record_id(int(number)), int(number)
    told = f"{origin} {arc['offset']} {arc['URL']}".encode("utf-8", "surrogateescape") + (message[1] if number else b"")
    h = hashlib.sha1(told).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-9{h[15:18]}-{h[18:30]}", None


def warc_record(arc: dict, refers_to: int | str | None, origin: str = "") -> bytes:
    """The WARC record of a parsed ARC record; with refers_to (an id, or a number that makes one), the revisit of that record."""
    block, message = arc["block"], http_parts(arc["block"])
    d = arc["Archive-date"].ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    info = arc["URL"].startswith("filedesc:")
    kind = "warcinfo" if info else "revisit" if refers_to is not None else "response" if message else "resource"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own_id(arc, origin)[0]}>", f"WARC-Date: {date}"]
    if info:
        lines += [f"WARC-Filename: {safe_url(arc['URL'].removeprefix('filedesc:').lstrip('/'))}", "Content-Type: text/plain"]
    else:
        lines.append(f"WARC-Target-URI: {safe_url(arc['URL'])}")
        if arc["IP-address"] not in ("0.0.0.0", "-", ""):
            lines.append(f"WARC-IP-Address: {arc['IP-address']}")
        lines.append(f"Content-Type: {'application/http; msgtype=response' if message else arc['Content-type']}")
        lines.append(f"WARC-Payload-Digest: sha1:{digest_of(message[1] if message else block)}")
    if refers_to is None:
        lines.append(f"WARC-Block-Digest: sha1:{digest_of(block)}")
    else:
        block = message[0]
        to = record_id(refers_to) if isinstance(refers_to, int) else refers_to
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{to}>", "WARC-Truncated: length"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # a file's last line ends once more
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        headers = _headers(data[at:end])
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is not as long as it declares")
        yield headers, block
        at = end + 8 + size


def _is_text(record: bytes) -> bool:
    try:
        record.decode()
    except UnicodeDecodeError:
        return False
    return True


def _write(rows: DataFrame, rank: str, path: str, least_bytes: int, compression: str, make) -> str:
    """rows: rank (what tells records apart, the least of equal payloads being the response; null ranks last), payload (null: no
    revisit) and what make needs, a function from a row with refers_to to a record. Only rows whose payloads occur again are dealt out."""
    digest, size = F.sha1("payload"), F.octet_length("payload")
    first = rows.where("payload is not null").select(rank, digest.alias("digest"), size.alias("size")).where(F.col("size") >= least_bytes)
    first = first.groupBy("digest", "size").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    again = stored(first.where("n > 1 and first is not null").drop("n"))
    some, others = matching(rows, F.xxhash64(F.coalesce(digest, F.lit(""))), again.select(F.xxhash64("digest").alias("key")))
    some = some.withColumn("digest", digest).withColumn("size", size).join(again, ["digest", "size"], "left").drop("digest", "size")
    none = F.lit(None).cast(dict(rows.dtypes)[rank])
    rows = some.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col(rank)), F.col("first"))).drop("first").unionByName(others.withColumn("refers_to", none))

    def files(batches, as_text):
        """Records, joined to files, of those that are UTF-8 text or of the others."""
        held, size = [], 0
        for b in batches:
            for r in (row for at in range(0, b.num_rows, 64) for row in b.slice(at, 64).to_pylist()):
                record = make(r)
                if _is_text(record) == as_text:
                    held.append(record)
                    size += len(record)
                if size >= FILE_BYTES:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def texts(batches):
        for held in files(batches, True):
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary()).cast(pa.string())], names=["file"])

    def binaries(batches):
        fs, top = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        for k, held in enumerate(files(batches, False)):
            # a task that runs again writes the same file again
            name = f"{top}/binary-{TaskContext.get().partitionId():06d}-{k:06d}.warc"
            part = f"{top}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part, compression=None) as out:
                for record in held:
                    out.write(gzip.compress(record) if compression == "gzip" else record)
            fs.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    bound_batches(rows.sparkSession)
    how = rows.mapInArrow(texts, "file string").write.option("lineSep", "\n").option("compression", compression)
    how.option("maxRecordsPerFile", 1).mode("errorifexists").text(path)  # a row is a file
    if not getattr(make, "is_text", False):
        rows.mapInArrow(binaries, "file string").count()
    discard(again)
    return path


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, compression: str = "gzip") -> str:
    """Writes a record for each page, through ARC records of both versions and the converter, as WARC files under path."""
    rows = pages.select(F.col(id_col).cast("long").alias("number"), F.col(url_col).alias("url"), F.coalesce(utf8(html_col), F.lit(b"")).alias("payload"))

    def make(r):
        version = 1 + hash(r["number"] or 0) % 2
        legacy = arc_file(version, [(safe_url(r["url"]), "20240101000000", http_message(r["number"], r["payload"]))])
        (arc,) = parse_arc(legacy)
        return warc_record(arc, r["refers_to"])

    make.is_text = True
    return _write(rows, "number", path, least_bytes, compression, make)


def _unpacked(data: bytes) -> bytes:
    """A file's bytes, of any number of gzip members if it is compressed."""
    if data[:2] != b"\x1f\x8b":
        return data
    whole = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        whole.append(d.decompress(data))
        data = d.unused_data
    return b"".join(whole)


def read_arc(spark, path: str) -> DataFrame:
    """(origin, offset, version, url, ip, date, type, code, block, payload, id) of each record in the .arc and .arc.gz files under
    path, version blocks included; payload is null but for HTTP messages."""
    schema = "origin string, offset bigint, version int, url string, ip string, date string, type string, code string, block binary, payload binary, id string"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.arc{,.gz}").load(path).select("path", "content")
    kinds = [(f.name, f.type) for f in arrow_schema(schema)]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, held, origin = [], 0, name.rpartition("/")[2]
                for arc in parse_arc(_unpacked(content.as_py()), True):
                    message = http_parts(arc["block"])
                    text = lambda k: arc.get(k, "-").encode("utf-8", "surrogateescape").decode("utf-8", "replace")  # noqa: B023, E731
                    payload = message[1] if message else None
                    rows.append((origin, arc["offset"], arc["version"], text("URL"), text("IP-address"), text("Archive-date"), text("Content-type"), text("Result-code"), arc["block"], payload, own_id(arc, origin)[0]))
                    held += 2 * len(arc["block"])
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return files.mapInArrow(run, schema)


def convert_archives(spark, source: str, path: str, least_bytes: int = 0, compression: str = "gzip") -> str:
    """Converts the ARC files under source to WARC files under path."""

    def make(r):
        arc = {"URL": r["url"], "IP-address": r["ip"], "Archive-date": r["date"], "Content-type": r["type"], "block": r["block"], "offset": r["offset"]}
        return warc_record(arc, r["refers_to"], r["origin"])

    return _write(read_arc(spark, source), "id", path, least_bytes, compression, make)


def read_archives(spark, path: str) -> DataFrame:
    """(number, type, target, digest, length, refers_to, block, id) of each record in the WARC files under path: number and
    refers_to of records that have numbers, length of the payload (the whole block where it is no HTTP message)."""
    schema = "number bigint, type string, target string, digest string, length bigint, refers_to bigint, block binary, id string"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    kinds = [(f.name, f.type) for f in arrow_schema(schema)]

    def one(headers, block):
        message, number, size = http_parts(block), None, len(block)
        if message:
            head = _headers(message[0])
            number = head.get("x-record-number")
            size = len(message[1])
            if headers["warc-type"] == "revisit":
                size = int(head["content-length"]) if "content-length" in head else None
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if headers["warc-type"] in ("response", "resource") and digest_of(message[1] if message else block) != digest:
            raise ValueError(f"the payload of {headers['warc-record-id']} is not what its header declares")
        to = headers.get("warc-refers-to")
        numbered = number and number != "-"
        return (
            int(number) if numbered else None, headers["warc-type"], headers.get("warc-target-uri"), digest, size,
            number_of(to.strip("<>")) if to and to.endswith("-000000000000>") else None, block, headers["warc-record-id"].strip("<>"),
        )

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for headers, block in parse_warc(_unpacked(content.as_py())):
                    rows.append(one(headers, block))
                    held += len(block)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return files.mapInArrow(run, schema)


def query(spark, sf_dir):
    path = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), new_folder(spark, "warc"))
    return read_archives(spark, path).select(F.col("number").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p),
h AS (SELECT *, sha1(html) AS hx FROM f),
bits AS (SELECT *, list_transform(range(0, 32), lambda i: list_reduce(list_transform(range(0, 5), lambda j:
           ((instr('0123456789abcdef', hx[1 + (i * 5 + j) // 4]) - 1) >> (3 - (i * 5 + j) % 4)) & 1), lambda a, b: a * 2 + b)) AS v FROM h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(x + 1 AS BIGINT)]), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM bits
"""
