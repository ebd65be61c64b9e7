"""HTTP/1.1 requests, pipelined: request line, headers, and a body of Content-Length bytes.

Rows (n, method, path, query, version, headers, body, error). Header names are lower-cased, as names are case-insensitive; a
name's last value counts. Malformed input gives a row with an error and ends its connection."""

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiff.functions.scalars import METHODS, reason
from skiff.sources.streams import decode

SCHEMA = "n bigint, method string, path string, query string, version string, headers map<string,string>, body binary, error string"


class Decoder:
    """Reads a head to its blank line, then hands the body's bytes on as they come, so a body costs its length once."""

    def __init__(self):
        self.rest, self.looked, self.n, self.dead = b"", 0, 0, False
        self.head: tuple | None = None
        self.missing = 0
        self.begin()

    def begin(self) -> None:
        """A new body."""
        self.body: list[bytes] = []

    def take(self, piece: bytes) -> None:
        """Some of the body."""
        self.body.append(piece)

    def row(self) -> tuple:
        """The request that is complete."""
        return (self.n, *self.head[:4], list(self.head[4].items()), b"".join(self.body), None)

    def failed(self, error: str) -> tuple:
        return (self.n, None, None, None, None, None, None, error)

    def feed(self, data: bytes) -> list[tuple]:
        out = []
        if self.dead:
            return out
        if self.head is None:
            data, self.rest = self.rest + data, b""
        while data or self.head is not None:
            if self.head is None:
                end = data.find(b"\r\n\r\n", max(0, self.looked - 3))
                # whole lines are judged as soon as they are there
                whole = end if end >= 0 else data.rfind(b"\r\n", self.looked)
                try:
                    found = self._head(data[:whole]) if whole > 0 else None
                except ValueError as e:
                    self.dead = True
                    return [*out, self.failed(str(e))]
                if end < 0:
                    self.rest, self.looked = data, max(0, len(data) - 1)
                    return out
                self.head, self.looked, data = found, 0, data[end + 4 :]
                if found is None:  # a blank line and no request line
                    self.dead = True
                    return [*out, self.failed("malformed request line")]
                self.missing = content_length(found[4].get("content-length", ""))
                self.begin()
            piece = data[: self.missing]
            if piece:
                self.take(piece)
            self.missing -= len(piece)
            data = data[len(piece) :]
            if self.missing:
                return out
            out.append(self.row())
            self.head = None
            self.n += 1
        return out

    def finish(self) -> list[tuple]:
        return []

    def _head(self, head: bytes) -> tuple[str, str, str, str, dict[str, str]]:
        line, *fields = head.decode("utf-8", "replace").split("\r\n")
        parts = line.split(" ", 2)
        if len(parts) != 3 or parts[0].upper() not in METHODS:
            raise ValueError("malformed request line")
        headers = {}
        for f in fields:
            name, colon, value = f.partition(":")
            if not colon:
                raise ValueError("header without a colon")
            headers[name.lower()] = value.lstrip(" \t")
        path, _, query = parts[1].partition("?")
        return parts[0].upper(), path, query, parts[2], headers


DIGEST_SCHEMA = "n bigint, method string, path string, size bigint, sha256 string, error string"


class Digester(Decoder):
    """The streaming body mode: a request's body is digested as it comes and never held. For batches; its state has no pickle."""

    def begin(self) -> None:
        self.size, self.digest = 0, hashlib.sha256()

    def take(self, piece: bytes) -> None:
        self.size += len(piece)
        self.digest.update(piece)

    def row(self) -> tuple:
        return (self.n, *self.head[:2], self.size, self.digest.hexdigest(), None)

    def failed(self, error: str) -> tuple:
        return (self.n, None, None, None, None, error)


def digests(chunks: DataFrame) -> DataFrame:
    """conn_id and DIGEST_SCHEMA: each request with its body's size and SHA-256, in the memory of one chunk."""
    return decode(chunks, Digester, DIGEST_SCHEMA)


def content_length(value: str) -> int:
    m = re.match(r"\s*(\d+)", value)
    return int(m[1]) if m else 0


def requests(chunks: DataFrame) -> DataFrame:
    return decode(chunks, Decoder, SCHEMA)


def response(status: Column, headers: Column, body: Column) -> Column:
    """A response as bytes: status line, headers (a map) and Content-Length in order of name, blank line, body."""
    length = F.create_map(F.lit("Content-Length"), F.octet_length(body).cast("string"))
    lines = F.transform(F.array_sort(F.map_entries(F.map_concat(headers, length))), lambda x: F.concat(x["key"], F.lit(": "), x["value"]))
    head = F.concat(F.lit("HTTP/1.1 "), status.cast("string"), F.lit(" "), reason(status), F.lit("\r\n"), F.array_join(lines, "\r\n"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body.cast("binary"))
