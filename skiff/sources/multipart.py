"""multipart/form-data bodies: parts between boundaries, whatever the chunks.

Rows (n, filename, content_type, data, error). Bytes that may be the beginning of a boundary are always withheld. A preamble is
skipped and an epilogue ignored; a body that ends inside a part gives a row with an error."""

import re

from pyspark.sql import DataFrame

from skiff.sources.streams import decode

SCHEMA = "n bigint, filename string, content_type string, data binary, error string"
_NAME = re.compile(r'filename="([^"]*)"', re.I)


def boundary_of(content_type: str) -> str:
    m = re.search(r'boundary="?([^";]*)', content_type or "")
    return m[1] if m else ""


class Decoder:
    """before, head, body or after: where in the body the next byte is."""

    def __init__(self, boundary: str):
        self.mark = b"\r\n--" + boundary.encode()
        self.state, self.n = "before", 0
        self.rest = b"\r\n"  # so that a boundary at the very beginning has its line end
        self.name, self.kind, self.data = "", "", []
        if not boundary:
            self.state = "error"

    def feed(self, data: bytes) -> list[tuple]:
        if self.state == "error":
            self.state = "after"
            return [(0, None, None, None, "no boundary")]
        if self.state == "after":
            return []
        self.rest += data
        out = []
        while self._step(out):
            pass
        return out

    def _step(self, out: list[tuple]) -> bool:
        if self.state == "head":
            if self.rest.startswith(b"\r\n"):
                end, skip = 0, 2
            else:
                end, skip = self.rest.find(b"\r\n\r\n"), 4
            if end < 0:
                return False
            self._fields(self.rest[:end].decode("utf-8", "replace"))
            # the blank line's own CRLF may begin the next boundary: an empty part
            self.rest, self.state, self.data = b"\r\n" + self.rest[end + skip :], "body", []
            return True
        if self.state in ("before", "body"):
            at = self.rest.find(self.mark)
            safe = at if at >= 0 else len(self.rest) - len(self.mark) + 1
            if self.state == "body" and safe > 0:
                self.data.append(self.rest[:safe])
            if at < 0:
                self.rest = self.rest[max(0, safe) :]
                return False
            after = self.rest[at + len(self.mark) : at + len(self.mark) + 2]
            if len(after) < 2:
                self.rest = self.rest[max(0, safe) :]
                return False
            if self.state == "body":
                out.append((self.n, self.name, self.kind, b"".join(self.data)[2:], None))
                self.n += 1
            self.state = "after" if after == b"--" else "head"
            self.rest = self.rest[at + len(self.mark) + (2 if after in (b"--", b"\r\n") else 0) :]
            return self.state != "after"
        return False

    def _fields(self, text: str) -> None:
        self.name = self.kind = ""
        for line in text.split("\r\n"):
            name, _, value = line.partition(":")
            if name.strip().lower() == "content-disposition" and (m := _NAME.search(value)):
                self.name = m[1]
            elif name.strip().lower() == "content-type":
                self.kind = value.strip()

    def finish(self) -> list[tuple]:
        return [] if self.state in ("after", "before") else [(self.n, None, None, None, "unfinished part")]


def parse(body: bytes, boundary: str) -> list[tuple]:
    d = Decoder(boundary)
    return d.feed(body) + d.finish()


def parts(chunks: DataFrame, boundary: str) -> DataFrame:
    """All connections' bodies have the one boundary."""
    return decode(chunks, lambda: Decoder(boundary), SCHEMA)


def parts_of_requests(requests: DataFrame) -> DataFrame:
    """conn_id, request (its number), then the parts of each POST's body, under the boundary that its headers name."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(c, r, *p) for c, r, body, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True) for p in parse(body, boundary_of(kind))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conn_id", "request", "n", "filename", "content_type", "data", "error"])

    asked = requests.where("method = 'POST' and error is null").selectExpr("conn_id", "n", "body", "coalesce(try_element_at(headers, 'content-type'), '')")
    return asked.mapInArrow(run, f"conn_id bigint, request bigint, {SCHEMA}")
