"""RESP request arrays: `*N`, then N times `$length` and the bytes, each line ended by CRLF.

Rows (n, args, error). An error ends its connection: what comes after it is not read, however the stream is chunked. An
unfinished command waits for more. A negative length is an error. Counts and lengths may have a numeric prefix; N of 0 or less is skipped."""

import re

from pyspark.sql import DataFrame

from skiff.sources.streams import decode

SCHEMA = "n bigint, args array<string>, error string"
# The protocol's errors.
NOT_ARRAY = "ERR unknown protocol"
BAD_COUNT = "ERR protocol error: invalid array length"
NOT_BULK = "ERR protocol error: expected '$' for bulk string"
BAD_LENGTH = "ERR protocol error: invalid bulk string length"
_NUMBER = re.compile(rb"\s*([+-]?\d+)")


class Decoder:
    def __init__(self, rest: bytes = b"", n: int = 0, dead: bool = False):
        self.rest, self.n, self.dead = rest, n, dead

    def feed(self, data: bytes) -> list[tuple]:
        if self.dead:
            return []
        self.rest += data
        out, at = [], 0
        while at < len(self.rest):
            try:
                got = self._command(at)
            except ValueError as e:
                out.append((self.n, None, str(e)))
                self.rest, self.dead = b"", True
                return out
            if got is None:
                break
            at, args = got
            if args:
                out.append((self.n, args, None))
                self.n += 1
        self.rest = self.rest[at:]
        return out

    def finish(self) -> list[tuple]:
        return []

    def _line(self, at: int, kind: bytes, wrong: str, bad: str) -> tuple[int, int] | None:
        """The number on the line at a place, and the next line's place; None for a line that is not all there."""
        if self.rest[at : at + 1] not in (kind, b""):
            raise ValueError(wrong)
        end = self.rest.find(b"\r\n", at)
        if end < 0:
            return None
        m = _NUMBER.match(self.rest, at + 1, end)
        if not m:
            raise ValueError(bad)
        return int(m[1]), end + 2

    def _command(self, at: int) -> tuple[int, list[str]] | None:
        """The place after the command that begins at a place, and its arguments."""
        head = self._line(at, b"*", NOT_ARRAY, BAD_COUNT)
        if head is None:
            return None
        count, at = head
        args = []
        for _ in range(count):
            bulk = self._line(at, b"$", NOT_BULK, BAD_LENGTH)
            if bulk is None:
                return None
            size, at = bulk
            if size < 0:
                raise ValueError(BAD_LENGTH)
            if len(self.rest) < at + size + 2:
                return None
            args.append(self.rest[at : at + size].decode("utf-8", "replace"))
            at += size + 2
        return at, args


def commands(chunks: DataFrame) -> DataFrame:
    return decode(chunks, Decoder, SCHEMA)
