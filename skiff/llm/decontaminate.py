"""Benchmark decontamination by Wu-Manber search over words.

A word is a run of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased; a window is ten consecutive words of a
benchmark item, or the whole item when it has one to nine. Windows of one length form one machine. Its shift table says,
for the block of two words (one, for one-word windows) at the search's right edge, how far the edge can move without
missing a window; where that is zero, a bucket (by the hashes of the window's last and first blocks) names the windows to
compare word by word. Words are numbered by the benchmark's vocabulary; a word that it does not have is skipped with all
windows over it.

Cases: a null or empty text has no words and no hits. Null, empty and wordless items have no windows. Items with one
item_id, or equal texts under several, are allowed: n_items counts distinct ids; an item whose id is null marks hits but
is not listed. Repeated documents are each answered. An empty benchmark gives no hits. Columns of docs are kept as they
are; the result's column takes another name if docs has one of that name. A very long text is searched whole, as one list
of words; an empty docs gives no rows.
"""

import hashlib
import uuid
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import fresh, row_function, table, utf8

WINDOW = 10
#: Bytes of benchmark text in one broadcast and its machines (which take about ten times as much memory).
BROADCAST_BYTES = 16 << 20
_TO_SPACE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

FOUND = "n_words bigint, spans array<bigint>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> Iterable[tuple[bytes, ...]]:
    if len(words) < size:
        return [tuple(words)] if words else []
    return (tuple(words[i : i + size]) for i in range(len(words) - size + 1))


_FACTOR = 0x9E3779B1


class WuManber:
    """Finds windows of one length, of words as numbers. Tables are flat arrays, some 20 bytes a window, not objects."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, length: int):
        """words: all items' numbers one after the other; starts: where windows begin in them."""
        self.words, self.length, self.block = array("q", words.astype(np.int64).tobytes()), length, min(2, length)
        self.far = length - self.block + 1
        self.mask = (1 << max(10, (4 * len(starts)).bit_length())) - 1
        # the shift table: for a block's hash, the least distance of such a block from a window's right edge
        shift = np.full(self.mask + 1, min(255, self.far), np.uint8)
        for off in range(length - self.block + 1):
            np.minimum.at(shift, self._hash(words, starts + off), length - self.block - off)
        self.shift = bytearray(shift)
        # the buckets: windows by the hash of their last and first blocks
        bucket = (self._hash(words, starts + length - self.block) * 31 + self._hash(words, starts)) & self.mask
        by = np.argsort(bucket, kind="stable")
        self.first = array("q", np.append(0, np.cumsum(np.bincount(bucket, minlength=self.mask + 1))).astype(np.int64).tobytes())
        self.starts = array("q", starts[by].astype(np.int64).tobytes())

    def _hash(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = words[at].astype(np.int64) * _FACTOR
        return (h + words[at + 1] if self.block == 2 else h) & self.mask

    def find(self, ids: list[int]) -> Iterable[tuple[int, int]]:
        """(place, start of an equal window) for each occurrence, by place. Numbers below 0 are words of no item."""
        n, m, b, mask, shift, first = len(ids), self.length, self.block, self.mask, self.shift, self.first
        edge = m
        while edge <= n:
            last = ids[edge - 1]
            if last < 0:
                edge += m
                continue
            h = last * _FACTOR
            if b == 2:
                if ids[edge - 2] < 0:
                    edge += m - 1
                    continue
                h = ids[edge - 2] * _FACTOR + last
            h &= mask
            if step := shift[h]:
                edge += step
                continue
            start = edge - m
            head = ids[start] * _FACTOR + ids[start + 1] if b == 2 else ids[start] * _FACTOR
            k = (h * 31 + (head & mask)) & mask
            if first[k] < first[k + 1]:
                here = array("q", ids[start:edge])
                for p in self.starts[first[k] : first[k + 1]]:
                    if self.words[p : p + m] == here:
                        yield start, p
            edge += 1


class Searcher:
    """Machines over some benchmark items: (item_id, text) pairs."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]]):
        self.number: dict[bytes, int] = {}
        self.items, begin, words = [], [0], []
        starts: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in items:
            own = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            if own:
                length = min(WINDOW, len(own))
                starts[length].append(np.arange(begin[-1], begin[-1] + len(own) - length + 1))
                words.append(np.array(own, np.int32))
                self.items.append(item)
                begin.append(begin[-1] + len(own))
        self.begin = begin
        whole = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.machines = [WuManber(whole, np.concatenate(at), length) for length, at in starts.items()]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        spans, items, number = [], set(), self.number.get
        ids = [number(w, -1) for w in words]
        for machine in self.machines:
            before = -1
            for place, p in machine.find(ids):
                if place != before:
                    spans.append((place, place + machine.length))
                    before = place
                item = self.items[bisect_right(self.begin, p) - 1]
                if item is not None:
                    items.add(item)
        return spans, items


_built: dict[str, Searcher] = {}


def built(tag: str, shared: Broadcast) -> Searcher:
    """The searcher over a broadcast list of items, made once in a worker's life; tag tells broadcasts apart."""
    if tag not in _built:
        _built.clear()
        _built[tag] = Searcher(shared.value)
    return _built[tag]


def merged(spans: Iterable[Sequence[int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", into: str = "contamination") -> tuple[DataFrame, str]:
    """docs with a struct column: n_words, spans (word ranges that windows cover, merged: start, end, start, ...) and items
    (ids of the items with occurring windows, sorted). Returns it with that column's name.

    The benchmark is dealt by hash into groups of about BROADCAST_BYTES at most (or one item, if it is longer), whatever its
    size; each group is one broadcast, one set of machines that a worker builds once, and one pass over the texts. There is no
    shuffle of documents."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), utf8(item_text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // (BROADCAST_BYTES // 2)) if total > BROADCAST_BYTES else 1)
    into = fresh(docs, into)
    for k in range(groups):
        some = [(r.item, bytes(r.text)) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == k).collect()]
        shared = spark.sparkContext.broadcast(some)

        def start(shared=shared, tag=uuid.uuid4().hex):
            searcher = built(tag, shared)

            def one(r):
                words = words_of(r["text"])
                spans, items = searcher.find(words)
                if r["before"] is not None:
                    spans += zip(r["before"]["spans"][::2], r["before"]["spans"][1::2], strict=True)
                    items |= set(r["before"]["items"])
                return len(words), [x for s in merged(spans) for x in s], sorted(items)

            return lambda rows: [one(r) for r in rows]

        before = F.col(into) if k else F.lit(None).cast(f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>")
        docs = docs.withColumn(into, row_function(FOUND, start)(F.struct(utf8(text_col).alias("text"), before.alias("before"))))
    return docs, into


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the documents in which a window of the benchmark occurs."""
    out, into = mark(docs, benchmark, text_col)
    return out.where(F.size(F.col(into)["items"]) + F.size(F.col(into)["spans"]) == 0).drop(into)


def query(spark, sf_dir):
    docs, at = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    covered = F.aggregate(F.sequence(F.lit(0), F.size(f"{at}.spans") - 1, F.lit(1)), F.lit(0).cast("long"), lambda n, i: n + F.when(i % 2 == 0, -F.get(F.col(f"{at}.spans"), i)).otherwise(F.get(F.col(f"{at}.spans"), i)))
    n_hit = F.when(F.size(f"{at}.spans") == 0, F.lit(0).cast("long")).otherwise(covered)
    return docs.select("doc_id", F.col(f"{at}.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(f"{at}.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", f"{at}.items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def brute_force(docs: Iterable[tuple], items: Iterable[tuple]) -> list[tuple]:
    """The rows of query(), by trying every window at every place."""
    out, sets = [], [(i, set(windows_of(words_of(t)))) for i, t in items]
    for doc_id, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for item, windows in sets:
            for w in windows:
                for at in range(len(words) - len(w) + 1):
                    if tuple(words[at : at + len(w)]) == w:
                        hit.update(range(at, at + len(w)))
                        ids.update(() if item is None else (str(item),))
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS l, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
       FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
l AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT rid, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS win FROM d, l, unnest(range(1, len(w) - l + 2)) AS r(i) WHERE len(w) >= l),
hit AS (SELECT rid, i, bw.l AS l, item FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, l FROM hit), unnest(range(i, i + l)) AS r(p) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""
