"""Byte-level BPE with forced-boundary splitting.

From the vocabulary: the set of byte pairs that stand next to each other inside some token. Any other pair is a certain cut,
since no merge can ever cross it; what lies between cuts is encoded by itself, and the ids follow one another. A text is first
parted at special tokens and into pieces by the tokenizer's own pattern (which looks at neighbours, so it goes over the
whole text), then each piece at its cuts. Fragments are merged by rank: short ones by scanning for the least rank, long ones with a heap, so a
fragment of n bytes takes n log n steps. Fragments' ids are kept for reuse, up to KEPT of them.

Decoding joins the tokens' bytes and decodes UTF-8, with U+FFFD for what is not.

The vocabulary file is read by its path, a parameter, where the tasks run. Cases: a null text is empty: no ids. Repeated
documents are each answered; columns of docs are kept, and the result's column takes another name if docs has that one.
"""

import hashlib
import heapq
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import fresh, row_function, table, utf8

KEPT = 400_000
# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: itself where printable, else U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in byte_letters().items()}
        raw = lambda t: bytes(of[c] for c in t)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        #: rank of each mergeable pair of ids, under one number for the pair; and the id that each rank's merge makes
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate((raw(a), raw(b)) for a, b in pairs):
            self.ranks.setdefault(self.ids[a] << 32 | self.ids[b], rank)
            self.made.append(self.ids[a + b])
        self.letter = [self.ids.get(bytes([b])) for b in range(256)]
        inside = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        #: for each first byte, the second bytes that a token holds next to it
        self.inside = [frozenset(p[1] for p in inside if p[0] == b) for b in range(256)]
        self.pattern = regex.compile(PATTERN)
        self.parts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece, cut wherever its byte pair occurs inside no token."""
        out, at, inside = [], 0, self.inside
        for k in range(1, len(piece)):
            if piece[k] not in inside[piece[k - 1]]:
                out.append(piece[at:k])
                at = k
        out.append(piece[at:])
        return out

    def merge(self, fragment: bytes) -> list[int]:
        """The lowest rank first, the leftmost of equal ones."""
        ids = [self.letter[b] for b in fragment]
        if len(ids) < 2:
            return ids
        if len(ids) > 256:
            return self._merge_long(ids)
        rank, made, none = self.ranks.get, self.made, 1 << 60
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != none:
            k = ranks.index(least)
            new = ids[k] = made[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank(ids[k - 1] << 32 | new, none)
            if k < len(ranks):
                ranks[k] = rank(new << 32 | ids[k + 1], none)
        return ids

    def _merge_long(self, here: list[int]) -> list[int]:
        """The same by a linked list, and a heap of the pairs that may be merged."""
        n, rank = len(here), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank(here[k] << 32 | here[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if here[k] < 0 or j >= n or rank(here[k] << 32 | here[j]) != r:
                continue
            here[k], here[j] = self.made[r], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (new := rank(here[left] << 32 | here[after[left]])) is not None:
                    heapq.heappush(heap, (new, left))
        return [i for i in here if i >= 0]

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids: list[int] = []
        for fragment in self.fragments(piece.encode()):
            ids += self.merge(fragment)
        if len(self.known) >= KEPT:
            self.known.clear()
        if len(piece) <= 64:
            self.known[piece] = tuple(ids)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, more = self.known.get, ids.extend
        for part in self.parts.split(text) if self.parts else (text,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            for piece in self.pattern.findall(part):
                more(known(piece) or self._piece(piece))
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """One tokenizer for each path in a worker's life."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, into: str = "tokens", keep_ids: bool = True) -> tuple[DataFrame, str]:
    """docs with a struct column: n, ids (null unless keep_ids), ids_sha256, decoded_sha256. One pass; no shuffle."""
    path = path or default_path()

    def start():
        tokenizer = load(path)
        names = [str(i) for i in range(max(tokenizer.bytes) + 1)]

        def one(text):
            ids = tokenizer.encode(text.decode("utf-8", "replace")) if text else []
            decoded = tokenizer.decode_bytes(ids).decode("utf-8", "replace").encode()
            return len(ids), ids if keep_ids else None, hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return lambda rows: [one(t) for t in rows]

    into = fresh(docs, into)
    return docs.withColumn(into, row_function("n bigint, ids array<int>, ids_sha256 string, decoded_sha256 string", start)(utf8(text_col))), into


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None, into: str = "text") -> tuple[DataFrame, str]:
    """rows with the text of a column of ids; null for null."""
    path = path or default_path()

    def start():
        tokenizer = load(path)
        return lambda lists: [(None if x is None else tokenizer.decode(x),) for x in lists]

    into = fresh(rows, into)
    return rows.withColumn(into, row_function("text string", start)(F.col(ids_col))["text"]), into


def query(spark, sf_dir):
    out, at = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)
    return out.select("doc_id", F.col(f"{at}.n").alias("n_tokens"), f"{at}.ids_sha256", f"{at}.decoded_sha256")
