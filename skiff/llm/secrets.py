"""Secret scans: fixed patterns, and an assignment-aware lexer.

The fixed patterns are assign, access and hex (see BASE). The lexer reads a text as loosely written source or
configuration: it takes (name, value) pairs from `name = value`, `name: value`, `"name": value`, `name := value`,
`export NAME=value`, `x["name"] = value`, `name: type = value`, `a = b = value` and the like, where a value is a quoted
literal, several joined by `+` (scored as one) or listed in brackets, a bare literal, another name, or a literal on the line
after `name:`. Names are constants from then on: a value that is a name stands for the literals last assigned to it, so a
literal flows to each name it reaches. A literal is scored by the most sensitive name that it reaches (the name's words,
see NAME_WORDS) and by its shape (length, kinds of characters, distinct characters); at SCORE or more it is a finding of
kind `literal`, unless a fixed pattern's span holds it already.

Spans are code points, end exclusive, over the whole text. A null or empty text has none. Repeated documents are each
answered; no row is dropped; columns of docs are kept, and the result's column takes another name if docs has that one.
"""

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import fresh, row_function, table, utf8

# The base patterns, over bytes; all that they match is ASCII, so bytes and code points agree on matches.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: How sensitive a target name is, by its words (camel case and separators part them).
NAME_WORDS = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "secrets": 3, "token": 3, "tokens": 2, "apikey": 3, "credential": 3, "credentials": 3,
    "auth": 2, "authorization": 2, "bearer": 2, "signature": 1, "private": 1, "access": 1, "api": 1, "client": 0.5, "key": 1.5, "pin": 1, "salt": 1, "cookie": 1, "session": 1, "dsn": 1, "cert": 1,
}
SCORE = 4.0
_PAIR = re.compile(
    rb"""(?<![A-Za-z0-9_$.\-])[0-9.\-]*+([A-Za-z_$][A-Za-z0-9_$.\-]*+)(?:["']\]?|\])?[ \t]*+"""
    rb"""(?:(?::=|=>|[:=])(?![=:>])[ \t]*+(?=["'`A-Za-z0-9+/_$]|[(\[][(\[ \t\r\n]*+[bruf]{0,2}["'`])"""
    rb"""|:[ \t]*+(?:[|>][+\-]?[ \t]*+)?(\r?\n)[ \t]++(?:-[ \t]++)?(?=["'`A-Za-z0-9+/_$]))"""
)
_QUOTED = re.compile(rb"""[bruf]{0,2}+(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`)""")
_OPEN = re.compile(rb"""[(\[][(\[ \t\r\n]*+(?=[bruf]{0,2}["'`])""")
_NEXT = re.compile(rb"""[ \t\r\n]*+(,?)[ \t\r\n]*+(?=[bruf]{0,2}["'`])""")
# a further target of a chained assignment, or an annotation
_CHAIN = re.compile(rb"""([A-Za-z_$][A-Za-z0-9_$.]*+)(?:\[[^\]\n]{0,200}+\])?(?:[ \t]++:?=(?![=>])[ \t]*+(?=["'`A-Za-z0-9+/_$(\[])|=(?=["'`]))""")
_END = re.compile(rb"[ \t]*+(?:\r?\n|\Z)")
_BARE = re.compile(rb"[A-Za-z0-9+/_$.=~@!%^*-]++")
_JOIN = re.compile(rb"[ \t]*\+[ \t]*(?:\\?\n[ \t]*)?")
_IDENT = re.compile(rb"[A-Za-z_$][A-Za-z0-9_$.]*+\Z")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_SIGN = re.compile(rb"[ \t]*+(?::=|=>|[:=])")
_QUICK = re.compile(rb"""["'\]A-Za-z0-9_$][ \t]*[:=]""")


def name_score(name: bytes) -> float:
    """How sensitive a target name is: its strongest word and a share of the others."""
    found = sorted((NAME_WORDS.get(w.lower(), 0) for w in _WORD.findall(name.decode("ascii"))), reverse=True)
    return found[0] + 0.5 * sum(found[1:3]) if found else 0.0


def literal_score(value: bytes, strong: bool = False) -> float:
    """How much a literal looks like a secret: length, kinds of characters and distinct characters; 0 for plain words. One
    with blanks counts only under a strongly sensitive name, and without them."""
    if b" " in value:
        value = value.replace(b" ", b"") if strong else b""
    if len(value) < 6 or not value.strip():
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^A-Za-z0-9]"))
    return (len(value) >= 8) * 0.5 + (len(value) >= 16) * 0.5 + (kinds - 1) * 0.75 + (len(set(value)) >= min(10, len(value) * 0.6)) * 0.5


def lex(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the literals that reach a sensitive name.

    Each assignment is a node with its own literals and the earlier nodes that its value names; one pass back over the
    nodes hands each name's score to what flows into it, so the work is linear in the text."""
    if not _QUICK.search(text):
        return []
    known: dict[bytes, int] = {}
    nodes: list[tuple[float, list[list[tuple[int, int]]], list[int]]] = []
    at = 0
    while m := _PAIR.search(text, at):
        names, at = [m[1]], m.end()
        literals: list[list[tuple[int, int]]] = []
        uses: list[int] = []
        inside = joins = False
        while True:
            if not inside and (o := _OPEN.match(text, at)):
                inside, at = True, o.end()
            if q := _QUOTED.match(text, at):
                span = next(q.span(i) for i in (1, 2, 3) if q[i] is not None)
                at = q.end()
            elif not joins and not m[2] and (c := _CHAIN.match(text, at)):
                names.append(c[1])
                at = c.end()
                continue
            elif b := _BARE.match(text, at):
                if m[2] and not _END.match(text, b.end()):
                    break  # a nested key or a statement
                span = None
                if _IDENT.match(b[0]) and b[0] in known:
                    uses.append(known[b[0]])
                elif _SIGN.match(text, b.end()):
                    break  # a name of its own, as in nested keys; it is read next
                else:
                    span = b.span()
                at = b.end()
            else:
                break
            if span and joins and literals:
                literals[-1].append(span)
            elif span:
                literals.append([span])
            if j := _JOIN.match(text, at):
                joins, at = True, j.end()
            elif inside and (j := _NEXT.match(text, at)):
                joins, at = not j[1], j.end()
            else:
                break
        for name in names:
            for key in {name, name.rpartition(b".")[2]}:
                known[key] = len(nodes)
        nodes.append((max(map(name_score, names)), literals, uses))
    best = [score for score, _, _ in nodes]
    for k in range(len(nodes) - 1, -1, -1):
        for used in nodes[k][2]:
            best[used] = max(best[used], best[k])
    found = []
    for score, (_, literals, _) in zip(best, nodes, strict=True):
        for parts in literals if score >= 1.5 else ():
            shape = literal_score(b"".join(text[a:b] for a, b in parts), score >= 3)
            if shape > 0 and score + shape >= SCORE:
                # parts of one or two characters tell nothing, unless there are no others
                found += [(a, b) for a, b in parts if b - a > 2] or [(a, b) for a, b in parts if a < b]
    return sorted(found)


def scan(text: bytes | None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in code points, ordered by both."""
    if not text:
        return []
    low = text.lower()
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found += [(a, b, 3) for a, b in lex(text) if not any(x <= a and b <= y for x, y, _ in found)]
    found.sort(key=lambda s: (s[0], s[2], s[1]))
    if not found or text.isascii():
        return found
    marks = sorted({x for s in found for x in s[:2]})
    points, at, seen = {}, 0, 0
    for x in marks:
        seen += len(text[at:x].decode("utf-8", "replace"))
        points[x], at = seen, x
    return [(points[a], points[b], k) for a, b, k in found]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


FOUND = "n_assign bigint, n_access bigint, n_hex bigint, n_literal bigint, base_sha256 string, spans string, redacted string"


def mark(docs: DataFrame, text_col: str = "text", into: str = "secrets", redact: bool = False) -> tuple[DataFrame, str]:
    """docs with a struct column: counts by kind, base_sha256, spans, and, if redact, the text with each finding
    (overlapping ones together) replaced by [REDACTED] where there is any. One pass over the texts; no shuffle."""

    def start():
        def one(text):
            spans = scan(text)
            n = [sum(s[2] == k for s in spans) for k in range(4)]
            new = None
            if redact and spans:
                whole, parts, at = text.decode("utf-8", "replace"), [], 0
                for a, b, _ in spans:
                    if a >= at:
                        parts += [whole[at:a], "[REDACTED]"]
                    at = max(at, b)
                new = "".join([*parts, whole[at:]])
            return (*n, hashlib.sha256(joined([s for s in spans if s[2] < 3]).encode()).hexdigest(), joined(spans), new)

        return lambda rows: [one(t) for t in rows]

    into = fresh(docs, into)
    return docs.withColumn(into, row_function(FOUND, start)(utf8(text_col))), into


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with every finding replaced in the text (and length_col set to the new text's length); other rows as they are."""
    out, into = mark(docs, text_col, redact=True)
    new = F.coalesce(F.col(into)["redacted"], F.col(text_col))
    if length_col:
        out = out.withColumn(length_col, F.when(F.col(into)["redacted"].isNull(), F.col(length_col)).otherwise(F.length(F.col(into)["redacted"])))
    return out.withColumn(text_col, new).select(*docs.columns)


def query(spark, sf_dir):
    docs, at = mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *(f"{at}.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal")))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base columns for a text, straight from the patterns as they are stated."""
    t, out = text or "", []
    rules = ((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6), (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24))
    for k, (p, flags, ok) in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t, flags) if ok(m)]
    base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
    return (*(sum(x[1] == k for x in out) for k in range(3)), hashlib.sha256(base.encode()).hexdigest())
