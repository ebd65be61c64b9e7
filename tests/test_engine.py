import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skiff.functions import scalars as S
from skiff.operators import blobs, kv, oplog
from skiff.plans import queries as engine
from skiff.plans import views as V
from skiff.sources import http, multipart, resp
from skiff.sources.streams import decode


def one(spark, cases, build):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ", ".join(f"c{k} {'bigint' if isinstance(x, int) else 'string'}" for k, x in enumerate(cases[0])))
    return [r.out for r in rows.select("i", build(*[F.col(f"c{k}") for k in range(len(cases[0]))]).alias("out")).orderBy("i").collect()]


def test_paths_and_urls(spark):
    assert one(spark, [("",), ("/",), ("//",), ("a",), ("a//b///",), ("/a/./b",)], S.normalize_path) == ["/", "/", "/", "/a/", "/a/b/", "/a/./b/"]
    assert one(spark, [("a%2Fb+c",), ("100%25",), ("%",), ("%4",), ("%zz",), ("%C3%A9",)], S.url_decode) == ["a/b c", "100%", "%", "%4", "%zz", "é"]
    q = [("name=a&x=1",), ("filename=b&name=c",), ("x=1",), ("name=",), ("a=1&name=z",)]
    assert one(spark, q, lambda c: S.query_param(c, "name")) == ["a", "c", "", "", "z"]
    assert one(spark, q, lambda c: S.query_param(c, "name", False)) == ["a", "b", "", "", "z"]
    assert one(spark, [("a b/é!'()~*",)], S.url_encode) == ["a%20b%2F%C3%A9!'()~*"]
    assert one(spark, [("/api/files/abc/download",), ("/x",)], S.url_hash) == ["abc", ""]


def test_names_sizes_and_headers(spark):
    names = [("a.JPG",), ("b.tar.gz",), (".nef",), ("none",), ("x.html",), ("v.m2ts",)]
    assert one(spark, names, S.extension) == ["jpg", "gz", "nef", "", "html", "m2ts"]
    assert one(spark, names, S.file_type) == ["image", "other", "raw", "other", "other", "video"]
    assert one(spark, names, S.mime_type)[4] == "text/html; charset=utf-8"
    assert one(spark, [(0,), (1,), (1023,), (1024,), (1280,), (1536,), (1048576,), (1 << 40,)], S.format_size) == ["0 B", "1 B", "1023 B", "1.0 KB", "1.3 KB", "1.5 KB", "1.0 MB", "1.0 TB"]
    assert one(spark, [("keep-alive", "HTTP/1.0"), ("CLOSE", "HTTP/1.1"), ("", "HTTP/1.1"), ("", "HTTP/1.0")], S.keep_alive) == [True, False, True, False]
    assert one(spark, [('multipart/form-data; boundary="ab"',), ("multipart/form-data; boundary=cd",), ("x",)], S.boundary) == ["ab", "cd", ""]
    assert one(spark, [("12",), (" 7x",), ("abc",)], S.content_length) == [12, 7, 0]
    text = 'a"b\\c\nd\re\tf\x01'
    assert one(spark, [(text,)], lambda c: S.unescape_json(S.escape_json(c))) == [text]
    assert one(spark, [("\\q\\",), ("\x01a\x02",), ("\\\\n\\\\\\n\\\x01",)], S.unescape_json) == ["q\\", "\x01a\x02", "\\n\\\n\x01"]
    for f in (S.normalize_path, S.escape_json, S.unescape_json, S.url_decode, S.url_encode, S.extension, S.escape_html, lambda c: S.query_param(c, "x")):
        assert one(spark, [(None,), ("",)], lambda c: f(c.cast("string")).isNotNull()) == [True, True]


def ops(seed, moves=False, drops=False):
    r = random.Random(seed)
    out, seq = [], 0
    for _ in range(60):
        seq += 1
        kind = r.choice(["save"] * 3 + ["remove"] * 2 + ["move"] * moves + ["remove_hash"] * drops)
        h = r.choice("xyz")
        out.append((seq, kind, "/d/", r.choice("abc"), "/d/", r.choice("abcde"), h, ord(h), f"t{seq}", "2024-01-01", ""))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_window_fold_is_replay(spark, seed, monkeypatch):
    monkeypatch.setattr(oplog, "BLOCK", 7 if seed else 1 << 20)
    log, state = ops(seed), oplog.State()
    for seq, op, p, n, np, nn, h, size, t, *_ in log:
        state.apply(op, "p:" + p + n, "p:" + np + nn, h, size, t)
    df = spark.createDataFrame(log, oplog.LOG_SCHEMA)
    assert {r.key: r.file_hash for r in oplog.path_index(df).collect()} == {k: v["file_hash"] for k, v in state.paths.items()}
    want = {k: (v["file_size"], v["content_type"], v["ref_count"]) for k, v in state.phys.items()}
    assert {r.file_hash: (r.file_size, r.content_type, r.ref_count) for r in oplog.phys_index(df).collect()} == want
    assert {r.file_hash: r.ref_count for r in oplog.ref_counts(df).collect()} == {k: v[2] for k, v in want.items()}


@pytest.mark.parametrize("seed", range(4, 8))
def test_any_log_folds_as_replay(spark, seed, monkeypatch):
    """Moves and remove_hash: the folds find which keys to keep together; blocks of a few operations."""
    monkeypatch.setattr(oplog, "BLOCK", 7)
    log, state = ops(seed, True, seed % 2 == 1), oplog.State()
    for seq, op, p, n, np, nn, h, size, t, *_ in log:
        state.apply(op, "p:" + p + n, "p:" + np + nn, h, size, t, seq)
    df = spark.createDataFrame(log, oplog.LOG_SCHEMA)
    assert {r.key: (r.file_hash, r.seq) for r in oplog.path_index(df).collect()} == {k: (v["file_hash"], v["seq"]) for k, v in state.paths.items()}
    want = {k: (v["file_size"], v["content_type"], v["ref_count"]) for k, v in state.phys.items()}
    assert {r.file_hash: (r.file_size, r.content_type, r.ref_count) for r in oplog.phys_index(df).collect()} == want
    assert {r.file_hash: r.ref_count for r in oplog.ref_counts(df).collect()} == {k: v[2] for k, v in want.items()}


def test_move_then_remove(spark):
    rows = [(1, "save", "/", "a", None, None, "x", 1, "t", "", ""), (2, "move", "/", "a", "/", "b", None, None, None, "", ""), (3, "remove", "/", "b", None, None, None, None, None, "", "")]
    df = spark.createDataFrame(rows, oplog.LOG_SCHEMA)
    assert not oplog.path_index(df).count() and not oplog.ref_counts(df).count() and not oplog.phys_index(df).count()


def test_general_replay(spark):
    log, state = ops(9, True, True), oplog.State()
    for seq, op, p, n, np, nn, h, size, t, *_ in log:
        state.apply(op, "p:" + p + n, "p:" + np + nn, h, size, t)
    got = oplog.replay(spark.createDataFrame(log, oplog.LOG_SCHEMA), "path").collect()
    assert {r.key: r.file_hash for r in got if r.kind == "path"} == {k: v["file_hash"] for k, v in state.paths.items()}
    assert {r.file_hash: r.refs for r in got if r.kind == "hash"} == {k: v["ref_count"] for k, v in state.phys.items()}


REQUEST = b"POST /api/files?path=%2F HTTP/1.1\r\nHost: h\r\nContent-Length: 5\r\n\r\nhello"
RESP = b"*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$4\r\na\r\nb\r\n*1\r\n$4\r\nping\r\n"
FORM = b'pre\r\n--B\r\nContent-Disposition: form-data; name="f"; filename="a.txt"\r\nCONTENT-TYPE: text/plain\r\n\r\nx\r\n--\r\n-By\r\n--B\r\nContent-Disposition: form-data; filename="e"\r\n\r\n\r\n--B--\r\nepilogue'


@given(st.sampled_from([(resp.Decoder, RESP * 2), (resp.Decoder, RESP + b"*1\r\nx\r\n" + RESP), (resp.Decoder, RESP + b"*z\r\n" + RESP), (http.Decoder, REQUEST + b"GET / HTTP/1.1\r\nbad\r\n\r\n" + REQUEST), (http.Decoder, REQUEST * 3), (lambda: multipart.Decoder("B"), FORM)]), st.lists(st.integers(0, 400), max_size=8))
@settings(max_examples=300, deadline=None)
def test_chunks_do_not_matter(case, cuts):
    start, data = case
    whole = start()
    want = whole.feed(data) + whole.finish()
    at, d, got = 0, start(), []
    for c in [*sorted(min(c, len(data)) for c in cuts), len(data)]:
        got += d.feed(data[at:c])
        at = c
    assert got + d.finish() == want and want


def test_a_body_costs_its_length():
    import time

    took = []
    for n in (4000, 16000):
        d, began = http.Decoder(), time.perf_counter()
        d.feed(b"POST / HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % (n * 1000))
        rows = [r for _ in range(n) for r in d.feed(b"x" * 1000)]
        took.append(time.perf_counter() - began)
        assert len(rows) == 1 and len(rows[0][6]) == n * 1000
    assert took[1] < 12 * took[0] + 0.2


def test_decoders_rows():
    assert multipart.parse(FORM, "B") == [(0, "a.txt", "text/plain", b"x\r\n--\r\n-By", None), (1, "e", "", b"", None)]
    assert multipart.parse(FORM[:60], "B")[-1][4] == "unfinished part"
    assert multipart.parse(b"x", "")[0][4] == "no boundary"
    assert resp.Decoder().feed(RESP) == [(0, ["SET", "k", "a\r\nb"], None), (1, ["ping"], None)]
    for bad in (b"hello\r\n", b"*x\r\n", b"*1\r\nfoo\r\n", b"*1\r\n$z\r\n", b"*1\r\n$-1\r\n"):
        assert resp.Decoder().feed(bad + RESP)[0][2].startswith("ERR")
    r = http.Decoder().feed(REQUEST)[0]
    assert r[1:5] == ("POST", "/api/files", "path=%2F", "HTTP/1.1") and r[6] == b"hello" and dict(r[5])["content-length"] == "5"
    assert http.Decoder().feed(b"FOO / HTTP/1.1\r\n\r\n")[0][7] and http.Decoder().feed(b"GET / HTTP/1.1\r\nbad\r\n\r\n")[0][7]


def test_parts_of_requests(spark):
    body = b"POST /api/files HTTP/1.1\r\nContent-Type: multipart/form-data; boundary=B\r\nContent-Length: " + str(len(FORM)).encode() + b"\r\n\r\n" + FORM
    chunks = spark.createDataFrame([(1, k, body[k * 50 : k * 50 + 50]) for k in range(len(body) // 50 + 1)], "conn_id long, seq long, data binary")
    got = multipart.parts_of_requests(http.requests(chunks)).collect()
    assert [(r.filename, r.content_type) for r in got] == [("a.txt", "text/plain"), ("e", "")]
    saved = oplog.uploads(multipart.parts_of_requests(http.requests(chunks)).withColumn("path", F.lit("/up")), "2024-01-01").collect()
    assert [(r.path, r.name, r.file_size) for r in saved] == [("/up/", "a.txt", 10), ("/up/", "e", 0)]


def test_kv(spark):
    log = spark.createDataFrame([(1, ["SET", "k", "1"]), (2, ["get", "k"]), (3, ["Get", "k"]), (4, ["SET", "k"]), (5, ["GET", "z"]), (6, ["PING", "x"])], "seq long, args array<string>")
    got = {r.seq: r.reply for r in kv.replies(log).collect()}
    assert got == {1: "+OK\r\n", 2: "$1\r\n1\r\n", 3: "-ERR unknown command 'Get'\r\n", 4: "-ERR wrong number of arguments for 'set' command\r\n", 5: "$-1\r\n", 6: "+PONG\r\n"}
    assert kv.get(log, spark.createDataFrame([("k",), ("q",)], "k string")).orderBy("k").collect() == [("k", "1"), ("q", None)]


def test_blobs(spark, tmp_path):
    b = blobs.from_contents(spark.createDataFrame([(b"abc",), (b"abc",), (b"",)], "content binary"))
    blobs.write(b, str(tmp_path / "b"))
    blobs.write(b, str(tmp_path / "b"))
    assert blobs.read(spark, str(tmp_path / "b")).count() == 2
    assert {bytes(r.part) for r in blobs.read_range(b, 1, 9).collect()} == {b"bc", b""}


def test_stream_is_batch(spark):
    for name, chunks, decoder, schema in (("stream_resp", V.resp_chunks, resp.Decoder, resp.SCHEMA), ("stream_http", V.http_chunks, http.Decoder, http.SCHEMA)):
        sf = "/root/testdata/sf0.001"
        show = lambda df: sorted(map(repr, df.drop("headers").collect()))
        rows = decode(chunks(spark, sf), decoder, schema)
        assert show(engine.queries()[name](spark, sf)) == show(engine._resp_columns(rows) if name == "stream_resp" else engine._http_columns(rows))


def test_scan_is_pushed_down(spark):
    c = V.catalog(spark, "/root/testdata/sf0.001")
    plan = c.path_index.where(F.col("file_path") == "/en/src0/").select("file_name")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
