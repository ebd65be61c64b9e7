"""The registered queries of the metadata engine, each over whole tables, and the same in DuckDB's SQL."""

import uuid

from pyspark.sql import functions as F

from skiff.functions import scalars as S
from skiff.operators import blobs, kv, oplog
from skiff.operators.store import shared_dir
from skiff.plans import views as V
from skiff.sources import http, multipart, resp

PATH, DIR = "/en/src0/", "/en/"
DAY = "2024-01-01"
_F = """f AS (SELECT 'p:/' || lang || '/' || source || '/doc_' || doc_id || '.' || ['txt', 'JPG', 'mp4', 'nef'][doc_id % 4 + 1] AS index_key,
  'doc_' || doc_id || '.' || ['txt', 'JPG', 'mp4', 'nef'][doc_id % 4 + 1] AS file_name, sha256(text) AS file_hash, '/' || lang || '/' || source || '/' AS file_path,
  '' AS file_author, strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d') AS file_time, CAST(strlen(text) AS BIGINT) AS file_size,
  ['application/octet-stream', 'image/jpeg', 'video/mp4', 'application/octet-stream'][doc_id % 4 + 1] AS content_type, doc_id, text FROM documents),
ph AS (SELECT file_hash, arg_min(file_size, index_key) AS file_size, arg_min(content_type, index_key) AS content_type, CAST(count(*) AS INTEGER) AS ref_count FROM f GROUP BY file_hash)"""
_COLS = "index_key, file_name, file_hash, file_path, file_author, file_time, file_size, content_type"
_EDGE_PATHS = ["", "/", "//", "a", "a//b///", "/a/./b"]
_EDGE_SIZES = [0, 1, 1023, 1024, 1280, 1536, 1048575, 1048576, 1 << 40, 1 << 50]
_OPS = """o AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS k, CASE WHEN event_type IN ('error', 'signup') THEN 'remove' {move} ELSE 'save' END AS op,
  CASE WHEN {saves} THEN sha256(props) END AS h, CAST(strlen(props) AS BIGINT) AS size FROM events),
l AS (SELECT *, lag(op) OVER w AS po, lag(h) OVER w AS ph, lag(size) OVER w AS ps, lead(seq) OVER w AS nx FROM o WINDOW w AS (PARTITION BY k ORDER BY seq))"""
_PLAIN = _OPS.format(move="", saves="event_type NOT IN ('error', 'signup')")
_MOVES = _OPS.format(move="WHEN event_type = 'click' THEN 'move'", saves="event_type NOT IN ('error', 'signup', 'click')")
_URLP = r"regexp_replace(regexp_extract(url, '^https?://[^/]*(.*)$', 1), '#.*$', '')"
_VERB, _ALIVE = "['GET', 'POST', 'DELETE'][page_id % 3 + 1]", "['keep-alive', 'Close', ''][page_id % 3 + 1]"


def _asked(spark, sf_dir):
    """Hashes to ask for: of every document, and one that does not exist for each."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    real = d.select((F.col("doc_id") * 2).alias("pos"), S.content_hash("text").alias("file_hash"))
    return real.unionByName(d.select((F.col("doc_id") * 2 + 1).alias("pos"), S.content_hash(F.concat(F.lit("missing"), F.col("doc_id").cast("string"))).alias("file_hash")))


_ASKED = "a AS (SELECT doc_id * 2 AS pos, sha256(text) AS file_hash FROM documents UNION ALL SELECT doc_id * 2 + 1, sha256('missing' || doc_id) FROM documents)"


def _download(spark, sf_dir):
    f = V.files(spark, sf_dir)
    n = F.regexp_extract("file_name", r"_(\d+)", 1).cast("bigint")
    q = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("path="), S.url_encode("file_path"), F.lit("&name="), S.url_encode("file_name"), F.lit("&dl=1"))).otherwise(F.concat(F.lit("name=none&path="), S.url_encode("file_path")))
    url = F.concat(F.lit("/api/files/"), F.when(n % 5 == 0, F.lit("0")).otherwise(F.col("file_hash")), F.lit("/download"))
    return V.catalog(spark, sf_dir).download(f.select(n.alias("id"), url.alias("url_path"), q.alias("query"))).drop("url_path", "query")


def _pages(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", "url")


def _requests(spark, sf_dir):
    return http.requests(V.http_chunks(spark, sf_dir))


def _routes(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages").select("page_id")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % by + 1).cast("int"))
    r = p.select("page_id", pick(("GET", "post", "DELETE", "PATCH"), 4).alias("m"), pick(("/", "/api/files", "/api/files/x/download", "/api/files/move", "/other"), 5).alias("p"), (F.col("page_id") % 3 + 65535).alias("length"))
    return r.select("page_id", S.handler("m", "p").alias("handler"), S.streams("m", "p", "length").alias("streams"), S.streams("m", "p", "length", True).alias("streams_at"), S.method("m").alias("method"), S.reason(F.lit(200) + F.col("page_id") % 3 * 102).alias("reason"))


def _moves(spark, sf_dir):
    body = F.to_json(F.struct(F.col("file_path").alias("old_path"), F.col("file_name").alias("old_name"), F.when(F.col("file_size") % 2 == 0, "/new/").otherwise("").alias("new_path")))
    return oplog.check_moves(V.files(spark, sf_dir).select("index_key", body.alias("body"))).drop("body")


def _deletes(spark, sf_dir):
    q = F.concat(F.lit("path="), S.url_encode("file_path"), F.when(F.col("file_size") % 2 == 0, F.concat(F.lit("&name="), S.url_encode("file_name"))).otherwise(""))
    return oplog.check_deletes(V.files(spark, sf_dir).select("index_key", q.alias("query"))).drop("query")


def _blob_write(spark, sf_dir):
    root = f"{shared_dir(spark)}/blobs-{uuid.uuid4().hex}"
    d = V.table(spark, sf_dir, "documents").select(F.col("text").alias("content"), "doc_id")
    for k in (0, 1):  # the second write finds what the first has stored
        blobs.write(blobs.from_contents(d if k else d.where("doc_id % 2 = 0")), root)
    return blobs.read(spark, root).select("file_hash", "shard", F.octet_length("content").cast("bigint").alias("size"))


def _catalog_stored(spark, sf_dir):
    """The listing of a catalog that was written in key order and opened again."""
    root = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}"
    V.catalog(spark, sf_dir).write(root)
    from skiff.operators.catalog import Catalog

    return Catalog.open(spark, root).list_by_path(PATH)


def _stream(decoder, schema, chunks):
    """A streaming run over the same chunks as in batch, written to a table and read again."""

    def query(spark, sf_dir):
        from skiff.streaming import decoders

        root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        chunks(spark, sf_dir).repartitionByRange(4, "seq").write.parquet(f"{root}/in")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", decoders.STORE)
        made = decoders.decode_stream(decoders.read_chunks(spark, f"{root}/in", 100), decoder, schema)
        made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(made.schema).parquet(f"{root}/out")

    return query


def _uploads(spark, sf_dir):
    parts = multipart.parts(V.multipart_chunks(spark, sf_dir), V.BOUNDARY)
    return oplog.uploads(parts.select(F.lit("up//load").alias("path"), "filename", "content_type", "data"), DAY)


def _union_literals(spark, df, name, values, kind):
    return df.unionByName(spark.createDataFrame([(v,) for v in values], f"{name} {kind}"))


def _sizes(spark, sf_dir):
    n = _union_literals(spark, V.files(spark, sf_dir).select(F.col("file_size").alias("n")), "n", _EDGE_SIZES, "bigint")
    return n.select("n", S.format_size("n").alias("label"))


def _values(xs):
    return ", ".join(f"('{x}')" if isinstance(x, str) else f"({x})" for x in xs)


def _replay(moves):
    return lambda spark, sf_dir: oplog.refs_after_replay(oplog.replay(V.op_log(spark, sf_dir, moves)))


def _replay_sql(hashes: bool) -> str:
    """The log in order, one step an operation: the hash that each user's name holds, and each hash's references."""
    gone = "WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'remove_hash'" if hashes else ""
    return f"""WITH RECURSIVE h AS (SELECT props, row_number() OVER (ORDER BY props) AS x, sha256(props) AS file_hash FROM (SELECT DISTINCT props FROM events)),
    o AS (SELECT row_number() OVER (ORDER BY event_id) AS rn, user_id + 1 AS u, event_id * 7 % 150 + 1 AS t, x,
      CASE WHEN event_type IN ('error', 'signup') THEN 'remove' WHEN event_type = 'click' THEN 'move' {gone} ELSE 'save' END AS op FROM events JOIN h USING (props)),
    r AS (SELECT CAST(0 AS BIGINT) AS rn, list_transform(range(0, (SELECT greatest(max(user_id), 149) + 1 FROM events)), lambda v: CAST(0 AS BIGINT)) AS p, list_transform(range(0, (SELECT count(*) FROM h)), lambda v: CAST(0 AS BIGINT)) AS c
      UNION ALL SELECT o.rn,
        CASE WHEN op = 'save' THEN list_transform(p, lambda v, i: CASE WHEN i = u THEN x ELSE v END)
             WHEN op = 'move' AND p[u] > 0 THEN list_transform(p, lambda v, i: CASE WHEN i = t THEN p[u] WHEN i = u THEN 0 ELSE v END)
             WHEN op = 'remove' AND p[u] > 0 AND c[p[u]] > 0 THEN list_transform(p, lambda v, i: CASE WHEN i = u THEN 0 ELSE v END) ELSE p END,
        CASE WHEN op = 'save' THEN list_transform(c, lambda v, i: CASE WHEN i = x THEN v + 1 ELSE v END)
             WHEN op = 'remove_hash' THEN list_transform(c, lambda v, i: CASE WHEN i = x THEN 0 ELSE v END)
             WHEN op = 'remove' AND p[u] > 0 AND c[p[u]] > 0 THEN list_transform(c, lambda v, i: CASE WHEN i = p[u] THEN v - 1 ELSE v END) ELSE c END
      FROM r JOIN o ON o.rn = r.rn + 1),
    e AS (SELECT p, c FROM r ORDER BY rn DESC LIMIT 1),
    live AS (SELECT v AS x, count(*) AS n FROM (SELECT unnest(p) AS v FROM e) WHERE v > 0 GROUP BY v)
    SELECT file_hash, CAST((SELECT c FROM e)[x] AS BIGINT) AS ref_count, coalesce(n, 0) AS live_refs FROM h LEFT JOIN live USING (x) WHERE (SELECT c FROM e)[x] > 0 OR n > 0"""


# (op, path, name, new_path, new_name, hash): a move and then a remove, moves onto entries and onto themselves, remove_hash before a remove
_EDGE_OPS = [
    ("save", "/", "a", None, None, "x"), ("move", "/", "a", "/d", "b", None), ("remove", "/d/", "b", None, None, None), ("save", "/", "c", None, None, "x"), ("save", "/", "e", None, None, "y"),
    ("move", "/", "c", "/", "e", None), ("move", "/", "e", "/", "", None), ("move", "/", "none", "/", "f", None), ("save", "/", "g", None, None, "z"), ("remove_hash", None, None, None, None, "z"),
    ("remove", "/", "g", None, None, None), ("save", "/", "h", None, None, "z"), ("remove", "/", "h", None, None, None), ("save", "/", "k", None, None, "z"),
]


def _edge_log(spark):
    rows = [(i, op, p, n, np, nn, h, None if h is None else i, f"t{i}", DAY, "") for i, (op, p, n, np, nn, h) in enumerate(_EDGE_OPS)]
    return spark.createDataFrame(rows, oplog.LOG_SCHEMA)


def _kv_log(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    k, v = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    t = F.col("event_type")
    args = F.when(t == "click", F.array(F.lit("get"), k)).when(t == "error", F.array(F.lit("PING"))).when(t == "signup", F.array(F.lit("Set"), k, v)).when(t == "view", F.array(F.lit("SET"), k)).otherwise(F.array(F.lit("SET"), k, v))
    return e.select(F.col("event_id").alias("seq"), args.alias("args"))


_HTTP_SQL = rf"""SELECT page_id AS conn_id, CAST(0 AS BIGINT) AS n, {_VERB} AS method, split_part({_URLP}, '?', 1) AS path, split_part({_URLP}, '?', 2) AS query, 'HTTP/1.1' AS version, regexp_extract(url, '^https?://([^/]*)', 1) AS host,
        CAST(strlen('id=' || page_id) AS BIGINT) AS length, 'id=' || page_id AS body, {_ALIVE} <> 'Close' AS alive, CAST(NULL AS VARCHAR) AS error FROM pages"""
_RESP_SQL = """SELECT user_id AS conn_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, 'SET ' || user_id || ' ' || event_id AS args,
  CAST(NULL AS VARCHAR) AS error FROM events"""


def _http_columns(rows):
    h = F.col("headers")
    return rows.select(
        "conn_id", "n", "method", "path", "query", "version", h["host"].alias("host"), S.content_length(h["content-length"]).alias("length"), F.decode("body", "UTF-8").alias("body"),
        S.keep_alive(h["connection"], "version").alias("alive"), "error",
    )


def _resp_columns(rows):
    return rows.select("conn_id", "n", F.concat_ws(" ", "args").alias("args"), "error")


def _upload_parts(spark, sf_dir):
    """The parts of HTTP uploads, with the directory that their request names."""
    asked = http.requests(V.upload_chunks(spark, sf_dir))
    path = asked.select("conn_id", F.col("n").alias("request"), S.url_decode(S.query_param("query", "path")).alias("path"))
    return multipart.parts_of_requests(asked).join(path, ["conn_id", "request"])


def _numbered(spark, sf_dir):
    f = V.files(spark, sf_dir).select("file_path", "file_name")
    return f.withColumn("id", F.regexp_extract("file_name", r"_(\d+)", 1).cast("bigint"))


def _delete_requests(spark, sf_dir):
    """Of an entry, of one that is not there, and without a name."""
    name = F.when(F.col("id") % 3 == 0, F.col("file_name")).when(F.col("id") % 3 == 1, "gone").otherwise("")
    return _numbered(spark, sf_dir).select("id", F.concat(F.lit("path="), S.url_encode("file_path"), F.lit("&name="), name).alias("query"))


def _move_requests(spark, sf_dir):
    name = F.when(F.col("id") % 3 == 1, "gone").otherwise(F.col("file_name"))
    body = F.to_json(F.struct(F.col("file_path").alias("old_path"), name.alias("old_name"), F.when(F.col("id") % 3 == 2, "").otherwise("/new").alias("new_path")))
    return _numbered(spark, sf_dir).select("id", body.alias("body"))


QUERIES = {
    "list_by_path": (lambda s, d: V.catalog(s, d).list_by_path(PATH), f"WITH {_F} SELECT {_COLS} FROM f WHERE file_path = '{PATH}'"),
    "catalog_write_open": (_catalog_stored, f"WITH {_F} SELECT {_COLS} FROM f WHERE file_path = '{PATH}'"),
    "prefix_scan": (lambda s, d: V.catalog(s, d).prefix_scan(DIR), f"WITH {_F} SELECT {_COLS} FROM f WHERE index_key >= 'p:{DIR}' AND index_key < 'p:/en0'"),
    "list_sub_dirs": (lambda s, d: V.catalog(s, d).list_sub_dirs(DIR), f"WITH {_F} SELECT DISTINCT split_part(file_path, '/', 3) AS name FROM f WHERE starts_with(file_path, '{DIR}')"),
    "list_root": (lambda s, d: V.catalog(s, d).list_all(), f"WITH {_F} SELECT {_COLS} FROM f WHERE file_path = '/'"),
    "list_recursive": (lambda s, d: V.catalog(s, d).list_recursive(), f"WITH {_F} SELECT {_COLS} FROM f"),
    "get_meta_by_path": (lambda s, d: V.catalog(s, d).get_by_path("en//src1", "doc_1.JPG"), f"WITH {_F} SELECT {_COLS} FROM f WHERE file_path = '/en/src1/' AND file_name = 'doc_1.JPG'"),
    "get_meta_by_hash": (
        lambda s, d: (lambda c: c.phys_index.join(_asked(s, d).select("file_hash").distinct(), "file_hash").select("file_hash", F.lit("").alias("file_name"), F.lit("").alias("file_path"), "file_size", "content_type"))(V.catalog(s, d)),
        f"WITH {_F} SELECT file_hash, '' AS file_name, '' AS file_path, file_size, content_type FROM ph",
    ),
    "phys_index": (lambda s, d: V.catalog(s, d).phys_index, f"WITH {_F} SELECT * FROM ph"),
    "batch_get": (lambda s, d: V.catalog(s, d).batch_join(_asked(s, d)), f"WITH {_F}, {_ASKED} SELECT pos, file_hash, file_size, content_type FROM a JOIN ph USING (file_hash)"),
    "is_referenced": (lambda s, d: V.catalog(s, d).is_referenced(_asked(s, d)), f"WITH {_F}, {_ASKED} SELECT file_hash, ref_count IS NOT NULL AS referenced FROM a LEFT JOIN ph USING (file_hash)"),
    "ref_count": (lambda s, d: V.catalog(s, d).ref_counts(_asked(s, d)), f"WITH {_F}, {_ASKED} SELECT file_hash, coalesce(ref_count, 0) AS ref_count FROM a LEFT JOIN ph USING (file_hash)"),
    "download_lookup": (
        _download,
        f"""WITH {_F} SELECT f.doc_id AS id, CASE WHEN f.doc_id % 5 = 0 THEN '0' ELSE f.file_hash END AS hash,
        CAST(CASE WHEN f.doc_id % 3 = 1 OR f.doc_id % 5 <> 0 THEN 200 ELSE 404 END AS INTEGER) AS status, CASE WHEN f.doc_id % 3 = 1 OR f.doc_id % 5 <> 0 THEN f.file_size END AS file_size,
        CASE WHEN f.doc_id % 3 = 1 THEN content_type ELSE 'application/octet-stream' END AS content_type,
        CASE WHEN f.doc_id % 3 = 1 THEN 'attachment; filename="' || file_name || '"' ELSE 'inline; filename="download"' END AS disposition, NOT (f.doc_id % 3 = 1 AND f.doc_id % 5 = 0) AS hash_matches FROM f""",
    ),
    "orphan_gc": (
        lambda s, d: (lambda c: type(c)(c.path_index.where(F.col("file_name").endswith(".JPG")), c.phys_index).orphans(c.phys_index.select("file_hash")))(V.catalog(s, d)),
        f"WITH {_F} SELECT file_hash FROM ph WHERE file_hash NOT IN (SELECT file_hash FROM f WHERE file_name LIKE '%.JPG')",
    ),
    "shard_histogram": (lambda s, d: V.files(s, d).select("file_hash").distinct().groupBy(S.shard("file_hash").alias("shard")).agg(F.count(F.lit(1)).alias("n")), f"WITH {_F} SELECT substr(file_hash, 1, 2) AS shard, count(*) AS n FROM ph GROUP BY 1"),
    "blob_path": (lambda s, d: V.files(s, d).select("file_name", S.blob_path("/data/", "file_hash").alias("blob")), f"WITH {_F} SELECT file_name, '/data/' || substr(file_hash, 1, 2) || '/' || file_hash AS blob FROM f"),
    "blob_write_dedup": (_blob_write, f"WITH {_F} SELECT file_hash, substr(file_hash, 1, 2) AS shard, file_size AS size FROM ph"),
    "blob_remove": (
        lambda s, d: blobs.remove(V.files(s, d).select("file_hash", "file_name"), V.files(s, d).where(F.col("file_size") % 2 == 0)).select("file_hash", "file_name"),
        f"WITH {_F} SELECT file_hash, file_name FROM f WHERE file_hash NOT IN (SELECT file_hash FROM f WHERE file_size % 2 = 0)",
    ),
    "blob_range_read": (
        lambda s, d: blobs.read_range(V.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file_hash"), F.col("text").cast("binary").alias("content")), 100, 64).select("file_hash", F.hex("part").alias("part")),
        "SELECT CAST(doc_id AS VARCHAR) AS file_hash, upper(substr(hex(encode(text)), 201, 128)) AS part FROM documents",
    ),
    "sha256_content": (lambda s, d: V.table(s, d, "documents").select("doc_id", S.content_hash("text").alias("h")), "SELECT doc_id, sha256(text) AS h FROM documents"),
    "mime_type": (
        lambda s, d: V.files(s, d).select("file_name", S.mime_type("file_name").alias("live"), S.mime_type("file_name", "wide").alias("wide"), S.extension("file_name").alias("ext"), S.file_type("file_name").alias("kind"), S.is_image("file_name").alias("image"), S.preview_kind("file_name").alias("preview")),
        f"""WITH {_F} SELECT file_name, content_type AS live, ['application/octet-stream', 'image/jpeg', 'video/mp4', 'image/x-raw'][doc_id % 4 + 1] AS wide, lower(split_part(file_name, '.', -1)) AS ext,
        ['other', 'image', 'video', 'raw'][doc_id % 4 + 1] AS kind, doc_id % 4 IN (1, 3) AS image, ['download', 'image', 'video', 'raw'][doc_id % 4 + 1] AS preview FROM f""",
    ),
    "format_size": (
        _sizes,
        f"""WITH {_F}, n AS (SELECT file_size AS n FROM f UNION ALL SELECT * FROM (VALUES {_values(_EDGE_SIZES)})), p AS (SELECT n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 WHEN n < 1125899906842624 THEN 4 ELSE 5 END AS i FROM n)
        SELECT n, CASE WHEN i = 0 THEN n || ' B' ELSE printf('%.1f', floor(n / power(1024, i) * 10 + 0.5) / 10) || ' ' || ['KB', 'MB', 'GB', 'TB', 'undefined'][i] END AS label FROM p""",
    ),
    "normalize_path": (
        lambda s, d: _union_literals(s, _pages(s, d).select(F.col("url").alias("s")), "s", _EDGE_PATHS, "string").select("s", S.normalize_path("s").alias("path")),
        f"WITH s AS (SELECT url AS s FROM pages UNION ALL SELECT * FROM (VALUES {_values(_EDGE_PATHS)})) SELECT s, regexp_replace(regexp_replace('/' || s, '/+', '/', 'g'), '/$', '') || '/' AS path FROM s",
    ),
    "query_param": (
        lambda s, d: _pages(s, d).select("page_id", S.query_param(F.regexp_extract("url", r"\?([^#]*)", 1), "page").alias("page"), S.query_param(F.regexp_extract("url", r"\?([^#]*)", 1), "age", False).alias("loose")),
        r"SELECT page_id, regexp_extract(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&)page=([^&]*)', 1) AS page, regexp_extract(regexp_extract(url, '\?([^#]*)', 1), 'age=([^&]*)', 1) AS loose FROM pages",
    ),
    "url_decode": (lambda s, d: _pages(s, d).select("page_id", S.url_decode(S.url_encode("url")).alias("url"), S.url_encode("url").alias("encoded")), "SELECT page_id, url_decode(url_encode(url)) AS url, url_encode(url) AS encoded FROM pages"),
    "http_requests": (
        lambda s, d: _http_columns(_requests(s, d)),
        _HTTP_SQL,
    ),
    "route_dispatch": (
        _routes,
        """WITH r AS (SELECT page_id, ['GET', 'POST', 'DELETE', ''][page_id % 4 + 1] AS method, ['/', '/api/files', '/api/files/x/download', '/api/files/move', '/other'][page_id % 5 + 1] AS p, page_id % 3 + 65535 AS n FROM pages)
        SELECT page_id, CASE WHEN p = '/' THEN 'static' WHEN p = '/api/files' THEN CASE method WHEN 'GET' THEN 'list' WHEN 'POST' THEN 'upload' WHEN 'DELETE' THEN 'delete' ELSE 'none' END WHEN p LIKE '%/download' THEN 'download' WHEN p = '/api/files/move' AND method = 'POST' THEN 'move' ELSE 'none' END AS handler,
        method = 'POST' AND p = '/api/files' AND n > 65536 AS streams, method = 'POST' AND p = '/api/files' AND n >= 65536 AS streams_at, method, ['OK', 'Found', 'Not Found'][page_id % 3 + 1] AS reason FROM r""",
    ),
    "escape_json": (
        lambda s, d: V.table(s, d, "documents").select("doc_id", S.escape_json("text").alias("escaped"), S.unescape_json(S.escape_json("text")).alias("back"), S.escape_html("text").alias("html")),
        r"""SELECT doc_id, replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS escaped, text AS back, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM documents""",
    ),
    "meta_json_roundtrip": (
        lambda s, d: V.files(s, d).select("index_key", F.to_json(F.struct("file_name", "file_hash", "file_size")).alias("j")).select("index_key", S.json_text("j", "file_name").alias("file_name"), S.json_text("j", "none").alias("none"), S.json_number("j", "file_size").alias("file_size"), S.json_number("j", "file_hash2").alias("zero")),
        f"WITH {_F} SELECT index_key, file_name, '' AS none, file_size, CAST(0 AS BIGINT) AS zero FROM f",
    ),
    "gallery_search": (lambda s, d: V.catalog(s, d).gallery("OC_1", "image").select("index_key", "file_name"), f"WITH {_F} SELECT index_key, file_name FROM f WHERE contains(lower(file_name), 'oc_1') AND doc_id % 4 IN (1, 3)"),
    "gallery_folders": (lambda s, d: V.catalog(s, d).gallery_folders(DIR, "SRC1", "image"), f"WITH {_F} SELECT DISTINCT split_part(file_path, '/', 3) AS name FROM f WHERE starts_with(file_path, '{DIR}') AND contains(split_part(file_path, '/', 3), 'src1')"),
    "listing_json": (
        lambda s, d: V.catalog(s, d).listing_json().select("path", F.get_json_object("body", "$.folders[0]").alias("first_folder"), F.size(F.from_json(F.get_json_object("body", "$.files"), "array<struct<file_name:string>>")).cast("bigint").alias("n_files"), F.get_json_object("body", "$.files[0].file_name").alias("first_file"), F.get_json_object("body", "$.files[0].file_author").alias("author")),
        f"""WITH {_F}, up AS (SELECT DISTINCT '/' AS path, split_part(file_path, '/', 2) AS name FROM f UNION SELECT '/' || split_part(file_path, '/', 2) || '/', split_part(file_path, '/', 3) FROM f),
        a AS (SELECT path, min(name) AS first_folder FROM up GROUP BY path), b AS (SELECT file_path AS path, count(*) AS n_files, min(file_name) AS first_file FROM f GROUP BY 1)
        SELECT path, first_folder, coalesce(n_files, 0) AS n_files, first_file, CAST(NULL AS VARCHAR) AS author FROM a FULL JOIN b USING (path)""",
    ),
    "oplog_path_index": (
        lambda s, d: oplog.path_index(V.op_log(s, d)).select("key", "file_hash", "file_size", "seq"),
        f"WITH {_PLAIN} SELECT 'p:/u/' || k AS key, h AS file_hash, size AS file_size, seq FROM l WHERE nx IS NULL AND op = 'save'",
    ),
    "oplog_ref_count": (
        lambda s, d: oplog.ref_counts(V.op_log(s, d)),
        f"WITH {_PLAIN}, d AS (SELECT h, 1 AS v FROM l WHERE op = 'save' UNION ALL SELECT ph, -1 FROM l WHERE op = 'remove' AND po = 'save') SELECT h AS file_hash, CAST(sum(v) AS INTEGER) AS ref_count FROM d GROUP BY h HAVING sum(v) > 0",
    ),
    "oplog_phys_index": (
        lambda s, d: oplog.phys_index(V.op_log(s, d)),
        f"WITH {_PLAIN}, d AS (SELECT h, 1 AS v, size FROM l WHERE op = 'save' UNION ALL SELECT ph, -1, NULL FROM l WHERE op = 'remove' AND po = 'save') SELECT h AS file_hash, max(size) AS file_size, 'application/json' AS content_type, CAST(sum(v) AS INTEGER) AS ref_count FROM d GROUP BY h HAVING sum(v) > 0",
    ),
    "oplog_applied": (
        lambda s, d: oplog.applied(V.op_log(s, d)).select("seq", "op", "applied"),
        f"WITH {_PLAIN} SELECT seq, op, op = 'save' OR coalesce(po, '') = 'save' AS applied FROM l",
    ),
    "oplog_moves_fresh": (
        lambda s, d: oplog.path_index(V.op_log(s, d, "fresh")).select("key", "file_hash", "seq"),
        f"WITH {_MOVES} SELECT 'p:/u/' || k AS key, h AS file_hash, seq FROM l WHERE nx IS NULL AND op = 'save' UNION ALL SELECT 'p:/u/' || k || '#' || seq, ph, seq FROM l WHERE op = 'move' AND po = 'save'",
    ),
    "oplog_moves_general": (_replay("any"), _replay_sql(False)),
    "oplog_remove_hash": (_replay("hash"), _replay_sql(True)),
    "oplog_edge_paths": (
        lambda s, d: oplog.path_index(_edge_log(s)).select("key", "file_hash", "seq"),
        "SELECT * FROM (VALUES ('p:/e', 'x', CAST(6 AS BIGINT)), ('p:/g', 'z', 8), ('p:/k', 'z', 13)) AS t(key, file_hash, seq)",
    ),
    "oplog_edge_hashes": (
        lambda s, d: oplog.phys_index(_edge_log(s)),
        "SELECT * FROM (VALUES ('x', CAST(3 AS BIGINT), 't3', CAST(1 AS INTEGER)), ('y', 4, 't4', 1), ('z', 13, 't13', 1)) AS t(file_hash, file_size, content_type, ref_count)",
    ),
    "check_moves": (_moves, f"WITH {_F} SELECT index_key, file_path AS old_path, file_name AS old_name, CASE WHEN file_size % 2 = 0 THEN '/new/' ELSE '' END AS new_path, file_name AS new_name, CAST(CASE WHEN file_size % 2 = 0 THEN 200 ELSE 400 END AS INTEGER) AS status FROM f"),
    "check_deletes": (_deletes, f"WITH {_F} SELECT index_key, file_path AS path, CASE WHEN file_size % 2 = 0 THEN file_name ELSE '' END AS name, CAST(CASE WHEN file_size % 2 = 0 THEN 200 ELSE 400 END AS INTEGER) AS status FROM f"),
    "kv_state": (lambda s, d: kv.state(_kv_log(s, d)), "SELECT CAST(user_id AS VARCHAR) AS k, CAST(max(event_id) AS VARCHAR) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1"),
    "kv_replies": (
        lambda s, d: kv.replies(_kv_log(s, d)),
        """WITH e AS (SELECT *, CAST(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR) AS old FROM events)
        SELECT event_id AS seq, CASE event_type WHEN 'click' THEN coalesce('$' || strlen(old) || chr(13) || chr(10) || old, '$-1') WHEN 'error' THEN '+PONG' WHEN 'signup' THEN '-ERR unknown command ''Set''' WHEN 'view' THEN '-ERR wrong number of arguments for ''set'' command' ELSE '+OK' END || chr(13) || chr(10) AS reply FROM e""",
    ),
    "resp_decode": (
        lambda s, d: _resp_columns(resp.commands(V.resp_chunks(s, d))),
        _RESP_SQL,
    ),
    "multipart_decode": (
        lambda s, d: multipart.parts(V.multipart_chunks(s, d), V.BOUNDARY).select("conn_id", "n", "filename", "content_type", S.content_hash("data").alias("h"), "error"),
        "SELECT doc_id AS conn_id, CAST(0 AS BIGINT) AS n, 'doc_' || doc_id || '.txt' AS filename, 'text/plain' AS content_type, sha256(text) AS h, CAST(NULL AS VARCHAR) AS error FROM documents",
    ),
    "upload_commit": (
        _uploads,
        f"SELECT 'save' AS op, '/up/load/' AS path, 'doc_' || doc_id || '.txt' AS name, sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS file_size, 'text/plain' AS content_type, '{DAY}' AS file_time, '' AS file_author FROM documents",
    ),
    "breadcrumbs": (
        lambda s, d: V.files(s, d).select("index_key", F.explode(S.breadcrumbs("file_path")).alias("c")).select("index_key", "c.name", "c.path"),
        f"WITH {_F} SELECT index_key, split_part(file_path, '/', 2) AS name, '/' || split_part(file_path, '/', 2) || '/' AS path FROM f UNION ALL SELECT index_key, split_part(file_path, '/', 3), file_path FROM f",
    ),
    "download_url": (
        lambda s, d: V.files(s, d).select("index_key", S.download_url("file_hash", "file_path", "file_name", True).alias("url")).select("index_key", "url", S.url_hash("url").alias("h")),
        f"WITH {_F} SELECT index_key, '/api/files/' || file_hash || '/download?path=' || replace(file_path, '/', '%2F') || '&name=' || file_name || '&dl=1' AS url, file_hash AS h FROM f",
    ),
    "stream_resp": (lambda s, d: _resp_columns(_stream(resp.Decoder, resp.SCHEMA, V.resp_chunks)(s, d)), _RESP_SQL),
    "stream_http": (lambda s, d: _http_columns(_stream(http.Decoder, http.SCHEMA, V.http_chunks)(s, d)), _HTTP_SQL),
    "http_body_digest": (
        lambda s, d: http.digests(V.http_chunks(s, d)).select("conn_id", "n", "method", "size", "sha256"),
        f"SELECT page_id AS conn_id, CAST(0 AS BIGINT) AS n, {_VERB} AS method, CAST(strlen('id=' || page_id) AS BIGINT) AS size, sha256('id=' || page_id) AS sha256 FROM pages",
    ),
    "http_malformed": (
        lambda s, d: http.requests(V.bad_chunks(s, d, "http")).select("conn_id", "n", "path", "error"),
        """SELECT page_id AS conn_id, CAST(0 AS BIGINT) AS n, '/a' AS path, CAST(NULL AS VARCHAR) AS error FROM pages
        UNION ALL SELECT page_id, 1, NULL, ['malformed request line', 'malformed request line', 'header without a colon'][page_id % 3 + 1] FROM pages""",
    ),
    "resp_malformed": (
        lambda s, d: _resp_columns(resp.commands(V.bad_chunks(s, d, "resp"))),
        """SELECT page_id AS conn_id, CAST(0 AS BIGINT) AS n, 'PING' AS args, CAST(NULL AS VARCHAR) AS error FROM pages
        UNION ALL SELECT page_id, 1, '', ['ERR unknown protocol', 'ERR protocol error: invalid array length', 'ERR protocol error: invalid bulk string length'][page_id % 3 + 1] FROM pages""",
    ),
    "upload_http": (
        lambda s, d: oplog.uploads(_upload_parts(s, d), DAY),
        f"SELECT 'save' AS op, '/up/' || lang || '/' AS path, 'doc_' || doc_id || '.txt' AS name, sha256(coalesce(text, '')) AS file_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS file_size, 'text/plain' AS content_type, '{DAY}' AS file_time, '' AS file_author FROM documents",
    ),
    "upload_counts": (lambda s, d: oplog.upload_counts(_upload_parts(s, d)), "SELECT doc_id AS conn_id, CAST(0 AS BIGINT) AS request, CAST(1 AS BIGINT) AS stored FROM documents"),
    "delete_statuses": (
        lambda s, d: oplog.check_deletes(_delete_requests(s, d), V.files(s, d)).select("id", "status"),
        "SELECT doc_id AS id, CAST([200, 404, 400][doc_id % 3 + 1] AS INTEGER) AS status FROM documents",
    ),
    "move_statuses": (
        lambda s, d: oplog.check_moves(_move_requests(s, d), V.files(s, d)).select("id", "new_name", "status"),
        f"WITH {_F} SELECT doc_id AS id, CASE WHEN doc_id % 3 = 1 THEN 'gone' ELSE file_name END AS new_name, CAST([200, 404, 400][doc_id % 3 + 1] AS INTEGER) AS status FROM f",
    ),
    "delete_tally": (
        lambda s, d: oplog.tally(oplog.check_deletes(_delete_requests(s, d), V.files(s, d))),
        "SELECT count(*) FILTER (doc_id % 3 = 0) AS succeeded, count(*) FILTER (doc_id % 3 <> 0) AS failed FROM documents",
    ),
    "list_root_files": (
        lambda s, d: V.rooted(s, d).list_all(),
        f"WITH {_F} SELECT 'p:/' || file_name AS index_key, file_name, file_hash, '/' AS file_path, file_author, file_time, file_size, content_type FROM f WHERE doc_id % 10 = 0",
    ),
    "http_responses": (
        lambda s, d: V.table(s, d, "pages").select("page_id", F.decode(http.response(F.lit(200) + F.col("page_id") % 2 * 204, F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Zone"), F.col("url")), F.coalesce("html", F.lit(""))), "UTF-8").alias("bytes")),
        r"""SELECT page_id, replace('HTTP/1.1 ' || ['200 OK', '404 Not Found'][page_id % 2 + 1] || '~Content-Length: ' || strlen(coalesce(html, '')) || '~Content-Type: text/html~Zone: ', '~', chr(13) || chr(10)) || url || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS bytes FROM pages""",
    ),
    "boundary_and_day": (
        lambda s, d: V.table(s, d, "events").select("event_id", S.boundary(F.concat(F.lit('multipart/form-data; boundary="b'), F.col("user_id").cast("string"), F.lit('"; charset=x'))).alias("boundary"), S.day("ts").alias("day")),
        "SELECT event_id, 'b' || user_id AS boundary, strftime(ts, '%Y-%m-%d') AS day FROM events",
    ),
}


def entry(spark, sf_dir):
    """The flagship: one directory's folders and files."""
    c = V.catalog(spark, sf_dir)
    folders = c.list_sub_dirs(DIR).select(F.lit("folder").alias("kind"), "name", F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("bigint").alias("file_size"))
    return folders.unionByName(c.list_by_path(PATH).select(F.lit("file").alias("kind"), F.col("file_name").alias("name"), "file_hash", "file_size"))


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
