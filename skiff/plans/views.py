"""Deterministic inputs for the registered queries, made of the driver tables in full."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.functions import scalars as S
from skiff.operators.catalog import Catalog


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, sf_dir: str) -> DataFrame:
    """A path entry for each document: /lang/source/doc_N.ext, its text being the content."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    ext = F.element_at(F.array(*map(F.lit, ("txt", "JPG", "mp4", "nef"))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    path = F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
    return d.select(
        F.concat(F.lit("p:"), path, name).alias("index_key"), name.alias("file_name"), S.content_hash("text").alias("file_hash"), path.alias("file_path"), F.lit("").alias("file_author"), day.alias("file_time"),
        F.octet_length("text").cast("bigint").alias("file_size"), S.mime_type(name).alias("content_type"),
    )


def phys(path_index: DataFrame) -> DataFrame:
    """The physical index of a path index: size and type of the first entry by key, and the number of entries."""
    return path_index.groupBy("file_hash").agg(F.min_by("file_size", "index_key").alias("file_size"), F.min_by("content_type", "index_key").alias("content_type"), F.count(F.lit(1)).cast("int").alias("ref_count"))


def catalog(spark, sf_dir: str) -> Catalog:
    f = files(spark, sf_dir)
    return Catalog(f, phys(f))


def op_log(spark, sf_dir: str, moves: str | None = None) -> DataFrame:
    """events as operations: error and signup remove, the others save; key user_id, content props. moves: fresh (click moves
    to a name of its own), any (click moves to another user's name) or hash (as any; every fifth number, if a purchase, is remove_hash of its own props)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    op = F.when(F.col("event_type").isin("error", "signup"), "remove").when(F.lit(bool(moves)) & (F.col("event_type") == "click"), "move")
    op = op.when(F.lit(moves == "hash") & (F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0), "remove_hash").otherwise("save")
    user = F.col("user_id").cast("string")
    to = F.concat(user, F.lit("#"), F.col("event_id").cast("string")) if moves == "fresh" else (F.col("event_id") * 7 % 150).cast("string")
    return e.select(
        F.col("event_id").alias("seq"), op.alias("op"), F.lit("/u/").alias("path"), user.alias("name"), F.lit("/u/").alias("new_path"), to.alias("new_name"), F.when(op.isin("save", "remove_hash"), S.content_hash("props")).alias("file_hash"),
        F.octet_length("props").cast("bigint").alias("file_size"), F.lit("application/json").alias("content_type"), F.lit("2024-01-01").alias("file_time"), F.lit("").alias("file_author"),
    )


def http_chunks(spark, sf_dir: str) -> DataFrame:
    """A request for each page's URL, in two chunks that part its header block."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    rest = F.regexp_extract("url", "^https?://[^/]*(.*)$", 1)
    verb = F.element_at(F.array(*map(F.lit, ("GET", "post", "DELETE"))), (F.col("page_id") % 3 + 1).cast("int"))
    alive = F.element_at(F.array(*map(F.lit, ("keep-alive", "Close", ""))), (F.col("page_id") % 3 + 1).cast("int"))
    body = F.concat(F.lit("id="), F.col("page_id").cast("string"))
    text = F.concat(verb, F.lit(" "), F.regexp_replace(rest, "#.*$", ""), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", "^https?://([^/]*)", 1), F.lit("\r\nConnection:  "), alive, F.lit("\r\ncontent-length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    cut = (F.col("page_id") % 40 + 5).cast("int")
    return p.select("page_id", text.cast("binary").alias("t")).select(F.col("page_id").alias("conn_id"), F.posexplode(F.array(F.substring("t", 1, cut), F.substring("t", cut + 1, 1 << 30))).alias("seq", "data")).select("conn_id", F.col("seq").cast("bigint").alias("seq"), "data")


def resp_chunks(spark, sf_dir: str) -> DataFrame:
    """events as SET commands, a connection for each user, a chunk for each command, cut over into the next by nothing."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    k, v = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    bulk = lambda c: F.concat(F.lit("$"), F.octet_length(c).cast("string"), F.lit("\r\n"), c, F.lit("\r\n"))
    text = F.concat(F.lit("*3\r\n$3\r\nSET\r\n"), bulk(k), bulk(v)).cast("binary")
    cut = (F.col("event_id") % 20 + 3).cast("int")
    halves = e.select(F.col("user_id").alias("conn_id"), "event_id", F.posexplode(F.array(F.substring(text, 1, cut), F.substring(text, cut + 1, 1 << 30))).alias("half", "data"))
    return halves.select("conn_id", (F.col("event_id") * 2 + F.col("half")).alias("seq"), "data")


BOUNDARY = "skiffboundary7d1"


def multipart_chunks(spark, sf_dir: str) -> DataFrame:
    """An upload of each document's text as a file, in chunks of 1000 bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.concat(F.lit(f'--{BOUNDARY}\r\nContent-Disposition: form-data; name="file"; filename="doc_'), F.col("doc_id").cast("string"), F.lit('.txt"\r\nContent-Type: text/plain\r\n\r\n'), "text", F.lit(f"\r\n--{BOUNDARY}--\r\n")).cast("binary")
    n = F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / 1000).cast("int"))
    return d.select("doc_id", body.alias("b")).select(F.col("doc_id").alias("conn_id"), "b", F.explode(n).alias("k")).select("conn_id", F.col("k").cast("bigint").alias("seq"), F.substring(F.col("b"), F.col("k") * 1000 + 1, F.lit(1000)).alias("data"))


def upload_chunks(spark, sf_dir: str) -> DataFrame:
    """An HTTP upload of each document's text as a file to /up/lang, with a second part that has no file name, in chunks of 900 bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    number = F.col("doc_id").cast("string")
    body = F.concat(
        F.lit(f'--{BOUNDARY}\r\nContent-Disposition: form-data; name="file"; filename="doc_'), number, F.lit('.txt"\r\nContent-Type: text/plain\r\n\r\n'), F.coalesce("text", F.lit("")),
        F.lit(f'\r\n--{BOUNDARY}\r\nContent-Disposition: form-data; name="note"\r\n\r\nx\r\n--{BOUNDARY}--\r\n'),
    )
    head = F.concat(F.lit("POST /api/files?path=%2Fup%2F"), "lang", F.lit(f" HTTP/1.1\r\nContent-Type: multipart/form-data; boundary={BOUNDARY}\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    n = F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / 900).cast("int"))
    whole = d.select(F.col("doc_id").alias("conn_id"), F.concat(head, body).cast("binary").alias("b"))
    return whole.select("conn_id", "b", F.explode(n).alias("k")).select("conn_id", F.col("k").cast("bigint").alias("seq"), F.substring(F.col("b"), F.col("k") * 900 + 1, F.lit(900)).alias("data"))


def bad_chunks(spark, sf_dir: str, kind: str) -> DataFrame:
    """Streams that go wrong after one good message, a connection for each page, in two chunks: kind http or resp."""
    p = table(spark, sf_dir, "pages").select("page_id")
    good = {"http": "GET /a HTTP/1.1\r\n\r\n", "resp": "*1\r\n$4\r\nPING\r\n"}[kind]
    bad = {"http": ["FOO / HTTP/1.1\r\n\r\n", "GET /\r\n\r\n", "GET / HTTP/1.1\r\nno colon\r\n\r\n"], "resp": ["hello\r\n", "*x\r\n", "*1\r\n$-1\r\n"]}[kind]
    text = F.concat(F.lit(good), F.element_at(F.array(*map(F.lit, bad)), (F.col("page_id") % 3 + 1).cast("int")), F.lit(good)).cast("binary")
    cut = (F.col("page_id") % 30 + 3).cast("int")
    halves = p.select(F.col("page_id").alias("conn_id"), F.posexplode(F.array(F.substring(text, 1, cut), F.substring(text, cut + 1, 1 << 30))).alias("seq", "data"))
    return halves.select("conn_id", F.col("seq").cast("bigint").alias("seq"), "data")


def rooted(spark, sf_dir: str) -> Catalog:
    """The catalog with every tenth document in the root directory."""
    f = files(spark, sf_dir)
    here = F.regexp_extract("file_name", r"_(\d+)", 1).cast("bigint") % 10 == 0
    f = f.withColumn("file_path", F.when(here, "/").otherwise(F.col("file_path"))).withColumn("index_key", S.index_key("file_path", "file_name"))
    return Catalog(f, phys(f))
