"""Scalar functions on paths, URLs, names, sizes, JSON and HTTP fields, as Column expressions inside code generation.

A missing value is an empty text or zero, never null, as everywhere in this data model."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content types by file name extension; "wide" has more than "live".
MIME_LIVE = {
    "html": "text/html; charset=utf-8", "htm": "text/html; charset=utf-8", "css": "text/css; charset=utf-8", "js": "application/javascript; charset=utf-8", "json": "application/json; charset=utf-8",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "mp4": "video/mp4", "mov": "video/quicktime", "mkv": "video/x-matroska",
}
MIME_WIDE = MIME_LIVE | {
    "bmp": "image/bmp", "avi": "video/x-msvideo", "raw": "image/x-raw", "nef": "image/x-raw", "cr2": "image/x-raw", "cr3": "image/x-raw", "arw": "image/x-raw", "dng": "image/x-raw", "orf": "image/x-raw", "rw2": "image/x-raw",
}
MIME_DEFAULT = "application/octet-stream"

# Extensions by kind of file.
IMAGE_EXTS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "tiff", "tif", "heic", "heif", "ico"]
RAW_EXTS = ["nef", "nrw", "cr2", "cr3", "arw", "sr2", "srf", "dng", "orf", "rw2", "pef", "raf", "3fr", "dcr", "kdc", "k25", "erf", "mrw", "mos", "x3f", "srw", "rwl", "raw"]
VIDEO_EXTS = ["mp4", "mov", "mkv", "avi", "wmv", "webm", "flv", "m4v", "mts", "m2ts", "ts", "3gp", "ogv", "rmvb"]

# HTTP reason phrases and methods, and the paths of static files.
REASONS = {200: "OK", 206: "Partial Content", 302: "Found", 304: "Not Modified", 400: "Bad Request", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 413: "Payload Too Large", 500: "Internal Server Error", 501: "Not Implemented"}
METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD"]
STATIC_PATHS = ["/", "/index.html", "/style.css", "/app.js", "/favicon.ico", "/favicon.svg"]
STREAM_BYTES = 65536


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def lookup(key: Column, values: dict, default) -> Column:
    pairs = F.create_map(*(F.lit(v) for kv in values.items() for v in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def normalize_path(s: Column | str) -> Column:
    """A leading and a trailing slash, single slashes between; dots stay as they are."""
    single = F.regexp_replace(F.concat(F.lit("/"), text(s)), "/+", "/")
    return F.concat(F.regexp_replace(single, "/$", ""), F.lit("/"))


def index_key(path: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("p:"), normalize_path(path), text(name))


def url_decode(s: Column | str) -> Column:
    """Percent escapes and plus signs; what is not an escape stays."""
    return F.try_url_decode(F.regexp_replace(text(s), "%(?![0-9A-Fa-f]{2})", "%25"))


def url_encode(s: Column | str) -> Column:
    """As browsers encode a query component."""
    out = F.url_encode(text(s))
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def query_param(q: Column | str, key: str, anchored: bool = True) -> Column:
    """The value of key; anchored: names are compared whole, otherwise the first place that ends in key= counts."""
    return F.regexp_extract(text(q), ("(?:^|&)" if anchored else "") + key + "=([^&]*)", 1)


def escape_json(s: Column | str) -> Column:
    out = text(s)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape_json(s: Column | str) -> Column:
    """Inverse of escape_json; an unknown escape stands for its letter, a lone last backslash for itself."""
    # what lies between double backslashes has single ones only

    def plain(part: Column) -> Column:
        for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
            part = F.replace(part, F.lit(a), F.lit(b))
        return F.regexp_replace(part, r"(?s)\\(.)", "$1")

    return F.array_join(F.transform(F.split(text(s), r"\\\\"), plain), "\\")


def json_text(j: Column | str, field: str) -> Column:
    return F.coalesce(F.get_json_object(col(j), f"$.{field}"), F.lit(""))


def json_number(j: Column | str, field: str) -> Column:
    return F.coalesce(F.get_json_object(col(j), f"$.{field}").try_cast("bigint"), F.lit(0).cast("bigint"))


def extension(name: Column | str) -> Column:
    return F.when(F.instr(text(name), ".") > 0, F.lower(F.substring_index(col(name), ".", -1))).otherwise("")


def mime_type(name: Column | str, profile: str = "live") -> Column:
    return lookup(extension(name), MIME_WIDE if profile == "wide" else MIME_LIVE, MIME_DEFAULT)


def file_type(name: Column | str) -> Column:
    e = extension(name)
    return F.when(e.isin(IMAGE_EXTS), "image").when(e.isin(RAW_EXTS), "raw").when(e.isin(VIDEO_EXTS), "video").otherwise("other")


def is_image(name: Column | str) -> Column:
    return file_type(name).isin("image", "raw")


def preview_kind(name: Column | str) -> Column:
    """How a file is shown; other files are downloaded."""
    return F.when(file_type(name) == "other", "download").otherwise(file_type(name))


def format_size(n: Column | str) -> Column:
    """1024-based with one decimal, ties up; a petabyte or more has no unit."""
    n = F.coalesce(col(n), F.lit(0)).cast("bigint")
    out = F.when(n == 0, "0 B").when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "undefined"), 1):
        shown = F.format_string("%.1f %s", F.floor(n.cast("double") / 1024.0**power * 10 + 0.5) / 10.0, F.lit(unit))
        out = out.otherwise(shown) if unit == "undefined" else out.when(n < 1024 ** (power + 1), shown)
    return out


def escape_html(s: Column | str) -> Column:
    out = text(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def download_url(file_hash: Column | str, path: Column | str, name: Column | str, force: bool = False) -> Column:
    path = F.when(text(path) == "", "/").otherwise(text(path))
    return F.concat(F.lit("/api/files/"), text(file_hash), F.lit("/download?path="), url_encode(path), F.lit("&name="), url_encode(name), F.lit("&dl=1" if force else ""))


def breadcrumbs(path: Column | str) -> Column:
    """The directories on the way to path, each a struct of its name and its normalized path."""
    parts = F.filter(F.split(text(path), "/"), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct(x.alias("name"), F.concat(F.lit("/"), F.concat_ws("/", F.slice(parts, F.lit(1), i + 1)), F.lit("/")).alias("path")))


def url_hash(path: Column | str) -> Column:
    return F.regexp_extract(col(path), "^/api/files/(.*?)/download", 1)


def boundary(content_type: Column | str) -> Column:
    return F.regexp_extract(col(content_type), 'boundary="?([^";]*)', 1)


def content_length(v: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(col(v), F.lit("")), r"^\s*(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def keep_alive(connection: Column | str, version: Column | str) -> Column:
    c = F.lower(F.coalesce(col(connection), F.lit("")))
    return F.when(c == "keep-alive", True).when(c == "close", False).otherwise(col(version) == "HTTP/1.1")


def content_hash(content: Column | str) -> Column:
    return F.sha2(col(content), 256)


def shard(file_hash: Column | str) -> Column:
    return F.substring(col(file_hash), 1, 2)


def blob_path(root: str, file_hash: Column | str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), shard(file_hash), F.lit("/"), col(file_hash))


def day(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def disposition(name: Column | str, dl: Column | str) -> Column:
    shown = F.when(col(name) == "", "download").otherwise(col(name))
    return F.concat(F.when(col(dl) == "", "inline").otherwise("attachment"), F.lit('; filename="'), shown, F.lit('"'))


def reason(status: Column | str) -> Column:
    return lookup(col(status).cast("int"), REASONS, "Unknown")


def method(m: Column | str) -> Column:
    """The method in upper case, or an empty text for one that is not known."""
    return F.when(F.upper(col(m)).isin(METHODS), F.upper(col(m))).otherwise("")


def handler(m: Column | str, path: Column | str) -> Column:
    """The route of a request; the first that matches."""
    m, p = method(m), col(path)
    return (
        F.when(p.isin(STATIC_PATHS), "static")
        .when((m == "GET") & (p == "/api/files"), "list")
        .when(p.startswith("/api/files/") & p.contains("/download"), "download")
        .when((m == "POST") & (p == "/api/files"), "upload")
        .when((m == "POST") & (p == "/api/files/move"), "move")
        .when((m == "DELETE") & (p == "/api/files"), "delete")
        .otherwise("none")
    )


def streams(m: Column | str, path: Column | str, length: Column | str, at_least: bool = False) -> Column:
    """Whether an upload is streamed: over the threshold, or at it too."""
    big = col(length) >= STREAM_BYTES if at_least else col(length) > STREAM_BYTES
    return (method(m) == "POST") & (col(path) == "/api/files") & big
