"""Lookups, listings and maintenance over the two metadata indexes and the blobs."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff.functions import scalars as S

PATH_SCHEMA = "index_key string, file_name string, file_hash string, file_path string, file_author string, file_time string, file_size bigint, content_type string"
PHYS_SCHEMA = "file_hash string, file_size bigint, content_type string, ref_count int"
LISTED = ("file_name", "file_hash", "file_path", "file_size", "file_time", "content_type")


def normal(path: str) -> str:
    return "/" + "".join(f"{p}/" for p in path.split("/") if p)


@dataclass
class Catalog:
    """path_index: a row for each file path; phys_index: a row for each content hash. Reads are lazy; a lookup that finds
    nothing is an empty DataFrame. At scale, write path_index ordered by index_key (write()) so that prefix and equality
    filters, which reach the scan, skip row groups."""

    path_index: DataFrame
    phys_index: DataFrame

    @classmethod
    def empty(cls, spark) -> "Catalog":
        return cls(spark.createDataFrame([], PATH_SCHEMA), spark.createDataFrame([], PHYS_SCHEMA))

    @classmethod
    def open(cls, spark, path: str) -> "Catalog":
        return cls(spark.read.parquet(f"{path}/path_index"), spark.read.parquet(f"{path}/phys_index"))

    def write(self, path: str) -> None:
        self.path_index.repartitionByRange("index_key").sortWithinPartitions("index_key").write.parquet(f"{path}/path_index")
        self.phys_index.repartitionByRange("file_hash").sortWithinPartitions("file_hash").write.parquet(f"{path}/phys_index")

    def list_by_path(self, path: str) -> DataFrame:
        """The files directly in a directory, in key order."""
        return self.path_index.where(F.col("file_path") == normal(path)).orderBy("index_key")

    def prefix_scan(self, path: str) -> DataFrame:
        """All entries at or below a directory."""
        return self.path_index.where(F.col("index_key").startswith("p:" + normal(path)))

    def list_sub_dirs(self, path: str) -> DataFrame:
        """(name): the directories directly in a directory, in byte order."""
        rest = F.substring("index_key", len("p:" + normal(path)) + 1, 1 << 30)
        found = self.prefix_scan(path).select(rest.alias("rest")).where(F.instr("rest", "/") > 0)
        return found.select(F.substring_index("rest", "/", 1).alias("name")).distinct().orderBy("name")

    def list_all(self) -> DataFrame:
        """The files in the root directory."""
        return self.list_by_path("/")

    def list_recursive(self, path: str = "/") -> DataFrame:
        return self.prefix_scan(path).orderBy("index_key")

    def get_by_path(self, path: str, name: str) -> DataFrame:
        return self.path_index.where((F.col("file_path") == normal(path)) & (F.col("file_name") == name))

    def get_by_hash(self, file_hash: str) -> DataFrame:
        """Physical facts in the shape of a path entry, with no path and no name."""
        return self.phys_index.where(F.col("file_hash") == file_hash).select("file_hash", F.lit("").alias("file_name"), F.lit("").alias("file_path"), "file_size", "content_type")

    def batch_get(self, hashes: Sequence[str]) -> DataFrame:
        """(pos, file_hash, file_size, content_type) for the hashes that exist, in the order asked and as often."""
        asked = self.phys_index.sparkSession.createDataFrame(list(enumerate(hashes)), "pos long, file_hash string")
        return self.batch_join(asked)

    def batch_join(self, asked: DataFrame) -> DataFrame:
        """batch_get for a table of (pos, file_hash); the planner chooses how to join by the sizes that it sees."""
        return asked.join(self.phys_index, "file_hash").select("pos", "file_hash", "file_size", "content_type").orderBy("pos")

    def is_referenced(self, asked: DataFrame) -> DataFrame:
        """asked's file_hash, with whether it has references."""
        return self.ref_counts(asked).select("file_hash", (F.col("ref_count") > 0).alias("referenced"))

    def ref_counts(self, asked: DataFrame) -> DataFrame:
        """asked's file_hash with its count, 0 for one that does not exist."""
        return asked.select("file_hash").join(self.phys_index.select("file_hash", "ref_count"), "file_hash", "left").select("file_hash", F.coalesce("ref_count", F.lit(0)).alias("ref_count"))

    def download(self, requests: DataFrame) -> DataFrame:
        """requests: url_path, query. Each request's file by path and name if it gives both and they exist, else by hash;
        status 404 where neither does. hash_matches tells whether the entry found has the URL's hash."""
        q = requests.select("*", S.url_hash("url_path").alias("hash"), S.normalize_path(S.url_decode(S.query_param("query", "path"))).alias("_path"), S.url_decode(S.query_param("query", "name")).alias("_name"), S.query_param("query", "dl").alias("_dl"), (S.query_param("query", "path") != "").alias("_has"))
        p = self.path_index.select(F.col("file_path").alias("_path"), F.col("file_name").alias("_name"), F.col("file_hash").alias("p_hash"), F.col("file_size").alias("p_size"))
        h = self.phys_index.select(F.col("file_hash").alias("hash"), F.col("file_size").alias("h_size"))
        use = F.col("_has") & (F.col("_name") != "")
        asked = q.withColumn("_path", F.when(use, F.col("_path"))).withColumn("_file", F.when(use, F.col("_name"))).drop("_name")
        found = asked.join(p.withColumnRenamed("_name", "_file"), ["_path", "_file"], "left").join(h, "hash", "left")
        by_path = F.col("p_hash").isNotNull()
        name = F.when(by_path, F.col("_file")).otherwise("")
        ok = by_path | F.col("h_size").isNotNull()
        return found.select(*requests.columns, F.col("hash"), F.when(ok, 200).otherwise(404).alias("status"), F.when(by_path, F.col("p_size")).otherwise(F.col("h_size")).alias("file_size"), S.mime_type(F.when(name == "", "download").otherwise(name)).alias("content_type"), S.disposition(name, "_dl").alias("disposition"), F.coalesce(F.col("p_hash") == F.col("hash"), F.lit(True)).alias("hash_matches"))

    def listing(self) -> DataFrame:
        """(path, folders, files): the listing of every directory that holds files, from one pass and one shuffle for each
        array. Files are structs without the author."""
        files = self.path_index.groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct(*LISTED))).alias("files"))
        up = self.path_index.select("file_path").distinct()
        steps = up.select(F.explode(S.breadcrumbs("file_path")).alias("c")).select(F.col("c.name").alias("name"), F.regexp_replace("c.path", "[^/]+/$", "").alias("path")).distinct()
        folders = steps.groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("folders"))
        none = F.array().cast(T.ArrayType(T.StringType()))
        return folders.join(files, "path", "full").select("path", F.coalesce("folders", none).alias("folders"), F.coalesce("files", F.filter(F.array(F.struct(*(F.lit(None).cast(t).alias(n) for n, t in self.path_index.select(*LISTED).dtypes))), lambda x: F.lit(False))).alias("files"))

    def listing_json(self) -> DataFrame:
        return self.listing().select("path", F.to_json(F.struct("path", "folders", "files")).alias("body"))

    def gallery(self, term: str = "", kind: str = "all") -> DataFrame:
        """Files whose name holds term (case does not count), of a kind: all, image (raw ones too) or video."""
        return self.path_index.where(shown("file_name", term, kind))

    def gallery_folders(self, path: str, term: str = "", kind: str = "all") -> DataFrame:
        """Folders are shown under all and image only."""
        return self.list_sub_dirs(path).where(F.lower("name").contains(term.lower()) & F.lit(kind in ("all", "image")))

    def orphans(self, blobs: DataFrame) -> DataFrame:
        """Blobs to which no path refers."""
        return blobs.join(self.path_index.select("file_hash"), "file_hash", "left_anti")


def shown(name: str, term: str, kind: str) -> Column:
    ok = F.lower(name).contains(term.lower())
    return ok & {"all": F.lit(True), "image": S.is_image(name), "video": S.file_type(name) == "video"}[kind]
