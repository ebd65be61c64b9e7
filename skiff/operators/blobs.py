"""Immutable contents under their SHA-256, in folders by the hash's first two letters."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.functions import scalars as S


def from_contents(rows: DataFrame, content: str = "content") -> DataFrame:
    """(file_hash, shard, content): one row for each distinct content. Copies meet by hash, with partial aggregation."""
    data = rows.select(F.col(content).cast("binary").alias("content")).where("content is not null")
    h = S.content_hash("content")
    return data.select(h.alias("file_hash"), "content").groupBy("file_hash").agg(F.first("content").alias("content")).select("file_hash", S.shard("file_hash").alias("shard"), "content")


def write(blobs: DataFrame, root: str) -> None:
    """Adds the blobs that root does not have yet; Spark's committer makes each write whole or absent."""
    spark = blobs.sparkSession
    try:
        there = spark.read.schema("file_hash string, content binary, shard string").parquet(root).select("file_hash")
    except Exception as e:  # a new store
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    new = blobs if there is None else blobs.join(there, "file_hash", "left_anti")
    new.repartition("shard").write.mode("append").partitionBy("shard").parquet(root)


def read(spark, root: str) -> DataFrame:
    return spark.read.schema("file_hash string, content binary, shard string").parquet(root)


def read_files(spark, root: str) -> DataFrame:
    """Blobs that are plain files at root/shard/hash."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_hash"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("shard"), "content")


def read_range(blobs: DataFrame, offset: int, length: int) -> DataFrame:
    """(file_hash, part): length bytes from offset, fewer at the end; nothing beyond it."""
    return blobs.select("file_hash", F.substring(F.col("content"), offset + 1, length).alias("part"))


def remove(blobs: DataFrame, hashes: DataFrame) -> DataFrame:
    """blobs without the hashes; ones that are not there do not matter."""
    return blobs.join(hashes.select("file_hash").distinct(), "file_hash", "left_anti")
