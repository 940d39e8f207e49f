"""Durable staging, and readers and writers of listings, index documents and snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared scratch folder; only where none is named (tests) under the warehouse."""
    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared scratch folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What ``staged_once`` has written, by session, folder and name.
_WRITTEN: dict[tuple, tuple[str, DataFrame]] = {}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def staged_once(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` staged once for a session and a source folder; made again if what was written is gone."""
    key = (spark.sparkContext.applicationId, id(spark), folder, name)
    if key not in _WRITTEN or not exists(spark, f"{_WRITTEN[key][0]}/_SUCCESS"):
        path = scratch(spark, name)
        df = make()
        df.write.parquet(path)
        _WRITTEN[key] = (path, spark.read.schema(df.schema).parquet(path))
    return _WRITTEN[key][1]


def list_objects(spark: SparkSession, path: str, keep_all: bool = False) -> DataFrame:
    """key, size, last_modified, extension, media_type of files under a folder; contents are not read.

    ``keep_all`` keeps unsupported objects, which an audit needs. Spark's file source itself passes over empty files; a
    store's own listing, read as a table, has them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), "modificationTime")
    root = F.lit(path.rstrip("/") + "/")
    key = F.when(F.contains("path", root), F.substring_index("path", path.rstrip("/") + "/", -1)).otherwise(F.col("path"))
    rows = found.withColumn("key", key).withColumn("extension", names.extension(F.col("key")))
    rows = rows.select("key", "size", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"), "extension", names.media_type(F.col("extension")).alias("media_type"))
    return rows if keep_all else rows.filter((F.col("size") > 0) & F.col("extension").isin(names.ALLOWED))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256 of the files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "content", F.sha2("content", 256).alias("sha256"))


def index_rows(documents: DataFrame) -> DataFrame:
    """ordinal, item (variant), declared (variant) of index documents (column ``body``): an object with items, or a bare array.

    Any other shape raises an error. Items stay variants, so a malformed row does not null its neighbours.
    """
    parsed = documents.select(F.parse_json("body").alias("v"))
    kind = F.schema_of_variant("v")
    items = F.when(F.startswith(kind, F.lit("ARRAY")), F.col("v")).when(
        F.startswith(kind, F.lit("OBJECT")) & F.startswith(F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.items", "variant")), F.lit("")), F.lit("ARRAY")), F.try_variant_get("v", "$.items", "variant")
    )
    listed = F.coalesce(items, F.raise_error(F.lit("index document has an unsupported format")).cast("variant"))
    declared = F.when(F.startswith(kind, F.lit("OBJECT")), F.try_variant_get("v", "$.count", "variant"))
    return parsed.select(F.posexplode(F.from_json(F.to_json(listed), "array<variant>")).alias("ordinal", "item"), declared.alias("declared"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return index_rows(spark.read.text(path, wholetext=True).select(F.col("value").alias("body")))


def index_document(items: DataFrame, generated_at: int, version: int = 1) -> DataFrame:
    """body: the published index as one compact JSON object. The document is one value by its format, so it is one row."""
    rows = items.agg(F.sort_array(F.collect_list(F.struct("ordinal", "key", "ext", "size"))).alias("i"))
    listed = F.transform("i", lambda r: F.struct(r["key"].alias("key"), r["ext"].alias("ext"), r["size"].alias("size")))
    return rows.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(generated_at).alias("generated_at"), F.size("i").alias("count"), listed.alias("items"))).alias("body"))


class Snapshots:
    """Versioned tables in a folder: version N + 1 is written beside N and never over what is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path)]
        done = [n for n in found if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.folder}/v{known[-1] if version is None else version}")

    def commit(self, df: DataFrame, expected: int) -> int:
        """Write the version after ``expected``; raises FileExistsError if another writer came first."""
        here = self.versions()
        if (here[-1] if here else 0) != expected:
            raise FileExistsError(f"version {expected} is not the latest")
        try:
            df.write.mode("error").parquet(f"{self.folder}/v{expected + 1}")
        except Exception as error:
            if "PATH_ALREADY_EXISTS" in str(error):
                raise FileExistsError(f"version {expected + 1} exists") from error
            raise
        return expected + 1

    def update(self, mutate, attempts: int = 8) -> int:
        """Read, mutate (DataFrame or None -> DataFrame, or None for no change), commit; again if another writer came first."""
        for _ in range(attempts):
            here = self.versions()
            version = here[-1] if here else 0
            changed = mutate(self.read(version) if here else None)
            if changed is None:
                return version
            try:
                return self.commit(changed, version)
            except FileExistsError:
                continue
        raise RuntimeError(f"no commit in {attempts} attempts")

