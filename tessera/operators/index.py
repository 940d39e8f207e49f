"""The published index: merge, removal, repair, upload filter and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import names


def merge(existing: DataFrame, additions: DataFrame) -> DataFrame:
    """(ordinal, key, ext, size): existing rows collapse to the first place and last value of a key; additions override or append."""
    rows = existing.filter("key <> ''").withColumn("_part", F.lit(0)).unionByName(additions.filter("key <> ''").withColumn("_part", F.lit(1)))
    place = F.struct("_part", "ordinal")
    return rows.groupBy("key").agg(F.min(place).alias("first"), F.max(F.struct(place.alias("p"), "ext", "size")).alias("last")).select(
        (F.col("first._part") * F.lit(1 << 40).cast("long") + F.col("first.ordinal")).alias("ordinal"), "key", "last.ext", "last.size"
    )


def remove(items: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not among ``keys``, and one row with the number of rows removed."""
    keys = keys.select("key").distinct()
    return items.join(keys, "key", "left_anti"), items.join(keys, "key", "left_semi").agg(F.count(F.lit(1)).alias("removed"))


def loaded(rows: DataFrame, prefix: str) -> DataFrame:
    """Index rows (is_object, key, ...) that a gallery serves: objects with a key under the prefix."""
    return rows.filter(F.col("is_object") & F.col("key").isNotNull() & F.startswith("key", F.lit(prefix)))


def missing(items: DataFrame, objects: DataFrame) -> DataFrame:
    """Valid objects (key, ext, size) that the index lacks."""
    ext = names.extension(F.col("key"))
    return objects.withColumn("ext", ext).filter((F.col("size") > 0) & F.col("ext").isin(names.ALLOWED)).join(items.select("key").distinct(), "key", "left_anti").select("key", "ext", "size")


def uploads(batch: DataFrame, items: DataFrame, most_mb: int) -> DataFrame:
    """Files (ordinal, key, ext, size) to upload: allowed, not indexed yet, the first of repeats."""
    fresh = batch.filter(names.allowed(F.col("ext"), F.col("size"), most_mb)).join(items.select("key").distinct(), "key", "left_anti")
    return fresh.groupBy("key").agg(F.min(F.struct("ordinal", "ext", "size")).alias("f")).select("f.ordinal", "key", "f.ext", "f.size")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def typed(rows: DataFrame) -> DataFrame:
    """Index rows (item variant) as is_object, key, ext, size (NULL unless of the right type; a boolean is no size)."""
    got = rows.select("item", F.startswith(_kind(F.col("item")), F.lit("OBJECT")).alias("is_object"))
    part = lambda n: F.when(F.col("is_object"), F.try_variant_get("item", f"$.{n}", "variant"))
    got = got.select("is_object", part("key").alias("k"), part("ext").alias("e"), part("size").alias("s"))
    return got.select(
        "is_object", F.when(_kind(F.col("k")) == "STRING", F.try_variant_get("k", "$", "string")).alias("key"),
        F.coalesce(F.try_variant_get("e", "$", "string"), F.lit("")).alias("ext"), F.when(_kind(F.col("s")) == "BIGINT", F.try_variant_get("s", "$", "bigint")).alias("size"),
    )


def audit(rows: DataFrame, objects: DataFrame, prefix: str, declared: Column | None = None) -> DataFrame:
    """One row of counters that compare index rows (is_object, key, ext, size) with objects (key, size).

    Rows that are no object, have no key or lie outside the prefix count as such and nowhere else.
    """
    n = F.col("key")
    invalid, outside = n.isNull() | (n == ""), ~F.startswith(n, F.lit(prefix))
    good = F.col("is_object") & ~invalid & F.coalesce(~outside, F.lit(False))
    stored = F.regexp_replace(F.lower(F.col("ext")), r"^\.+", "")
    own = rows.withColumn("good", good).withColumn("stored", stored).withColumn("actual", names.extension(n))
    still, clip = F.col("stored").isin(names.STILLS), F.col("stored").isin(names.CLIPS)
    count = lambda c: F.count_if(F.col("good") & c)
    counted = own.agg(
        F.count(F.lit(1)).alias("actual_index_rows"), count(F.lit(True)).alias("random_eligible_rows"), count(still).alias("random_still_rows"), count(clip).alias("random_clip_rows"),
        count(~still & ~clip).alias("random_unclassified_rows"), F.count_if(~F.col("is_object")).alias("non_object_rows"), F.count_if(F.col("is_object") & invalid).alias("invalid_key_rows"),
        F.count_if(F.col("is_object") & ~invalid & outside).alias("outside_gallery_prefix_rows"), count(~F.col("stored").isin(names.ALLOWED)).alias("unsupported_extension_rows"),
        count(F.col("stored") != F.col("actual")).alias("extension_mismatch_rows"), count(F.col("size").isNull() | (F.col("size") <= 0)).alias("invalid_size_rows"),
    )
    there = objects.filter(F.startswith("key", F.lit(prefix))).groupBy("key").agg(F.max((F.col("size") > 0) & names.extension(F.col("key")).isin(names.ALLOWED)).alias("supported"))
    keys = own.filter("good").select("key").distinct().withColumn("indexed", F.lit(True))
    both = keys.join(there, "key", "full")
    diffs = both.agg(
        F.count_if(F.col("indexed")).alias("unique_random_keys"), F.count_if(F.col("supported").isNotNull()).alias("gallery_objects"), F.count_if(F.col("supported")).alias("supported_media_objects"),
        F.count_if(~F.col("supported")).alias("unsupported_objects"), F.count_if(F.col("indexed") & F.col("supported").isNull()).alias("indexed_keys_missing"),
        F.count_if(F.col("supported") & F.col("indexed").isNull()).alias("supported_objects_not_indexed"),
    )
    report = counted.crossJoin(diffs)  # one row each
    report = report.withColumn("duplicate_key_rows", F.col("random_eligible_rows") - F.col("unique_random_keys"))
    report = report.withColumn("declared_count_mismatch", F.lit(False) if declared is None else F.coalesce(declared != F.col("actual_index_rows"), F.lit(False)))
    problems = ["duplicate_key_rows", "random_unclassified_rows", "non_object_rows", "invalid_key_rows", "outside_gallery_prefix_rows", "unsupported_extension_rows", "extension_mismatch_rows", "invalid_size_rows", "unsupported_objects", "indexed_keys_missing", "supported_objects_not_indexed"]
    dirty = F.col("declared_count_mismatch")
    for p in problems:
        dirty = dirty | (F.col(p) > 0)
    return report.withColumn("clean", ~dirty)


def bucket_counts(items: DataFrame) -> DataFrame:
    return items.select(F.explode(names.buckets(F.col("ext"))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("items"))


def random_pick(items: DataFrame, bucket: str, seed: int) -> DataFrame:
    """One row of a bucket chosen by a hash of its place and the seed, with the bucket's ``total``: rows weigh alike, repeats too."""
    rows = items.filter(F.array_contains(names.buckets(F.col("ext")), bucket))
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("ordinal").cast("string"), F.col("key")), 256)
    picked = rows.agg(F.min(F.struct(draw.alias("d"), "key", "ext")).alias("p"), F.count(F.lit(1)).alias("total"))
    return picked.filter("total > 0").select("p.key", "p.ext", "total")
