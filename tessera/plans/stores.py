"""Queries of stores, published documents, streams of listings and uploads, and stages that are run with exact pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import index, inventory, matching, media, review, tags
from tessera.plans import fixtures as fx
from tessera.plans.catalog import _ALL, SITE, STRICT, _digests, _keys, _live, _sources, query
from tessera.plans.fixtures import sql
from tessera.sources import tables
from tessera.sources.datasource import raw_listing as listed_raw
from tessera.sources.datasource import write_index
from tessera.sources.tables import Snapshots, scratch
from tessera.streaming import scan

# A store of files: the customers' names of each nation --------------------------------------------------------------

_FILES = "files AS (SELECT 'c_nationkey=' || c_nationkey AS folder, string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10) AS content FROM customer GROUP BY c_nationkey)"
fx.SQL["files"] = _FILES


def _store(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "store")
    rows = fx.table(spark, sf_dir, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(path)
    return path


def _folder(path) -> F.Column:
    return F.regexp_extract(path, "(c_nationkey=[^/]*)/", 1)


@query(sql("files", then="SELECT folder, 1::BIGINT AS objects, 0::BIGINT AS empty, strlen(content)::BIGINT AS bytes FROM files UNION ALL SELECT '', 1, 1, 0"))
def raw_listing(spark, d):
    """Objects of each folder, the empty mark of a finished write too."""
    rows = listed_raw(spark, _store(spark, d)).filter(~F.endswith("key", F.lit(".crc")))
    return rows.groupBy(_folder(F.col("key")).alias("folder")).agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("size") == 0).alias("empty"), F.sum("size").alias("bytes"))


@query(sql("files", then="SELECT folder, sha256(content) AS sha256, strlen(content)::BIGINT AS bytes FROM files"))
def store_bytes(spark, d):
    rows = tables.read_bytes(spark, _store(spark, d))
    return rows.select(_folder(F.col("path")).alias("folder"), "sha256", F.octet_length("content").cast("long").alias("bytes"))


@query(sql("files", then="SELECT folder, strlen(content)::BIGINT AS size, 'txt' AS extension, 'image' AS media_type FROM files"))
def store_listing(spark, d):
    rows = tables.list_objects(spark, _store(spark, d), keep_all=True)
    return rows.select(_folder(F.col("key")).alias("folder"), "size", "extension", "media_type")


# Published documents ------------------------------------------------------------------------------------------------

@query(sql("items", then="SELECT row_number() OVER (ORDER BY ordinal, key) - 1 AS place, key, ext, size FROM items"))
def index_published(spark, d):
    """The index as tasks write it and one commit publishes it, read back in its order."""
    path = scratch(spark, "index") + ".json"
    write_index(fx.index_items(spark, d), path, 1, "")
    rows = tables.read_index(spark, path)
    field = lambda n, kind: F.try_variant_get("item", f"$.{n}", kind).alias(n)
    return rows.select(F.col("ordinal").cast("long").alias("place"), field("key", "string"), field("ext", "string"), field("size", "bigint"))


@query(sql("tagged", "catalog", then="SELECT t.key, t.ext, string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY u.pos) AS ids FROM tagged t, LATERAL (SELECT unnest(t.tags) AS name, generate_subscripts(t.tags, 1) AS pos) u JOIN catalog c ON c.name = u.name GROUP BY 1, 2"))
def tag_document_items(spark, d):
    """Items of the tag index after it was published, in as many documents as it takes, and read by its rules."""
    paths = tags.write_tag_documents(fx.tagged(spark, d), scratch(spark, "tags"), tags.THRESHOLD, "m", "2024")
    _, items = tags.read_tag_document(spark.read.text(paths, wholetext=True).select(F.col("value").alias("body")))
    return items.select("key", "ext", F.array_join(F.col("tags").cast("array<string>"), ",").alias("ids"))


# Streams ------------------------------------------------------------------------------------------------------------

@query(sql("listing", then="SELECT key, size, etag, sha256(key || ':' || etag) AS sha256 FROM listing"))
def incremental_scan(spark, d):
    """The inventory after listings that arrive in parts were merged and fingerprinted batch by batch."""
    source, store = scratch(spark, "scan-listing"), Snapshots(spark, scratch(spark, "scan-store"))
    rows = fx.orders_listing(spark, d)
    for part in (0, 1, 1):  # one part comes again
        rows.filter(F.pmod(F.xxhash64("key"), F.lit(2)) == part).select("key", F.col("size").cast("long"), "etag", "last_modified").write.mode("append").parquet(source)
    scan.scan(spark, source, store, lambda w: w.select("key", F.sha2(F.concat_ws(":", "key", "etag"), 256).alias("sha256")), scratch(spark, "scan-checkpoint"), files_per_batch=1000)
    return store.read().select("key", "size", "etag", "sha256")


@query(sql("items", then="SELECT key, arg_min(ext, ordinal) AS ext FROM items WHERE size > 0 AND ext <> 'bmp' GROUP BY 1"))
def uploads_merged(spark, d):
    """The index after batches of uploads have joined it, those of a key that is indexed left out."""
    source, store = scratch(spark, "uploads"), Snapshots(spark, scratch(spark, "uploads-store"))
    rows = fx.index_items(spark, d).select("ordinal", "key", "ext", "size")
    for again in (False, True):
        rows.filter((F.col("ordinal") >= 10_000_000_000) == again).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    running = stream.writeStream.foreachBatch(scan.merge_uploads(store, 500)).option("checkpointLocation", scratch(spark, "uploads-checkpoint")).trigger(availableNow=True).start()
    running.awaitTermination()
    return store.read().select("key", "ext")


# Media steps --------------------------------------------------------------------------------------------------------

@query("SELECT doc_id, sha256(text) AS sha256, CASE WHEN strlen(text) % 7 <> 0 THEN CAST(strlen(text) % 1000 AS INT) END AS width, CASE WHEN strlen(text) % 7 = 0 THEN 'no picture of ' || strlen(text) || ' bytes' END AS scan_error FROM documents")
def scan_errors(spark, d):
    """Bytes that a decoder refuses keep their digest and the error."""

    def decode(content: bytes, extension: str) -> dict:
        if len(content) % 7 == 0:
            raise ValueError(f"no picture of {len(content)} bytes")
        return {"width": len(content) % 1000}

    rows = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.encode("text", "UTF-8").alias("content"), F.lit("jpg").alias("extension"))
    return media.fingerprints(rows, decode).select(F.col("key").cast("long").alias("doc_id"), "sha256", "width", "scan_error")


@query("""SELECT id, idx, t FROM (SELECT id, idx, CAST(coalesce(sum(delay) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t, count(*) OVER (PARTITION BY id) AS n
    FROM (SELECT l_orderkey AS id, l_linenumber - 1 AS idx, sum(CAST(l_quantity AS INT)) AS delay FROM lineitem GROUP BY 1, 2))
    WHERE n > 1 AND idx % greatest(1, CAST(ceil(n / 3.0) AS BIGINT)) = 0""")
def animation_frames(spark, d):
    """Frames of an order's lines that are hashed, three at most, with the time before each."""
    lines = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") - 1).alias("idx"))
    frames = lines.agg(F.sum(F.col("l_quantity").cast("int")).alias("delay"))
    return media.animation_samples(frames, 3).select(F.col("key").alias("id"), "idx", "t")


# Exact pairs, queues and sources --------------------------------------------------------------------------------------

@query(sql("docs", then="""SELECT a.key AS left_key, b.key AS right_key, 100.0::DOUBLE AS score, 'exact SHA-256 match' AS reason FROM docs a JOIN docs b ON a.sha256 = b.sha256 AND a.key < b.key"""))
def exact_pairs(spark, d):
    return _keys(matching.exact_stage(fx.documents(spark, d)))


_EXACT = sql(*_ALL, "offered", "best", then='SELECT "left" AS left_key, "right" AS right_key, score, reason, qualified FROM best')
_EXACT = _EXACT.replace(" FROM docs WHERE sha256 NOT IN (SELECT sha256 FROM docs GROUP BY 1 HAVING count(*) > 1))", " FROM docs)")
_EXACT = _EXACT.replace("offered AS (SELECT 1", "offered AS (SELECT 0 AS stage, a.key AS \"left\", b.key AS \"right\", 100.0::DOUBLE AS score, 'exact SHA-256 match' AS reason FROM docs a JOIN docs b ON a.sha256 = b.sha256 AND a.key < b.key UNION ALL SELECT 1")


@query(_EXACT)
def candidate_best_exact(spark, d):
    """The best offers when exact pairs are a stage and their members are not withheld."""
    return _keys(matching.best_offers(matching.offers(fx.assets(spark, d), STRICT, include_exact=True)))


@query(sql("stored", "digests", then="SELECT g.key, NULL::BIGINT AS pair_id, s.size FROM digests g JOIN stored s ON s.key = g.key AND NOT s.deleted"))
def sha_queue_live(spark, d):
    return review.live_digests(_digests(spark, d), _live(spark, d))


_SITE = "https://www.example.com/r/"
fx.SQL["addressed"] = f"""addressed AS (SELECT ordinal % 2 AS list, ordinal, CASE WHEN value LIKE 'placeholder%' THEN '' WHEN value LIKE 'https://%' THEN rtrim(value, '/') || '/' WHEN regexp_full_match(regexp_replace(trim(value, '/'), '^[rR]/', ''), '[A-Za-z0-9_]{{3,21}}') THEN '{_SITE}' || regexp_replace(trim(value, '/'), '^[rR]/', '') || '/new/' ELSE '' END AS value FROM sources)"""


@query(sql("sources", "addressed", then="SELECT row_number() OVER (ORDER BY list, ordinal) - 1 AS ordinal, value FROM (SELECT *, row_number() OVER (PARTITION BY lower(value) ORDER BY list, ordinal) AS n FROM addressed WHERE value <> '') WHERE n = 1"))
def sources_united(spark, d):
    """The settings' sources and then the managed ones, by their addresses."""
    rows = _sources(spark, d)
    return inventory.united_sources(rows.filter("ordinal % 2 = 0"), rows.filter("ordinal % 2 = 1"), SITE)
