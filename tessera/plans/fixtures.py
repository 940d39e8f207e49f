"""Tables of a media catalog derived from the driver's tables, and the same as SQL for DuckDB."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.sources.tables import staged_once

VIDEO_LINES = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _extension(n: str):
    return F.get(F.array(*map(F.lit, names.ALLOWED)), (F.col(n) % 8).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assets without perceptual hashes."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((100 * F.max("quality")).cast("int").alias("pdq_quality"))
    docs = table(spark, sf_dir, "documents").withColumn("extension", _extension("doc_id")).join(labels, "doc_id", "left")
    return docs.select(
        F.concat(F.lit("gallery/"), F.col("doc_id").cast("string"), F.lit("."), "extension").alias("key"), F.col("n_chars").alias("size"), "extension", names.media_type(F.col("extension")).alias("media_type"),
        F.sha2("text", 256).alias("sha256"), (100 + F.col("n_chars") % 1000).cast("int").alias("width"), (100 + F.col("doc_id") % 500).cast("int").alias("height"), "pdq_quality",
        F.lit(None).cast("double").alias("duration"), "text", "doc_id",
    )


#: For each byte, its bits as eight lanes of eight bits, so that 255 bytes can be added lane by lane.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)


def simhash(words: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, pdq_hash: bits that more than half of the words' digests have; the fingerprint that stands for a decoded picture's."""
    for batch in words:
        known = pc.dictionary_encode(pc.list_flatten(batch.column(1)))
        digests = np.frombuffer(b"".join(hashlib.sha256(w.as_buffer()).digest() for w in known.dictionary.cast(pa.large_binary())), np.uint8).reshape(-1, 32)
        codes = known.indices.to_numpy()
        out, start = [], 0
        for n in pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_pylist():
            ones = np.zeros(256, np.int64)
            for i in range(start, start + n, 255):
                ones += _LANES[digests[codes[i : min(i + 255, start + n)]]].sum(axis=0).view(np.uint8)
            out.append(np.packbits(2 * ones > n).tobytes().hex())
            start += n
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "pdq_hash"])


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_once(spark, sf_dir, "assets", lambda: _assets(spark, sf_dir))


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with hashes: SimHash as PDQ and pHash, lines as crop segments, and as frames from ``VIDEO_LINES`` lines on."""
    docs = documents(spark, sf_dir)
    hashed = docs.select("key", F.split(F.lower("text"), r"\s+").alias("words")).mapInArrow(simhash, "key string, pdq_hash string")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    noise = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2)
    frame = F.transform(lines, lambda x, i: F.struct(F.concat(F.substring(F.sha2(x, 256), 1, 62), noise).alias("h"), (20 + F.char_length(x) % 80).cast("int").alias("q"), i.cast("long").alias("t")))
    out = docs.withColumn("lines", lines).withColumn("crop", F.transform("lines", lambda x: F.substring(F.sha2(x, 256), 1, 16)))
    out = out.withColumn("vpdq", F.when(F.size("lines") >= VIDEO_LINES, frame)).drop("text", "doc_id", "lines").join(hashed, "key")
    return out.withColumn("phash", F.substring("pdq_hash", 1, 16))


def visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.matching import visual_assets

    return staged_once(spark, sf_dir, "visual", lambda: visual_assets(assets(spark, sf_dir)))


def orders_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored inventory: nine of ten orders, some of them hashed, failed or deleted."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0")
    k = F.col("o_orderkey")
    null = lambda t: F.lit(None).cast(t)
    return o.select(
        F.concat(F.lit("o/"), k.cast("string"), F.lit(".jpg")).alias("key"), (k % 1000 + 1).cast("long").alias("size"), F.lit("e0").alias("etag"), F.lit("2024").alias("last_modified"),
        F.when(k % 3 != 0, F.sha2(k.cast("string"), 256)).alias("sha256"), F.when(k % 11 == 0, "decode failed").alias("scan_error"), null("string").alias("phash"), (k % 13 == 0).alias("deleted"),
    )


def orders_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("o/"), k.cast("string"), F.lit(".jpg")).alias("key"), (k % 1000 + 1).cast("long").alias("size"), F.when(k % 5 == 0, "e1").otherwise("e0").alias("etag"), F.lit("2024").alias("last_modified"))


def index_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k")).filter("k % 11 <> 0")
    ext = F.get(F.array(*map(F.lit, names.ALLOWED)), (F.col("k") % 8).cast("int"))
    rows = p.select(F.col("k").alias("ordinal"), F.concat(F.lit("gallery/"), F.col("k").cast("string"), F.lit("."), ext).alias("key"), F.when(F.col("k") % 19 == 0, "bmp").otherwise(ext).alias("ext"), F.when(F.col("k") % 23 == 0, 0).otherwise(F.col("k") % 997 + 1).cast("long").alias("size"), "k")
    again = rows.filter("k % 17 = 0").withColumn("ordinal", F.col("ordinal") + 10_000_000_000).withColumn("size", F.col("size") + 5)
    return rows.union(again).drop("k")


def index_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k")).filter("k % 13 <> 0")
    ext = F.get(F.array(*map(F.lit, names.ALLOWED)), (F.col("k") % 8).cast("int"))
    return p.select(F.concat(F.lit("gallery/"), F.col("k").cast("string"), F.lit("."), ext).alias("key"), F.when(F.col("k") % 29 == 0, 0).otherwise(F.col("k") % 997 + 1).cast("long").alias("size"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ext = F.get(F.array(*map(F.lit, names.ALLOWED)), (F.col("p_partkey") % 8).cast("int"))
    return p.select(F.concat(F.lit("gallery/"), F.col("p_partkey").cast("string")).alias("key"), ext.alias("ext"), F.concat(F.split("p_name", " "), F.array("p_brand", "p_type")).alias("tags"))


_EXTS = "['jpg','jpeg','png','gif','webp','mp4','m4v','webm']"

#: The same tables as common table expressions for DuckDB.
SQL = {
    "docs": f"""docs AS (SELECT 'gallery/' || d.doc_id || '.' || ({_EXTS})[d.doc_id % 8 + 1] AS key, n_chars AS size, ({_EXTS})[d.doc_id % 8 + 1] AS extension, sha256(text) AS sha256,
        CAST(100 + n_chars % 1000 AS INT) AS width, CAST(100 + d.doc_id % 500 AS INT) AS height, q.pdq_quality, text, d.doc_id
        FROM documents d LEFT JOIN (SELECT doc_id, CAST(100 * max(quality) AS INT) AS pdq_quality FROM labels GROUP BY 1) q ON q.doc_id = d.doc_id)""",
    "ranked": """ranked AS (SELECT *, row_number() OVER (ORDER BY CAST(width AS BIGINT) * height DESC, coalesce(pdq_quality, 0) DESC, size DESC, key DESC) AS place FROM docs)""",
    "visual": """visual AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM docs WHERE sha256 NOT IN (SELECT sha256 FROM docs GROUP BY 1 HAVING count(*) > 1))""",
    "words": """words AS (SELECT key, sha256(unnest(regexp_split_to_array(lower(text), '\\s+'))) AS w FROM visual)""",
    "hashed": "hashed AS (SELECT key, " + ", ".join(f"SUM(CASE WHEN (('0x' || substr(w, {8 * (b // 32) + 1}, 8))::BIGINT >> {31 - b % 32}) & 1 = 1 THEN 1 ELSE -1 END) AS b{b}" for b in range(256)) + " FROM words GROUP BY key)",
    "laned": "laned AS (SELECT key, " + ", ".join(" + ".join(f"CASE WHEN b{32 * k + i} > 0 THEN {1 << (31 - i)} ELSE 0 END" for i in range(32)) + f" AS l{k}" for k in range(8)) + " FROM hashed)",
    "stills": """stills AS (SELECT v.*, l.* EXCLUDE (key) FROM visual v JOIN laned l ON l.key = v.key WHERE len(lines) < 6)""",
    "segments": """segments AS (SELECT key, len(lines) AS n, generate_subscripts(lines, 1) AS pos, substr(sha256(unnest(lines)), 1, 16) AS seg FROM visual WHERE len(lines) BETWEEN 1 AND 5)""",
    "segdist": """segdist AS (SELECT a.seg AS a, b.seg AS b, CAST(bit_count(xor(('0x' || substr(a.seg, 1, 8))::BIGINT, ('0x' || substr(b.seg, 1, 8))::BIGINT)) AS INT) + CAST(bit_count(xor(('0x' || substr(a.seg, 9, 8))::BIGINT, ('0x' || substr(b.seg, 9, 8))::BIGINT)) AS INT) AS d
        FROM (SELECT DISTINCT seg FROM segments) a, (SELECT DISTINCT seg FROM segments) b)""",
    "frames": """frames AS (SELECT key, sha256, len(lines) AS n_frames, generate_subscripts(lines, 1) AS t, unnest(lines) AS line, doc_id FROM visual WHERE len(lines) >= 6),
        framed AS (SELECT key, sha256, n_frames, t, substr(sha256(line), 1, 62) || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS h, CAST(20 + length(line) % 80 AS INT) AS q FROM frames)""",
    "stored": """stored AS (SELECT 'o/' || o_orderkey || '.jpg' AS key, o_orderkey % 1000 + 1 AS size, 'e0' AS etag, CASE WHEN o_orderkey % 3 <> 0 THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS sha256,
        CASE WHEN o_orderkey % 11 = 0 THEN 'decode failed' END AS scan_error, o_orderkey % 13 = 0 AS deleted FROM orders WHERE o_orderkey % 10 <> 0)""",
    "listing": """listing AS (SELECT 'o/' || o_orderkey || '.jpg' AS key, o_orderkey % 1000 + 1 AS size, CASE WHEN o_orderkey % 5 = 0 THEN 'e1' ELSE 'e0' END AS etag FROM orders WHERE o_orderkey % 7 <> 0)""",
    "items": f"""items AS (SELECT k AS ordinal, 'gallery/' || k || '.' || ({_EXTS})[k % 8 + 1] AS key, CASE WHEN k % 19 = 0 THEN 'bmp' ELSE ({_EXTS})[k % 8 + 1] END AS ext, CASE WHEN k % 23 = 0 THEN 0 ELSE k % 997 + 1 END AS size FROM (SELECT p_partkey::BIGINT AS k FROM part WHERE p_partkey % 11 <> 0)
        UNION ALL SELECT k + 10000000000, 'gallery/' || k || '.' || ({_EXTS})[k % 8 + 1], CASE WHEN k % 19 = 0 THEN 'bmp' ELSE ({_EXTS})[k % 8 + 1] END, CASE WHEN k % 23 = 0 THEN 5 ELSE k % 997 + 6 END FROM (SELECT p_partkey::BIGINT AS k FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 17 = 0))""",
    "objects": f"""objects AS (SELECT 'gallery/' || k || '.' || ({_EXTS})[k % 8 + 1] AS key, ({_EXTS})[k % 8 + 1] AS ext, CASE WHEN k % 29 = 0 THEN 0 ELSE k % 997 + 1 END AS size FROM (SELECT p_partkey::BIGINT AS k FROM part WHERE p_partkey % 13 <> 0))""",
    "tagged": f"""tagged AS (SELECT 'gallery/' || p_partkey AS key, ({_EXTS})[p_partkey % 8 + 1] AS ext, list_concat(string_split(p_name, ' '), [p_brand, p_type]) AS tags FROM part)""",
}


def sql(*needed: str, then: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in needed) + " " + then
