"""Fingerprints, tags and frame samples of media bytes; decoders and models are passed in, since none is bundled.

Bytes have to be decoded in Python, so these run in Arrow batches. The digest is taken before decoding: a row
whose decoder fails keeps its digest and an error (and is not tried again until it changes), one whose bytes are missing has neither.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.samples import sample_step

FIELDS = ("phash", "crop_hashes", "pdq_hash", "pdq_quality", "vpdq_hashes", "width", "height", "duration")
_SCHEMA = "key string, sha256 string, phash string, crop_hashes array<string>, pdq_hash string, pdq_quality int, vpdq_hashes array<struct<h: string, q: int, t: bigint>>, width int, height int, duration double, scan_error string"
_TYPES = [pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.list_(pa.struct([("h", pa.string()), ("q", pa.int32()), ("t", pa.int64())])), pa.int32(), pa.int32(), pa.float64()]
ERROR_LENGTH = 1000


def fingerprints(objects: DataFrame, decode: Callable[[bytes, str], dict]) -> DataFrame:
    """key, sha256, the fields that ``decode(content, extension)`` returns, scan_error of objects (key, content, extension)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content, extension in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if content is None:
                    rows.append((None, {}, "download failed"))
                    continue
                digest = hashlib.sha256(content).hexdigest()
                try:
                    rows.append((digest, decode(content, extension), None))
                except Exception as error:  # whatever a decoder raises becomes the row's error
                    rows.append((digest, {}, str(error)[:ERROR_LENGTH]))
            fields = [pa.array([r[1].get(f) for r in rows], t) for f, t in zip(FIELDS, _TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), *fields, pa.array([r[2] for r in rows], pa.string())], names=["key", "sha256", *FIELDS, "scan_error"])

    return objects.select("key", "content", "extension").mapInArrow(each, _SCHEMA)


def frame_scores(frames: DataFrame, load: Callable[[], Callable[[list[bytes]], list[dict[str, float]]]]) -> DataFrame:
    """(key, tag, score) of frames (key, content): ``load`` makes the scorer once for each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = load()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out = [(k, tag, float(s)) for k, scores in zip(keys, score(batch.column(1).to_pylist())) for tag, s in scores.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.float64())], names=["key", "tag", "score"])

    return frames.select("key", "content").mapInArrow(each, "key string, tag string, score double")


def animation_samples(frames: DataFrame, most: int) -> DataFrame:
    """(key, idx, t) of an animation's frames (key, idx, delay) kept at an even step, at most ``most``; t is the time before the frame. Single frames are no animation."""
    order = Window.partitionBy("key").orderBy("idx")
    timed = frames.withColumn("t", F.coalesce(F.sum("delay").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return timed.filter((F.col("n") > 1) & (F.col("idx") % sample_step(F.col("n"), most) == 0)).select("key", "idx", "t")


def preview_samples(frames: DataFrame, most: int = 60) -> DataFrame:
    """(key, idx, delay) of frames kept for a preview, each with the delays since the last kept one (20 at least each); a trailing rest is dropped."""
    sized = frames.withColumn("step", sample_step(F.count(F.lit(1)).over(Window.partitionBy("key")), most))
    grouped = sized.groupBy("key", "step", F.ceil(F.col("idx") / F.col("step")).alias("g")).agg(F.sum(F.greatest(F.lit(20), "delay")).alias("delay"), F.max("idx").alias("last"))
    return grouped.filter("last = g * step").select("key", F.col("last").alias("idx"), "delay")
