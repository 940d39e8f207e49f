"""Incremental scan and publication with Structured Streaming.

A file source delivers listings as they arrive; each micro-batch is merged into a versioned inventory, its pending
rows are fingerprinted and saved, and the checkpoint makes a stopped run go on where it was. A batch that is
replayed after a failure changes nothing: the merge is idempotent, and unchanged rows keep their hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import index, inventory, tags
from tessera.sources.tables import Snapshots

INVENTORY = "key string, size bigint, etag string, last_modified string, sha256 string, phash string, scan_error string, deleted boolean"
SCORES = "key string, tag string, score double"


def listings(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def merge_batch(store: Snapshots, fingerprint: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: listing rows come in (the last of a key; no time is earliest, ties go by size and etag), pending ones are fingerprinted (key, derived columns)."""

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.groupBy("key").agg(F.max_by(F.struct("size", "etag", "last_modified"), F.struct(F.coalesce("last_modified", F.lit("")), "size", "etag")).alias("r")).select("key", "r.*")

        def mutate(stored: DataFrame | None) -> DataFrame:
            stored = stored if stored is not None else batch.sparkSession.createDataFrame([], INVENTORY)
            merged = inventory.upsert(stored, rows)
            waiting = merged.join(inventory.pending(merged), "key", "left_semi")
            return inventory.save_hashes(merged, fingerprint(waiting))

        store.update(mutate)

    return merge


def scan(spark: SparkSession, source: str, store: Snapshots, fingerprint: Callable[[DataFrame], DataFrame], checkpoint: str, files_per_batch: int = 1):
    """Runs over all listings that are there, one micro-batch after the other, and returns the finished query."""
    stream = listings(spark, source, "key string, size bigint, etag string, last_modified string", files_per_batch)
    running = stream.writeStream.foreachBatch(merge_batch(store, fingerprint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def best_tags(scores: DataFrame, threshold: float = tags.THRESHOLD) -> DataFrame:
    """A running best score of each (key, tag) from a stream of frame scores; use output mode ``update`` or ``complete``."""
    return tags.frame_max(scores, threshold)


def merge_uploads(store: Snapshots, most_mb: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: uploaded files (ordinal, key, ext, size) of a batch join the index (ordinal, key, ext, size) in one commit.

    Failed uploads are simply not in the batch; a replayed batch finds its keys indexed and changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        def mutate(items: DataFrame | None) -> DataFrame | None:
            items = items if items is not None else batch.sparkSession.createDataFrame([], "ordinal long, key string, ext string, size long")
            fresh = index.uploads(batch, items, most_mb)
            return None if fresh.isEmpty() else index.merge(items, fresh)

        store.update(mutate)

    return merge
