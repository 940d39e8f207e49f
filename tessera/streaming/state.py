"""Inventory and publication as keyed state of a stream (``transformWithState``).

``listed_changes`` keeps one row for each object key in the state store: only listed keys are touched, no stored table is written
again. A listing's generation is its event time; the watermark is the newest generation that was seen, and a timer just
after a row's generation fires once a newer listing is known, which is when a key that has not come again is missing. Listings
may arrive in any order and again: an older generation never overwrites a newer one, a key that comes late revives, and what is known
already changes nothing. What goes out are changes; ``current`` is their last one for each key.

``publication_events`` counts the completed items of each run in state and publishes after every item, completed or failed, that
leaves the count at a positive multiple; and once when the run ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LISTED = "generation long, key string, size long, etag string, last_modified string"
CHANGE = "key string, step long, generation long, size long, etag string, last_modified string, deleted boolean, status string"
RESULT = "run long, ordinal long, error string, last boolean"
EVENT = "run long, ordinal long, completed long, reason string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs, for the queries that are started inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _after(generation: int) -> int:
    """Milliseconds just after a generation."""
    return generation * 1000 + 1


def _value(x):
    return None if x is None or x != x else x


class KeptObject(StatefulProcessor):
    """One object: its newest listed row, whether it is missing, and how often it has changed."""

    def init(self, handle):
        self.handle = handle
        self.row = handle.getValueState("row", "generation long, size long, etag string, last_modified string, deleted boolean, step long")

    def handleInputRows(self, key, rows, timerValues):
        listed = [(int(r.generation), _value(r.last_modified), int(r.size), _value(r.etag)) for part in rows for r in part.itertuples(index=False)]
        order = lambda x: (x[0], x[1] or "", x[2], x[3] or "")
        generation, modified, size, etag = max(listed, key=order)
        old = self.row.get() if self.row.exists() else None
        if old and order((generation, modified, size, etag)) <= order((old[0], old[3], old[1], old[2])):
            return
        missing = timerValues.getCurrentWatermarkInMs() >= _after(generation)
        changed = old and (size, etag, modified) != (old[1], old[2], old[3])
        status = "new" if not old else "changed" if changed else "revived" if old[4] and not missing else "same"
        step = (old[5] if old else 0) + (status != "same")
        if status == "same":
            missing = old[4]
        self.row.update((generation, size, etag, modified, missing, step))
        if not missing:
            self.handle.registerTimer(_after(generation))
        if status != "same":
            yield self._change(key, step, generation, size, etag, modified, missing, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        generation, size, etag, modified, deleted, step = self.row.get()
        if not deleted and timerValues.getCurrentWatermarkInMs() >= _after(generation):
            self.row.update((generation, size, etag, modified, True, step + 1))
            yield self._change(key, step + 1, generation, size, etag, modified, True, "missing")

    def _change(self, key, *values) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *values)], columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self):
        pass


def listed_changes(listings: DataFrame) -> DataFrame:
    """A stream of changes from a stream of listing rows (``LISTED``)."""
    timed = listings.withColumn("at", F.timestamp_seconds("generation")).withWatermark("at", "0 seconds")
    # without the watermark's column, rows of older generations are not taken for late and dropped
    rows = timed.select("key", "generation", "size", "etag", "last_modified")
    return rows.groupBy("key").transformWithStateInPandas(KeptObject(), CHANGE, "Append", "EventTime")


class Publisher(StatefulProcessor):
    """One run: how many of its items are completed."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle):
        self.completed = handle.getValueState("completed", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.completed.get()[0] if self.completed.exists() else 0
        out = []
        for ordinal, error, last in sorted((int(r.ordinal), _value(r.error), bool(r.last)) for part in rows for r in part.itertuples(index=False)):
            n += error is None
            if n and n % self.every == 0:
                out.append((key[0], ordinal, n, "multiple"))
            if last:
                out.append((key[0], ordinal, n, "end"))
        self.completed.update((n,))
        yield pd.DataFrame(out, columns=["run", "ordinal", "completed", "reason"])

    def close(self):
        pass


def publication_events(results: DataFrame, every: int) -> DataFrame:
    """A stream of publications from a stream of results (``RESULT``: one row for each item of a run, in the run's order from batch to batch)."""
    return results.select("run", "ordinal", "error", "last").groupBy("run").transformWithStateInPandas(Publisher(every), EVENT, "Append", "None")


def publication_points(results: DataFrame, every: int) -> DataFrame:
    """The same from a finished table of results."""
    upto = Window.partitionBy("run").orderBy("ordinal")
    counted = results.withColumn("completed", F.count_if(F.col("error").isNull()).over(upto))
    reasons = F.array(F.when((F.col("completed") > 0) & (F.col("completed") % every == 0), "multiple"), F.when(F.col("last"), "end"))
    return counted.select("run", "ordinal", "completed", F.explode(F.array_compact(reasons)).alias("reason"))


def current(changes: DataFrame) -> DataFrame:
    """key, size, etag, last_modified, deleted after all changes."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("size", "etag", "last_modified", "deleted"), "step").alias("r"))
    return last.select("key", "r.*")


def appended(stream: DataFrame, folder: str, checkpoint: str):
    """Runs a stream over all that is there, appends what comes out to a folder exactly once, and returns the finished query."""
    with rocksdb(stream.sparkSession):
        running = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
    return running


def run_changes(spark: SparkSession, source: str, folder: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """The changes so far of all listing files in a folder."""
    appended(listed_changes(spark.readStream.schema(LISTED).option("maxFilesPerTrigger", files_per_batch).parquet(source)), folder, checkpoint)
    return spark.read.schema(CHANGE).parquet(folder)


def run_publications(spark: SparkSession, source: str, folder: str, checkpoint: str, every: int, files_per_batch: int = 1000) -> DataFrame:
    """The publications so far of all result files in a folder."""
    appended(publication_events(spark.readStream.schema(RESULT).option("maxFilesPerTrigger", files_per_batch).parquet(source), every), folder, checkpoint)
    return spark.read.schema(EVENT).parquet(folder)
