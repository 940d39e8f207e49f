"""Shared helpers of the corpus operators: table access, durable staging and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most UTF-8 bytes of text that a task's Python code holds as arrays at once (a longer text is a block alone).
BLOCK_BYTES = 1 << 19
#: Most bytes of the Arrow batches that go to a task's Python code; without, 10,000 texts make one, which both sides hold several times over.
BATCH_BYTES = 1 << 22


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; only where none is named (tests) one under the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def _bytes(setting: str) -> int:
    """A size as Spark writes it: digits, or with b, k, m, g."""
    n = setting.lower().removesuffix("b")
    return int(n[:-1]) << " kmgtp".index(n[-1]) * 10 if n[-1:] in "kmgtp" and n else int(n)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and lost executors cost nothing.

    From here on the session's Arrow batches are bounded by ``BATCH_BYTES`` (a setting that is smaller already stays).
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[tuple, object] = {}
_kept_task: list[int | None] = [None]


def _task() -> int | None:
    context = TaskContext.get()
    return context.taskAttemptId() if context else None


def kept(make: Callable) -> Callable:
    """``make`` with its last result kept for the tasks that follow in the worker; all functions of this kind share one place.

    A worker serves the stages of many operators one after the other: ``blocks`` in a task that asks for nothing kept lets go of what another operator left.
    """

    @wraps(make)
    def get(*key):
        _kept_task[0] = _task()
        if (make, key) not in _kept:
            _kept.clear()
            _kept[make, key] = make(*key)
        return _kept[make, key]

    return get


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``most`` bytes of text (or one row), and their texts as UTF-8; null is empty."""
    if _kept and _kept_task[0] != _task():
        _kept.clear()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = size = 0
        for i, n in enumerate([*sizes, most + 1]):
            if i > start and size + n > most:
                yield batch.slice(start, i - start), [b"" if x is None else x for x in column.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # what the C library kept of freed arrays


def map_texts(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *keep: str) -> DataFrame:
    """mapInArrow over the named columns only, so that the scan reads no others."""
    return df.select(*keep).mapInArrow(function, schema)


def sampled(rows: DataFrame, n: int, most: int, *keys: str) -> DataFrame:
    """About ``most`` of ``n`` rows, or all if there are no more, by a hash of the keys; rows of equal keys count once.

    The hash has 62 bits, so the share may be as small as it gets. A key (or null) that a third of all rows hold is one row of the sample.
    """
    columns = rows.columns
    keyed = rows.withColumn("__key", F.xxhash64(*keys).bitwiseAND(F.lit((1 << 62) - 1)))
    if n > most:
        keyed = keyed.filter(F.col("__key") < F.lit((most << 62) // n))
    return keyed.dropDuplicates(["__key"]).select(*columns)


class Remembered(dict):
    """Results of ``function`` by key, of at most twice ``most`` keys: when ``most`` new ones have come, those before them go.

    Keys longer than ``longest`` are not kept, so memory stays bounded.
    """

    def __init__(self, function: Callable, most: int = 100_000, longest: int = 64):
        self.function, self.most, self.longest, self.older = function, most, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def int_column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: A broadcast of ids is made up to this many rows (8 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def sized_semi_join(rows: DataFrame, ids: DataFrame, how: str = "left_semi", on: str | list[str] = "doc_id") -> DataFrame:
    """Rows whose id is (or, ``left_anti``, is not) among ``ids``; the ids are broadcast only if counted as few."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, on, how)
