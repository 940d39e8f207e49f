"""Review pairs, deletion queues and the ledger as set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_pairs(found: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Pairs (id, left_key, right_key, similarity, reason, status) of found ones (ordinal, left_key, right_key, similarity, reason).

    The highest similarity of an oriented pair wins, the first of equals; exclusions of ``previous`` are carried over.
    """
    best = found.groupBy("left_key", "right_key").agg(F.max(F.struct("similarity", (-F.col("ordinal")).alias("o"), "reason")).alias("b"), F.min("ordinal").alias("id"))
    rows = best.select("id", "left_key", "right_key", "b.similarity", "b.reason")
    if previous is None:
        return rows.withColumn("status", F.lit("included"))
    out = previous.filter("status = 'excluded'").select("left_key", "right_key").distinct().withColumn("_out", F.lit(True))
    return rows.join(out, ["left_key", "right_key"], "left").select("id", "left_key", "right_key", "similarity", "reason", F.when(F.col("_out"), "excluded").otherwise("included").alias("status"))


def live_pairs(pairs: DataFrame, assets: DataFrame) -> DataFrame:
    """Pairs of which both ends are live."""
    live = assets.filter("not deleted").select("key")
    return pairs.join(live.withColumnRenamed("key", "left_key"), "left_key", "left_semi").join(live.withColumnRenamed("key", "right_key"), "right_key", "left_semi").select(*pairs.columns)


def review_order(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("similarity", "id")


def deletion_queue(pairs: DataFrame, assets: DataFrame) -> DataFrame:
    """(key, pair_id): right ends of included live pairs, one row for each key with the first pair's id."""
    return live_pairs(pairs.filter("status = 'included'"), assets).groupBy(F.col("right_key").alias("key")).agg(F.min("id").alias("pair_id"))


def exclude_pair(pairs: DataFrame, queue: DataFrame, pair_id: int) -> tuple[DataFrame, DataFrame]:
    """Pairs with one excluded, and the queue without the row that came from it."""
    status = F.when(F.col("id") == pair_id, "excluded").otherwise(F.col("status"))
    return pairs.withColumn("status", status), queue.filter(F.col("pair_id") != pair_id)


def exclude_keys(pairs: DataFrame, queue: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with those of the given ends (left_key, right_key) excluded, and the queue without the rows that came from them."""
    out = keys.select("left_key", "right_key").distinct().withColumn("_out", F.lit(True))
    marked = pairs.join(out, ["left_key", "right_key"], "left")
    rest = queue.join(marked.filter("_out").select(F.col("id").alias("pair_id")), "pair_id", "left_anti").select(*queue.columns)
    return marked.withColumn("status", F.when(F.col("_out"), "excluded").otherwise(F.col("status"))).select(*pairs.columns), rest


def queue_order(queued: DataFrame) -> DataFrame:
    """Queued rows (key, queued_at, ...) in the order they came."""
    return queued.orderBy("queued_at", "key")


def workflow_reset(state: DataFrame, pairs: DataFrame, queue: DataFrame, name: str, wanted: str) -> tuple[DataFrame, DataFrame]:
    """Pairs and queue, emptied if the state's value of ``name`` (name, value) is another than wanted or missing."""
    kept = state.filter((F.col("name") == name) & (F.col("value") == wanted)).select(F.lit(True).alias("_kept")).limit(1)
    hold = lambda rows: rows.join(F.broadcast(kept), F.lit(True), "left_semi")  # noqa: E731  one row at most
    return hold(pairs), hold(queue)


def sha_queue(deletions: DataFrame) -> DataFrame:
    """(key, survivor_key) of (ordinal, survivor_key, deletion_key): the last survivor named, pairs of a key with itself dropped."""
    last = deletions.groupBy(F.col("deletion_key").alias("key")).agg(F.max_by("survivor_key", "ordinal").alias("survivor_key"))
    return last.filter("key <> survivor_key")


def live_digests(digests: DataFrame, assets: DataFrame) -> DataFrame:
    """(key, pair_id, size) of the digest queue's rows whose key is live; no pair is behind them."""
    live = assets.filter("not deleted").select("key", "size")
    return digests.join(live, "key").select("key", F.lit(None).cast("bigint").alias("pair_id"), "size")


def queue_union(queue: DataFrame, digests: DataFrame, assets: DataFrame) -> DataFrame:
    """(key, pair_id, size) to delete: visual rows that the digest queue lacks, and the digest queue; live keys only."""
    live = assets.filter("not deleted").select("key", "size")
    visual = queue.join(digests.select("key"), "key", "left_anti").join(live, "key").select("key", "pair_id", "size")
    return visual.unionByName(live_digests(digests, assets))


def results(queued: DataFrame, response: DataFrame) -> DataFrame:
    """Queued rows with their result: 'deleted', the error, or that the store did not confirm."""
    return queued.join(response, "key", "left").withColumn("result", F.coalesce("result", F.lit("store did not confirm deletion")))


def ledger(found: DataFrame, pairs: DataFrame, digests: DataFrame) -> DataFrame:
    """deleted_key, survivor_key, pair_id, size, result: the survivor is the pair's other end, or the digest's."""
    p = pairs.select(F.col("id").alias("pair_id"), "left_key", "right_key")
    rows = found.join(p, "pair_id", "left").join(digests, "key", "left")
    other = F.when(F.col("right_key") == F.col("key"), F.col("left_key")).otherwise(F.col("right_key"))
    return rows.select(F.col("key").alias("deleted_key"), F.coalesce(F.when(F.col("pair_id").isNotNull(), other), F.col("survivor_key")).alias("survivor_key"), "pair_id", "size", "result")


def apply_deletions(assets: DataFrame, queue: DataFrame, digests: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assets with confirmed keys marked deleted, and both queues without them."""
    gone = found.filter("result = 'deleted'").select("key").distinct()
    marked = assets.join(gone.withColumn("_gone", F.lit(True)), "key", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).select(*assets.columns)
    return marked, queue.join(gone, "key", "left_anti"), digests.join(gone, "key", "left_anti")


def reclaimed(found: DataFrame) -> DataFrame:
    ok = F.col("result") == "deleted"
    return found.agg(F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(ok).alias("deleted"), F.count_if(~ok).alias("failed"))


def reverse_delete(pairs: DataFrame, digests: DataFrame, assets: DataFrame, left_key: str, confirmed: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After the left end of a pair was deleted instead: pairs that touch it go, digest rows that name it too, and the queue is rebuilt."""
    if not confirmed:
        return pairs, digests, deletion_queue(pairs, assets)
    rest = pairs.filter((F.col("left_key") != left_key) & (F.col("right_key") != left_key))
    digests = digests.filter((F.col("key") != left_key) & (F.col("survivor_key") != left_key))
    live = assets.withColumn("deleted", F.col("deleted") | (F.col("key") == left_key))
    return rest, digests, deletion_queue(rest, live)


def cleanup_queue(queued: DataFrame, added: DataFrame, cleared: DataFrame) -> DataFrame:
    return queued.select("key").unionByName(added.select("key")).distinct().join(cleared.select("key"), "key", "left_anti")

