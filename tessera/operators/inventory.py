"""Inventory and tag state as set algebra between stored rows and a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import order

#: Columns that are derived from an object's bytes; a changed object loses them.
DERIVED = ["sha256", "phash", "crop_hashes", "pdq_hash", "pdq_quality", "vpdq_hashes", "width", "height", "duration", "scan_error"]
LISTED = ["size", "etag", "last_modified"]


def _joined(stored: DataFrame, listing: DataFrame) -> DataFrame:
    s = stored.select([F.col(c).alias(f"s_{c}") for c in stored.columns])
    n = listing.select([F.col(c).alias(f"n_{c}") for c in listing.columns])
    return s.join(n, F.col("s_key") == F.col("n_key"), "full")


def _changed(columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"s_{c}").eqNullSafe(F.col(f"n_{c}"))
    return ~same


def diff(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """key, status of every key of either side: new, changed, same or missing."""
    status = F.when(F.col("s_key").isNull(), "new").when(F.col("n_key").isNull(), "missing").when(_changed(LISTED), "changed").otherwise("same")
    return _joined(stored, listing).select(F.coalesce("n_key", "s_key").alias("key"), status.alias("status"))


def upsert(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """The stored rows after a listing: new keys come in, changed ones lose what was derived, listed ones revive, others stay."""
    fresh = F.col("s_key").isNull() | (F.col("n_key").isNotNull() & _changed(LISTED))
    out = []
    for c in stored.columns:
        if c == "deleted":
            out.append(F.when(F.col("n_key").isNotNull(), F.lit(False)).otherwise(F.col("s_deleted")).alias(c))
        elif c in DERIVED:
            out.append(F.when(~fresh, F.col(f"s_{c}")).alias(c))
        elif c in listing.columns:
            out.append(F.coalesce(f"n_{c}", f"s_{c}").alias(c))
        else:
            out.append(F.col(f"s_{c}").alias(c))
    return _joined(stored, listing).select(*out)


def purge_changed(sha_queue: DataFrame, statuses: DataFrame) -> DataFrame:
    """The digest queue without rows that name a changed key, as the one to go or as survivor."""
    changed = statuses.filter("status = 'changed'").select("key")
    return sha_queue.join(changed, "key", "left_anti").join(changed.withColumnRenamed("key", "survivor_key"), "survivor_key", "left_anti").select(*sha_queue.columns)


def mark_missing(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """Live rows that the listing lacks are marked deleted."""
    here = listing.select("key").distinct().withColumn("_here", F.lit(True))
    return stored.join(here, "key", "left").withColumn("deleted", F.col("deleted") | F.col("_here").isNull()).select(*stored.columns)


def purge_missing(queue: DataFrame, sha_queue: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both queues without missing keys; the digest queue also loses rows whose survivor is missing."""
    gone = missing.select("key").distinct()
    digests = sha_queue.join(gone, "key", "left_anti").join(gone.withColumnRenamed("key", "survivor_key"), "survivor_key", "left_anti")
    return queue.join(gone, "key", "left_anti"), digests.select(*sha_queue.columns)


def lookup(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the given keys; unknown keys give none."""
    return stored.join(keys.select("key").distinct(), "key", "left_semi")


def pending(stored: DataFrame) -> DataFrame:
    return stored.filter("not deleted and sha256 is null").select("key").orderBy("key")


def hashed(stored: DataFrame) -> DataFrame:
    return stored.filter("not deleted and sha256 is not null")


def save_hashes(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Derived columns of found keys replace the stored ones, nulls too."""
    new = found.select(F.col("key"), F.lit(True).alias("_new"), *[F.col(c).alias(f"n_{c}") for c in found.columns if c in DERIVED])
    take = lambda c: F.when(F.col("_new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in DERIVED and c in found.columns else F.col(c)
    return stored.join(new, "key", "left").select(*[take(c) for c in stored.columns])


def counts(stored: DataFrame, pairs: DataFrame, queue: DataFrame, sha_queue: DataFrame) -> DataFrame:
    """One row: total, live, hashed, errors (of deleted rows too), pending pairs, queued, sha_queued."""
    live = stored.filter("not deleted").select("key")
    both = pairs.filter("status = 'included'").join(live.withColumnRenamed("key", "left_key"), "left_key", "left_semi").join(live.withColumnRenamed("key", "right_key"), "right_key", "left_semi")
    queued = queue.join(live, "key", "left_semi").join(sha_queue.select("key"), "key", "left_anti")
    base = stored.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("deleted")).alias("live"), F.count_if(~F.col("deleted") & F.col("sha256").isNotNull()).alias("hashed"), F.count_if(F.col("scan_error").isNotNull()).alias("errors"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    # each side is one row
    return base.crossJoin(one(both, "pending_pairs")).crossJoin(one(queued, "queued")).crossJoin(one(sha_queue.join(live, "key", "left_semi"), "sha_queued"))


def tag_sync(state: DataFrame, listing: DataFrame) -> DataFrame:
    """Tag state (key, size, etag, extension, state, tags, error) after a listing: only listed keys stay; a changed size or etag is pending again."""
    old = state.select("key", F.col("size").alias("_size"), F.col("etag").alias("_etag"), "state", "tags", "error")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("etag").eqNullSafe(F.col("_etag")) & F.col("state").isNotNull()
    keep = lambda c: F.when(same, F.col(c)).alias(c)
    return listing.select("key", "size", "etag", "extension").join(old, "key", "left").select("key", "size", "etag", "extension", F.when(same, F.col("state")).otherwise("pending").alias("state"), keep("tags"), keep("error"))


def tag_pending(state: DataFrame) -> DataFrame:
    return state.filter("state <> 'tagged'").orderBy("key")


def tag_rows(state: DataFrame) -> DataFrame:
    """(key, extension, tags) of tagged rows by key; no tags are an empty list."""
    return state.filter("state = 'tagged'").select("key", "extension", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).orderBy("key")


def publications(completed: DataFrame, every: int) -> DataFrame:
    """(run, published) of completed items (run): how often a run publishes, after each ``every`` items and once at its end."""
    return completed.groupBy("run").agg((F.floor(F.count(F.lit(1)) / F.lit(every)) + 1).alias("published"))


def tag_results(state: DataFrame, results: DataFrame) -> DataFrame:
    """State after results (key, tags, error): tags mark a row tagged; an error (2000 characters at most) keeps the old tags."""
    new = results.select("key", F.col("tags").alias("_tags"), F.substring("error", 1, 2000).alias("_error"), F.lit(True).alias("_new"))
    done, failed = F.col("_new") & F.col("_error").isNull(), F.col("_new") & F.col("_error").isNotNull()
    return state.join(new, "key", "left").select(
        "key", "size", "etag", "extension", F.when(done, "tagged").when(failed, "error").otherwise(F.col("state")).alias("state"),
        F.when(done, F.col("_tags")).otherwise(F.col("tags")).alias("tags"), F.when(F.col("_new"), F.col("_error")).otherwise(F.col("error")).alias("error"),
    )


def tag_counts(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "tagged").alias("tagged"), F.count_if(F.col("state") == "error").alias("errors"))


def last_values(rows: DataFrame) -> DataFrame:
    """Key/value state (ordinal, name, value): the last write of each name."""
    return rows.groupBy("name").agg(F.max_by("value", "ordinal").alias("value"))


def value_of(rows: DataFrame, names: DataFrame, default: str = "not_started") -> DataFrame:
    """(name, value) of each asked name: its last write, or the default."""
    return names.select("name").distinct().join(last_values(rows), "name", "left").select("name", F.coalesce("value", F.lit(default)).alias("value"))


def dedupe_sources(rows: DataFrame) -> DataFrame:
    """(ordinal, value): the first spelling of each name whatever its case, in input order."""
    first = Window.partitionBy(F.lower("value")).orderBy("ordinal")
    return rows.filter("value <> ''").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").orderBy("ordinal")


def united_sources(settings: DataFrame, managed: DataFrame, site: str) -> DataFrame:
    """(ordinal, value): the addresses of both lists (ordinal, value), settings first, each once whatever its case; values that give no address go."""
    both = settings.select(F.lit(0).alias("list"), "ordinal", "value").unionByName(managed.select(F.lit(1).alias("list"), "ordinal", "value"))
    named = both.withColumn("value", names.normalize_source(F.col("value"), site)).filter("value <> ''")
    first = named.groupBy(F.lower("value").alias("low")).agg(F.min(F.struct("list", "ordinal", "value")).alias("s"))
    return order.numbered(first.select("s.*"), "place", F.asc("list"), F.asc("ordinal"), F.asc("value")).select(F.col("place").alias("ordinal"), "value")


def add_source(rows: DataFrame, value: str, most: int = 500) -> DataFrame:
    """The sources with one more name, if it is new and there is room."""
    state = rows.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0)).alias("ordinal"), F.count(F.lit(1)).alias("n"), F.count_if(F.lower("value") == value.lower()).alias("known"))
    return rows.unionByName(state.filter((F.col("n") < most) & (F.col("known") == 0)).select("ordinal", F.lit(value).alias("value")))


def rollback(checkpoints: DataFrame, runs: DataFrame) -> DataFrame:
    """The checkpoint (n) that precedes the lowest-numbered failed source run; the latest if none failed."""
    failed = runs.agg(F.min(F.when(F.col("failed") > 0, F.col("n"))).alias("first_failed"))
    return checkpoints.crossJoin(F.broadcast(failed)).filter("first_failed is null or n < first_failed").groupBy().agg(F.max_by("path", "n").alias("path"), F.max("n").alias("n"))


def run_state(files: DataFrame) -> DataFrame:
    """source, discovered, total_size of downloaded files (source, size)."""
    return files.groupBy("source").agg(F.count(F.lit(1)).alias("discovered"), F.sum("size").alias("total_size"))


def stop_after(posts: DataFrame, k: int) -> DataFrame:
    """Posts (source, ordinal, archived) of each source up to the first run of k archived ones. Our own definition of the rule."""
    w = Window.partitionBy("source").orderBy("ordinal")
    block = posts.withColumn("_b", F.sum(F.when(~F.col("archived"), 1).otherwise(0)).over(w))
    run = Window.partitionBy("source", "_b").orderBy("ordinal")
    full = block.withColumn("_run", F.sum(F.col("archived").cast("int")).over(run)).withColumn("_stop", F.max(F.when(F.col("_run") >= k, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return full.filter("coalesce(_stop, 0) = 0").drop("_b", "_run", "_stop")
