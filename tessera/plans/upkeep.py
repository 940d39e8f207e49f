"""More queries of the catalog: upkeep of inventory, queues, state and index, and functions of names, mails and media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import hashes, names, samples, text
from tessera.operators import index, inventory, review, tags
from tessera.plans import fixtures as fx
from tessera.plans.catalog import _QUEUES, _digests, _found, _live, _pairs, _results, _sources, _tag_state, _united, query
from tessera.plans.fixtures import sql

_K = "o_orderkey"


# Inventory ----------------------------------------------------------------------------------------------------------

@query(sql("stored", then="SELECT key, sha256 FROM stored WHERE NOT deleted AND sha256 IS NOT NULL"))
def hashed_assets(spark, d):
    return inventory.hashed(fx.orders_stored(spark, d)).select("key", "sha256")


@query(sql("stored", "listing", then="SELECT s.key, CASE WHEN l.key IS NOT NULL THEN nullif('h' || l.etag, 'he1') ELSE s.sha256 END AS sha256, CASE WHEN l.key IS NULL THEN s.scan_error END AS scan_error, s.deleted FROM stored s LEFT JOIN listing l ON l.key = s.key"))
def hashes_saved(spark, d):
    """Found hashes replace the stored ones, nulls too."""
    found = fx.orders_listing(spark, d).select("key", F.when(F.col("etag") != "e1", F.concat(F.lit("h"), "etag")).alias("sha256"), F.lit(None).cast("string").alias("scan_error"))
    return inventory.save_hashes(fx.orders_stored(spark, d), found).select("key", "sha256", "scan_error", "deleted")


fx.SQL["changed"] = "changed AS (SELECT s.key FROM stored s JOIN listing n ON n.key = s.key WHERE s.etag <> n.etag OR s.size <> n.size)"
fx.SQL["gone"] = "gone AS (SELECT key FROM stored WHERE NOT deleted AND key NOT IN (SELECT key FROM listing))"


@query(sql("stored", "listing", "digests", "changed", then="SELECT key, survivor_key FROM digests WHERE key NOT IN (SELECT key FROM changed) AND survivor_key NOT IN (SELECT key FROM changed)"))
def changed_purged(spark, d):
    return inventory.purge_changed(_digests(spark, d), inventory.diff(fx.orders_stored(spark, d), fx.orders_listing(spark, d))).select("key", "survivor_key")


def _queues_left(spark, d) -> tuple[DataFrame, DataFrame]:
    stored = fx.orders_stored(spark, d)
    missing = inventory.mark_missing(stored, fx.orders_listing(spark, d)).filter("deleted").join(stored.filter("deleted").select("key"), "key", "left_anti")
    return inventory.purge_missing(review.deletion_queue(_pairs(spark, d), _live(spark, d)), _digests(spark, d), missing)


@query(sql("stored", "listing", "found", "pairs", "queue", "gone", then="SELECT key, pair_id FROM queue WHERE key NOT IN (SELECT key FROM gone)"))
def missing_purged_queue(spark, d):
    return _queues_left(spark, d)[0].select("key", "pair_id")


@query(sql("stored", "listing", "digests", "gone", then="SELECT key, survivor_key FROM digests WHERE key NOT IN (SELECT key FROM gone) AND survivor_key NOT IN (SELECT key FROM gone)"))
def missing_purged_digests(spark, d):
    return _queues_left(spark, d)[1].select("key", "survivor_key")


@query(sql("stored", then="SELECT s.key, s.size, s.sha256, s.deleted FROM stored s WHERE s.key IN (SELECT 'o/' || l_orderkey || '.jpg' FROM lineitem WHERE l_returnflag = 'R')"))
def assets_looked_up(spark, d):
    keys = fx.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("o/"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("key"))
    return inventory.lookup(fx.orders_stored(spark, d), keys).select("key", "size", "sha256", "deleted")


@query(sql(*_QUEUES[:5], then="""SELECT (SELECT count(*) FROM stored) AS total, (SELECT count(*) FROM stored WHERE NOT deleted) AS live, (SELECT count(*) FROM stored WHERE NOT deleted AND sha256 IS NOT NULL) AS hashed, (SELECT count(*) FROM stored WHERE scan_error IS NOT NULL) AS errors,
    (SELECT count(*) FROM pairs p JOIN stored l ON l.key = p.left_key AND NOT l.deleted JOIN stored r ON r.key = p.right_key AND NOT r.deleted WHERE p.status = 'included') AS pending_pairs,
    (SELECT count(*) FROM queue WHERE key NOT IN (SELECT key FROM digests)) AS queued, (SELECT count(*) FROM digests g JOIN stored s ON s.key = g.key AND NOT s.deleted) AS sha_queued"""))
def library_counts(spark, d):
    pairs = _pairs(spark, d)
    return inventory.counts(fx.orders_stored(spark, d), pairs, review.deletion_queue(pairs, _live(spark, d)), _digests(spark, d))


# Tag state ----------------------------------------------------------------------------------------------------------

_STATE = "CASE WHEN scan_error IS NOT NULL THEN 'error' WHEN sha256 IS NOT NULL THEN 'tagged' ELSE 'pending' END"
_TAGS = "CASE WHEN sha256 IS NOT NULL THEN 'a,' || substr(sha256, 1, 1) END"


@query(sql("stored", then=f"SELECT key, {_STATE} AS state FROM stored WHERE {_STATE} <> 'tagged'"))
def tags_pending(spark, d):
    return inventory.tag_pending(_tag_state(spark, d)).select("key", "state")


@query(sql("stored", then=f"SELECT key, 'jpg' AS extension, {_TAGS} AS tags FROM stored WHERE {_STATE} = 'tagged'"))
def tagged_rows(spark, d):
    return inventory.tag_rows(_tag_state(spark, d)).select("key", "extension", F.array_join("tags", ",").alias("tags"))


@query(sql("stored", "listing", then=f"""SELECT s.key, CASE WHEN l.key IS NULL THEN {_STATE} WHEN l.etag = 'e1' THEN 'error' ELSE 'tagged' END AS state, CASE WHEN l.key IS NULL OR l.etag = 'e1' THEN {_TAGS} ELSE 'new,' || l.etag END AS tags,
    CASE WHEN l.key IS NULL THEN s.scan_error WHEN l.etag = 'e1' THEN substr(repeat('broken ', 400), 1, 2000) END AS error FROM stored s LEFT JOIN listing l ON l.key = s.key"""))
def tag_results(spark, d):
    """Tags mark a row tagged, an error of any length is cut and keeps the old tags."""
    failed = F.col("etag") == "e1"
    new = fx.orders_listing(spark, d).select("key", F.when(~failed, F.array(F.lit("new"), F.col("etag"))).alias("tags"), F.when(failed, F.repeat(F.lit("broken "), F.lit(400))).alias("error"))
    return inventory.tag_results(_tag_state(spark, d), new).select("key", "state", F.array_join("tags", ",").alias("tags"), "error")


@query("SELECT l_orderkey AS run, CAST(count(*) // 3 + 1 AS BIGINT) AS published FROM lineitem GROUP BY 1")
def tag_publications(spark, d):
    return inventory.publications(fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run")), 3)


@query("SELECT 'k' || c_custkey AS name, coalesce(max(strftime(o_orderdate, '%Y-%m-%d')), 'not_started') AS value FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderdate, o_orderkey) AS o_orderdate FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def state_values(spark, d):
    writes = fx.table(spark, d, "orders").select(F.col(_K).alias("ordinal"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("name"), F.date_format("o_orderdate", _DAY).alias("value"))
    return inventory.value_of(writes, fx.table(spark, d, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("name")))


_DAY = "yyyy-MM-dd"


# Sources and runs -----------------------------------------------------------------------------------------------------

@query("SELECT 'p' || max(o_orderkey) AS path, max(o_orderkey) AS n FROM orders WHERE o_orderkey < (SELECT min(l_orderkey) FROM lineitem WHERE l_quantity = 50 AND l_orderkey > 200)")
def run_rolled_back(spark, d):
    checkpoints = fx.table(spark, d, "orders").select(F.col(_K).alias("n"), F.concat(F.lit("p"), F.col(_K).cast("string")).alias("path"))
    runs = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("n"), ((F.col("l_quantity") == 50) & (F.col("l_orderkey") > 200)).cast("int").alias("failed"))
    return inventory.rollback(checkpoints, runs).select("path", "n")


@query("SELECT l_suppkey AS source, count(*) AS discovered, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_size FROM lineitem GROUP BY 1")
def source_runs(spark, d):
    return inventory.run_state(fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_quantity").cast("long").alias("size")))


@query("""WITH posts AS (SELECT o_custkey AS source, o_orderkey AS ordinal, o_orderkey % 3 <> 0 AS archived FROM orders), runs AS (SELECT *, archived AND lag(archived, 1, false) OVER w AS pair FROM posts WINDOW w AS (PARTITION BY source ORDER BY ordinal)),
    stops AS (SELECT source, min(ordinal) FILTER (pair) AS stop FROM runs GROUP BY 1) SELECT p.source, p.ordinal FROM posts p JOIN stops s ON s.source = p.source WHERE s.stop IS NULL OR p.ordinal <= s.stop""")
def source_stopped(spark, d):
    """Posts up to the second of two archived ones in a row."""
    posts = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col(_K).alias("ordinal"), (F.col(_K) % 3 != 0).alias("archived"))
    return inventory.stop_after(posts, 2).select("source", "ordinal")


@query(sql("sources", then="SELECT ordinal, value FROM sources UNION ALL SELECT max(ordinal) + 1, 'One_more' FROM sources HAVING count(*) < 100000"))
def source_added(spark, d):
    known = inventory.add_source(_sources(spark, d), "One_more", 100_000)
    return inventory.add_source(known, "ONE_MORE", 100_000)


# Review queues --------------------------------------------------------------------------------------------------------

@query(sql("found", "pairs", then="SELECT id, left_key, right_key, CASE WHEN id = (SELECT min(id) FROM pairs) THEN 'excluded' ELSE status END AS status FROM pairs"))
def pair_excluded(spark, d):
    pairs = _pairs(spark, d)
    least = _found(spark, d).agg(F.min("ordinal")).first()[0]  # the first pair's id
    queue = pairs.select(F.col("right_key").alias("key"), F.col("id").alias("pair_id"))
    return review.exclude_pair(pairs, queue, least if least is not None else -1)[0].select("id", "left_key", "right_key", "status")


def _excluded(spark, d) -> tuple[DataFrame, DataFrame]:
    pairs = _pairs(spark, d)
    keys = _found(spark, d).filter("reason = 'R'").select("left_key", "right_key")
    return review.exclude_keys(pairs, review.deletion_queue(pairs, _live(spark, d)), keys)


fx.SQL["refused"] = "refused AS (SELECT p.id FROM pairs p WHERE EXISTS (SELECT 1 FROM found f WHERE f.reason = 'R' AND f.left_key = p.left_key AND f.right_key = p.right_key))"


@query(sql("found", "pairs", "refused", then="SELECT id, left_key, right_key, CASE WHEN id IN (SELECT id FROM refused) THEN 'excluded' ELSE status END AS status FROM pairs"))
def pairs_excluded_by_keys(spark, d):
    return _excluded(spark, d)[0].select("id", "left_key", "right_key", "status")


@query(sql("stored", "found", "pairs", "queue", "refused", then="SELECT key, pair_id FROM queue WHERE pair_id NOT IN (SELECT id FROM refused)"))
def queue_after_exclusion(spark, d):
    return _excluded(spark, d)[1].select("key", "pair_id")


@query(sql(*_QUEUES[:-1], then="SELECT key, pair_id, size, coalesce(pair_id, 0) AS queued_at FROM united"))
def queue_in_order(spark, d):
    return review.queue_order(_united(spark, d).withColumn("queued_at", F.coalesce("pair_id", F.lit(0)).cast("long")))


def _applied(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return review.apply_deletions(fx.orders_stored(spark, d).select("key", "deleted"), review.deletion_queue(_pairs(spark, d), _live(spark, d)), _digests(spark, d), _results(spark, d))


fx.SQL["confirmed"] = "confirmed AS (SELECT DISTINCT key FROM results WHERE result = 'deleted')"


@query(sql(*_QUEUES, "confirmed", then="SELECT key, deleted OR key IN (SELECT key FROM confirmed) AS deleted FROM stored"))
def deletions_applied(spark, d):
    return _applied(spark, d)[0]


@query(sql(*_QUEUES, "confirmed", then="SELECT key, pair_id FROM queue WHERE key NOT IN (SELECT key FROM confirmed)"))
def queue_after_deletions(spark, d):
    return _applied(spark, d)[1].select("key", "pair_id")


@query(sql(*_QUEUES, "confirmed", then="SELECT key, survivor_key FROM digests WHERE key NOT IN (SELECT key FROM confirmed)"))
def digests_after_deletions(spark, d):
    return _applied(spark, d)[2].select("key", "survivor_key")


@query(sql("found", "pairs", then="SELECT id, left_key, right_key FROM pairs WHERE left_key <> 'o/1.jpg' AND right_key <> 'o/1.jpg'"))
def reverse_delete_pairs(spark, d):
    return review.reverse_delete(_pairs(spark, d), _digests(spark, d), _live(spark, d), "o/1.jpg")[0].select("id", "left_key", "right_key")


@query(sql("digests", then="SELECT key, survivor_key FROM digests WHERE key <> 'o/1.jpg' AND survivor_key <> 'o/1.jpg'"))
def reverse_delete_digests(spark, d):
    return review.reverse_delete(_pairs(spark, d), _digests(spark, d), _live(spark, d), "o/1.jpg")[1].select("key", "survivor_key")


@query(sql("stored", "listing", "digests", then="SELECT key FROM (SELECT key FROM digests UNION SELECT key FROM listing) WHERE key NOT IN (SELECT key FROM stored WHERE deleted)"))
def cleanup_list(spark, d):
    return review.cleanup_queue(_digests(spark, d), fx.orders_listing(spark, d), fx.orders_stored(spark, d).filter("deleted"))


@query(sql("found", "pairs", then="SELECT 'same' AS workflow, count(*) AS pairs FROM pairs UNION ALL SELECT 'other', 0"))
def workflow_kept_or_reset(spark, d):
    pairs = _pairs(spark, d)
    state = fx.table(spark, d, "region").select(F.lit("review").alias("name"), F.lit("v2").alias("value"))
    left = lambda wanted: review.workflow_reset(state, pairs, pairs.select("id"), "review", wanted)[0].agg(F.count(F.lit(1)).alias("pairs"))
    return left("v2").select(F.lit("same").alias("workflow"), "pairs").union(left("v3").select(F.lit("other"), "pairs"))


# Index and tags -------------------------------------------------------------------------------------------------------

_DIRTY = "CASE k % 7 WHEN 0 THEN 'other/' || k ELSE 'gallery/' || k END"


def _dirty(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    key = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 7 == 0, F.concat(F.lit("other/"), k.cast("string"))).otherwise(F.concat(F.lit("gallery/"), k.cast("string")))
    return fx.table(spark, d, "part").select((k % 3 != 0).alias("is_object"), F.when(k % 3 != 0, key).alias("key"), F.lit("jpg").alias("ext"), F.lit(1).cast("long").alias("size"))


@query(f"SELECT key FROM (SELECT {_DIRTY} AS key, k FROM (SELECT p_partkey AS k FROM part)) WHERE k % 3 <> 0 AND k % 5 <> 0 AND key LIKE 'gallery/%'")
def index_loaded(spark, d):
    return index.loaded(_dirty(spark, d), "gallery/").select("key")


@query(f"""SELECT count(*) AS rows, count(*) FILTER (k % 3 = 0) AS non_object, count(*) FILTER (k % 3 <> 0 AND k % 5 = 0) AS invalid_key, count(*) FILTER (k % 3 <> 0 AND k % 5 <> 0 AND k % 7 = 0) AS outside_prefix,
    count(*) FILTER (k % 3 <> 0 AND k % 5 <> 0 AND k % 7 <> 0) AS eligible, false AS clean FROM (SELECT p_partkey AS k FROM part)""")
def index_audit_dirty(spark, d):
    report = index.audit(_dirty(spark, d), fx.index_objects(spark, d), "gallery/")
    return report.select(F.col("actual_index_rows").alias("rows"), F.col("non_object_rows").alias("non_object"), F.col("invalid_key_rows").alias("invalid_key"), F.col("outside_gallery_prefix_rows").alias("outside_prefix"), F.col("random_eligible_rows").alias("eligible"), "clean")


@query(sql("items", "objects", then="SELECT count(*) AS removed FROM items WHERE key IN (SELECT key FROM objects WHERE size % 2 = 0)"))
def index_removed_count(spark, d):
    return index.remove(fx.index_items(spark, d), fx.index_objects(spark, d).filter("size % 2 = 0"))[1]


@query(sql("tagged", then="SELECT 1 AS version, count(*) AS items FROM tagged UNION ALL SELECT 2, 0"))
def tag_index_read(spark, d):
    """Items that a reader takes from an index of version 1 and of another, in documents of as many items as it allows."""
    rows = tags.dealt(fx.tagged(spark, d))
    entries = tags.catalog(rows)
    read = lambda v: tags.readable(rows, entries, v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("items"))
    return read(1).union(read(2))


@query(sql("tagged", then="SELECT DISTINCT c_mktsegment AS name FROM customer EXCEPT SELECT unnest(tags) FROM tagged"))
def tags_unknown(spark, d):
    wanted = fx.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).union(fx.table(spark, d, "part").select("p_brand"))
    return tags.unknown_tags(tags.catalog(fx.tagged(spark, d)), wanted)


# Functions ------------------------------------------------------------------------------------------------------------

@query(sql("items", then="SELECT ordinal, CASE WHEN ext IN ('mp4', 'm4v', 'webm') THEN 'video' ELSE 'image' END AS media, ext <> 'bmp' AND size > 0 AND size <= 1048576 AS allowed FROM items"))
def media_types(spark, d):
    ext = F.col("ext")
    return fx.index_items(spark, d).select("ordinal", names.media_type(ext).alias("media"), names.allowed(ext, F.col("size"), 1).alias("allowed"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand || ',' || p_type END AS hashes FROM part")
def crop_lists_parsed(spark, d):
    k = F.col("p_partkey")
    listed = F.concat(F.lit('["'), "p_brand", F.lit('", "", null, "'), "p_type", F.lit('"]'))
    return fx.table(spark, d, "part").select(k.alias("id"), F.array_join(hashes.crop_hashes(F.when(k % 5 == 0, F.lit('{"a": 1}')).otherwise(listed)), ",").alias("hashes"))


@query("""SELECT c_custkey AS id, lower('Mail.Example.COM') AS domain, 'a@' || c_custkey AS local, '[' || c_custkey || '] plain ' || c_name AS scrubbed, replace(c_name, '#', '_') || '_x' AS file, c_mktsegment || ' two' AS header,
    CASE WHEN c_custkey % 2 = 0 THEN 'image/png' ELSE 'application/octet-stream' END AS mime, c_custkey % 3 <> 0 AS email FROM customer""")
def mail_fields(spark, d):
    k = F.col("c_custkey")
    address = names.parse_address(F.concat(F.lit("a@"), k.cast("string"), F.lit("@Mail.Example.COM")))
    return fx.table(spark, d, "customer").select(
        k.alias("id"), address["domain"].alias("domain"), address["local"].alias("local"), names.scrub(F.concat(F.lit("["), k.cast("string"), F.lit("] PLAIN+key "), "c_name"), "plain+KEY", "plain").alias("scrubbed"),
        names.attachment_name(F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit("/")), F.lit('"\r\\x'))).alias("file"), names.header_value(F.concat("c_mktsegment", F.lit("\r\ntwo"))).alias("header"),
        names.mime_type(F.when(k % 2 == 0, "image/png").otherwise("image png")).alias("mime"), names.is_email(F.when(k % 3 == 0, "a b@c.d").otherwise("a@b.c")).alias("email"),
    )


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def html_escaped(spark, d):
    return fx.table(spark, d, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query(r"SELECT page_id, rtrim(regexp_replace(base64(encode(html)), '(.{76})', E'\\1\r\n', 'g'), E'\r\n') AS wrapped FROM pages")
def base64_wrapped(spark, d):
    return fx.table(spark, d, "pages").select("page_id", text.wrapped_base64(F.encode("html", "UTF-8")).alias("wrapped"))


@query("SELECT user_id AS id, round_even(sum(1 / (1 + exp(-greatest(-80.0::DOUBLE, least(80.0::DOUBLE, value))))), 6) AS score FROM events GROUP BY 1")
def sigmoid_scores(spark, d):
    return fx.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.bround(F.sum(samples.sigmoid(F.col("value"))), 6).alias("score"))


@query("""SELECT p_partkey AS id, array_to_string((range(0, p_size * 20, CASE WHEN p_partkey % 40 = 0 THEN 30 ELSE greatest(1, CAST(round_even(p_partkey % 40 * 2.0, 0) AS INT)) END))[1:12], ',') AS frames, array_to_string((range(0, p_size * 20, CASE WHEN p_partkey % 40 = 0 THEN 4 ELSE greatest(1, CAST(round_even((p_partkey % 40) / 6.0, 0) AS INT)) END))[1:60], ',') AS preview,
    greatest(1, CAST(ceil(p_size * 20 / 12.0) AS BIGINT)) AS step FROM part""")
def video_frames(spark, d):
    total, fps = F.col("p_size") * 20, (F.col("p_partkey") % 40).cast("double")
    shown = lambda x: F.array_join(x.cast("array<string>"), ",")
    return fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), shown(samples.video_positions(total, fps, 2.0, 12)).alias("frames"), shown(samples.preview_positions(total, fps)).alias("preview"), samples.sample_step(total, 12).cast("long").alias("step")
    )


@query("SELECT c_custkey AS id, '/media/' || replace(replace(replace(replace(replace(url_encode('gallery/' || c_name || ' *~é+(1)!.jpg'), '%2A', '*'), '%28', '('), '%29', ')'), '%21', '!'), '%7E', '~') AS url FROM customer")
def media_component_url(spark, d):
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), names.component_url(F.concat(F.lit("gallery/"), "c_name", F.lit(" *~é+(1)!.jpg"))).alias("url"))
