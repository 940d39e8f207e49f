"""Operators against small cases and brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import hashes, names
from tessera.functions.text import escape_html, html_text
from tessera.operators import index, inventory, matching, orient, review, tags
from tessera.sources.tables import Snapshots, index_document, index_rows

ASSET = "key string, size long, sha256 string, phash string, pdq_hash string, crop array<string>, vpdq array<struct<h: string, q: int, t: bigint>>, width int, height int, duration double, pdq_quality int, deleted boolean"


def asset(key, sha="", phash=None, pdq=None, crop=None, vpdq=None, w=None, h=None, size=100):
    return (key, size, sha, phash, pdq, crop or [], vpdq, w, h, None, None, False)


def assets(spark, *rows):
    return spark.createDataFrame(list(rows), ASSET)


def bits(n, width):
    return f"{n:0{width}x}"


def test_limits():
    assert [hashes.limits(s)["phash"] for s in (0, 25, 50, 75, 99)] == [18, 15, 12, 9, 6]
    assert [hashes.limits(s)["pdq"] for s in (0, 25, 50, 75, 99)] == [48, 42, 35, 29, 23]
    assert hashes.limits(-5) == hashes.limits(0) and hashes.limits(120) == hashes.limits(99)


@pytest.mark.parametrize("count,radius", [(2, 0), (2, 3), (2, 9), (2, 18), (8, 20), (8, 48)])
def test_multi_index_equals_nested_loop(spark, count, radius):
    rng = random.Random(count + radius)
    base = [rng.getrandbits(32 * count) for _ in range(30)]
    values = [b ^ sum(1 << k for k in {rng.randrange(32 * count) for _ in range(rng.randrange(12))}) for b in base * 4]
    values += [values[0] | 0xFFFF, values[1] | 0xFFFF, values[0]]
    rows = spark.createDataFrame([(i, bits(v, 8 * count)) for i, v in enumerate(values)], "key long, h string").withColumn("lanes", hashes.lanes(F.col("h"), count))
    pairs = lambda limit: sorted((r.l_key, r.r_key, r.distance) for r in matching.hamming_pairs(rows, "lanes", count, radius, [], limit).collect())
    expected = sorted((i, j, d) for i in range(len(values)) for j in range(i + 1, len(values)) if (d := (values[i] ^ values[j]).bit_count()) <= radius)
    assert pairs(0) == pairs(10_000) == expected and expected


def test_any_deal_of_the_radius_is_exact(spark):
    from tessera.operators import hamming

    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for b in base for _ in range(6)})
    distinct = spark.createDataFrame([(bits(v, 16),) for v in values], "s string").select(hashes.lanes(F.col("s"), 2).alias("h"))
    pairs = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :]}
    hexed = lambda h: h[0] << 32 | h[1]
    for bands in ((hamming.Band(0, 40, 2, 1), hamming.Band(40, 24, 1, 1)), (hamming.Band(3, 20, 1, 0), hamming.Band(23, 10, 0, 0), hamming.Band(33, 31, 2, 2))):
        got = sorted((r.band, *sorted((hexed(r.x), hexed(r.y)))) for r in hamming.met_hashes(distinct, 2, bands).collect())
        part = lambda v, b: (v >> (64 - b.start - b.width)) & ((1 << b.width) - 1)
        expected = sorted((i, a, b) for i, band in enumerate(bands) for a, b in pairs if (part(a, band) ^ part(b, band)).bit_count() <= band.sent + band.kept)
        assert got == expected and expected


def test_candidates_for_each_pair_stay_level(spark):
    from tessera.operators import hamming

    def met(n, radius):
        rng = np.random.default_rng(n)
        base = rng.integers(0, 1 << 32, (n, 2))
        near = base.copy()
        for _ in range(radius - 1):
            at = rng.integers(0, 64, n)
            near[np.arange(n), at // 32] ^= 1 << (at % 32)
        rows = spark.createDataFrame(pd.DataFrame(np.concatenate([base, near]), columns=["a", "b"])).select(F.array("a", "b").alias("h")).distinct()
        chosen = hamming.plan(*hamming.counted_bits(rows, 2), radius, 0)
        assert sum(b.sent + b.kept + 1 for b in chosen.bands) == radius + 1
        return hamming.met_hashes(rows, 2, chosen.bands).count() / n

    small, large = met(10_000, 6), met(160_000, 6)
    assert large < 2 * small and small < 400
    # bits that all hashes share hold no information: the bands that count are cut from the others
    skewed = hamming.plan(50_000, [0] * 32 + [25_000] * 32, 3, 0)
    assert all(b.start + b.width > 32 for b in skewed.bands) and skewed.meets < 2_000


def brute_seeds(rows):
    """Pairs of assets (key, sha256, frames) that share enough tokens, and how many."""
    held = {k: ({(b, h[4 * b : 4 * b + 4]) for h, q in f if q >= 35 for b in range(16)}, max(1, min(8, math.ceil(len(f) * 0.2))), s) for k, s, f in rows}
    out = {}
    for a in held:
        for b in held:
            if a < b and not (held[a][2] and held[a][2] == held[b][2]):
                shared, required = len(held[a][0] & held[b][0]), min(held[a][1], held[b][1])
                if shared >= required:
                    out[a, b] = (shared, required)
    return out


@pytest.mark.parametrize("frames", [(10, 10), (3, 60)])
def test_frame_tokens_that_many_share(spark, frames):
    rng = random.Random(sum(frames))
    hexed = lambda: bits(rng.getrandbits(256), 64)
    rows = []
    for i in range(330):
        f = [(hexed(), rng.choice([20, 40, 80])) for _ in range(rng.randint(*frames))]
        if i % 3 == 0:
            f[0] = ("ffff" + f[0][0][4:], 90)  # a third share this token
        if i % 5 == 0:
            f[-1] = ("0000" * 3 + f[-1][0][12:], 90)  # a fifth share three
        if i % 11 == 1:
            f[0] = rows[-1][2][0]
        rows.append((f"k{i:03}", None if i % 7 == 0 else f"s{i // 2}" if i % 17 == 0 else "", f))
    a = assets(spark, *[asset(k, s, vpdq=[(h, q, n) for n, (h, q) in enumerate(f)]) for k, s, f in rows])
    expected = brute_seeds(rows)
    for heavy in (5, 40, 10_000):
        got = {(r.left, r.right): (r.shared, r.required) for r in matching.vpdq_candidates(a, heavy).collect()}
        assert got == expected
    if frames == (10, 10):
        # two shared tokens are needed: the one that 110 assets share, 5,995 pairs, seeds none
        light, frequent = matching.heavy_tokens(matching.frame_tokens(a), 40)
        seeds = matching.vpdq_seeds(light, frequent).count()
        assert len(expected) <= seeds < 3 * len(expected) + 1_500


@pytest.mark.parametrize("slider", [0, 50, 99])
def test_crop_lists_with_common_segments(spark, slider):
    rng = random.Random(slider)
    limit = hashes.limits(slider)
    pool = [rng.getrandbits(64) for _ in range(60)]
    near = lambda v: v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7)))
    rows = {}
    for i in range(240):
        listed = [near(rng.choice(pool)) if rng.random() < 0.3 else rng.getrandbits(64) for _ in range(rng.randrange(1, 7))]
        listed += [0] * (i % 3 == 0) + [near(pool[0])] * (i % 4 == 0)
        rows[f"k{i:03}"] = listed
    a = assets(spark, *[asset(k, crop=[bits(v, 16) for v in c]) for k, c in rows.items()])
    cutoff, ratio, expected = int(limit["crop_distance"]), limit["crop_ratio"], {}
    for x in rows:
        for y in rows:
            if x < y:
                share = lambda p, q: sum(min((v ^ w).bit_count() for w in q) <= cutoff for v in p) / len(p)
                score = 100 * min(share(rows[x], rows[y]), share(rows[y], rows[x]))
                if score / 100 >= ratio:
                    expected[x, y] = round(score, 9)
    assert {(r.left, r.right): round(r.score, 9) for r in matching.crop_stage(a, slider).collect()} == expected and expected
    listed = matching._listed(a)
    met = matching.crop_candidates(listed, matching._close_segments(listed, cutoff), ratio).count()
    everyone = matching.crop_candidates(listed, matching._close_segments(listed, cutoff), 0.0).count()
    assert len(expected) <= met <= everyone and (slider == 0 or met < 0.5 * everyone)


def test_exact_groups_and_survivors(spark):
    a = assets(spark, asset("small", "s", w=1, h=1), asset("large", "s", w=9, h=9), asset("one", "t"), asset("none", ""), asset("none2", ""))
    assert [tuple(r) for r in matching.exact_survivors(a).collect()] == [("large", "small")]
    assert {r.key for r in matching.visual_assets(a).collect()} == {"one", "none", "none2"}
    assert [tuple(r)[:3] for r in matching.exact_stage(a).collect()] == [("large", "small", 100.0)]


def test_phash_pair_and_frames_are_left_out(spark):
    a = assets(spark, asset("a", phash=bits(0, 16)), asset("b", phash=bits(3, 16)), asset("v", phash=bits(0, 16), vpdq=[]))
    assert [tuple(r)[:3] for r in matching.phash_stage(a, 50).collect()] == [("a", "b", 2)]


def test_crop_ratio_follows_the_slider(spark):
    x, y, z = "0" * 16, "f" * 16, "0f" * 8
    a = assets(spark, asset("a", crop=[x, y]), asset("b", crop=[x, z]))
    assert [(r.left, r.right, r.score) for r in matching.crop_stage(a, 50).collect()] == [("a", "b", 50.0)]
    assert matching.crop_stage(a, 99).isEmpty()


def frame(n, q=100):
    return (bits(n, 64), q, 0)


def test_vpdq_counts_both_ways_and_needs_seeds(spark):
    rng = random.Random(1)
    x, y = rng.getrandbits(256), rng.getrandbits(256)
    a = assets(spark, asset("a", vpdq=[frame(x), frame(y)]), asset("b", vpdq=[frame(x)]))
    got = matching.vpdq_stage(a, 0).collect()
    assert [(r.left, r.right, r.score, r.reason) for r in got] == [("a", "b", 50.0, "vPDQ frames: 50% / 100%")]
    band = "abcd"
    many = lambda: [(band + bits(rng.getrandbits(240), 60), 100, 0) for _ in range(20)]
    assert matching.vpdq_candidates(assets(spark, asset("a", vpdq=many()), asset("b", vpdq=many()))).isEmpty()
    low = assets(spark, asset("a", vpdq=[frame(x, 10)]), asset("b", vpdq=[frame(x, 10)]))
    assert matching.vpdq_candidates(low).isEmpty()


@pytest.mark.parametrize("distance,stage", [(8, "visual"), (9, "Meta"), (10, "Meta")])
def test_reason_when_scores_tie(spark, distance, stage):
    a = assets(spark, asset("a", phash=bits(0, 16), pdq=bits(0, 64)), asset("b", phash=bits(63, 16), pdq=bits((1 << distance) - 1, 64)))
    best = matching.best_offers(matching.offers(a, 99)).collect()
    assert len(best) == 1 and best[0].reason.startswith(stage)


def greedy(edges, order):
    gone, out = set(), []
    for key in order:
        if key in gone:
            continue
        for a, b in edges:
            other = b if a == key else a if b == key else None
            if other is not None and other not in gone:
                out.append((key, other))
                gone.add(other)
        gone.add(key)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_orientation_equals_greedy(spark, seed):
    rng = random.Random(seed)
    n = 24
    a = assets(spark, *[asset(f"k{i:02}", w=rng.randrange(5), h=1) for i in range(n)])
    edges = sorted({tuple(sorted((f"k{rng.randrange(n):02}", f"k{rng.randrange(n):02}"))) for _ in range(30)})
    edges = [e for e in edges if e[0] != e[1]]
    chosen = spark.createDataFrame([(x, y, 90.0, "r") for x, y in edges], "left string, right string, score double, reason string")
    order = [r.key for r in a.orderBy(matching.rank().desc()).collect()]
    assert sorted((r.survivor, r.candidate) for r in orient.oriented_pairs(chosen, a).collect()) == greedy(edges, order)


def test_chain_never_pairs_indirectly(spark):
    a = assets(spark, asset("a", w=3, h=1), asset("b", w=1, h=1), asset("c", w=2, h=1))
    chosen = spark.createDataFrame([("a", "b", 90.0, "r"), ("b", "c", 90.0, "r")], "left string, right string, score double, reason string")
    assert [(r.survivor, r.candidate, r.reason) for r in orient.oriented_pairs(chosen, a).collect()] == [("a", "b", "automatic survivor; r")]
    assert orient.oriented_pairs(chosen.limit(0), a).isEmpty()


STORED = "key string, size long, etag string, last_modified string, sha256 string, scan_error string, deleted boolean"


def test_inventory_changes_and_missing(spark):
    stored = spark.createDataFrame([("same", 1, "e", "m", "s", None, False), ("changed", 1, "e", "m", "s", "x", False), ("gone", 1, "e", "m", "s", None, False), ("back", 1, "e", "m", "s", None, True)], STORED)
    listing = spark.createDataFrame([("same", 1, "e", "m"), ("changed", 1, "f", "m"), ("new", 2, "e", "m"), ("back", 1, "e", "m")], "key string, size long, etag string, last_modified string")
    status = {r.key: r.status for r in inventory.diff(stored, listing).collect()}
    assert status == {"same": "same", "changed": "changed", "gone": "missing", "new": "new", "back": "same"}
    after = inventory.upsert(stored, listing)
    got = {r.key: (r.sha256, r.deleted) for r in after.collect()}
    assert got == {"same": ("s", False), "changed": (None, False), "gone": ("s", False), "new": (None, False), "back": ("s", False)}
    assert [r.key for r in inventory.pending(after).collect()] == ["changed", "new"]
    again = inventory.upsert(after, listing)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))
    assert {r.key for r in inventory.mark_missing(after, listing).filter("deleted").collect()} == {"gone"}


def test_tag_sync_and_results(spark):
    schema = "key string, size long, etag string, extension string, state string, tags array<string>, error string"
    state = spark.createDataFrame([("a", 1, "e", "jpg", "tagged", ["x"], None), ("b", 1, "e", "jpg", "tagged", ["x"], None), ("c", 1, "e", "jpg", "tagged", ["x"], None)], schema)
    listing = spark.createDataFrame([("a", 1, "e", "jpg"), ("b", 2, "e", "jpg"), ("n", 1, "e", "jpg")], "key string, size long, etag string, extension string")
    synced = inventory.tag_sync(state, listing)
    assert {r.key: (r.state, r.tags) for r in synced.collect()} == {"a": ("tagged", ["x"]), "b": ("pending", None), "n": ("pending", None)}
    done = inventory.tag_results(synced, spark.createDataFrame([("b", ["y"], None), ("a", None, "boom" * 600)], "key string, tags array<string>, error string"))
    got = {r.key: (r.state, r.tags, len(r.error or "")) for r in done.collect()}
    assert got["b"] == ("tagged", ["y"], 0) and got["a"] == ("error", ["x"], 2000)
    assert [r.key for r in inventory.tag_pending(done).collect()] == ["a", "n"]


def test_review_queue_rules(spark):
    live = assets(spark, asset("a"), asset("b"), asset("c")).select("key", "size", "deleted")
    found = spark.createDataFrame([(1, "a", "b", 90.0, "x"), (2, "a", "b", 95.0, "y"), (3, "c", "b", 80.0, "z"), (4, "a", "dead", 99.0, "w")], "ordinal long, left_key string, right_key string, similarity double, reason string")
    pairs = review.replace_pairs(found)
    assert {(r.left_key, r.right_key): (r.id, r.similarity, r.reason) for r in pairs.collect()}["a", "b"] == (1, 95.0, "y")
    queue = review.deletion_queue(pairs, live)
    assert [tuple(r) for r in queue.collect()] == [("b", 1)]
    excluded, rest = review.exclude_pair(pairs, queue, 1)
    assert rest.isEmpty()
    kept = review.replace_pairs(found, excluded)
    assert {r.status for r in kept.filter("left_key = 'a' and right_key = 'b'").collect()} == {"excluded"}
    assert [tuple(r) for r in review.deletion_queue(kept, live).collect()] == [("b", 3)]
    left, digests, queue = review.reverse_delete(pairs, spark.createDataFrame([("x", "a")], "key string, survivor_key string"), live, "a")
    assert {r.left_key for r in left.collect()} == {"c"} and digests.isEmpty() and [tuple(r) for r in queue.collect()] == [("b", 3)]


def test_sha_queue_last_wins(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", "b"), (3, "d", "d")], "ordinal long, survivor_key string, deletion_key string")
    assert [tuple(r) for r in review.sha_queue(rows).collect()] == [("b", "c")]


def test_ledger_and_unconfirmed(spark):
    queued = spark.createDataFrame([("b", 1, 10), ("x", None, 5)], "key string, pair_id long, size long")
    found = review.results(queued, spark.createDataFrame([("b", "deleted")], "key string, result string"))
    pairs = spark.createDataFrame([(1, "a", "b")], "id long, left_key string, right_key string")
    got = {r.deleted_key: (r.survivor_key, r.result) for r in review.ledger(found, pairs, spark.createDataFrame([("x", "y")], "key string, survivor_key string")).collect()}
    assert got == {"b": ("a", "deleted"), "x": ("y", "store did not confirm deletion")}
    assert tuple(review.reclaimed(found).first()) == (10, 1, 1)


def test_index_merge_remove_and_repair(spark):
    items = spark.createDataFrame([(0, "a.jpg", "jpg", 1), (1, "b.jpg", "jpg", 1), (2, "a.jpg", "jpg", 2), (3, "", "jpg", 2)], "ordinal long, key string, ext string, size long")
    merged = index.merge(items, spark.createDataFrame([(0, "b.jpg", "jpg", 9), (1, "c.jpg", "jpg", 3)], "ordinal long, key string, ext string, size long"))
    assert [(r.key, r.size) for r in merged.orderBy("ordinal").collect()] == [("a.jpg", 2), ("b.jpg", 9), ("c.jpg", 3)]
    rest, removed = index.remove(items, spark.createDataFrame([("a.jpg",), ("zzz",)], "key string"))
    assert rest.count() == 2 and removed.first().removed == 2
    objects = spark.createDataFrame([("a.jpg", 1), ("n.PNG", 1), ("t.txt", 1), ("e.jpg", 0)], "key string, size long")
    assert [r.key for r in index.missing(items, objects).collect()] == ["n.PNG"]


def test_dirty_audit(spark):
    body = '{"count": 7, "items": [{"key":"gallery/a.jpg","ext":"jpg","size":5},{"key":"gallery/a.jpg","ext":"jpg","size":5},{"key":"gallery/b.jpg","ext":"png","size":true},"bad",{"key":5},{"key":"other/c.jpg","ext":"jpg","size":1},{"key":"gallery/d.txt","ext":"txt","size":1}]}'
    rows = index.typed(index_rows(spark.createDataFrame([(body,)], "body string")))
    objects = spark.createDataFrame([("gallery/a.jpg", 5), ("gallery/z.jpg", 5), ("gallery/e.jpg", 0)], "key string, size long")
    r = index.audit(rows, objects, "gallery/", F.lit(9)).first()
    assert (r.actual_index_rows, r.random_eligible_rows, r.duplicate_key_rows, r.non_object_rows, r.invalid_key_rows, r.outside_gallery_prefix_rows) == (7, 4, 1, 1, 1, 1)
    assert (r.random_unclassified_rows, r.extension_mismatch_rows, r.invalid_size_rows, r.indexed_keys_missing, r.supported_objects_not_indexed, r.unsupported_objects) == (1, 1, 1, 2, 1, 1)
    assert r.declared_count_mismatch and not r.clean
    clean = spark.createDataFrame([(True, "gallery/a.jpg", "jpg", 5)], "is_object boolean, key string, ext string, size long")
    assert index.audit(clean, objects.filter("key = 'gallery/a.jpg'"), "gallery/").first().clean


def test_index_document_round_trip(spark):
    items = spark.createDataFrame([(1, "b.jpg", "jpg", 1), (0, "a.jpg", "jpg", 2)], "ordinal long, key string, ext string, size long")
    body = index_document(items, 5).first().body
    assert body == '{"version":1,"generated_at":5,"count":2,"items":[{"key":"a.jpg","ext":"jpg","size":2},{"key":"b.jpg","ext":"jpg","size":1}]}'
    assert [r.key for r in index.typed(index_rows(spark.createDataFrame([("[{\"key\":\"q\"}]",)], "body string"))).collect()] == ["q"]
    with pytest.raises(Exception, match="unsupported format"):
        index_rows(spark.createDataFrame([('{"a": 1}',)], "body string")).collect()


def test_tag_index(spark):
    rows = spark.createDataFrame([("gallery/a", "jpg", ["cat", "blue_eyes"]), ("gallery/b", "gif", ["cat"])], "key string, ext string, tags array<string>")
    entries = tags.catalog(rows)
    assert [tuple(r) for r in entries.orderBy("id").collect()] == [(0, "cat", 2), (1, "blue_eyes", 1)]
    body = tags.tag_document(rows, 0.4, "m").first().body
    assert body == '{"version":1,"model":"m","threshold":0.4,"tagged_count":2,"catalog":[["cat",2],["blue_eyes",1]],"items":[["gallery/a","jpg",[0,1]],["gallery/b","gif",[0]]]}'
    assert [r.key for r in tags.with_all(rows, ["cat", "blue_eyes", "cat"]).collect()] == ["gallery/a"]
    assert [r.key for r in tags.with_all(rows, ["cat"], "clips").collect()] == ["gallery/b"]
    with pytest.raises(ValueError):
        tags.with_all(rows, [""])


def test_names(spark):
    rows = spark.createDataFrame([("a.b/c",), ("x.JPG",), ("plain",)], "k string")
    assert [r[0] for r in rows.select(names.extension(F.col("k"))).collect()] == ["b/c", "jpg", ""]
    urls = spark.createDataFrame([(" r/Some_name/ ",), ("https://www.example.com/r/abc/top",), ("https://evil.org/r/abc",), ("placeholder7",), ("x",), (None,)], "v string")
    hosts = ["www.example.com"]
    got = [tuple(r) for r in urls.select(names.normalize_source(F.col("v"), "https://s/"), names.source_name(F.col("v"), hosts)).collect()]
    assert got == [("https://s/Some_name/new/", "Some_name"), ("https://www.example.com/r/abc/top/", "abc"), ("https://evil.org/r/abc/", ""), ("", "placeholder7"), ("", ""), ("", "")]
    one = spark.createDataFrame([("<p>a</p><script>x</script>b &amp;lt; c<br/>d",)], "h string")
    assert one.select(html_text(F.col("h"))).first()[0] == "a\n\nb < c\nd"
    assert one.select(escape_html(F.lit('<a "b">&'))).first()[0] == "&lt;a &quot;b&quot;&gt;&amp;"
    mail = spark.createDataFrame([("Ann@X@Example.COM",), ("@x",), ("none",)], "a string")
    assert [r[0] and tuple(r[0]) for r in mail.select(names.parse_address(F.col("a"))).collect()] == [("Ann@X", "example.com"), None, None]


def test_sources(spark):
    rows = spark.createDataFrame([(0, "Cats"), (1, "cats"), (2, "dogs")], "ordinal long, value string")
    assert [r.value for r in inventory.dedupe_sources(rows).collect()] == ["Cats", "dogs"]
    assert inventory.add_source(rows, "CATS").count() == 3 and inventory.add_source(rows, "birds").count() == 4
    posts = spark.createDataFrame([("s", i, i in (1, 3, 4)) for i in range(7)], "source string, ordinal long, archived boolean")
    assert sorted(r.ordinal for r in inventory.stop_after(posts, 2).collect()) == [0, 1, 2, 3, 4]


def test_snapshots_refuse_a_late_writer(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1,)], "a long")
    assert store.read() is None and store.commit(one, 0) == 1
    with pytest.raises(FileExistsError):
        store.commit(one, 0)
    assert store.update(lambda df: df.union(one)) == 2 and store.read().count() == 2
    assert store.update(lambda df: None) == 2


def test_incremental_scan_equals_batch(spark, tmp_path):
    from tessera.streaming import scan

    schema = "key string, size long, etag string, last_modified string"
    parts = [[("a", 1, "e", "1"), ("b", 1, "e", "1")], [("b", 2, "f", "2"), ("c", 1, "e", "2")]]
    source = str(tmp_path / "in")
    fingerprint = lambda df: df.select("key", F.sha2(F.concat_ws(":", "key", "etag"), 256).alias("sha256"))
    store = Snapshots(spark, str(tmp_path / "out"))
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(source)
        scan.scan(spark, source, store, fingerprint, str(tmp_path / "check"))
    got = {r.key: (r.size, r.etag, r.sha256) for r in store.read().collect()}
    last = spark.createDataFrame([("a", 1, "e", "1"), ("b", 2, "f", "2"), ("c", 1, "e", "2")], schema)
    assert got == {r.key: (r.size, r.etag, r.h) for r in last.withColumn("h", F.sha2(F.concat_ws(":", "key", "etag"), 256)).collect()}


def test_long_chains_of_survivors_settle(spark):
    from tessera.operators import orient

    n = 24
    assets = spark.createDataFrame([(f"k{i:03}", 10, 10, None, None, 1000 - i) for i in range(n)], "key string, width int, height int, duration double, pdq_quality int, size long")
    chain = spark.createDataFrame([(f"k{i:03}", f"k{i + 1:03}", 90.0, "near") for i in range(n - 1)], "left string, right string, score double, reason string")
    got = {(r.survivor, r.candidate) for r in orient.oriented_pairs(chain, assets).collect()}
    assert got == {(f"k{i:03}", f"k{i + 1:03}") for i in range(0, n, 2)}


def test_unknown_tags_are_an_error(spark):
    import pytest

    from tessera.operators import tags

    rows = spark.createDataFrame([("a", "jpg", ["x", "y"]), ("b", "png", ["x"])], "key string, ext string, tags array<string>")
    entries = tags.catalog(rows)
    assert [r.key for r in tags.with_all(rows, ["x", "y"], entries=entries).collect()] == ["a"]
    with pytest.raises(ValueError, match="unknown"):
        tags.with_all(rows, ["x", "z"], entries=entries)


def test_merge_keeps_rows_without_a_time_and_breaks_ties(spark, tmp_path):
    from tessera.streaming import scan

    store = Snapshots(spark, str(tmp_path / "untimed"))
    batch = spark.createDataFrame([("a", 7, "e", None), ("b", 1, "e", None), ("b", 2, "f", "1"), ("c", 3, "g", "1"), ("c", 4, "g", "1")], "key string, size long, etag string, last_modified string")
    scan.merge_batch(store, lambda df: df.select("key", F.sha2("key", 256).alias("sha256")))(batch, 0)
    assert sorted((r.key, r.size, r.etag) for r in store.read().collect()) == [("a", 7, "e"), ("b", 2, "f"), ("c", 4, "g")]


def walked(edges):
    """Survivors of edges between places, one vertex at a time."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    gone, wins = set(), set()
    for v in sorted(near):
        if v not in gone:
            wins.add(v)
            gone |= near[v]
    return wins


def graphs():
    rng = random.Random(8)
    yield "random", {tuple(sorted(rng.sample(range(400), 2))) for _ in range(600)}, 60
    yield "hubs and rungs", {(rng.randrange(3), 3 + i) for i in range(300)} | {(i, i + 7) for i in range(3, 290, 3)}, 80
    yield "dense", {tuple(sorted(rng.sample(range(40), 2))) for _ in range(500)}, 100
    yield "chain", {(i, i + 1) for i in range(300)}, 100


@pytest.mark.parametrize(("edges", "task_edges"), [g[1:] for g in graphs()], ids=[g[0] for g in graphs()])
def test_survivors_in_blocks_equal_the_walk(spark, edges, task_edges):
    df = spark.createDataFrame(sorted(edges), "a long, b long").repartition(3)
    assert {r.v for r in orient.survivors(df, task_edges).collect()} == walked(edges)


def test_a_chain_of_100_000_settles_in_few_rounds(spark, monkeypatch):
    rounds, real = [], orient._block_winners
    monkeypatch.setattr(orient, "_block_winners", lambda *a: rounds.append(1) or real(*a))
    chain = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    wins = orient.survivors(chain)
    assert wins.count() == wins.filter("v % 2 = 0").count() == 50_001 and len(rounds) < 40


def test_components_by_contraction(spark):
    from tessera.operators.components import components

    rng = random.Random(2)
    edges = [(rng.randrange(500), rng.randrange(500)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long"), 40).collect()}
    assert got == {x: root(x) for x in parent}


@pytest.mark.parametrize("task_edges", [50, 250_000])
def test_survivors_are_kept_up_to_date(spark, task_edges):
    from tessera.operators.stages import Survivors

    rng = random.Random(task_edges)
    state, known = Survivors(task_edges), set()
    # many small groups, so that few vertices lie below new edges
    batches = [{tuple(sorted((10 * g + rng.randrange(10), 10 * g + rng.randrange(10)))) for g in range(60) for _ in range(6)}] + [
        {tuple(sorted((rng.randrange(600), rng.randrange(600)))) for _ in range(k)} for k in (3, 0, 12)
    ]
    for k, batch in enumerate(batches):
        new = {(a, b) for a, b in batch if a != b} - known
        known |= new
        sent = new | set(rng.sample(sorted(known), min(5, len(known))))
        wins = state.add(spark.createDataFrame(sorted(sent), "a long, b long"))
        assert {r.v for r in wins.collect()} == walked(known)
        again = {r.v for r in state.again.collect()}
        reached, open_ = set(), {b for _, b in new}
        while open_:
            reached |= open_
            open_ = {b for a, b in known if a in open_} - reached
        if k:
            assert reached <= again and len(again) < 0.5 * len({v for e in known for v in e})
        assert k == 0 or bool(again) == bool(new)
