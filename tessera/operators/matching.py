"""Similarity joins of the duplicate scan, best reason of a pair, selection and survivors.

Assets come as DataFrames (key, sha256, phash, pdq_hash, crop array<string>, vpdq array<struct<h,q,t>>, ...);
list order is key order. Hamming self-joins are exact (see ``hamming``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import hashes
from tessera.operators import framesets, hamming
from tessera.operators.components import components
from tessera.sources.tables import staged

#: Distinct hashes up to which a Hamming self-join may compare all pairs, in blocks.
NESTED_LOOP_ROWS = 8_000_000
#: Assets that share a token, from which on it is heavy.
HEAVY = 256


def hamming_pairs(rows: DataFrame, lanes: str, count: int, radius: int, keep: list[str], nested_loop_rows: int = NESTED_LOOP_ROWS) -> DataFrame:
    """Unordered pairs of rows (``key``, ``lanes``, kept columns) within the radius: l_*, r_* and ``distance``."""
    return hamming.hamming_pairs(rows, lanes, count, radius, keep, nested_loop_rows)


def rank() -> Column:
    """Survivor rank: pixels, duration, quality, size, then the unique key."""
    zero = F.lit(0).cast("long")
    return F.struct(
        (F.coalesce(F.col("width").cast("long"), zero) * F.coalesce(F.col("height").cast("long"), zero)).alias("pixels"),
        F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("duration"),
        F.coalesce(F.col("pdq_quality").cast("long"), zero).alias("quality"),
        F.coalesce(F.col("size").cast("long"), zero).alias("size"),
        F.col("key"),
    )


def exact_groups(assets: DataFrame) -> DataFrame:
    """sha256, members, total_size of each digest that several assets share."""
    return assets.filter("sha256 <> ''").groupBy("sha256").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total_size")).filter("members > 1")


def exact_survivors(assets: DataFrame) -> DataFrame:
    """(survivor_key, deletion_key): the member of highest rank survives. The best of a digest is pre-aggregated and joined back."""
    best = assets.filter("sha256 <> ''").groupBy("sha256").agg(F.max(rank()).alias("best"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    joined = assets.select("sha256", "key").join(best.select("sha256", F.col("best.key").alias("survivor_key")), "sha256")
    return joined.filter("key <> survivor_key").select("survivor_key", F.col("key").alias("deletion_key"))


def visual_assets(assets: DataFrame) -> DataFrame:
    """Assets that take part in perceptual matching: no member of an exact group does."""
    return assets.join(exact_groups(assets).select("sha256"), "sha256", "left_anti")


def _stills(assets: DataFrame) -> DataFrame:
    return assets.filter("vpdq is null")


def _listed(assets: DataFrame) -> DataFrame:
    """key, n, pos, segment of every item of the crop lists."""
    return _stills(assets).filter("size(crop) > 0").select("key", F.size("crop").alias("n"), F.posexplode("crop").alias("pos", "segment"))


def _close_segments(listed: DataFrame, cutoff: int) -> DataFrame:
    """a, b: distinct segments within the cutoff, both ways and each with itself; a segment that many assets share is compared once."""
    segments = listed.select(F.col("segment").alias("key")).distinct().withColumn("lanes", hashes.lanes(F.col("key"), hashes.PHASH_LANES))
    close = hamming_pairs(segments, "lanes", hashes.PHASH_LANES, cutoff, []).select(F.col("l_key").alias("a"), F.col("r_key").alias("b"))
    return close.union(close.select("b", "a")).union(segments.select(F.col("key").alias("a"), F.col("key").alias("b")))


def _classes(listed: DataFrame, close: DataFrame) -> DataFrame:
    """segment, class, owners: components of close segments, with the number of list items in each."""
    sides = close.filter("a < b").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))  # hashes that agree by chance only join classes
    labels = components(sides).select(F.col("v").alias("h"), "c")
    counted = listed.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("segment")).join(labels, "h", "left")
    named = counted.select("segment", F.coalesce("c", "h").alias("class"), "n")
    return named.join(named.groupBy("class").agg(F.sum("n").alias("owners")), "class").select("segment", "class", "owners")


def crop_candidates(listed: DataFrame, close: DataFrame, ratio: float) -> DataFrame:
    """(left, right): pairs of lists that may reach the ratio both ways, from the lists' prefixes.

    A list that reaches it has ``required`` items with a close one in the other. Ordered by class, rarest first, the first of these has
    ``required`` - 1 items after it, so it is not among the last ``required`` - 1; and as close items are of one class, the same class is met on
    both sides. A prefix is therefore the list without its last ``required`` - 1 items, but with whole classes, and only prefixes meet.
    """
    required = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(ratio)) - F.lit(1e-9)).cast("int"))
    order = Window.partitionBy("key").orderBy("owners", "class", "pos")
    placed = listed.join(_classes(listed, close), "segment").withColumn("place", F.row_number().over(order)).withColumn("kept", F.col("place") <= F.col("n") - required + 1)
    prefix = placed.withColumn("kept", F.max("kept").over(Window.partitionBy("key", "class"))).filter("kept").select("key", "segment").distinct()
    one = prefix.select(F.col("key").alias("left"), F.col("segment").alias("a"))
    two = prefix.select(F.col("key").alias("right"), F.col("segment").alias("b"))
    return one.join(close, "a").join(two, "b").filter("left < right").select("left", "right").distinct()


def crop_scores(assets: DataFrame, cutoff: int, ratio: float = 0.0) -> DataFrame:
    """(left, right, crop): lists of segments compared both ways, repeated segments counted; pairs with a close segment and of ``ratio`` at least."""
    listed = staged(_listed(assets), "crop-items")
    close = staged(_close_segments(listed, cutoff), "crop-close")
    lists = _stills(assets).filter("size(crop) > 0").select("key", F.transform("crop", hashes.as_long).alias("s"))
    side = lambda n: lists.select(F.col("key").alias(n), F.col("s").alias(n[0]))
    met = crop_candidates(listed, close, ratio).join(side("left"), "left").join(side("right"), "right")
    share = lambda x, y: f"size(filter({x}, p -> exists({y}, q -> bit_count(p ^ q) <= {cutoff}))) / size({x})"
    scored = met.select("left", "right", F.expr(f"100.0D * least({share('l', 'r')}, {share('r', 'l')})").alias("crop"))
    return scored.filter(F.col("crop") / 100 >= F.lit(float(ratio)))


def phash_stage(assets: DataFrame, slider: int) -> DataFrame:
    """(left, right, distance, score, reason): the best of the pHash, PDQ and crop scores of pairs within the pHash radius."""
    limit = hashes.limits(slider)
    rows = _stills(assets).filter("phash <> ''").withColumn("lanes", hashes.lanes(F.col("phash"), 2)).withColumn("wide", F.when(F.col("pdq_hash") != "", hashes.lanes(F.col("pdq_hash"), 8)))
    met = hamming_pairs(rows.withColumn("crop", F.transform("crop", hashes.as_long)), "lanes", 2, limit["phash"], ["wide", "crop"])  # an asset's hex is read once, not for each pair
    share = lambda x, y: f"size(filter({x}, p -> exists({y}, q -> bit_count(p ^ q) <= {float(limit['crop_distance'])}D))) / size({x})"
    both = F.expr(f"if(size(l_crop) > 0 and size(r_crop) > 0, 100.0D * least({share('l_crop', 'r_crop')}, {share('r_crop', 'l_crop')}), 0.0D)")
    scored = met.select(
        F.col("l_key").alias("left"), F.col("r_key").alias("right"), "distance", (100 * (1 - F.col("distance") / 64)).alias("p"),
        F.coalesce(100 * (1 - hashes.hamming("l_wide", "r_wide", 8) / 256), F.lit(0.0)).alias("q"), F.coalesce(both, F.lit(0.0)).alias("c"),
    )
    reason = F.concat(F.lit("visual match: pHash "), hashes.percent(F.col("p")), F.lit(", PDQ "), hashes.percent(F.col("q")), F.lit(", crop "), hashes.percent(F.col("c")))
    return scored.select("left", "right", "distance", F.greatest("p", "q", "c").alias("score"), reason.alias("reason"))


def pdq_stage(assets: DataFrame, slider: int) -> DataFrame:
    limit = hashes.limits(slider)
    rows = _stills(assets).filter("pdq_hash <> ''").withColumn("lanes", hashes.lanes(F.col("pdq_hash"), 8))
    score = 100 * (1 - F.col("distance") / 256)
    met = hamming_pairs(rows, "lanes", 8, limit["pdq"], [])
    return met.select(F.col("l_key").alias("left"), F.col("r_key").alias("right"), "distance", score.alias("score"), F.concat(F.lit("Meta PDQ match: "), hashes.percent(score)).alias("reason"))


def crop_stage(assets: DataFrame, slider: int) -> DataFrame:
    """Pairs whose crop similarity reaches the slider's ratio; these are qualified whatever the minimum score."""
    limit = hashes.limits(slider)
    found = crop_scores(assets, int(limit["crop_distance"]), limit["crop_ratio"])
    required = hashes.percent(F.lit(100 * limit["crop_ratio"]))
    reason = F.concat(F.lit("crop-resistant match: "), hashes.percent(F.col("crop")), F.lit(" segment overlap (required "), required, F.lit(")"))
    return found.select("left", "right", F.col("crop").alias("score"), reason.alias("reason"))


def frames(assets: DataFrame) -> DataFrame:
    """key, sha256, n_frames and each frame's h and q (a missing quality is the default)."""
    rows = assets.filter("vpdq is not null").select("key", "sha256", F.expr("filter(vpdq, f -> f.h <> '')").alias("f"))
    return rows.select("key", "sha256", F.size("f").alias("n_frames"), F.explode("f").alias("f")).select("key", "sha256", "n_frames", "f.h", F.coalesce("f.q", F.lit(hashes.DEFAULT_QUALITY)).alias("q"))


def frame_tokens(assets: DataFrame) -> DataFrame:
    """key, required, token of good frames, each once: 16-bit pieces with their band in front; lossy by design.

    ``required`` is what a pair of assets with so many frames each would have to share; a pair needs the lesser of both.
    """
    good = frames(assets).filter(F.col("q") >= hashes.QUALITY_FLOOR)
    tokens = F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: b * 65536 + F.conv(F.substring(F.col("h"), b * 4 + 1, F.lit(4)), 16, 10).cast("int")))
    required = F.greatest(F.lit(1), F.least(F.lit(8), F.ceil(F.col("n_frames") * F.lit(0.2)).cast("int")))
    return good.select("key", required.alias("required"), tokens.alias("token")).distinct()


def heavy_tokens(tokens: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Tokens of at most ``heavy`` assets, and the others with their ``place`` in each asset's list of them, most frequent first."""
    frequent = staged(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("owners")).filter(F.col("owners") > heavy), "vpdq-heavy")
    order = Window.partitionBy("key").orderBy(F.desc("owners"), "token")
    return tokens.join(frequent.select("token"), "token", "left_anti"), tokens.join(frequent, "token").withColumn("place", F.row_number().over(order))


def vpdq_seeds(light: DataFrame, heavy: DataFrame) -> DataFrame:
    """(left, right, light): pairs that may share enough tokens, with the number of light ones that they share.

    Light tokens meet in an ordinary join. Of heavy ones a pair that needs r shared tokens may ignore each side's r - 1 most frequent: if only those
    were shared there would be too few. A token row is sent to the levels r for which it is not ignored; the side that sets r leads, so
    a token that a third of all assets hold meets nobody unless a single shared token is enough.
    """
    side = lambda rows, s, *more: rows.select("token", *more, *[F.col(c).alias(f"{s}_{c}") for c in ("key", "required")])
    met = side(light, "l").join(side(light, "r"), "token").filter("l_key < r_key")
    counted = met.groupBy(F.col("l_key").alias("left"), F.col("r_key").alias("right")).agg(F.count(F.lit(1)).cast("int").alias("light"))
    leads = side(heavy.filter("place >= required"), "l").withColumn("level", F.col("l_required"))
    follows = side(heavy, "r", "place").withColumn("level", F.explode(F.sequence(F.lit(1), F.least("place", "r_required"))))
    first = "(r_required > l_required or l_key < r_key)"
    paired = leads.join(follows, ["token", "level"]).filter(f"l_key <> r_key and {first}")
    paired = paired.select(F.least("l_key", "r_key").alias("left"), F.greatest("l_key", "r_key").alias("right"), F.lit(0).alias("light"))
    return counted.union(paired.distinct()).groupBy("left", "right").agg(F.max("light").alias("light"))


def vpdq_candidates(assets: DataFrame, block_assets: int = framesets.BLOCK_ASSETS) -> DataFrame:
    """(left, right, shared, required): pairs that share enough 16-bit tokens of good frames, exactly counted."""
    return framesets.candidates(assets, block_assets)


def vpdq_stage(assets: DataFrame, slider: int) -> DataFrame:
    """Candidates whose distinct good frames match both ways in the slider's share."""
    limit = hashes.limits(slider)
    close = framesets.matched(assets, int(limit["vpdq_distance"]), limit["vpdq_match"])
    both = close.select("left", "right", (F.col("ml") / F.col("nl")).alias("pl"), (F.col("mr") / F.col("nr")).alias("pr")).filter(F.least("pl", "pr") >= limit["vpdq_match"])
    reason = F.concat(F.lit("vPDQ frames: "), hashes.percent(100 * F.col("pl")), F.lit(" / "), hashes.percent(100 * F.col("pr")))
    return both.select("left", "right", (100 * F.least("pl", "pr")).alias("score"), reason.alias("reason"))


def exact_stage(assets: DataFrame) -> DataFrame:
    """All unordered pairs of equal digest. Library use only: quadratic in a group by its definition; scans withhold exact groups instead."""
    rows = assets.filter("sha256 <> ''").select("sha256", "key")
    met = rows.withColumnRenamed("key", "left").join(rows.withColumnRenamed("key", "right"), "sha256").filter("left < right")
    return met.select("left", "right", F.lit(100.0).alias("score"), F.lit("exact SHA-256 match").alias("reason"))


STAGES = ("exact", "phash", "pdq", "images", "complete")


def offers(assets: DataFrame, slider: int, include_exact: bool = False) -> DataFrame:
    """Every stage's pairs: stage number, left, right, score, reason."""
    parts = [(1, phash_stage(assets, slider).drop("distance")), (2, pdq_stage(assets, slider).drop("distance")), (3, crop_stage(assets, slider)), (4, vpdq_stage(assets, slider))]
    if include_exact:
        parts.insert(0, (0, exact_stage(assets)))
    out = None
    for number, part in parts:
        part = part.select(F.lit(number).alias("stage"), "left", "right", "score", "reason")
        out = part if out is None else out.unionByName(part)
    return out


def best_offers(offered: DataFrame) -> DataFrame:
    """left, right, score, reason, qualified: a fold in stage order; a later offer wins only above the rounded score kept so far.

    A pair has at most one offer of a stage, so a group is at most five rows.
    """
    folded = F.expr("""aggregate(sort_array(offers), named_struct('score', cast(-1 as double), 'reason', ''),
        (kept, o) -> if(o.score > kept.score, named_struct('score', bround(least(100.0D, o.score), 2), 'reason', o.reason), kept))""")
    grouped = offered.groupBy("left", "right").agg(F.collect_list(F.struct("stage", "score", "reason")).alias("offers"), F.max(F.col("stage") == 3).alias("qualified"))
    return grouped.select("left", "right", folded.alias("kept"), "qualified").select("left", "right", "kept.score", "kept.reason", "qualified")


def selected(best: DataFrame, slider: int) -> DataFrame:
    return best.filter((F.col("score") >= hashes.limits(slider)["minimum"]) | F.col("qualified")).drop("qualified")
