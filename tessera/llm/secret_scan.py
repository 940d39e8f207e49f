"""Secret scans: patterns find candidates, their ownership over the whole corpus tells examples from live keys.

Every candidate's value is hashed; hashes are counted by distinct repositories and distinct
owners. A value that many owners or repositories hold is an example that was copied around; one that few
hold looks live. Base patterns always report; values that look like a provider's key, a password within an address or, where
no other candidate overlaps, a random token are reported only where their ownership says live.

All of it is DataFrame functions. Offsets of matches come from the lengths of what lies between
them, summed in a window over a text's matches. One pass over the texts writes the few candidates to the shared folder; only those are
shuffled, counts are pre-aggregated by (value, owner, repository), and the join back is salted, so a key
copied into a third of all documents stays spread over tasks.

Defined cases: null or empty texts have no spans, an empty table no rows; a null owner, repository or id counts as one more of its
kind; repeated rows are reported one by one and count once as a repository; of kinds that tie at a place the one listed first comes first;
a very long text is read whole, its work grows with its length and its matches; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged, text_or_empty

#: A value with more owners, or in more repositories, than this counts as copied around.
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 20
SALTS = 32
#: A random token has this many different characters, digits and letters at least.
VARIETY, DIGITS, LETTERS = 10, 3, 3

# Kind, pattern, group of the value, least length of the value (0: the pattern has it).
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", r"[0-9a-f]{24,}", 0, 0),
]
ADDED = [
    ("provider", r"(?:gh[opsu]_|glpat-|sk_live_|xox[abp]-|AIza|eyJ)[A-Za-z0-9_.-]{16,}", 0, 0),
    ("address", r"://[^\x20\x09-\x0D:/@]{1,64}:([^\x20\x09-\x0D:/@]{6,64})@", 1, 0),
    ("token", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 0, 0),
]
KINDS = [k for k, *_ in BASE + ADDED]
TOKEN = KINDS.index("token")


def _random(value: Column) -> Column:
    """Whether a value looks drawn at random: digits and letters mixed, of many different characters."""
    left = lambda pattern: F.char_length(F.regexp_replace(value, pattern, ""))
    return (left("[^0-9]") >= DIGITS) & (left("[^A-Za-z]") >= LETTERS) & (F.size(F.array_distinct(F.split(value, ""))) >= VARIETY)


def _cut(k: int, pattern: str, group: int, least: int) -> Column:
    """Array of (kind, gap before, size, value's hash) of a kind's matches, in order; the hash is null for matches that are no candidates, the size after the last."""
    p = F.lit(pattern)
    gaps = F.transform(F.split("text", pattern, -1), F.char_length)
    sized = F.zip_with(gaps, F.regexp_extract_all("text", p, F.lit(0)), lambda g, m: F.struct(g.alias("gap"), F.char_length(m).alias("size")))
    holds = (lambda v: _random(v)) if k == TOKEN else (lambda v: F.char_length(v) >= least)
    cut = lambda x, v: F.struct(F.lit(k).alias("kind"), x["gap"].alias("gap"), x["size"].alias("size"), F.when(holds(v), F.sha2(v, 256)).alias("value"))
    found = F.zip_with(sized, F.regexp_extract_all("text", p, F.lit(group)), cut)
    return F.when(F.col("text").rlike(pattern), found).otherwise(F.array().cast("array<struct<kind: int, gap: int, size: int, value: string>>"))


def _named(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def _candidates(found: DataFrame) -> DataFrame:
    """row, owner, repository, kind, start, end, value: code points, end exclusive; tokens that overlap a candidate of another kind are no candidates."""
    cuts = found.select("row", "owner", "repository", F.posexplode("cuts").alias("place", "c")).select("row", "owner", "repository", "place", "c.*").filter("size is not null").repartition("row")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("place"))
    spans = cuts.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).filter("value is not null")
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    sure = F.col("kind") != TOKEN
    before = F.max(F.when(sure, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(sure, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return spans.withColumn("free", sure | free).filter("free").select("row", "owner", "repository", "kind", "start", "end", "value")


def secret_scan(
    docs: DataFrame, owner_col: str = "source", repository_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text",
    live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES,
) -> DataFrame:
    """One row per document: counts and digest of base spans, ``spans`` with the added ones, ``n_live`` and ``n_copied``."""
    cuts = F.concat(*[_cut(k, p, g, least) for k, (_, p, g, least) in enumerate(BASE + ADDED)])
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repository_col).cast("string").alias("repository"), text_or_empty(text_col).alias("text"))
    found = staged(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", cuts.alias("cuts")), "secret-candidates")
    some = found.filter(F.size("cuts") > 0)
    each = staged(_candidates(some), "secret-spans")
    owned = (
        each.select("value", "owner", "repository").distinct()
        .groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("value").agg(F.sum("repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    )
    live = (F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories)
    spread = owned.select("value", live.alias("live"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    base, span = F.col("kind") < len(BASE), F.struct("start", "kind", "end")
    judged = (
        each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        .join(spread, ["value", "salt"])
        .groupBy("row")
        .agg(
            *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)],
            F.collect_list(F.when(base, span)).alias("base"),
            F.collect_list(F.when(base | F.col("live"), span)).alias("all"),
            F.count_if("live").alias("n_live"),
            F.count_if(~F.col("live")).alias("n_copied"),
        )
    )
    counts, zero = [f"n_{name}" for name, *_ in BASE], F.lit(0).cast("long")
    with_spans = some.select("row", "doc_id").join(judged, "row", "left").select(
        "doc_id", *[F.coalesce(n, zero).alias(n) for n in counts], F.sha2(F.coalesce(_named(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_named(F.col("all")), F.lit("")).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"),
    )
    without = found.filter(F.size("cuts") == 0).select("doc_id", *[zero.alias(n) for n in counts], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_live"), zero.alias("n_copied"))
    return with_spans.union(without)
