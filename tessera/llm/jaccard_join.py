"""Exact near-duplicate classes of documents: a metric-space join under the Jaccard distance of word shingles.

The Jaccard distance is a metric, so a pivot p prunes a pair (x, y) whenever |d(x,p) - d(y,p)| > r.
Unrelated texts all lie at distance 1 from each other, so pivots drawn at random would put nearly
every document into every window. Pivots are therefore elected where documents can meet at all:

1. Documents with equal sets fall into one class (distance 0); only classes go on.
2. Regions: a set joins the region of each shingle among its rarest ``n - ceil(t n) + 1``; two sets within
   the radius share such a shingle, so each close pair meets in some region. The rank of shingles is fitted
   on a bounded sample (``ORDER_ROWS``); any one order gives the same result, a good one small regions.
3. Each region elects a pivot, its least member. Members are verified against their pivots exactly; those
   within the radius form the pivot's ball and are one component, whatever their number.
4. Boundary: where a region holds members of more than one component, it is joined recursively: a new pivot is
   held against those of other components that a triangle-inequality window leaves - sizes, and the sets' counts in
   hash classes, which are distances to fixed pivot sets - and leaves the region, until one component remains.
   A round sends on pairs in proportion to the region's members and verifies them; links merge components.
5. Components of all verified links give the classes.

Pairs inside a group are never all made: balls link to their pivot, hot groups of equal copies collapse
first, components run over an edge table. Sets are re-made from the texts where they are verified, since texts are smaller than sets of
hashes. A pair is sent on by one of the regions that its documents share (``SHARED``). What one task holds together are a region's ids, sizes and
counts, in the window over a shingle and in the rounds of pivots.

Defined cases: null or empty texts have an empty set and their own component; fewer than five words
make one shingle; repeated rows fall into one class; a row without an id takes its class' component and gives none; extra columns are ignored; an empty table gives none.
Hashes of shingles have 64 bits; a set is known by 64 bits of its digest and its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.common import blocks, sampled, sized_semi_join, staged
from tessera.llm.components import connected_components, extended

#: Documents that the order of shingles is fitted on (expected number), and most shingles it ranks.
ORDER_ROWS, ORDER_SHINGLES = 8192, 400_000
#: Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Pairs that a region sends on in a round: so many for each member.
ROUND_PAIRS = 16
#: Partners of each member that a round tries first.
NEAREST, NEAREST_ROUNDS = 3, 2
#: In those rounds a region with more members is dealt into parts.
PART_MEMBERS = 2048
#: Open regions of a document by which it is decided where a pair is sent on.
SHARED = 16
#: Digests of sets that a task remembers, so as not to send equal ones again.
_SEEN = 1_000_000


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _fit_order(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least two documents of the sample hold, sorted, and their counts there."""
    n = docs.count()
    sample = sampled(docs, n, ORDER_ROWS, "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([_long(kernels.shingles(texts, size)[0])], names=["token"])

    counted = sample.select("text").mapInArrow(each, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = counted.orderBy(F.desc("n"), "token").limit(ORDER_SHINGLES).collect()
    tokens = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r[1] for r in rows], np.int64)[order]


def _need(n: np.ndarray | int):
    """Least intersection of a set of n with any set it links to."""
    return (PERCENT * n + 99) // 100


def _linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def _classes(n: int) -> int:
    """How many hash classes a set of n is counted in: about a shingle or two for each."""
    return 1 << max(6, int(n).bit_length() - 1)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, sig, counts: the size of each document's set, 64 bits of its digest, and its shingles' numbers in hash classes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            h, at = kernels.shingles(texts, size)
            n = np.diff(at)
            sig, counts = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                sig.append(xxhash.xxh3_64_intdigest(h[a:b].tobytes()))
                k = _classes(b - a)
                counts.append(np.minimum(np.bincount((h[a:b] & np.uint64(k - 1)).astype(np.int64), minlength=k), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), _long(np.array(sig, np.uint64)), pa.array(counts, pa.binary())], names=["doc_id", "n", "sig", "counts"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, n long, sig long, counts binary")


def _folded(counts: np.ndarray, k: int) -> np.ndarray:
    """Counts in k classes of counts (..., a multiple of k) in more; a class filled to 255 stays so."""
    while counts.shape[-1] > k:
        half = counts.shape[-1] // 2
        low, high = counts[..., :half].astype(np.uint16), counts[..., half:]
        counts = np.minimum(low + high, 255).astype(np.uint8)
    return counts


def _may_link(na, ca: np.ndarray, nb, cb: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and class counts may link: their least symmetric difference, summed over the classes, allows it.

    Each class is a pivot set, and |x & class| is the coordinate that its distance gives; a class filled to 255 tells nothing.
    """
    k = min(ca.shape[-1], cb.shape[-1])
    ca, cb = _folded(ca, k), _folded(cb, k)
    common = np.minimum(ca, cb).sum(axis=-1, dtype=np.int64)
    unknown = (np.maximum(ca, cb) == 255).any(axis=-1)
    return (100 * common >= PERCENT * (na + nb - common)) | unknown


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs (pivot, doc_id) of which the class counts (pn, pcounts, n, counts) allow a link."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("pn", "pcounts", "n", "counts")))
            keep = [bool(_may_link(na, np.frombuffer(a, np.uint8), nb, np.frombuffer(b, np.uint8))) for na, a, nb, b in rows]
            yield batch.select(["pivot", "doc_id"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(each, "pivot long, doc_id long")


class _Members:
    """Sizes and class counts of a region's members; those of as many classes lie in one array."""

    def __init__(self, n: np.ndarray, counts: list[bytes]):
        self.n = n
        classes = np.array([len(c) for c in counts])
        self.parts = {int(k): np.flatnonzero(classes == k) for k in np.unique(classes)}
        self.arrays = {k: np.frombuffer(b"".join(counts[i] for i in at), np.uint8).reshape(-1, k) for k, at in self.parts.items()}
        self.row = np.zeros(len(n), np.int64)
        for at in self.parts.values():
            self.row[at] = np.arange(len(at))
        self.classes = classes

    def near(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of other members those that may link with i, and the difference of their counts relative to the sizes."""
        own = self.arrays[int(self.classes[i])][self.row[i]]
        found, apart = [], []
        for k in self.parts:
            part = others[self.classes[others] == k]
            if len(part):
                counts = self.arrays[k][self.row[part]]
                least = min(k, len(own))
                counts, mine = _folded(counts, least), _folded(own, least)
                keep = _may_link(self.n[i], mine[None, :], self.n[part], counts)
                found.append(part[keep])
                apart.append(np.abs(counts[keep].astype(np.int16) - mine.astype(np.int16)).sum(axis=1, dtype=np.int64) / (self.n[i] + self.n[part[keep]]))
        if not found:
            return others[:0], np.zeros(0)
        return np.concatenate(found), np.concatenate(apart)


def _tokens(docs: DataFrame, size: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, sig, n: a row for each of the rarest shingles of a set; a task makes those of equal sets once."""
    known, counts = order

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in blocks(batches):
            h, at = kernels.shingles(texts, size)
            n = np.diff(at)
            rank = np.zeros(len(h), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[place] == h, counts[place], 0)
            sigs, want = np.zeros(len(n), np.uint64), np.zeros(len(n), np.int64)
            for i in range(len(n)):
                if n[i]:
                    sigs[i] = sig = xxhash.xxh3_64_intdigest(h[at[i] : at[i + 1]].tobytes())
                    if sig not in seen:
                        if len(seen) < _SEEN:
                            seen.add(sig)
                        want[i] = n[i] - _need(int(n[i])) + 1
            owner = np.repeat(np.arange(len(n)), n)
            by = np.lexsort((h, rank, owner))
            take = by[np.arange(len(h)) - at[:-1][owner] < want[owner]]
            owner = owner[take]
            yield pa.RecordBatch.from_arrays([_long(h[take]), _long(sigs[owner]), pa.array(n[owner])], names=["token", "sig", "n"])

    return docs.select("text").mapInArrow(each, "token long, sig long, n long")


class _Sets:
    """Sets of one group: hashes end to end, and the bounds of each."""

    def __init__(self, texts: list[bytes], size: int):
        parts = [kernels.shingles(texts[i : i + 256], size) for i in range(0, len(texts), 256)]
        self.hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.n = np.concatenate([np.diff(at) for _, at in parts]) if parts else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])

    def one(self, i: int) -> np.ndarray:
        return self.hashes[self.at[i] : self.at[i + 1]]

    def common(self, pivot: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pivot's (sorted) set with the members' sets."""
        where = np.concatenate([np.arange(self.at[i], self.at[i + 1]) for i in members])
        h = self.hashes[where]
        place = np.minimum(np.searchsorted(pivot, h), len(pivot) - 1)
        hits = np.concatenate([[0], np.cumsum(pivot[place] == h)])
        ends = np.cumsum(self.n[members])
        return hits[ends] - hits[ends - self.n[members]]


def _verified(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Of pairs (pivot, doc_id) the links (a, b): texts are joined to either end, only those that are asked for if they are few.

    Both joins are merge joins between plain shuffles, at every size, so that a pivot with very many pairs is split at run time.
    """
    ids = pairs.select(F.explode(F.array("pivot", "doc_id")).alias("doc_id")).distinct()
    texts = sized_semi_join(docs.select("doc_id", "text"), ids)
    both = pairs.hint("merge").join(texts, "doc_id").hint("merge").join(texts.select(F.col("doc_id").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, np.zeros(0, np.uint64)
        for part, texts in blocks(batches):
            sets = _Sets(texts, size)
            at = part.schema.get_field_index("pivot")
            pivots = part.column(at).to_numpy()
            keep = np.zeros(len(pivots), bool)
            cuts = np.append(np.flatnonzero(np.append(True, pivots[1:] != pivots[:-1])), len(pivots))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if pivots[a] != last:
                    last, pivot = pivots[a], kernels.shingles([(part.column("pivot_text")[int(a)].as_py() or "").encode("utf-8", "surrogatepass")], size)[0]
                members = np.arange(a, b)
                common = sets.common(pivot, members)
                keep[a:b] = 100 * common >= PERCENT * (len(pivot) + sets.n[members] - common)
            yield pa.RecordBatch.from_arrays([part.column(at).filter(pa.array(keep)), part.column("doc_id").filter(pa.array(keep))], names=["a", "b"])

    return staged(both.select("pivot", "doc_id", "text", "pivot_text").mapInArrow(each, "a long, b long"), "jaccard-links")


def region_pairs(component: np.ndarray, members: _Members, most: int, nearest: bool = False) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of a region's members that must be verified, about ``most`` at most, and the members that are done with.

    ``nearest``: each member's likeliest partners of other components, as one link joins two components for good. If these
    are few, and in other rounds, pivots: one of the smallest component is held against all members of other components; the
    triangle inequality over the class counts leaves few. It then leaves the region, and so on until one component remains.
    """
    n, everyone = members.n, np.arange(len(component))

    def partners(i: int, among: np.ndarray) -> np.ndarray:
        among = among[component[among] != component[i]]
        return among[100 * np.minimum(n[among], n[i]) >= PERCENT * np.maximum(n[among], n[i])]

    pairs: dict[tuple[int, int], None] = {}
    for i in range(len(component) if nearest else 0):
        near, apart = members.near(i, partners(i, everyone))
        for j in near[np.argsort(apart, kind="stable")[:NEAREST]].tolist():
            pairs[min(i, j), max(i, j)] = None
    if len(pairs) > len(component):
        return list(pairs), []  # once these are verified, components will be few
    pairs.clear()
    active, done = everyone, []
    while len(active) and len(pairs) < most:
        own = np.unique(component[active], return_inverse=True)[1]
        sizes = np.bincount(own)
        if len(sizes) == 1:
            done += active.tolist()
            break
        at = int(np.argmin(sizes[own]))
        pivot, active = int(active[at]), np.delete(active, at)
        pairs.update(((pivot, int(i)), None) for i in members.near(pivot, partners(pivot, active))[0])
        done.append(pivot)
    return list(pairs), done


def _regions(groups: DataFrame, nearest: bool) -> DataFrame:
    """region, a, b: a pair to verify, or (b null) a member that is done with, of each region (bucket, region, token, doc_id, component, n, counts, shared).

    Near copies share most of their regions. Where both of a pair name some among their first ones (``shared``), the least of these sends the pair on.
    """

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by([("region", "ascending"), ("doc_id", "ascending")])
        region, ids, component, n, token = (table.column(k).to_numpy() for k in ("region", "doc_id", "component", "n", "token"))
        shared = table.column("shared").to_pylist()
        counts = table.column("counts").to_pylist()
        cuts = np.append(np.flatnonzero(np.append(True, region[1:] != region[:-1])), len(region))
        out: list[tuple[int, int, int | None]] = []
        for x, y in zip(cuts[:-1], cuts[1:]):
            pairs, done = region_pairs(component[x:y], _Members(n[x:y], counts[x:y]), ROUND_PAIRS * int(y - x), nearest)
            named = [set(s) for s in shared[x:y]]
            out += [(region[x], ids[x + i], ids[x + j]) for i, j in pairs if min(named[i] & named[j], default=token[x]) == token[x]]
            out += [(region[x], ids[x + i], None) for i in done]
        return pa.table({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(("region", "a", "b"))})

    return groups.groupBy("bucket").applyInArrow(each, "region long, a long, b long")


def jaccard_classes(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(_signed(docs, size), "jaccard-sets")
    classes = signed.filter("n > 0 and doc_id is not null").groupBy("sig", "n").agg(F.min(F.struct("doc_id", "counts")).alias("c")).select("sig", "n", F.col("c.doc_id").alias("rep"), "c.counts")
    classes = staged(classes, "jaccard-classes")
    region = Window.partitionBy("token")
    least, most = F.min(F.struct("sig", "n")).over(region), F.max(F.struct("sig", "n")).over(region)
    met = _tokens(docs, size, _fit_order(docs, size)).withColumn("members", F.count(F.lit(1)).over(region)).withColumn("pivot", least).withColumn("last", most)
    met = staged(met.filter("pivot < last").drop("last"), "jaccard-regions")
    near = "(100 * least(n, pivot.n) >= {0} * greatest(n, pivot.n))".format(PERCENT)
    pairs = met.filter(f"not (sig = pivot.sig and n = pivot.n) and {near}").select("sig", "n", F.col("pivot.sig").alias("psig"), F.col("pivot.n").alias("pn")).distinct()
    pairs = pairs.join(classes.withColumnRenamed("rep", "doc_id"), ["sig", "n"]).join(classes.select(F.col("sig").alias("psig"), F.col("n").alias("pn"), F.col("rep").alias("pivot"), F.col("counts").alias("pcounts")), ["psig", "pn"])
    verified = staged(_possible(pairs.select("pivot", "pn", "pcounts", "doc_id", "n", "counts")), "jaccard-pairs")
    found = staged(connected_components(_verified(verified, docs, size)), "jaccard-components")
    # regions with members, beside their pivot, of several components; equal regions are joined once
    members = met.filter("members > 2 and not (sig = pivot.sig and n = pivot.n)").select("token", "sig", "n").distinct()
    members = members.join(classes.select("sig", "n", F.col("rep").alias("doc_id")), ["sig", "n"]).join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("token", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    open_ = members.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("h")).filter("x < y")
    open_ = open_.groupBy("k", "h").agg(F.min("token").alias("token")).select("token")
    left = staged(members.join(open_, "token").select(F.col("token").alias("region"), "doc_id"), "jaccard-boundaries")
    shared = left.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list("region")), 1, SHARED).alias("shared"))
    shared = staged(shared.join(classes.select(F.col("rep").alias("doc_id"), "n", "counts"), "doc_id"), "jaccard-members")
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = 0
    while not left.isEmpty():
        here = left.withColumn("token", F.col("region"))
        if turn < NEAREST_ROUNDS and left.groupBy("region").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > PART_MEMBERS).count():
            # parts of a large region, dealt anew each round, so that no task compares all of its members with each other
            parts = left.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_MEMBERS)).alias("parts"))
            here = left.join(parts, "region").select(F.xxhash64("region", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.col("parts"))).alias("region"), F.col("region").alias("token"), "doc_id")
        now = here.join(shared, "doc_id").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        bucketed = now.withColumn("bucket", F.pmod(F.xxhash64("region"), F.lit(buckets)).cast("int"))
        sent = staged(_regions(bucketed, turn < NEAREST_ROUNDS), "jaccard-round")
        turn += 1
        pairs = sent.filter("b is not null").select(F.least("a", "b").alias("pivot"), F.greatest("a", "b").alias("doc_id")).distinct()
        pairs = staged(pairs.join(verified, ["pivot", "doc_id"], "left_anti").join(verified.select(F.col("pivot").alias("doc_id"), F.col("doc_id").alias("pivot")), ["pivot", "doc_id"], "left_anti"), "jaccard-pairs")
        verified = verified.union(pairs)
        links = _verified(pairs, docs, size)
        if not links.isEmpty():
            found = extended(found, links)
        left = staged(left.join(sent.filter("b is null").select("region", F.col("a").alias("doc_id")), ["region", "doc_id"], "left_anti"), "jaccard-boundaries")
    whole = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("sig", "n", F.coalesce("component", "rep").alias("component_id"))
    return signed.drop("counts").join(whole, ["sig", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
