"""Hard negatives of embeddings: Hilbert-ordered blocks with zone maps, read only where interval bounds say so.

Rows are ordered by label and by their place on a Hilbert curve through the vectors' space, and written as Parquet blocks of up to ``BLOCK_ROWS``
rows; a block's zone map is the least and the greatest value of each dimension and of the label. Anchors come in chunks that are
ordered the same way. For an anchor and a zone, interval arithmetic bounds the inner product from both sides; a block is read for a
chunk only if, for a window of one of its anchors, it can hold a score inside the window that is not below the k-th best known.
The first known ones come from the block of the greatest upper bound of each anchor. Zone maps are read without the
blocks' other columns. A search for positives (one window without limits, equal labels) sets the windows of the search for
negatives (one for each positive, other labels), which is the same code.

Anchors are a stated query set (ids divisible by ``every``) that meets zones and blocks in cells of bounded size. Nothing is
broadcast; the driver gets each dimension's mean and spread, and counts.

Defined cases: rows without an id, a label or a vector, or with a null or non-finite component, take no part; vectors of fewer
components than the longest count as filled up with zeros; components are cut to 27 bits after scaling, so that
no inner product of up to 512 of them leaves a long; no row of the anchor's own id is its positive; repeated rows are
rows each; an anchor without positives gives no rows; an empty table gives no rows; columns besides id, vector and label are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged

SCALE, LARGEST = 256, (1 << 26) - 1
EVERY, FLIP_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES, FLOOR, CEILING = 5, 10, 30, 90
#: Rows of a block, anchors of a chunk, zones of a group; groups and chunks of a cell and blocks of a read.
BLOCK_ROWS, CHUNK, ZONES, CELL, READ = 256, 256, 128, 16, 64
#: A block may end at a change of label once it has so many rows.
LABEL_ROWS = 64
#: Bits of a component on the curve, and standard deviations of a step.
CURVE_BITS, STEP = 3, 0.5
#: Hits that a task holds before it keeps only the best of each window.
HITS = 1 << 18
ANY = np.int64(1) << np.int64(62)


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, v: integer components; labels of some ids are moved on by one, as the query set has it."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    whole = F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & whole)
    moved = F.when(F.col("vec_id") % FLIP_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    cut = F.transform("x", lambda c: F.greatest(F.lit(-LARGEST - 1.0), F.least(F.lit(float(LARGEST)), c * SCALE)))
    return rows.select("vec_id", moved.alias("label"), F.transform(cut, lambda c: F.floor(c).cast("int")).alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows x dimensions, ``bits`` each) as rows of bytes in order.

    After Skilling, Programming the Hilbert curve (2004): the axes are unfolded from the top bit down, then Gray-decoded, and their bits interleaved.
    """
    axes = cells.astype(np.uint32).T.copy()
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for axis in axes:
            flip = (axis >> np.uint32(level)) & np.uint32(1) == 1
            swap = np.where(flip, 0, (axes[0] ^ axis) & low).astype(np.uint32)
            axes[0] ^= np.where(flip, low, swap)
            axis ^= swap
    for d in range(1, len(axes)):
        axes[d] ^= axes[d - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> np.uint32(level)) & np.uint32(1) == 1, np.uint32((1 << level) - 1), np.uint32(0))
    axes ^= turn
    woven = np.stack([(axes >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)])  # levels x dimensions x rows
    return np.packbits(woven.reshape(-1, axes.shape[1]).T.astype(np.uint8), axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to ``width``."""
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width), np.int32)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def keyed(rows: DataFrame) -> tuple[DataFrame, int]:
    """label, key, vec_id, v (binary, 32 bits a component) of quantised rows, and the number of dimensions."""
    spread = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).orderBy("d").collect()
    width = max(1, len(spread))
    mean, step = np.zeros(width), np.ones(width)
    for r in spread:
        mean[r.d], step[r.d] = r["mean"], max(STEP * r.sd, 1e-9)
    top = (1 << CURVE_BITS) - 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), width)
            cells = np.clip(np.floor((v - mean) / step) + (top + 1) // 2, 0, top)
            keys = [k.tobytes() for k in hilbert_keys(cells, CURVE_BITS)] if len(v) else []
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(keys, pa.binary()), batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["label", "key", "vec_id", "v"])

    return staged(rows.select("vec_id", "label", "v").mapInArrow(placed, "label long, key binary, vec_id long, v binary"), "hilbert-rows"), width


def _runs(batches: Iterator[pa.RecordBatch], most: int, at_label: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Labels, ids and vectors of consecutive runs of up to ``most`` rows; a run of ``at_label`` rows ends where the label changes."""
    labels, ids, vectors = [], [], []
    for batch in batches:
        for label, id_, v in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if len(labels) >= most or len(labels) >= at_label and labels[-1] != label:
                yield np.array(labels), np.array(ids), b"".join(vectors)
                labels, ids, vectors = [], [], []
            labels.append(label)
            ids.append(id_)
            vectors.append(v)
    if labels:
        yield np.array(labels), np.array(ids), b"".join(vectors)


def _numbered() -> Iterator[int]:
    own = TaskContext.get().partitionId() << 32
    return iter(range(own, own + (1 << 32)))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


BLOCK = "block long, label_lo long, label_hi long, lo binary, hi binary, ids binary, labels binary, vectors binary"
ANCHORS = "chunk long, ids binary, labels binary, vectors binary, lo binary, hi binary, least binary"
ZONE_GROUP = "group long, blocks binary, label_lo binary, label_hi binary, lo binary, hi binary"
HIT = "chunk long, anchor int, anchor_id long, window int, score long, id long"


def blocks_of(rows: DataFrame, width: int) -> DataFrame:
    """Parquet blocks of keyed rows in curve order, one row each, with their zone maps."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbered()
        for labels, ids, data in _runs(batches, BLOCK_ROWS, LABEL_ROWS):
            v = np.frombuffer(data, np.int32).reshape(-1, width)
            yield _rows([(next(number), labels.min(), labels.max(), v.min(axis=0).tobytes(), v.max(axis=0).tobytes(), ids.tobytes(), labels.tobytes(), data)], _schema(BLOCK))

    ordered = rows.repartitionByRange("label", "key", "vec_id").sortWithinPartitions("label", "key", "vec_id")
    return staged(ordered.mapInArrow(packed, BLOCK), "hilbert-blocks")


def zone_groups(blocks: DataFrame, width: int) -> DataFrame:
    """Zone maps only, up to ``ZONES`` to a row."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = _numbered(), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == ZONES:
                    yield _rows([_group(next(number), held)], _schema(ZONE_GROUP))
                    held = []
        if held:
            yield _rows([_group(next(number), held)], _schema(ZONE_GROUP))

    def _group(number: int, zones: list[tuple]) -> tuple:
        block, label_lo, label_hi, lo, hi = zip(*zones, strict=True)
        return number, np.array(block).tobytes(), np.array(label_lo).tobytes(), np.array(label_hi).tobytes(), b"".join(lo), b"".join(hi)

    return staged(blocks.select("block", "label_lo", "label_hi", "lo", "hi").mapInArrow(packed, ZONE_GROUP), "hilbert-zones")


def anchor_chunks(rows: DataFrame, every: int) -> DataFrame:
    """Anchors in curve order, up to ``CHUNK`` to a row, with one window that takes every score."""
    own = rows.filter(F.col("vec_id") % every == 0)
    parts = max(1, -(-own.count() // CHUNK))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbered()
        for labels, ids, data in _runs(batches, CHUNK, CHUNK):
            ends = [np.full((len(ids), 1), x, np.int64).tobytes() for x in (-ANY, ANY, -ANY)]
            yield _rows([(next(number), ids.tobytes(), labels.tobytes(), data, *ends)], _schema(ANCHORS))

    ordered = own.repartitionByRange(parts, "label", "key", "vec_id").sortWithinPartitions("label", "key", "vec_id")
    return staged(ordered.mapInArrow(packed, ANCHORS), "hilbert-anchors")


class Chunk:
    """A row of ``ANCHORS`` as arrays."""

    def __init__(self, row: dict, width: int):
        longs = lambda k: np.frombuffer(row[k], np.int64)
        self.number, self.ids, self.labels = row["chunk"], longs("ids"), longs("labels")
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(-1, width)
        self.lo, self.hi, self.least = (longs(k).reshape(len(self.ids), -1) for k in ("lo", "hi", "least"))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; by floats while these hold every sum exactly."""
    most = float(np.abs(left.astype(np.int64)).max(initial=0)) * float(np.abs(right.astype(np.int64)).max(initial=0)) * left.shape[1]
    kind = np.float64 if most < 2**53 else np.int64
    return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)


def bounds(vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product (vectors x zones) of a vector and any point of the zone's box."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def _useful(chunk: Chunk, group: dict, width: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which zones an anchor's windows need (anchors x zones), and the upper bounds."""
    longs = lambda k: np.frombuffer(group[k], np.int64)
    lo, hi = (np.frombuffer(group[k], np.int32).reshape(-1, width) for k in ("lo", "hi"))
    least, most = bounds(chunk.vectors, lo, hi)
    a, b, own = longs("label_lo")[None, :], longs("label_hi")[None, :], chunk.labels[:, None]
    fits = (a <= own) & (own <= b) if same else (a != b) | (a != own)
    inside = np.zeros_like(fits)
    for w in range(chunk.lo.shape[1]):
        inside |= (most >= chunk.least[:, w, None]) & (least <= chunk.hi[:, w, None]) & (chunk.lo <= chunk.hi)[:, w, None]
    return fits & inside, most


def chosen_blocks(chunks: DataFrame, zones: DataFrame, width: int, same: bool, seeds: bool) -> DataFrame:
    """chunk, block: blocks that a chunk must read, or each anchor's most promising one (``seeds``)."""
    lanes, stripes = (max(1, -(-x.count() // CELL)) for x in (chunks, zones))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, groups = [], right.to_pylist()
        for row in left.to_pylist():
            chunk = Chunk(row, width)
            for group in groups:
                block = np.frombuffer(group["blocks"], np.int64)
                useful, most = _useful(chunk, group, width, same)
                if seeds:
                    best = np.where(useful, most, -ANY).argmax(axis=1)
                    at = np.arange(len(best))
                    rows += [(chunk.number, int(i), int(block[best[i]]), int(most[i, best[i]])) for i in at[useful[at, best]]]
                else:
                    rows += [(chunk.number, 0, int(b), 0) for b in block[useful.any(axis=0)]]
        return pa.Table.from_batches([_rows(rows, _schema(schema))])

    schema = "chunk long, anchor int, block long, most long"
    cell = lambda df, key, own, other, n: df.withColumn(own[0], F.pmod(F.xxhash64(key), F.lit(own[1])).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = cell(chunks, "chunk", ("lane", lanes), "stripe", stripes).groupBy("lane", "stripe")
    right = cell(zones, "group", ("stripe", stripes), "lane", lanes).groupBy("lane", "stripe")
    found = left.cogroup(right).applyInArrow(met, schema)
    if seeds:
        found = found.groupBy("chunk", "anchor").agg(F.max_by("block", "most").alias("block")).select("chunk", "block").distinct()
    return staged(found.select("chunk", "block"), "hilbert-chosen")


class Best:
    """The k best hits of each anchor and window: greatest score, then least id."""

    def __init__(self, chunk: Chunk, k: int):
        self.k, self.least, self.hits, self.held = k, chunk.least.copy(), [], 0

    def add(self, anchor: np.ndarray, window: int, score: np.ndarray, id_: np.ndarray) -> None:
        self.hits.append(np.stack([anchor, np.full(len(anchor), window), score, id_]))
        self.held += len(anchor)
        if self.held >= HITS:
            self.trimmed()

    def trimmed(self) -> np.ndarray:
        rows = np.concatenate(self.hits, axis=1) if self.hits else np.empty((4, 0), np.int64)
        rows = rows[:, np.lexsort((rows[3], -rows[2], rows[1], rows[0]))]
        start = np.concatenate([[True], (np.diff(rows[:2], axis=1) != 0).any(axis=0)])[: rows.shape[1]]
        firsts = np.flatnonzero(start)
        rank = np.arange(rows.shape[1]) - firsts[np.cumsum(start) - 1] if len(firsts) else np.empty(0, np.int64)
        full = rows[:, rank == self.k - 1]
        self.least[full[0], full[1]] = full[2]
        kept = rows[:, rank < self.k]
        self.hits, self.held = [kept], kept.shape[1]
        return kept


def read_blocks(chunks: DataFrame, chosen: DataFrame, blocks: DataFrame, width: int, same: bool, k: int) -> DataFrame:
    """The k best rows of each anchor and window among the chosen blocks, with their ``rank`` from 1."""
    shards = max(1, -(-blocks.count() // READ))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            chunk = Chunk(row, width)
            best = Best(chunk, k)
            for i in range(right.num_rows):
                ids, labels = (np.frombuffer(right[c][i].as_buffer(), np.int64) for c in ("ids", "labels"))
                score = products(chunk.vectors, np.frombuffer(right["vectors"][i].as_buffer(), np.int32).reshape(-1, width))
                equal = chunk.labels[:, None] == labels[None, :]
                fits = equal & (chunk.ids[:, None] != ids[None, :]) if same else ~equal
                for w in range(chunk.lo.shape[1]):
                    a, b = np.nonzero(fits & (score >= best.least[:, w, None]) & (score <= chunk.hi[:, w, None]))
                    best.add(a, w, score[a, b], ids[b])
            found = best.trimmed()
            out.append((chunk.number, chunk.ids, found))
        columns = [np.concatenate([np.full(f.shape[1], n) for n, _, f in out]), *(np.concatenate(x) for x in ([f[0] for *_, f in out], [ids[f[0]] for _, ids, f in out], [f[1] for *_, f in out], [f[2] for *_, f in out], [f[3] for *_, f in out]))] if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _schema(HIT).types, strict=True)], schema=_schema(HIT))

    dealt = chosen.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    left = chunks.join(dealt.select("chunk", "shard").distinct().toDF("chunk", "shard"), "chunk").groupBy("chunk", "shard")
    right = dealt.join(blocks.select("block", "ids", "labels", "vectors"), "block").groupBy("chunk", "shard")
    found = left.cogroup(right).applyInArrow(scored, HIT)
    order = Window.partitionBy("chunk", "anchor", "window").orderBy(F.desc("score"), "id")  # k rows of each shard at most
    return staged(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "hilbert-hits")


def _with_least(chunks: DataFrame, hits: DataFrame, width: int, k: int) -> DataFrame:
    """Chunks that know the k-th best score of windows for which so many were found."""
    known = hits.filter(F.col("rank") == k).select("chunk", "anchor", "window", "score")

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        for row in rows:
            least = Chunk(row, width).least.copy()
            least[right["anchor"].to_numpy(), right["window"].to_numpy()] = np.maximum(least[right["anchor"].to_numpy(), right["window"].to_numpy()], right["score"].to_numpy())
            row["least"] = least.tobytes()
        return pa.Table.from_pylist(rows, schema=_schema(ANCHORS))

    return staged(chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(told, ANCHORS), "hilbert-anchors")


def best_rows(chunks: DataFrame, zones: DataFrame, blocks: DataFrame, width: int, same: bool, k: int) -> DataFrame:
    """The k best rows for each anchor and window, exactly: seeds first, then every block that could still hold one."""
    seeds = read_blocks(chunks, chosen_blocks(chunks, zones, width, same, True), blocks, width, same, k)
    told = _with_least(chunks, seeds, width, k)
    return read_blocks(told, chosen_blocks(told, zones, width, same, False), blocks, width, same, k)


def _windows(chunks: DataFrame, positives: DataFrame, width: int, count: int, floor: int, ceiling: int) -> DataFrame:
    """Chunks with a window of scores for each positive: from ``floor`` to ``ceiling`` hundredths of its score."""

    def set_(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        for row in rows:
            n = len(row["ids"]) // 8
            lo, hi = np.ones((n, count), np.int64), np.zeros((n, count), np.int64)
            at = right["anchor"].to_numpy(), right["rank"].to_numpy() - 1
            score = right["score"].to_numpy()
            lo[at], hi[at] = -(-floor * score // 100), ceiling * score // 100
            row["lo"], row["hi"] = lo.tobytes(), hi.tobytes()
            row["least"] = row["lo"]
        return pa.Table.from_pylist(rows, schema=_schema(ANCHORS))

    return staged(chunks.groupBy("chunk").cogroup(positives.select("chunk", "anchor", "rank", "score").groupBy("chunk")).applyInArrow(set_, ANCHORS), "hilbert-anchors")


def hard_negatives(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, floor: int = FLOOR, ceiling: int = CEILING) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor, positive and negative."""
    rows, width = keyed(quantised(embeddings))
    blocks = blocks_of(rows, width)
    zones, chunks = zone_groups(blocks, width), anchor_chunks(rows, every)
    near = best_rows(chunks, zones, blocks, width, True, positives)
    far = best_rows(_windows(chunks, near, width, positives, floor, ceiling), zones, blocks, width, False, negatives)
    own = near.select("chunk", "anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    met = far.join(own, ["chunk", "anchor", "window"])
    return met.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
