"""Exact substring dedup: bytes that a string of 50 bytes covers which also starts in an earlier document.

A depth-limited radix sort of suffixes, most significant digits first: only their first 50 bytes order them, and
equal groups at that depth are exactly the repeated windows. A shuffle of every suffix would move some
ten times the input, so suffixes are taken at synchronising places: of the 20-byte grams inside a window, the
one of least hash is its anchor, equal windows have it at the same offset, and one in thirteen places is an anchor.

1. Equal texts fall together first; all but the least id of a class are covered wholly (if they have 50 bytes).
2. First digit: the anchor's gram. Anchors are dealt into buckets by its leading bits, packed as arrays; a
   block of texts sends each (gram, context) once, for its least document. The context is all windows of the anchor.
   Within a bucket, sorting by (gram, context) leaves groups of grams; those of one context are settled: all
   but its least document are covered.
3. Last digits: groups of a gram with several contexts go on. Each context's least document sends the context's
   bytes; windows are told apart by all their 50 bytes, and each is covered if an earlier document has it.

Buckets number as the data does, so a bucket stays small; a passage that a third of all documents share is sent
once per block of texts, not once per document.

Defined cases: null or empty texts have no bytes and the digest of the empty string; of rows with equal ids none is
earlier; rows without an id stay whole and are earlier than none; texts under 50 bytes stay whole; a very long
text is one block, whole; of documents that tie for a string the one of least id has it first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.common import blocks, sized_semi_join, staged
from tessera.llm.kernels import U64

DEPTH, GRAM = 50, 20
#: Bytes of text for each bucket of anchors, and the least number of buckets.
BUCKET_BYTES, BUCKETS = 16 << 20, 256
_EMPTY = hashlib.sha256(b"").hexdigest()


class Anchors:
    """Anchors of a block of texts: text, place, first and last window start (places within ``data``), gram and context hashes."""

    def __init__(self, texts: list[bytes], depth: int = DEPTH, gram: int = GRAM):
        self.data, self.at = kernels.joined(texts)
        none = np.zeros(0, np.int64)
        self.text = self.place = self.first = self.last = none
        self.gram = self.context = none.astype(U64)
        n = len(self.data) - gram + 1
        if n < depth - gram + 1:
            return
        sums = kernels.prefix_sums(self.data)
        starts = np.arange(n)
        grams = kernels.span_hashes(sums, starts, starts + gram)
        place = kernels.leftmost_minima(grams, depth - gram + 1)
        window = np.arange(len(place))
        text = np.searchsorted(self.at, window, "right") - 1
        fits = window + depth < self.at[text + 1]
        window, place, text = window[fits], place[fits], text[fits]
        if not len(window):
            return
        new = np.ones(len(window), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        heads = np.flatnonzero(new)
        self.text, self.place, self.first = text[heads], place[heads], window[heads]
        self.last = window[np.append(heads[1:], len(window)) - 1]
        self.gram = grams[self.place]
        # equal only if the windows' bytes and the anchor's offset are
        self.context = kernels.mix(kernels.span_hashes(sums, self.first, self.last + depth) + (self.place - self.first).astype(U64) * U64(0x9E3779B97F4A7C15))


def _low(gram: np.ndarray) -> np.ndarray:
    """What of a gram's hash is shipped beside its bucket."""
    return (gram & U64(0xFFFFFFFF)).astype(np.uint32)


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, grams, contexts, owners, ids: a block's anchors of a bucket as arrays."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, most=4 << 20):
            ids = np.array(part.column(0).to_pylist(), np.int64)
            small = [Anchors(texts[i:j]) for i, j in _slices(texts)]
            offset = np.cumsum([0, *(j - i for i, j in _slices(texts))])
            doc = np.concatenate([ids[a.text + o] for a, o in zip(small, offset)])
            gram, context = (np.concatenate([getattr(a, k) for a in small]) for k in ("gram", "context"))
            order = np.lexsort((doc, context, gram))
            doc, gram, context = doc[order], gram[order], context[order]
            # of a (gram, context) the least document goes on; the others of this block send theirs in the rest
            head = np.ones(len(doc), bool)
            head[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
            least = doc[np.maximum.accumulate(np.where(head, np.arange(len(doc)), 0))] if len(doc) else doc
            later = doc > least
            again = np.zeros(len(doc), bool)
            again[1:] = ~head[1:] & (doc[1:] == doc[:-1])
            yield _rows(-1, gram[later & ~again], context[later & ~again], doc[later & ~again])
            gram, context, doc = gram[head], context[head], doc[head]
            bucket = (gram >> U64(32)) % U64(buckets)
            order = np.argsort(bucket, kind="stable")
            gram, context, doc, bucket = gram[order], context[order], doc[order], bucket[order]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield _rows(int(bucket[a]), gram[a:b], context[a:b], doc[a:b])

    def _slices(texts: list[bytes]) -> list[tuple[int, int]]:
        out, start, size = [], 0, 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > 1 << 19:
                out.append((start, i))
                start, size = i, 0
            size += len(t)
        return [*out, (start, len(texts))]

    def _rows(bucket: int, gram: np.ndarray, context: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        ids, owner = np.unique(doc, return_inverse=True)
        owner = owner.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (_low(gram), context, owner, ids))], names=["bucket", "grams", "contexts", "owners", "ids"]
        )

    return docs.select("doc_id", "text").mapInArrow(each, "bucket int, grams binary, contexts binary, owners binary, ids binary")


def _unpacked(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams, contexts, docs = [], [], []
    for g, c, o, i in zip(*(table.column(k).to_pylist() for k in ("grams", "contexts", "owners", "ids"))):
        grams.append(np.frombuffer(g, np.uint32))
        contexts.append(np.frombuffer(c, np.uint64))
        owner = np.frombuffer(o, np.uint16 if len(o) == 2 * len(grams[-1]) else np.uint32)
        docs.append(np.frombuffer(i, np.int64)[owner])
    return np.concatenate(grams), np.concatenate(contexts), np.concatenate(docs)


def _keys(doc: np.ndarray, open_: np.ndarray, gram: np.ndarray, context: np.ndarray) -> dict[str, pa.Array]:
    return {"doc_id": pa.array(doc, pa.int64()), "open": pa.array(open_, pa.bool_()), "gram": pa.array(gram.astype(np.int64)), "context": pa.array(context.view(np.int64))}


_KEYS = "doc_id long, open boolean, gram long, context long"


def _settled(packed: DataFrame) -> DataFrame:
    """For each repeated anchor: doc_id, whether it is open (its context's least document, windows to be told apart) or covered, gram, context."""

    def each(table: pa.Table) -> pa.Table:
        gram, context, doc = _unpacked(table)
        order = np.lexsort((doc, context, gram))
        gram, context, doc = gram[order], context[order], doc[order]
        n = len(gram)
        head = np.append(True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]))
        least = doc[np.maximum.accumulate(np.where(head, np.arange(n), 0))]
        covered = doc > least
        group = np.append(True, gram[1:] != gram[:-1])
        number = np.cumsum(group) - 1
        contexts = np.bincount(number, weights=head)
        bounds = np.flatnonzero(group)
        several = (contexts >= 2) & (np.minimum.reduceat(doc, bounds) != np.maximum.reduceat(doc, bounds))
        open_ = head & several[number]
        keep = covered | open_
        return pa.table(_keys(doc[keep], open_[keep], gram[keep], context[keep]))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gram, context, doc = _unpacked(batch)
                yield pa.RecordBatch.from_pydict(_keys(doc, np.zeros(len(doc), bool), gram, context))

    dealt = packed.filter("bucket >= 0").groupBy("bucket").applyInArrow(each, _KEYS)
    within = packed.filter("bucket < 0").select("grams", "contexts", "owners", "ids").mapInArrow(local, _KEYS)
    return dealt.union(within)


def _wanted(anchors: Anchors, keys: list[list[dict] | None]) -> np.ndarray:
    """Which anchors are among their text's keys."""
    known = [{(k["gram"], k["context"]) for k in ks or ()} for ks in keys]
    pairs = zip(anchors.text.tolist(), _low(anchors.gram).tolist(), anchors.context.view(np.int64).tolist())
    return np.fromiter(((g, c) in known[t] for t, g, c in pairs), bool, len(anchors.text))


def _opened(rows: DataFrame) -> DataFrame:
    """gram, doc_id, h, start, shift, bytes of the open anchors' contexts, from (doc_id, h, text, keys)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            a = Anchors(texts)
            take = np.flatnonzero(_wanted(a, part.column("keys").to_pylist()))
            if len(take):
                ids, h = part.column("doc_id").to_numpy(), part.column("h").to_numpy()
                base = a.at[a.text[take]]
                data = a.data.tobytes()
                spans = [data[x:y] for x, y in zip(a.first[take].tolist(), (a.last[take] + DEPTH).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_low(a.gram[take]).astype(np.int64)), pa.array(ids[a.text[take]]), pa.array(h[a.text[take]]), pa.array(a.first[take] - base), pa.array(a.place[take] - a.first[take]), pa.array(spans, pa.binary())], names=["gram", "doc_id", "h", "start", "shift", "bytes"]
                )

    return rows.mapInArrow(each, "gram long, doc_id long, h long, start long, shift long, bytes binary")


def _told_apart(contexts: DataFrame, buckets: int) -> DataFrame:
    """doc_id, h, start, end: windows of the contexts that an earlier document has, runs joined."""

    def each(table: pa.Table) -> pa.Table:
        gram, doc, h, start, shift, data = (table.column(k).to_pylist() for k in ("gram", "doc_id", "h", "start", "shift", "bytes"))
        least: dict[tuple, int] = {}
        for g, d, s, b in zip(gram, doc, shift, data):
            for k in range(len(b) - DEPTH + 1):
                key = (g, s - k, b[k : k + DEPTH])
                if least.get(key, d) >= d:
                    least[key] = d
        out: list[tuple[int, int, int, int]] = []
        for g, d, x, at, s, b in zip(gram, doc, h, start, shift, data):
            run = -1
            for k in range(len(b) - DEPTH + 2):
                if k <= len(b) - DEPTH and least[g, s - k, b[k : k + DEPTH]] < d:
                    run = k if run < 0 else run
                elif run >= 0:
                    out.append((d, x, at + run, at + k - 1 + DEPTH))
                    run = -1
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("doc_id", "h", "start", "end"))})

    return contexts.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(each, "doc_id long, h long, start long, end long")


def _removed(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from (doc_id, h, text, keys, spans)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            a = Anchors(texts)
            take = _wanted(a, part.column("keys").to_pylist())
            change = np.zeros(len(a.data) + 1, np.int32)
            np.add.at(change, a.first[take], 1)
            np.add.at(change, a.last[take] + DEPTH, -1)
            for i, (h, spans) in enumerate(zip(part.column("h").to_pylist(), part.column("spans").to_pylist())):
                for s in (s for s in spans or () if s["h"] == h):
                    change[a.at[i] + s["start"]] += 1
                    change[a.at[i] + s["end"]] -= 1
            gone = np.cumsum(change[:-1]) > 0
            out = []
            for i, t in enumerate(texts):
                g = gone[a.at[i] : a.at[i] + len(t)]
                kept = a.data[a.at[i] : a.at[i] + len(t)][~g].tobytes()
                out.append((len(t), int(g.sum()), int((np.diff(g.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([x[k] for x in out], pa.int64()) for k in range(3)), pa.array([x[3] for x in out], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    # h tells rows of equal ids apart
    docs = rows.filter("doc_id is not null").withColumn("h", F.xxhash64("text"))
    signed = staged(docs.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "suffix-digests")
    classes = signed.groupBy("sha").agg(F.min("doc_id").alias("least"))
    copies = staged(signed.filter(f"n_bytes >= {DEPTH}").join(classes, "sha").filter("doc_id > least").select("doc_id", "h", "n_bytes"), "suffix-copies")
    size = signed.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(BUCKETS, size // BUCKET_BYTES)
    first = sized_semi_join(docs, copies.select("doc_id", "h").distinct(), "left_anti", on=["doc_id", "h"])
    keys = staged(_settled(_packed(first, buckets)), "suffix-keys")

    def of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "context")).alias("keys"))

    opened = of(keys.filter("open"))
    contexts = _opened(sized_semi_join(first, opened.select("doc_id")).join(opened, "doc_id").select("doc_id", "h", "text", "keys"))
    spans = staged(_told_apart(contexts, buckets), "suffix-spans").groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "end")).alias("spans"))
    marks = staged(of(keys.filter("not open")).join(spans, "doc_id", "full"), "suffix-marks")
    cut = _removed(sized_semi_join(first, marks.select("doc_id")).join(marks, "doc_id").select("doc_id", "h", "text", "keys", "spans"))
    none, empty = F.lit(0).cast("long"), F.lit(_EMPTY)
    covered = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("kept_sha256"))
    untouched = signed.join(copies.select("doc_id", "h"), ["doc_id", "h"], "left_anti").join(marks.select("doc_id"), "doc_id", "left_anti")
    whole = untouched.select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    unnamed = rows.filter("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return cut.union(covered).union(whole).union(unnamed)
