"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Each word of the vocabulary generates its edits of one code point as hashes that are sums of a value for each place and
letter, so an edit's hash costs two additions and no string is built. Edits are probed against blocked Bloom filters,
one shard for each word length, that are built by a grouped bit-or and broadcast. Only positives shuffle: pairs of hashes,
which join the vocabulary; what joins is checked by its edit distance, so false positives go and hashes need not be unique.
Of two near words one generates the other (the longer by a deletion, the one with the smaller letter by a replacement),
and both get the link.

A filter has ``FILTER_BYTES`` at most. A vocabulary that needs more is taken in several passes over hash segments, each with a filter of
that size, so the broadcast stays bounded and results whole.

Defined cases: null and empty texts have no words; a document without an id counts under the empty id; repeated rows count each time; ties of n go to the smaller word
in code-point order; an empty table gives no rows; words are taken from whole texts, however long, and may be of any
length themselves (their edits are made in blocks of places); columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, map_texts, staged
from tessera.llm.kernels import U64, mix

SHORTEST, LEAST_N, RATIO, SLIP = 7, 2, 10, 31
#: Lengths from here on share a shard.
LONG = 64
BITS_PER_WORD, FILTER_BYTES = 16, 16 << 20
FIELDS = (0, 6, 12, 18, 24)  # bits of a hash that name a bit of its filter word
#: Edits that are probed at once, and words that a task counts before it sends them on.
PROBES, COUNTED = 1 << 20, 300_000


def word_counts(docs: DataFrame, shortest: int = SHORTEST, slip: int = SLIP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of runs of letters with A-Z lower-cased, of at least ``shortest`` code points.

    Where ``slip`` divides the crc32 of id and run, one letter of the run is left out (0: nowhere); tasks add up what they have before it is shuffled.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part, texts in blocks(batches):
            for id_, text in zip(part.column(0).to_pylist(), texts, strict=True):
                found = Counter(runs.findall(text.lower().decode()))  # bytes.lower changes A-Z alone
                if slip:
                    start, moved = zlib.crc32(f"{'' if id_ is None else id_}:".encode()), []
                    for run, n in found.items():
                        h = zlib.crc32(run.encode(), start)
                        if h % slip == 0:
                            moved.append((run, h % len(run), n))
                    for run, at, n in moved:
                        del found[run]
                    total.update(found)
                    for run, at, n in moved:
                        if len(run) > shortest:
                            total[run[:at] + run[at + 1 :]] += n
                else:
                    total.update(found)
            if len(total) >= COUNTED:
                yield rows(total)
                total = Counter()
        if total:
            yield rows(total)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(source, counted, "word string, n long", "doc_id", "text").groupBy("word").agg(F.sum("n").alias("n"))


def place_values(places: np.ndarray, points: np.ndarray) -> np.ndarray:
    """A random-looking value of each letter at each place; a word's hash is their sum."""
    return mix(((places.astype(U64) << U64(32)) + points.astype(U64)) * U64(0x9E3779B97F4A7C15) + U64(0xD1B54A32D192ED03))


def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, rows and code points (rows x length) of the words of each length."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield n, rows, np.array(words.take(pa.array(rows)).to_pylist(), f"<U{n}").view(np.uint32).reshape(len(rows), n)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, U64)
        for n, rows, points in _by_length(batch.column(0)):
            out[rows] = place_values(np.arange(n), points).sum(axis=1, dtype=U64)
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), *batch.columns], names=["h", "word", "n"])


def vocabulary(counts: DataFrame, least_n: int = LEAST_N) -> DataFrame:
    """h, word, n of words found often enough."""
    return counts.filter(F.col("n") >= least_n).select("word", "n").mapInArrow(_hashed, "h long, word string, n long")


def edits(points: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Whether these are deletions, the row and the hash of the edits of words of one length; blocks of at most about ``PROBES``."""
    count, n = points.shape
    per_place = len(alphabet)
    width = max(1, min(n, PROBES // per_place))
    height = max(1, PROBES // (width * per_place))
    for top in range(0, count, height):
        rows = points[top : top + height]
        own = place_values(np.arange(n), rows)
        whole = own.sum(axis=1, dtype=U64)
        before = np.cumsum(own, axis=1, dtype=U64) - own
        moved = place_values(np.arange(n - 1), rows[:, 1:])
        after = np.concatenate([np.cumsum(moved[:, ::-1], axis=1, dtype=U64)[:, ::-1], np.zeros((len(rows), 1), U64)], axis=1)
        first = np.concatenate([np.ones((len(rows), 1), bool), rows[:, 1:] != rows[:, :-1]], axis=1)  # of equal letters in a row, one is enough
        yield True, top + np.nonzero(first)[0], (before + after)[first]
        for left in range(0, n, width):
            part = slice(left, min(left + width, n))
            values = place_values(np.arange(n)[part, None], alphabet[None, :])
            hashes = (whole[:, None] - own[:, part])[:, :, None] + values[None]
            up = alphabet[None, None, :] > rows[:, part, None]
            yield False, top + np.nonzero(up)[0], hashes[up]


class Filters:
    """Blocked Bloom filters by word length in one array of 64-bit words; a hash has one word there and five of its bits."""

    def __init__(self, lengths: dict[int, int], passes: int):
        self.passes = passes
        self.slots, self.starts, self.size = {}, {}, 0
        for n, count in sorted(lengths.items()):
            self.slots[n] = -(-count * BITS_PER_WORD // (64 * passes))
            self.starts[n] = self.size
            self.size += self.slots[n]

    def segment(self, hashes: np.ndarray) -> np.ndarray:
        return mix(hashes) % U64(self.passes)

    def slot(self, length: int, hashes: np.ndarray) -> np.ndarray:
        n = min(length, LONG)
        return ((hashes >> U64(32)) * U64(self.slots[n]) >> U64(32)).astype(np.int64) + self.starts[n]

    def held(self, words: np.ndarray, length: int, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be words of this length."""
        if min(length, LONG) not in self.slots:
            return np.empty(0, np.int64)
        word = words[self.slot(length, hashes)]
        kept = np.flatnonzero((word >> (hashes & U64(63))) & U64(1))
        for shift in FIELDS[1:]:
            kept = kept[((word[kept] >> ((hashes[kept] >> U64(shift)) & U64(63))) & U64(1)).astype(bool)]
        return kept


def _profile(vocab: DataFrame) -> tuple[dict[int, int], np.ndarray]:
    """Words of each length (lengths from ``LONG`` on together) and the letters that occur: a few rows of each task."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, letters = Counter(), set()
        for batch in batches:
            for n, rows, points in _by_length(batch.column(0)):
                lengths[min(n, LONG)] += len(rows)
                letters.update(np.unique(points).tolist())
        keys = [("length", k, v) for k, v in lengths.items()] + [("letter", c, 1) for c in letters]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "value", "n"), x, strict=True)) for x in keys], schema=pa.schema([("kind", pa.string()), ("value", pa.int64()), ("n", pa.int64())]))

    found = vocab.select("word").mapInArrow(seen, "kind string, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")).collect()
    return {r.value: r.n for r in found if r.kind == "length"}, np.array(sorted(r.value for r in found if r.kind == "letter"), np.uint32)


def _built(vocab: DataFrame, filters: Filters, number: int) -> np.ndarray:
    """The filters' words for one segment; at most ``FILTER_BYTES``."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(U64)
            lengths = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)
            own = filters.segment(hashes) == number
            slots = np.empty(len(hashes), np.int64)
            for n in np.unique(lengths).tolist():
                slots[lengths == n] = filters.slot(n, hashes[lengths == n])
            word = np.zeros(len(hashes), U64)
            for shift in FIELDS:
                word |= U64(1) << ((hashes >> U64(shift)) & U64(63))
            yield pa.RecordBatch.from_arrays([pa.array(slots[own]), pa.array(word[own].view(np.int64))], names=["slot", "bits"])

    found = vocab.select("h", "word").mapInArrow(bits, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(filters.size, U64)
    words[found["slot"].to_numpy()] = found["bits"].to_numpy().view(U64)
    return words


def _positives(vocab: DataFrame, filters: Filters, number: int, alphabet: np.ndarray) -> DataFrame:
    """hx, hy: hashes of words and of those of their edits that a filter may hold."""
    sent = vocab.sparkSession.sparkContext.broadcast(_built(vocab, filters, number))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            own = batch.column(0).to_numpy().view(U64)
            for n, rows, points in _by_length(batch.column(1)):
                xs, ys = [], []
                for shorter, row, hashes in edits(points, alphabet):
                    if filters.passes > 1:
                        mine = filters.segment(hashes) == number
                        row, hashes = row[mine], hashes[mine]
                    kept = filters.held(words, n - shorter, hashes)
                    xs.append(own[rows[row[kept]]])
                    ys.append(hashes[kept])
                pairs = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], names=["hx", "hy"])

    return vocab.select("h", "word").mapInArrow(probed, "hx long, hy long")


def near_words(vocab: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, near, near_n of all words of the vocabulary (h, word, n) that one edit tells apart, both ways."""
    lengths, alphabet = _profile(vocab)
    passes = max(1, -(-sum(lengths.values()) * BITS_PER_WORD // (8 * filter_bytes)))
    filters = Filters(lengths, passes)
    found = None
    for number in range(passes if lengths else 0):
        part = staged(_positives(vocab, filters, number, alphabet), "spelling-positives")
        found = part if found is None else found.union(part)
    if found is None:
        return vocab.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    y = vocab.select(F.col("h").alias("hy"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    x = vocab.select(F.col("h").alias("hx"), "word", "n")
    met = found.join(y, "hy").join(x, "hx").filter(F.levenshtein("word", "near", 1) == 1)
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return met.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (word, form). Chains double each round; n grows along them, so they end."""
    found = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if found.join(on, "root", "left_semi").isEmpty():
            return found
        found = staged(found.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")


def variants(vocab: DataFrame, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary (h, word, n)."""
    near = near_words(vocab, filter_bytes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = vocab.select("word", "n").join(near, "word", "left")
    often = -F.col("best.less") >= ratio * F.col("n")
    formed = staged(best.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, slip: int = SLIP, least_n: int = LEAST_N, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The vocabulary of the documents with each word's form and root."""
    vocab = staged(vocabulary(word_counts(docs, shortest, slip), least_n), "spelling-vocabulary")
    return variants(vocab, ratio, filter_bytes)
