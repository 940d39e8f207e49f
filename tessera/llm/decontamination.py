"""Benchmark decontamination by templates: also questions whose numbers, names or units were exchanged.

Words of benchmark items and documents are canonicalised: numbers, units after a number, and names (capitalised
words wherever they stand, as a sentence may begin with a name; one placeholder for a run) become typed placeholders, whose own texts are their
slots; other words are lower-cased and stripped of punctuation. Windows of ``WINDOW`` template words are hashed and joined with
the benchmark's; within a match the slots must be consistent: one benchmark value always maps to one document value of the same
type and no two to the same. Windows of one copy keep their distance from the item's; the copy with most consistent windows is judged first,
and others add to it what agrees with its map. A document is contaminated by an item if consistent windows cover at least ``COVER`` of
the item's template words.

Windows that hold fewer than ``LITERAL`` ordinary words are hashed with their slots' texts, so they match verbatim copies only. The benchmark's
windows are broadcast only up to a counted bound (``BROADCAST_WINDOWS``): blocks of texts are then hashed as arrays, and only texts with a window whose
template is known are looked at word by word; beyond the bound, all windows of the documents are joined by a shuffle. An item shorter than a
window is one window.

Defined cases: null or empty texts and items, and rows without an id, match nothing; texts of one id are judged each by itself, equal ones once; repeated
items each by their id; ties among copies go to the earliest; texts of any length are handled whole; an empty benchmark or table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Remembered, blocks, kept, sized_semi_join, staged
from tessera.llm.kernels import PLACE, U64, mix

WINDOW, LITERAL, COVER = 8, 4, 0.5
BROADCAST_WINDOWS = 500_000

NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
# Words that are units after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons ml l litre litres liter liters "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh dollar dollars euro euros cent cents usd eur percent degrees celsius".split()
)
# Numbers in words.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?$")
_NUMBER_UNIT = re.compile(r"([-+]?[$€£]?\d[\d.,]*)([A-Za-z]+)$")
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_`~…«»„“”"


PLAIN, CAPITAL, NUMERAL, MEASURE, EMPTY, MAYBE_UNIT = 0, 1, 2, 3, 4, 8
_REMEMBERED = 200_000


def _kind(raw: str) -> tuple[int, str, str]:
    """What a word is by itself (``MAYBE_UNIT`` added if it is a unit after a number), its text, a measure's unit."""
    word = raw.strip(_STRIP)
    low = word.lower()
    if not word:
        return EMPTY, "", ""
    if not word[0].isalpha():
        if _NUMBER.match(word):
            return NUMERAL, word, ""
        if (both := _NUMBER_UNIT.match(word)) and both[2].lower() in UNITS:
            return MEASURE, both[1], both[2].lower()
    elif low in NUMBER_WORDS or "-" in low and NUMBER_WORDS.issuperset(low.split("-")):
        return NUMERAL, low, ""
    return (CAPITAL if word[0].isupper() and not word.isupper() else PLAIN) | (MAYBE_UNIT if low in UNITS else 0), low, ""


def template(text: str) -> tuple[list[str], list[str]]:
    """Template words of a text, and for each the text of its slot ('' for ordinary words)."""
    words: list[str] = []
    slots: list[str] = []
    for raw in text.split():
        kind, low, unit = _kind(raw)
        if kind == EMPTY:
            continue
        if kind == NUMERAL:
            words.append(NUMBER)
            slots.append(low)
        elif kind == MEASURE:
            words += (NUMBER, UNIT)
            slots += (low, unit)
        elif kind & MAYBE_UNIT and words and words[-1] == NUMBER:
            words.append(UNIT)
            slots.append(low)
        elif kind & CAPITAL:
            if words and words[-1] == NAME:
                slots[-1] += " " + low
            else:
                words.append(NAME)
                slots.append(low)
        else:
            words.append(low)
            slots.append("")
    return words, slots


def _marked(raw: str) -> int:
    """A word's kind in the low four bits, and above them a hash of its text."""
    kind, low, _ = _kind(raw)
    return xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace")) & ~15 | kind


_SLOT = {kind: U64(xxhash.xxh3_64_intdigest(kind.encode()) & ~15) for kind in (NUMBER, UNIT, NAME)}


class Shapes:
    """Hashes of templates' windows of whole blocks of texts, by arrays: what ``template`` gives, without the slots."""

    def __init__(self):
        self.marks = Remembered(_marked)

    def __call__(self, texts: list[str], sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size the windows' hashes, and the texts they stand in; a text with fewer words is one window of the first size."""
        parts = [t.split() for t in texts]
        marks = np.fromiter(map(self.marks.__getitem__, chain.from_iterable(parts)), U64, sum(map(len, parts)))
        text = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        kind, h = (marks & U64(15)).astype(np.uint8), marks & ~U64(15)
        there = kind != EMPTY
        kind, h, text = kind[there], h[there], text[there]
        if not len(kind):
            return [(np.zeros(0, U64), np.zeros(0, np.int64)) for _ in sizes]
        same = np.append(False, text[1:] == text[:-1])
        after_number = np.append(False, kind[:-1] == NUMERAL) & same
        unit = (kind & MAYBE_UNIT).astype(bool) & after_number
        name = (kind & 7 == CAPITAL) & ~unit
        number = (kind == NUMERAL) | (kind == MEASURE)
        h[number], h[unit], h[name] = _SLOT[NUMBER], _SLOT[UNIT], _SLOT[NAME]
        keep = ~(name & np.append(False, name[:-1]) & same)
        times = np.where(kind == MEASURE, 2, 1)[keep]
        h, text = np.repeat(h[keep], times), np.repeat(text[keep], times)
        second = np.cumsum(times)[times == 2] - 1
        h[second] = _SLOT[UNIT]
        out = []
        count = np.bincount(text, minlength=len(parts))
        first = np.cumsum(count) - count
        for k, size in enumerate(sizes):
            places = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :]) if len(text) >= size else np.zeros(0, np.int64)
            hashes, owner = _mixed(h, places, size), text[places]
            if k == 0:
                for i in np.flatnonzero((count > 0) & (count < size)).tolist():
                    hashes = np.append(hashes, _mixed(h, first[i : i + 1], int(count[i])))
                    owner = np.append(owner, i)
            out.append((hashes, owner))
        return out


@kept
def _word_hashes() -> dict[str, int]:
    return {}


def _hash(word: str, known: dict[str, int]) -> int:
    if len(known) >= _REMEMBERED:
        known.clear()
    known[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
    return h


def windows(words: list[str], size: int = WINDOW, literal: int = LITERAL, slots: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows with enough ordinary words, and with ``slots`` of the others by their slots' texts; a shorter text is one window."""
    n = len(words)
    size = min(size, n)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known = _word_hashes()
    h = np.array([known.get(w) or _hash(w, known) for w in words], np.uint64)
    plain = np.fromiter((w not in (NUMBER, UNIT, NAME) for w in words), np.int64, n)
    totals = np.concatenate([[0], np.cumsum(plain)])
    enough = totals[size:] - totals[: n - size + 1] >= min(literal, size)
    places = np.flatnonzero(enough)
    found = _mixed(h, places, size)
    if slots is None or enough.all():
        return found, places
    dense = np.flatnonzero(~enough)
    held = h.copy()
    for i in np.flatnonzero(plain == 0).tolist():
        word = f"{words[i]} {slots[i]}"
        held[i] = known.get(word) or _hash(word, known)
    return np.append(found, mix(_mixed(held, dense, size) ^ _VERBATIM)), np.append(places, dense)


_VERBATIM = np.uint64(0x5DEECE66D1CE4E5B)


def _mixed(h: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    total = np.full(len(places), np.uint64(size))
    for j in range(size):
        total += h[places + j] * PLACE[j]
    return mix(total)


_WINDOWS = "id long, copy long, window long, place int, length int, slots array<string>"


def _rows_of(rows: pa.RecordBatch, texts: list[str], sizes: list[int], known: np.ndarray | None = None) -> pa.RecordBatch:
    """The windows of the texts, with their rows' id and copy; with ``known`` (sorted hashes) only those among them."""
    out: list[tuple] = []
    for i, t in enumerate(texts):
        words, held = template(t)
        for size in sizes:
            if size > len(words) and size != WINDOW:
                continue
            found, at = windows(words, size, slots=held)
            if known is not None:
                keep = known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found
                found, at = found[keep], at[keep]
            out += [(i, h, k, len(words), held[k : k + min(size, len(words))]) for h, k in zip(found.view(np.int64).tolist(), at.tolist())]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
    row, *found = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([rows.column(0).take(row), rows.column(1).take(row), *found], names=["id", "copy", "window", "place", "length", "slots"])


def _every_window(sizes: list[int]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _word_hashes()  # kept from task to task
        for part, texts in blocks(batches):
            yield _rows_of(part, [t.decode("utf-8", "replace") for t in texts], sizes)

    return each


def _known_windows(sizes: list[int], known: np.ndarray, shapes: np.ndarray):
    """Windows among ``known``; texts without a window of a known shape are passed over."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shapes()
        _word_hashes()  # kept from task to task
        for part, whole in blocks(batches):
            texts = [t.decode("utf-8", "replace") for t in whole]
            wanted = np.zeros(len(texts), bool)
            for hashes, owner in of(texts, sizes):
                wanted[owner[shapes[np.minimum(np.searchsorted(shapes, hashes), len(shapes) - 1)] == hashes]] = True
            some = np.flatnonzero(wanted).tolist()
            if some:
                yield _rows_of(part.take(pa.array(some)), [texts[i] for i in some], sizes, known)

    return each


def _shapes_of(sizes: list[int]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shapes()
        for _, texts in blocks(batches):
            for hashes, _ in of([t.decode("utf-8", "replace") for t in texts], sizes):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["shape"])

    return each


def judge(rows: list[tuple[int, int, list[str], list[str]]]) -> tuple[int, int]:
    """Item words that consistent windows cover, and slots changed; rows: (place, item_place, slots, item_slots) of one document and item."""

    def extend(copy: list[tuple], forward: dict[str, str], back: dict[str, str], covered: set[int]) -> int:
        agreed = 0
        for _, item_place, slots, item_slots in copy:
            pairs = {(a, b) for a, b in zip(item_slots, slots) if a or b}
            there, here = dict(pairs), {b: a for a, b in pairs}
            # the window's own slots must agree with each other, and with the map so far
            if len(there) == len(here) == len(pairs) and all(forward.get(a, b) == b and back.get(b, a) == a for a, b in pairs):
                forward.update(there)
                back.update(here)
                covered.update(range(item_place, item_place + len(slots)))
                agreed += 1
        return agreed

    copies: dict[int, list[tuple]] = {}
    for row in sorted(rows, key=lambda r: r[:2]):
        copies.setdefault(row[0] - row[1], []).append(row)
    ranked = sorted(copies.values(), key=lambda copy: (-extend(copy, {}, {}, set()), copy[0][0]))
    forward: dict[str, str] = {}
    back: dict[str, str] = {}
    covered: set[int] = set()
    for copy in ranked:
        extend(copy, forward, back, covered)
    return len(covered), sum(a != b for a, b in forward.items())


def _judged(matches: DataFrame) -> DataFrame:
    """doc_id, copy, item_id, covered, n_words, n_slots_changed of the matches' consistent windows."""

    def each(table: pa.Table) -> pa.Table:
        keys = np.stack([table.column(k).to_numpy() for k in ("doc_id", "copy", "item_id")])
        length = table.column("length").to_numpy()
        order = np.lexsort(keys[::-1])
        cuts = np.append(np.flatnonzero(np.append(True, (keys[:, order][:, 1:] != keys[:, order][:, :-1]).any(axis=0))), len(order))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = table.select(["place", "item_place", "slots", "item_slots"]).take(pa.array(order[a:b])).to_pydict()
            out.append((*keys[:, order[a]], *judge(list(zip(*own.values()))), length[order[a]]))
        return pa.table({n: pa.array([int(x[j]) for x in out], pa.int64()) for n, j in (("doc_id", 0), ("copy", 1), ("item_id", 2), ("covered", 3), ("n_words", 5), ("n_slots_changed", 4))})

    return matches.groupBy("bucket").applyInArrow(each, "doc_id long, copy long, item_id long, covered long, n_words long, n_slots_changed long")


def contaminated_copies(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """(doc_id, copy, item_id, covered, n_words, n_slots_changed): each text (``copy``: its hash) of an id and the items it gives away."""
    spark = docs.sparkSession
    copy = lambda text: F.xxhash64(text).alias("copy")
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.lit(0).cast("long").alias("copy"), F.col("text").alias("text")).dropna()
    held = staged(items.mapInArrow(_every_window([WINDOW]), _WINDOWS).distinct(), "benchmark-windows")
    n = held.count()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), copy(F.col(text_col)), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    short = [r[0] for r in held.filter(f"length < {WINDOW}").select("length").distinct().collect()]  # fewer than WINDOW values
    sizes = [WINDOW, *sorted(short)]
    mapper = _every_window(sizes)
    if 0 < n <= BROADCAST_WINDOWS:
        known = np.sort(np.array([r[0] for r in held.select("window").distinct().collect()], np.int64).view(U64))
        shapes = items.select("text").mapInArrow(_shapes_of([WINDOW]), "shape long").distinct().collect()  # no more than words of the items
        mapper = _known_windows(sizes, known, np.sort(np.array([r[0] for r in shapes], np.int64).view(U64)))
    found = rows.mapInArrow(mapper, _WINDOWS).select(F.col("id").alias("doc_id"), "copy", "window", "place", "slots")
    side = held.select(F.col("id").alias("item_id"), "window", F.col("place").alias("item_place"), "length", F.col("slots").alias("item_slots"))
    matches = found.join(F.broadcast(side) if n <= BROADCAST_WINDOWS else side, "window").filter("size(slots) = size(item_slots)")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    judged = _judged(matches.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy", "item_id"), F.lit(buckets)).cast("int")))
    return judged.filter(F.col("covered") >= F.lit(cover) * F.col("n_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, covered, n_words, n_slots_changed): each document and the items it gives away, by its text that covers most."""
    found = contaminated_copies(docs, benchmark, id_col, text_col, cover)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", (-F.col("n_slots_changed")).alias("kept"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.covered", "b.n_words", (-F.col("b.kept")).alias("n_slots_changed"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no item contaminates, with all their columns; texts of one id are told apart."""
    bad = staged(contaminated_copies(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).distinct(), "contaminated")
    kept = sized_semi_join(docs.withColumns({"__id": F.col(id_col).cast("long"), "__copy": F.xxhash64(text_col)}), bad, "left_anti", on=["__id", "__copy"])
    return kept.select(*docs.columns)
