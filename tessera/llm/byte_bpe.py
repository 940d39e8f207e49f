"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries of the pre-tokeniser's matches come from arrays, not from a regular expression:
code points map to classes (letter, number, white space, apostrophe, other), a look at the
next characters turns classes into symbols, and each symbol is a function between the
states of a small automaton. Composition of such functions is associative and their closure
is finite, so a scan needs only look-ups in a composition table: first within the columns of
a (blocks x width) array, then over the blocks' totals. A match begins where the symbol
met in its state says so. Slices of the text's bytes between boundaries feed pair merging,
which is remembered per slice; their offsets stay with the ids, so decoding gives back each slice.

Null and empty texts give no ids and the digests of empty strings. Rows pass one by one
(no shuffle), those without an id too; repeated rows give equal results; pairs of equal rank merge from the left; an empty
table gives no rows; a very long text is a block of its own and encoded whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, kept, map_texts

#: Slices whose ids one worker remembers, and bytes of the longest.
REMEMBERED, LONGEST_REMEMBERED = 150_000, 64
#: Slices that are merged as rows of arrays have so many bytes at most, and arrays so many rows.
WIDE, ROWS = 40, 4096
NEVER = np.int64(1 << 62)
#: Code points of a block: width of the scan's columns.
WIDTH = 128

# Classes of code points.
LETTER, NUMBER, BLANK, WHITE, QUOTE, OTHER = range(6)
# Symbols: classes after a look at what follows. LEAD is a blank that joins the next match, LONE another white
# character before a non-white one, RUN white space that more white space or the end follows; SHORT and LONG are
# apostrophes before a contraction's one or two letters.
S_LETTER, S_NUMBER, S_OTHER, S_LEAD, S_LONE, S_RUN, S_SHORT, S_LONG = range(8)
# States after a symbol.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_RUN, AFTER_LEAD, ONE_LETTER, TWO_LETTERS = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the symbol begins a match."""
    if symbol == S_LETTER:
        if state == TWO_LETTERS:
            return ONE_LETTER, False
        if state == ONE_LETTER:
            return FREE, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_LEAD)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_LEAD)
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in (IN_OTHER, AFTER_LEAD):
            return IN_OTHER, False
        return {S_OTHER: IN_OTHER, S_SHORT: ONE_LETTER, S_LONG: TWO_LETTERS}[symbol], True
    if symbol == S_RUN:
        return IN_RUN, state != IN_RUN
    return (AFTER_LEAD if symbol == S_LEAD else FREE), True


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the symbols' functions (then of those after a reset), composition table, states from FREE, begins."""
    single = [tuple(_step(q, s)[0] for q in range(8)) for s in range(8)]
    resets = [(f[FREE],) * 8 for f in single]  # the same after a text's start
    known: dict[tuple, int] = {}
    for f in [tuple(range(8)), *single, *resets]:
        known.setdefault(f, len(known))
    grown = True
    while grown:
        grown = False
        for f in list(known):
            for g in [*single, *resets]:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    grown = True
    functions = list(known)
    table = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16)
    begins = np.array([[_step(q, s)[1] for s in range(8)] for q in range(8)])
    return np.array([known[f] for f in [*single, *resets]], np.uint16), table, np.array([f[FREE] for f in functions], np.uint8), begins


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    # Unicode's White_Space, fixed values
    for first, last in ((0x09, 0x0D), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[first : last + 1] = WHITE
    out[0x20], out[ord("'")] = BLANK, QUOTE
    return out


def match_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where matches begin in concatenated texts of code points; ``firsts``: where the (non-empty) texts begin."""
    n = len(points)
    function_ids, table, state_of, begins = _automaton()
    kind = _classes()[points]
    text_end = np.zeros(n, bool)
    text_end[firsts[1:] - 1] = True
    text_end[-1] = True
    following = np.append(kind[1:], WHITE)
    following[text_end] = WHITE
    symbol = np.array([S_LETTER, S_NUMBER, S_RUN, S_RUN, S_OTHER, S_OTHER], np.uint8)[kind]
    before_word = following < BLANK
    before_word |= following > WHITE
    symbol[(kind == BLANK) & before_word] = S_LEAD
    symbol[(kind == WHITE) & before_word] = S_LONE
    quotes = np.flatnonzero((kind == QUOTE) & (following == LETTER))
    if len(quotes):
        one = points[quotes + 1]
        symbol[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        pairs = quotes[~text_end[np.minimum(quotes + 1, n - 1)] & (quotes + 2 < n)]
        code = points[pairs + 1].astype(np.int64) << 32 | points[pairs + 2]
        symbol[pairs[np.isin(code, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = S_LONG
    ids = symbol.astype(np.uint8)
    ids[firsts] += 8
    rows = -(-n // WIDTH)
    grid = np.full(rows * WIDTH, S_RUN, np.uint8)
    grid[:n] = ids
    grid = function_ids[grid].reshape(rows, WIDTH)
    grid = np.ascontiguousarray(grid.T)  # column k of all blocks lies together
    for k in range(1, WIDTH):
        grid[k] = table[grid[k - 1], grid[k]]
    totals, apart = grid[-1].copy(), 1
    while apart < rows:  # composes twice as many blocks' totals each time
        totals[apart:] = table[totals[:-apart], totals[apart:]]
        apart *= 2
    reached = np.append(np.uint16(0), totals[:-1])  # 0 is the identity
    after = state_of[table[reached[None, :], grid]].T.reshape(-1)[:n]
    earlier = np.empty(n, np.uint8)
    earlier[0] = FREE
    earlier[1:] = after[:-1]
    earlier[firsts] = FREE
    return np.flatnonzero(begins[earlier, symbol])


class ByteBpe:
    """Ranks of byte strings; encodes slices by merging the pair of lowest rank, leftmost first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.digits = {r: str(r) for r in ranks.values()}
        self.ids: dict[bytes, tuple[int, ...]] = {}
        self.single = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        # pairs of ids that merge, as numbers in order, and what they become
        joins = sorted((a << 32 | b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None)
        self.pairs, self.joined = (np.array([x[k] for x in joins] or [-1], np.int64) for k in range(2))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of ids become, or NEVER."""
        code = left << 32 | right
        place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[place] == code, self.joined[place], NEVER)

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece; those of up to WIDE bytes are rows of arrays, in which each round merges one pair of every row."""
        out: list[tuple[int, ...] | None] = [(r,) if (r := self.ranks.get(p)) is not None else None for p in pieces]
        rows: list[int] = []
        for i, p in enumerate(pieces):
            if out[i] is None:
                if len(p) > WIDE:
                    out[i] = self._merge_long(p)
                else:
                    rows.append(i)
        for k in range(0, len(rows), ROWS):
            some = sorted(rows[k : k + ROWS], key=lambda i: len(pieces[i]))
            for i, ids in zip(some, self._merge_rows([pieces[i] for i in some])):
                out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        n = np.array([len(p) for p in pieces])
        m, width = len(pieces), int(n.max())
        column = np.arange(width)
        ids = np.full((m, width + 1), -1, np.int64)
        ids[:, :width][column < n[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((m, width), NEVER)
        inner = column + 1 < n[:, None]
        rank[inner] = self._rank(ids[:, :-1][inner], ids[:, 1:][inner])
        row, done = np.arange(m), [()] * m
        while len(row):
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(row)), at]
            open_ = least < NEVER
            for i in np.flatnonzero(~open_).tolist():
                done[row[i]] = tuple(ids[i, : n[i]].tolist())
            row, at, least, n, ids, rank = (x[open_] for x in (row, at, least, n, ids, rank))
            each = np.arange(len(row))
            # what stands behind the pair moves up by one
            ids[:, 1:-1] = np.where(column[1:] > at[:, None], ids[:, 2:], ids[:, 1:-1])
            rank[:, :-1] = np.where(column[:-1] > at[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NEVER
            ids[each, at] = least
            n -= 1
            follows, leads = at + 1 < n, at > 0
            rank[each, at] = NEVER
            rank[each[follows], at[follows]] = self._rank(least[follows], ids[each[follows], at[follows] + 1])
            rank[each[leads], at[leads] - 1] = self._rank(ids[each[leads], at[leads] - 1], least[leads])
        return done

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that begins at i; ends 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or ends[j] != end:
                continue
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def ids_of(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece. Those of short pieces are remembered; if these become too many, only what this block had."""
        here = set(pieces)
        lacking = sorted(here.difference(self.ids))
        if len(self.ids) + len(lacking) > REMEMBERED:
            self.ids = {p: self.ids[p] for p in here if p in self.ids}
        self.ids.update(zip(lacking, self.merge_all(lacking)))
        out = list(map(self.ids.__getitem__, pieces))
        for p in lacking:
            if len(p) > LONGEST_REMEMBERED:
                del self.ids[p]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def encode_block(self, texts: list[bytes]) -> Iterator[tuple[list[int], list[tuple[int, ...]]]]:
        """For each text: byte offsets of its slices (then its end) and each slice's ids."""
        whole = b"".join(texts).decode("utf-8", "surrogatepass")
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            yield from (([0], []) for _ in texts)
            return
        offsets = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), out=offsets[1:])
        text_at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        filled = np.flatnonzero(np.diff(text_at))
        starts = offsets[match_starts(points, np.searchsorted(offsets, text_at[filled]))]
        data, cuts = b"".join(texts), [*starts.tolist(), int(text_at[-1])]
        ids = self.ids_of([data[a:b] for a, b in zip(cuts, cuts[1:])])
        bounds = np.searchsorted(starts, text_at).tolist()
        for a, b, first, t in zip(bounds, bounds[1:], text_at.tolist(), texts):
            yield [*(starts[a:b] - first).tolist(), len(t)], ids[a:b]


@kept
def byte_bpe(rank_path: str) -> ByteBpe:
    with open(rank_path, "rb") as lines:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, rank_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``ids`` and the byte offsets ``ends`` at which each id's bytes end."""
    path = rank_path or default_ranks()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for part, texts in blocks(batches):
            ids = [list(chain.from_iterable(parts)) for _, parts in bpe.encode_block(texts)]
            ends = [np.cumsum([len(bpe.token[i]) for i in x], dtype=np.int64).tolist() for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int64()))], names=["doc_id", "ids", "ends"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(source, encoded, "doc_id long, ids array<int>, ends array<long>", "doc_id", "text")


def decode(ids: DataFrame, rank_path: str | None = None) -> DataFrame:
    """The texts' bytes from ``ids`` of ``encode``."""
    path = rank_path or default_ranks()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return ids.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, data binary")


def round_trip(docs: DataFrame, rank_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256`` (decimal ids, one space between) and ``decoded_sha256``."""
    path = rank_path or default_ranks()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        digit = bpe.digits.__getitem__
        for part, texts in blocks(batches):
            counts, named, back = [], [], []
            for _, parts in bpe.encode_block(texts):
                ids = list(chain.from_iterable(parts))
                counts.append(len(ids))
                named.append(hashlib.sha256(" ".join(map(digit, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(named), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(source, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "doc_id", "text")
