"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per connected group.

A line is normalised (ASCII letters lower, white space single). Its tokens are runs of letters, digits and non-ASCII
bytes; characters of scripts without blanks are tokens by themselves. Lines with a token take part. Two lines link if they are equal
once normalised, or if they have ``MIN_TOKENS`` tokens or more and an edit similarity of 0.8 or more. The latter are looked for by SimHash: 64 bits,
each the majority of its distinct tokens' hashes. Edits of that size flip some 13 bits, so equal runs of these bits (3 of 64 may differ in four blocks)
find next to nothing. The pigeonholes are therefore made of the tokens: they fall into classes by hash, each class has a
SimHash of its own, and these are the blocks that lines meet by. An edit of a token touches two classes at most, so with
k classes lines that (k - 1) / 2 edits part meet surely, and others by chance; lines of few tokens have their first and last half as blocks.

1. Equal lines: each block of texts sends a line once, for its first occurrence; others of the block are dropped at
   once. A window over the few that remain finds the first occurrence of each distinct line.
2. Distinct lines meet by block; in a group each is held against the group's first line and the two before it, if their
   SimHashes differ in ``BITS`` bits at most. Edit similarity verifies them, links make components; groups that still
   span several compare the rest of their pairs, those of different components within ``BITS`` bits; a large group in parts.
3. Of each component the first occurrence stays, in the order of (doc_id, hash of the text, line number).

Defined cases: null and empty texts and an empty table have no lines to remove; a row is known by its id and its text, so rows of one id and
other texts are documents of their own, and repeated rows are one document, which keeps its lines in each; rows without an id
stay whole; ties go to the smaller line number. Lines of any length take part, and what meets is judged by the exact distance (its time is the
square of the length; beyond ``LONG`` characters only the band of the table that a near pair can reach is computed). Other columns pass through
``dedup_documents``; columns that are named like its two counts are replaced.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm import kernels
from tessera.llm.common import blocks, sized_semi_join, staged
from tessera.llm.components import connected_components, extended
from tessera.llm.kernels import U64

#: Tokens that a line needs for the fuzzy step; least edit similarity, as a share of 5.
MIN_TOKENS, ALIKE = 4, 4
#: Bits in which SimHashes of near lines may differ.
BITS = 20
#: (least tokens, tokens it ends at, classes); they overlap, so lines on both sides of a bound meet.
CLASSES = [(12, 30, 4), (24, 160, 6), (128, 1 << 60, 12)]
#: Lines of fewer tokens have halves as blocks.
HALVES = 15
#: Tokens that a block needs.
BLOCK_TOKENS = 2
#: Characters from which the edit distance is computed in a band, and members of a group that one task compares.
LONG, PART = 2_000, 4096

_TOKEN = kernels.IS_WORD.copy()
_TOKEN[list(string.punctuation.encode())] = False
_FIRST, _SECOND, _SIM = (U64(int(x) | 1) for x in np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 63, 3))


def normalised(line: bytes) -> bytes:
    """What lines are compared by."""
    return b" ".join(line.lower().split())


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens; a character of a script without blanks is one."""
    inside = _TOKEN[data]
    starts = inside & ~np.concatenate([[False], inside[:-1]])
    # lead bytes E3 and above: kana, Chinese, Hangul and beyond; E0 B8 to E0 BB: Thai and Lao
    apart = data >= 0xE3
    apart[:-1] |= (data[:-1] == 0xE0) & (data[1:] >= 0xB8) & (data[1:] <= 0xBB)
    if apart.any():
        lead = inside & ((data < 0x80) | (data >= 0xC0))
        at = np.flatnonzero(lead)
        own = apart[at]
        begins = own.copy()
        begins[1:] |= own[:-1]
        starts[at[begins]] = True
    begin = np.flatnonzero(starts)
    ends = np.append(np.flatnonzero(inside[:-1] & ~inside[1:]) + 1, np.zeros(0, np.int64))
    ends = ends[np.searchsorted(ends, begin, "right")] if len(begin) else begin
    return begin, np.minimum(ends, np.append(begin[1:], len(data))) if len(begin) else begin


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


#: For each byte, its bits as eight lanes of eight bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(U64).reshape(-1)


def _majority(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each run of 64-bit values: bits that more than half of them have. Bits are summed in lanes, 255 values at a time."""
    if not len(first):
        return np.zeros(0, U64)
    size = np.diff(np.append(first, len(values)))
    pieces = -(-size // 255)
    at = np.cumsum(pieces) - pieces
    starts = np.repeat(first - 255 * at, pieces) + 255 * np.arange(pieces.sum())
    sums = np.add.reduceat(_LANES[values.view(np.uint8).reshape(-1, 8)], starts, axis=0).view(np.uint8)
    counts = sums if len(starts) == len(first) else np.add.reduceat(sums, at, axis=0, dtype=np.int32)
    return np.packbits(counts > (size // 2)[:, None], axis=1).view(U64).reshape(-1)


class Lines:
    """Lines of texts: text, number, key (128 bits), characters, tokens; ``at``: those that have a token."""

    def __init__(self, texts: list[bytes]):
        data, at = kernels.joined(texts)
        data = kernels.lower_ascii(data)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.text = np.searchsorted(at, starts, "right") - 1
        self.number = np.arange(len(starts)) - np.searchsorted(starts, at[:-1])[self.text]
        begin, end = _tokens(data)
        line_of = np.cumsum(data == 10, dtype=np.int32)
        self.token_line = line_of[begin]
        sums = kernels.prefix_sums(data)
        self.token_hash = kernels.word_hashes(data, begin, end, sums)
        self.tokens = np.bincount(self.token_line, minlength=len(starts))
        begin, end = kernels.words(data)
        end = end[: len(begin)]
        line = line_of[begin]
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else line
        place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
        factor = kernels.mix((place + 1).astype(U64) * _FIRST) | U64(1)
        h = kernels.word_hashes(data, begin, end, sums)
        del sums
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.key = np.zeros((len(starts), 2), U64)
        self.length = np.zeros(len(starts), np.int64)
        own = line[first]
        self.key[own, 0] = kernels.mix(_sums(h * factor, first))
        self.key[own, 1] = kernels.mix(_sums(kernels.mix(h ^ _SECOND) * factor, first) ^ _SECOND)
        self.length[own] = _sums(points[end] - points[begin] + 1, first) - 1
        self.at = np.flatnonzero(self.tokens > 0)

    def sketches(self, chosen: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """SimHash of each chosen line (rising places), and its blocks, none for lines of few tokens."""
        if len(chosen) >> 24:
            parts = [self.sketches(chosen[i : i + (1 << 24) - 1]) for i in range(0, len(chosen), (1 << 24) - 1)]
            return np.concatenate([sim for sim, _ in parts]), pa.concat_arrays([found for _, found in parts])
        order = np.full(len(self.tokens), -1)
        order[chosen] = np.arange(len(chosen))
        mine = order[self.token_line]
        held = np.flatnonzero(mine >= 0)
        # each token of a line counts once: (line, 40 bits of the token) as one number
        once = np.sort(mine[held].astype(U64) << U64(40) | self.token_hash[held] >> U64(24))
        once = once[np.append(True, once[1:] != once[:-1])] if len(once) else once
        line, h = (once >> U64(40)).astype(np.int64), once & U64((1 << 40) - 1)
        first = np.searchsorted(line, np.arange(len(chosen) + 1))
        n = np.diff(first)[line]
        # lines of few tokens: halves of the tokens in their order
        total = self.tokens[chosen]
        few = held[total[mine[held]] < HALVES]
        place = few - np.searchsorted(self.token_line, self.token_line[few])
        few_line, few_n = mine[few], total[mine[few]]
        line, h = np.append(line, few_line), np.append(h, self.token_hash[few] >> U64(24))
        bits = kernels.mix(h * _SIM)
        sim = _majority(bits[: len(once)], first[:-1])
        rows, codes = [], []
        for k, (low, high, classes) in enumerate(CLASSES):
            some = np.flatnonzero((n >= low) & (n < high))
            rows.append(some)
            codes.append((h[some] % U64(classes)).astype(np.int64) + 64 * k)
        for half, inside in ((few_n // 2, few_n >= MIN_TOKENS), ((few_n - 1) // 2, (few_n >= MIN_TOKENS) & (few_n % 2 == 0))):
            for last, own in ((0, place < half), (1, place >= few_n - half)):
                some = np.flatnonzero(inside & own)
                rows.append(len(once) + some)
                codes.append(512 + 2 * half[some] + last)
        row, code = np.concatenate(rows), np.concatenate(codes)
        group = line[row] * 1024 + code
        by = np.argsort(group, kind="stable")
        row, group = row[by], group[by]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
        full = np.diff(np.append(first, len(group))) >= BLOCK_TOKENS
        block = kernels.mix(_majority(bits[row], first)[full] ^ kernels.mix((group[first[full]] % 1024 + 1).astype(U64) * _FIRST))
        of = group[first[full]] // 1024
        return sim, pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(chosen) + 1)), pa.int32()), pa.array(block.view(np.int64)))


def simhashes(lines: list[bytes]) -> np.ndarray:
    """SimHash of each line (one without line feeds); 0 for lines without tokens."""
    all_ = Lines(lines)
    return all_.sketches(np.arange(len(lines)))[0] if len(all_.at) == len(lines) else np.array([simhashes([x])[0] if len(Lines([x]).at) else U64(0) for x in lines], U64)


def _unlike(a: str, b: str) -> tuple[str, str]:
    """What is left of both (b no longer than a) without their common beginning and end."""
    for _ in range(2):
        low, high = 0, len(b)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
        a, b = a[low:][::-1], b[low:][::-1]
    return a, b


def _aligned(a: str, b: str, most: int) -> bool:
    """Whether an alignment by equal words, by their numbers or greedy from the left, needs ``most`` edits or fewer."""
    wa, wb = a.split(" "), b.split(" ")
    if len(wa) == len(wb) and sum(max(len(x), len(y)) for x, y in zip(wa, wb) if x != y) <= most:
        return True
    at_b = [0]
    for w in wb:
        at_b.append(at_b[-1] + len(w) + 1)
    cost = here = last_a = next_b = 0
    for w in wa:
        if next_b < len(wb) and wb[next_b] == w:
            j = next_b
        else:
            try:
                j = wb.index(w, next_b, next_b + 9)
            except ValueError:
                j = -1
        if j >= 0:
            cost += max(here - last_a, at_b[j] - at_b[next_b])
            if cost > most:
                return False
            last_a, next_b = here + len(w) + 1, j + 1
        here += len(w) + 1
    return cost + max(here - last_a, at_b[-1] - at_b[next_b]) <= most


def _begun(a: str, b: str) -> bool | tuple[str, str, int]:
    """Whether a and b are alike, if that is soon known; else what is left of them (the longer first), and the most edits."""
    if len(a) < len(b):
        a, b = b, a
    most = len(a) * (5 - ALIKE) // 5
    if len(a) - len(b) > most:
        return False
    a, b = _unlike(a, b)
    return len(a) <= most or _aligned(a, b, most) or (a, b, most)


def _ended(a: str, b: str, most: int) -> bool:
    if (Counter(a) - Counter(b)).total() > most:
        return False
    if len(b) <= LONG:
        return _distance(a, b, most) <= most
    return any(_within(a, b, k) for k in (most // 16, most // 4, most))


def alike(a: str, b: str) -> bool:
    """Whether the Levenshtein distance is at most a fifth of the longer length."""
    found = _begun(a, b)
    return found if isinstance(found, bool) else _ended(*found)


def all_alike(pairs: list[tuple[str, str]]) -> list[bool]:
    """``alike`` of each pair."""
    found = [_begun(a, b) for a, b in pairs]
    left = [x for x in found if not isinstance(x, bool)]
    far = iter(_far(left))
    return [x if isinstance(x, bool) else not next(far) and _ended(*x) for x in found]


#: Bags that strings of three characters are counted in, and pairs that are counted at once.
BAGS, PAIRS = 2048, 16


def _far(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """Pairs (the longer first) that surely need more edits than their most: an edit takes away three strings of three characters, no more."""
    out = np.zeros(len(pairs), bool)
    for at in range(0, len(pairs), PAIRS):
        longer, shorter, most = zip(*pairs[at : at + PAIRS])
        more = _bags(longer)
        more -= _bags(shorter)
        out[at : at + PAIRS] = np.maximum(more, 0, out=more).sum(axis=1) > 3 * np.array(most)
    return out


def _bags(texts: tuple[str, ...]) -> np.ndarray:
    """How many of each text's strings of three characters fall into each bag."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(texts)) * BAGS, [len(t) for t in texts])
    bag = ((code[:-2] * np.uint32(31) + code[1:-1]) * np.uint32(31) + code[2:]) * np.uint32(2654435769) >> np.uint32(21)
    whole = own[:-2] == own[2:]
    return np.bincount((own[:-2] + bag)[whole], minlength=len(texts) * BAGS).reshape(-1, BAGS)


def _distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance by bit-parallel columns; beyond ``most`` any number beyond it."""
    n, full = len(b), (1 << len(b)) - 1
    if n == 0:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    up, down, distance, top, left = full, 0, n, 1 << (n - 1), len(a)
    for c in a:
        eq = where.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(x | up) & full, up & x
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        left -= 1
        if distance - left > most:
            return distance - left
        plus = (plus << 1 | 1) & full
        up, down = (minus << 1 & full) | ~((eq | down) | plus) & full, plus & (eq | down)
    return distance


#: Bits of the masks that ``_within`` keeps.
MASKS = 1 << 28


def _within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance (a no shorter than b) is at most ``most``; bit-parallel columns, of each only the rows that a path of so few edits can reach.

    Columns go in runs that share a window of rows. Outside the window each step counts as an edit, which no path of
    ``most`` edits needs, so distances up to ``most`` are exact. The run ends early if no row of the window can end in ``most``.
    """
    longer, n = len(a), len(b)
    spare = most - (longer - n)
    if spare < 0:
        return False
    above = spare // 2
    below = above + longer - n
    run = max(256, (above + below) // 4)
    codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = high = up = down = distance = 0
    for j in range(0, longer, run):
        piece = a[j : j + run]
        done = j + len(piece)
        up, down, low = up >> max(0, j - below) - low, down >> max(0, j - below) - low, max(0, j - below)
        new = min(n, done + above) - high
        up |= ((1 << new) - 1) << high - low
        high, distance = high + new, distance + new
        size = high - low
        window, full, top = codes[low:high], (1 << size) - 1, (1 << size) >> 1
        masks: dict[str, int] = {}
        for c in piece:
            eq = masks.get(c)
            if eq is None:
                if len(masks) * size > MASKS:
                    masks.clear()
                eq = masks[c] = int.from_bytes(np.packbits(window == ord(c), bitorder="little").tobytes(), "little")
            x = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | ~(x | up) & full, up & x
            if plus & top:
                distance += 1
            elif minus & top:
                distance -= 1
            plus = (plus << 1 | 1) & full
            up, down = (minus << 1 & full) | ~((eq | down) | plus) & full, plus & (eq | down)
        steps = [np.unpackbits(np.frombuffer(v.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size].astype(np.int64) for v in (up, down)]
        rows = distance - np.append(np.cumsum((steps[0] - steps[1])[::-1])[::-1], 0)
        if (rows + np.abs((longer - done) - (n - low - np.arange(size + 1)))).min() > most:
            return False
    return distance <= most


def edit_similarity(a: str, b: str) -> float:
    """1 - Levenshtein distance / longer length."""
    longer = max(len(a), len(b))
    return 1 - _distance(a, b, longer) / longer if longer else 1.0


#: Blocks are the bytes of 64-bit numbers: arrays cost several times as much in a shuffle and in Parquet.
_LINES = "k1 long, k2 long, sim long, length int, blocks binary, doc_id long, h long, line int, later boolean"


def _occurrences(docs: DataFrame, min_tokens: int) -> DataFrame:
    """A row for each first occurrence within a block of texts, and (``later``) for the others, which are to be dropped; docs: doc_id, h, text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            ids, h = (part.column(k).to_numpy() for k in range(2))
            order = np.lexsort((h, ids))
            ids, h = ids[order], h[order]
            new = np.append(True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1]))
            ids, h = ids[new], h[new]
            lines = Lines([texts[i] for i in order[new]])
            at = lines.at
            _, first = np.unique(lines.key[at].view([("", U64)] * 2).reshape(-1), return_index=True)
            is_first = np.zeros(len(at), bool)
            is_first[first] = True
            ones, others = at[is_first], at[~is_first]
            sim, found = lines.sketches(ones)
            if min_tokens > MIN_TOKENS:
                found = pa.array([x if n >= min_tokens else [] for x, n in zip(found.to_pylist(), lines.tokens[ones])], pa.list_(pa.int64()))
            places, m = np.append(ones, others), len(others)
            text, none = lines.text[places], np.zeros(m, np.int64)
            bytes_at = np.append(8 * found.offsets.to_numpy(), np.full(m, 8 * len(found.values), np.int32)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(bytes_at), pa.py_buffer(found.values.to_numpy().tobytes())])
            keys = lines.key[ones].view(np.int64)
            # keys of the others only spread them over the tasks
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(keys[:, 0], (lines.key[others, 0] + kernels.mix(others.astype(U64))).view(np.int64))), pa.array(np.append(keys[:, 1], none)), pa.array(np.append(sim.view(np.int64), none)),
                    pa.array(np.append(np.minimum(lines.length[ones], 2**31 - 1), none), pa.int32()), packed,
                    pa.array(ids[text]), pa.array(h[text]), pa.array(lines.number[places], pa.int32()), pa.array(np.arange(len(places)) >= len(ones)),
                ],
                names=["k1", "k2", "sim", "length", "blocks", "doc_id", "h", "line", "later"],
            )

    return docs.mapInArrow(each, _LINES)


def _close(sim: np.ndarray, n: np.ndarray, other_sim: np.ndarray, other_n: np.ndarray) -> np.ndarray:
    """Whether lines of these SimHashes and lengths may be near."""
    return (np.bitwise_count((sim ^ other_sim).view(U64)) <= BITS) & (5 * np.minimum(n, other_n) >= ALIKE * np.maximum(n, other_n))


_MEETINGS = "block long, id long, sim long, length long, mates array<long>"
#: Buckets of blocks for each task; rows that go to a bucket as one piece; rows that are dealt, and compared, at once.
BUCKETS, PIECE, DEALT = 16, 256, 1 << 18


def _dealt(lines: DataFrame, buckets: int) -> DataFrame:
    """(bucket, rows) of lines (blocks: array or bytes of 64-bit numbers, id, sim, length): a block's rows (block, id, sim, length) in pieces of 64-bit numbers, as single rows cost many times as much to shuffle."""

    def pieces(rows: np.ndarray) -> pa.RecordBatch:
        bucket = rows[:, 0].view(U64) % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order].astype(np.int32)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        starts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(starts, np.append(starts[1:], len(rows)))])
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array([x.tobytes() for x in np.split(rows, starts[1:])], pa.binary())], names=["bucket", "rows"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            found = batch.column(0)
            if pa.types.is_binary(found.type):
                size = pc.binary_length(found).to_numpy() // 8
                found = np.frombuffer(b"".join(found.to_pylist()), np.int64)
            else:
                size, found = found.value_lengths().to_numpy(), found.flatten().to_numpy()
            own = (np.repeat(batch.column(k).to_numpy(), size) for k in range(1, 4))
            held.append(np.stack([found, *own], axis=1))
            n += len(held[-1])
            if n >= DEALT:
                yield pieces(np.concatenate(held))
                held, n = [], 0
        if n:
            yield pieces(np.concatenate(held))

    return lines.select("blocks", "id", "sim", F.col("length").cast("long")).mapInArrow(each, "bucket int, rows binary")


def _meetings(lines: DataFrame) -> DataFrame:
    """Lines (blocks, id, sim, length) of blocks with several, with their near ones among the block's first line and the two before, in any order."""

    def compared(rows: np.ndarray, n_kept: int) -> tuple[pa.RecordBatch, np.ndarray]:
        """What ``rows`` give, the first ``n_kept`` of which are the first and the last two of the blocks so far, and the rows to keep for the next."""
        order = np.argsort(rows[:, 0], kind="stable")
        rows, fresh = rows[order], order >= n_kept
        block, ids, sim, n = rows.T
        at = np.arange(len(rows))
        head = np.append(True, block[1:] != block[:-1])
        first = np.maximum.accumulate(np.where(head, at, 0))
        # a block's first line goes out with its second
        second = fresh & (at == first + 1)
        out = fresh & (at > first)
        mates = np.full((len(rows), 3), -1, np.int64)
        for k, back in enumerate((at - first, np.ones_like(at), np.full_like(at, 2))):
            other = at - back
            ok = out & (other >= first) & ((k == 0) | (other > first))
            i, j = at[ok], other[ok]
            near = _close(sim[i], n[i], sim[j], n[j])
            mates[i[near], k] = ids[j[near]]
        pick = np.concatenate([at[second] - 1, at[out]])
        found = mates[pick]
        there = found >= 0
        last = np.append(head[1:], True)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(rows[pick, k]) for k in range(4)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(there.sum(axis=1))), pa.int32()), pa.array(found[there]))], names=["block", "id", "sim", "length", "mates"]
        ), rows[head | last | np.append(last[1:], False)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 4), np.int64)
        kept, held, n, now = none, [], 0, None
        for batch in batches:
            for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                if n and (bucket != now or n >= DEALT):
                    out, kept = compared(np.concatenate([kept, *held]), len(kept))
                    yield out
                    held, n = [], 0
                if bucket != now:
                    kept, now = none, bucket
                held.append(np.frombuffer(rows.as_buffer(), np.int64).reshape(-1, 4))
                n += len(held[-1])
        if n:
            yield compared(np.concatenate([kept, *held]), len(kept))[0]

    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _dealt(lines, BUCKETS * tasks).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, _MEETINGS)


def _rest(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within ``BITS`` bits inside each group of (block, members, id, sim, length, component).

    A group of more than ``PART`` members is dealt into parts, and each two parts of it go to a task.
    """

    def each(table: pa.Table) -> pa.Table:
        columns = [table.column(k).to_numpy() for k in ("block", "x", "y", "part", "id", "sim", "length", "component")]
        order = np.lexsort(columns[3::-1])
        block, x, y, part, ids, sim, n, own = (c[order] for c in columns)
        cuts = np.append(np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))), len(block))
        left, right = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            middle = a + int(np.searchsorted(part[a:b], y[a])) if x[a] < y[a] else a
            for i in range(a, middle if x[a] < y[a] else b - 1):
                others = slice(max(i + 1, middle), b)
                hits = others.start + np.flatnonzero(_close(sim[i], n[i], sim[others], n[others]) & (own[i] != own[others]))
                left += [ids[i]] * len(hits)
                right += ids[hits].tolist()
        left, right = np.array(left, np.int64), np.array(right, np.int64)
        return pa.table({"a": np.minimum(left, right), "b": np.maximum(left, right)})

    parts = F.ceil(F.col("members") / F.lit(PART)).cast("int")
    dealt = groups.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other"))
    buckets = 4 * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("block", "x", "y", "part", "id", "sim", "length", "component", F.pmod(F.xxhash64("block", "x", "y"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(each, "a long, b long").distinct()


def _links(pairs: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of lines (id, doc_id, h, line) those of sufficient edit similarity; docs: doc_id, h, text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, whole in blocks(batches):
            ids, out = [], []
            for t, wanted in zip(whole, part.column("wanted").to_pylist()):
                own = t.split(b"\n")
                ids += [w["id"] for w in wanted]
                out += [normalised(own[w["line"]]).decode("utf-8", "replace") for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "text"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()))
            yield batch.select(["a", "b"]).filter(pa.array(all_alike(both), pa.bool_()))

    wanted = lines.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    wanted = staged(wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("id", "line")).alias("wanted")), "line-wanted")
    found = sized_semi_join(docs, wanted.select("doc_id", "h"), on=["doc_id", "h"]).hint("merge").join(wanted, ["doc_id", "h"]).select("text", "wanted")
    found = staged(found.mapInArrow(texts, "id long, text string"), "line-texts")
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(found.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(both.select("a", "b", "ta", "tb").repartition(tasks, "a", "b").mapInArrow(judged, "a long, b long"), "line-links")


def dropped_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, h, line) of every line but the first occurrence of each connected group; docs: doc_id, h, text. ``min_tokens`` bounds the fuzzy step only."""
    docs = docs.filter("doc_id is not null").select("doc_id", "h", "text")
    same, place = Window.partitionBy("k1", "k2"), F.struct("doc_id", "h", "line")
    seen = _occurrences(docs, min_tokens).withColumn("first", F.min(F.when(~F.col("later"), place)).over(same))
    seen = seen.withColumn("later", F.col("later") | (place > F.col("first"))).drop("first", "k1", "k2").withColumn("id", F.monotonically_increasing_id())
    seen = staged(seen, "line-occurrences")
    lines = seen.filter("not later and octet_length(blocks) > 0")
    met = staged(_meetings(lines), "line-meetings")
    pairs = staged(met.filter("size(mates) > 0").select(F.explode("mates").alias("mate"), "id").select(F.least("mate", "id").alias("a"), F.greatest("mate", "id").alias("b")).distinct(), "line-pairs")
    # all that follows is about lines that met others: a small part of all
    of = staged(sized_semi_join(lines.select("id", "doc_id", "h", "line"), staged(met.select("id").distinct(), "line-met"), on="id"), "line-places")
    if not docs.groupBy("doc_id", "h").count().filter("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "h"])
    links = _links(pairs, of, docs)
    found = connected_components(links)
    # the first line and two before each are all pairs of up to four members
    members = F.count(F.lit(1)).over(Window.partitionBy("block"))
    several = met.withColumn("members", members).filter("members > 4").select("block", "members", "id", "sim", "length").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = several.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("block")
    rest = staged(_rest(several.join(open_, "block")).join(pairs, ["a", "b"], "left_anti"), "line-rest")
    if not rest.isEmpty():
        found = extended(found, _links(rest, of, docs))
    members = found.join(of, "id")
    first = members.groupBy("component").agg(F.min(place).alias("first"))
    fuzzy = members.join(first, "component").filter(place > F.col("first")).select("doc_id", "h", "line")
    return seen.filter("later").select("doc_id", "h", "line").union(fuzzy)


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    def rest(text: str, lines: list[int]) -> str:
        out = set(lines)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)

    return pa.array((rest(t.as_py(), g.as_py()) for t, g in zip(texts, gone)), pa.string(), size=len(texts))


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The rows with repeated lines taken out of the text; adds ``counts``: lines before, and removed ones."""
    n_lines, n_removed = counts
    columns = [*(c for c in docs.columns if c not in counts), *counts]
    keyed = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__h", F.xxhash64(text_col))
    gone = dropped_lines(keyed.select(F.col("__id").alias("doc_id"), F.col("__h").alias("h"), F.col(text_col).alias("text")), min_tokens)
    gone = staged(gone.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set("line").alias("__gone")), "line-removed")
    keyed = keyed.withColumn(n_lines, F.coalesce(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))), F.lit(0)) + 1)
    key = ["__id", "__h"]
    # merge joins at every size: texts' plan is the same on a small table as on a large one
    cut = sized_semi_join(keyed, gone.select(*key), on=key).join(gone.hint("merge"), key)
    # a filter on what is left of a text would otherwise have Spark cut it a second time below the filter, with two Python workers for each task
    without = F.arrow_udf(_without, StringType()).asNondeterministic()
    cut = cut.withColumn(text_col, without(F.col(text_col), F.col("__gone"))).withColumn(n_removed, F.size("__gone"))
    whole = sized_semi_join(keyed, gone.select(*key), "left_anti", on=key).withColumn(n_removed, F.lit(0))
    return cut.select(*columns).union(whole.select(*columns))
