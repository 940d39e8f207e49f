"""Best-fit packing of token pieces into sequences of a fixed length, by the sum of squares.

Texts become ids (the tokenizers library's), an end id closes each document, and a document longer than a sequence is
cut into pieces from its end, so only its first piece may be shorter. A piece goes where the sum, over all residual gaps, of the
squared count of open sequences with that gap becomes least; opening a sequence is one of the choices.
That keeps every gap about equally common, so some open sequence fits nearly every piece.

Pieces are dealt into shards of a bounded number of pieces by a hash, so each task packs one shard whatever the table's
size and no group grows with a source or a group of copies. What a shard leaves open is packed again as if it
were pieces, in rounds over ever fewer shards, until one shard holds what is left. Full pieces are sequences at once.

Pre-tokenisation of texts below U+0250 is one pattern with its character classes spelled out, whose slices are looked up among
those that the library has encoded before; other texts go to the library whole. Both give the library's ids.

Defined cases: null and empty texts are the end id alone; rows without an id and repeated rows are packed like any other, row by row; an empty table gives
no rows; texts are encoded whole, however long; the string of a special token inside a text is that token, as the
library has it; columns besides id and text are ignored, whatever their names. Ties between gaps go to the smaller gap, then to the sequence opened last.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Remembered, blocks, kept, map_texts, staged

LIMIT, END = 2048, 0
#: Pieces that one task packs, and those below which one shard does the rest.
SHARD_ITEMS = 16_384
#: Texts whose characters all lie below are split by the spelled-out pattern.
PLAIN = 0x250


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _plain_pattern() -> re.Pattern:
    """The byte-level pre-tokeniser's pattern for characters below ``PLAIN``; \\s is Unicode's white space, not Python's."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    blank = "\t\n\x0b\x0c\r \x85\xa0"
    letters, numbers = kinds["L"], kinds["N"]
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{blank}{letters}{numbers}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


class IdEncoder:
    """Texts to the bytes of their ids (unsigned, 32 bits, little-endian)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.unusual, self.pattern = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]"), _plain_pattern()
        self.known = Remembered(self.merged, 300_000)
        # byte-level vocabularies write each byte as a character: printable ones as themselves, the others from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.written = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*printable}))}

    def by_library(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, piece: str) -> bytes:
        """The library's ids of one slice of the pre-tokeniser."""
        return array("I", [t.id for t in self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.written))]).tobytes()

    def encode(self, text: str) -> bytes:
        if self.unusual.search(text):
            return self.by_library(text)
        if self.split_special and self.split_special.search(text):
            return b"".join(np.asarray([self.special[x]], "<u4").tobytes() if i % 2 else self.encode(x) for i, x in enumerate(self.split_special.split(text)))
        return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))


@kept
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


def pieces(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None, end: int = END, ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, the piece's ids (binary, unsigned 32 bits, little-endian)."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = id_encoder(path), np.asarray([end], "<u4").tobytes()
        for part, texts in blocks(batches):
            rows, number, starts, lengths, sums, held = [], [], [], [], [], []
            for row, text in enumerate(texts):
                data = memoryview(encoder.encode(text.decode()) + closing)
                n = len(data) // 4
                at = [0, *range(n % limit or limit, n + 1, limit)]
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    own = data[4 * a : 4 * b]
                    for to, x in ((rows, row), (number, k), (starts, a), (lengths, b - a), (sums, zlib.crc32(own))):
                        to.append(x)
                    if ids:
                        held.append(bytes(own))
            columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(held, pa.binary())] if ids else [])], names=[*names, *(["ids"] if ids else [])])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(source, cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else ""), "doc_id", "text")


def pack_shard(items: np.ndarray, lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item the item that opened its sequence, and the offset there; items come longest first.

    Once the open gaps hold as much as all that is left, a sequence is opened only where nothing fits.
    """
    counts = np.zeros(limit + 1)  # open sequences by gap
    counts[0] = -0.5  # a sequence without a gap is closed: its square does not count
    opened: list[list[int]] = [[] for _ in range(limit + 1)]
    into, offset = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
    left, room = int(lengths.sum()), 0
    for i, (item, size) in enumerate(zip(items.tolist(), lengths.tolist(), strict=True)):
        here = counts[size:limit]
        change = np.where(here > 0, counts[: limit - size] - here, np.inf)  # half the change of the sum of squares, less 1
        best = int(change.argmin()) if size < limit else 0
        if size < limit and change[best] < np.inf and (room >= left or change[best] <= counts[limit - size] - 0.5):
            gap = size + best
            counts[gap] -= 1
            first = opened[gap].pop()
        else:
            gap, first, room = limit, item, room + limit
        into[i], offset[i] = first, limit - gap
        if gap > size:
            counts[gap - size] += 1
            opened[gap - size].append(first)
        left, room = left - size, room - size
    return into, offset


def _round(open_: DataFrame, limit: int, shards: int) -> DataFrame:
    """item, into, at: where each of the items (item, length) goes; a shard is the partition that a hash deals it to."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        whole = pa.Table.from_batches(held)
        into, at = pack_shard(whole["item"].to_numpy(), whole["length"].to_numpy(), limit)
        for start in range(0, len(into), 1 << 16):
            part = slice(start, start + (1 << 16))
            yield pa.RecordBatch.from_arrays([whole["item"].combine_chunks()[part], pa.array(into[part]), pa.array(at[part])], names=["item", "into", "at"])

    dealt = open_.select("item", "length").withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    # a partition may hold several shards; that only makes it pack better
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions(F.desc("length"), "item").select("item", "length")
    return staged(dealt.mapInArrow(packed, "item long, into long, at long"), "packing-round")


def placed(items: DataFrame, limit: int = LIMIT, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """item, sequence_id, offset of items (item: unique long, length: from 1 to ``limit``)."""
    own = items.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = items.filter(F.col("length") < limit).select("item", "length")
    n, found = open_.count(), None
    while n:
        shards = -(-n // shard_items)
        went = _round(open_, limit, shards)
        if found is None:
            found = went.select("item", F.col("into").alias("sequence_id"), F.col("at").alias("offset"))
        else:  # items ride along with the sequence they are in
            moved = found.join(went.withColumnRenamed("item", "sequence_id"), "sequence_id", "left")
            found = staged(moved.select("item", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset")), "packing-found")
        if shards == 1:
            break
        filled = went.join(open_, "item").groupBy(F.col("into").alias("item")).agg(F.sum("length").alias("length")).filter(F.col("length") < limit)
        filled = staged(filled, "packing-open")
        least = filled.agg(F.min("length")).first()[0] or 0
        open_ = filled.filter(F.col("length") + least <= limit)  # the others cannot take any more
        before, n = n, open_.count()
        if n >= before:  # no two of a shard's items went together
            break
    return own if found is None else own.join(found.select("item"), "item", "left_anti").unionByName(found)


def packed(cut: DataFrame, limit: int = LIMIT, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, gapless from 0 in each sequence."""
    numbered = staged(cut.withColumn("__item", F.monotonically_increasing_id()), "packing-pieces")
    where = placed(numbered.select(F.col("__item").alias("item"), "length"), limit, shard_items)
    return numbered.join(where.withColumnRenamed("item", "__item"), "__item").drop("__item")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, length and ids (binary) of whole sequences, from packed pieces with their ids; a group is one sequence, so it is bounded."""
    grouped = packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", "length", F.aggregate(F.col("parts.ids"), F.lit(b"").cast("binary"), lambda kept, x: F.concat(kept, x)).alias("ids"))
