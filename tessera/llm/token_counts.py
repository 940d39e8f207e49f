"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made.

A piece vocabulary (sentencepiece BPE with byte fallback) holds white space only at the
front of a piece, so a text falls into chunks - a run of spaces and what follows it - across which
no merge can reach; nor can one join two characters that no piece holds side by side. Characters that pieces
link, directly or by others, form a family, and chunks are runs of one. The count of a chunk is its symbols
minus its merges, plus what byte fallback adds; chunks repeat, so each task keeps the counts of common ones.

Null and empty texts count 0 tokens. Repeated rows and ties give equal counts row by row.
Rows pass through one by one (no shuffle), those without an id too; an empty table gives no rows; a very long text is
counted whole; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Remembered, blocks, map_texts

SPACE = "▁"


def _chunks(pieces: Iterable[str]) -> re.Pattern:
    """What matches the chunks of a text: runs of a family after spaces, other characters alone, spaces at the end."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    for piece in pieces:
        tied = piece.lstrip(SPACE)
        for a, b in zip(tied, tied[1:]):
            if (x := find(a)) != (y := find(b)):
                root[y] = x
    families: dict[str, list[str]] = {}
    for c in root:
        families.setdefault(find(c), []).append(c)
    runs = [f"{SPACE}*[{re.escape(''.join(sorted(x)))}]+" for x in families.values()]
    return re.compile("|".join([*runs, f"{SPACE}*[^{SPACE}]", f"{SPACE}+"]))


class PieceMerger:
    """Counts tokens of a piece vocabulary: ``rank`` of a piece is lower if it merges earlier."""

    def __init__(self, ranks: dict[str, float]):
        order = {r: k for k, r in enumerate(sorted(set(ranks.values())))}
        self.ranks = {piece: order[r] for piece, r in ranks.items()}
        self.single = frozenset(piece for piece in ranks if len(piece) == 1)
        self.chunks = _chunks(ranks).findall
        self.counts = Remembered(self.chunk)

    def count(self, text: str) -> int:
        """Tokens of a whole text; a space is put in front, as the library does."""
        return sum(map(self.counts.__getitem__, self.chunks(SPACE + text.replace(" ", SPACE)))) if text else 0

    def chunk(self, chunk: str) -> int:
        """Initial symbols minus merges; symbols outside the vocabulary count their UTF-8 bytes.

        The symbol that begins at i has ``size[i]`` characters (none once it is merged into the one before it, at
        ``before[i]``). The heap holds a number for each pair: its rank, then where it begins and ends.
        """
        n = len(chunk)
        rank_of, bits = self.ranks.get, n.bit_length()
        low, width = (1 << bits) - 1, 2 * bits
        heap = [r << width | i << bits | i + 2 for i in range(n - 1) if (r := rank_of(chunk[i : i + 2])) is not None]
        heapify(heap)
        size, before = [1] * n, list(range(-1, n - 1))
        tokens = n
        while heap:
            pair = heappop(heap)
            i, end = pair >> bits & low, pair & low
            if not size[i] or (j := i + size[i]) >= end or j + size[j] != end:
                continue  # one of the two was merged meanwhile
            tokens -= 1
            size[i], size[j] = end - i, 0
            if end < n:
                before[end] = i
                after = end + size[end]
                if (r := rank_of(chunk[i:after])) is not None:
                    heappush(heap, r << width | i << bits | after)
            if (h := before[i]) >= 0 and (r := rank_of(chunk[h:end])) is not None:
                heappush(heap, r << width | h << bits | end)
        if not self.single.issuperset(chunk):
            symbols = (chunk[i : i + k] for i, k in enumerate(size) if k)
            tokens += sum(len(x.encode("utf-8", "surrogatepass")) - 1 for x in symbols if x not in self.ranks)
        return tokens


@lru_cache(maxsize=2)
def piece_merger(model_path: str) -> PieceMerger:
    """Ordinary pieces of a model file; their order of merging is the order of falling scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return PieceMerger({model.id_to_piece(i): -model.get_score(i) for i in ids})


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit)."""
    path = model_path or default_model()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = piece_merger(path)
        for part, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([merger.count(t.decode("utf-8", "surrogatepass")) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(source, counted, "doc_id long, n_bytes long, n_tokens long", "doc_id", "text").withColumn("over_limit", F.col("n_tokens") > limit)
