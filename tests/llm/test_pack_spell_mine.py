"""Packing, spelling variants and hard negatives against brute force, the library and SQL."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
from tessera.llm import hard_negatives, oracles, packing, queries, spelling  # noqa: E402

DATA = os.environ.get("TESSERA_TESTDATA", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({"length": F.lit("clash"), "n": F.lit(None).cast("string"), "word": F.lit(1), "h": F.lit(2), "__item": F.lit(3)})


@given
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    expected, got = duck.sql(oracles.ORACLES[name]), queries.QUERIES[name](spark, DATA)
    assert sorted(expected.columns) == sorted(got.columns)
    found = sorted((tuple(r[c] for c in expected.columns) for r in got.collect()), key=repr)
    assert found and found == sorted(expected.fetchall(), key=repr)


# 11 Spelling variants ------------------------------------------------------------------------------------------------

def brute_variants(rows, least_n=2, ratio=10):
    count = collections.Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    vocab = {w: n for w, n in count.items() if len(w) >= 7 and n >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in vocab.items():
        others = sorted((-m, x) for x, m in vocab.items() if abs(len(x) - len(w)) <= 1 and near(w, x))
        if others and -others[0][0] >= ratio * n:
            form[w] = others[0][1]
        out[w] = (form.get(w), n, len(others), vocab[form[w]] if w in form else None)

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def variants(df, **how):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, **how).collect()}


def spelled():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 12))) for _ in range(40)] + ["mississippi", "bookkeeper", "aaaaaaaaa", "Überraschung"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.1)), len(stems) - 1)]
            while rng.random() < 0.25:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abcxÿ") + w[p:], w[:p] + rng.choice("abcx÷") + w[p + 1 :]])
            words.append(w if rng.random() < 0.9 else w.upper())
        rows.append((i, ", ".join(words)))
    long = "z" * 3000
    rows += [(1000, None), (1001, ""), (1002, f"{long} {long}y {long}y"), (1003, f"{long} {long[1:]} {long[1:]}"), (None, "without an identity"), (None, "without an identity"), (5, rows[5][1])]
    return rows


def test_spelling_variants_brute_force(spark):
    rows = spelled()
    expected = brute_variants(rows)
    assert variants(frame(spark, rows)) == expected
    assert sum(f is not None for f, *_ in expected.values()) > 50 and any(r != f for f, r, *_ in expected.values() if f)
    # a filter of 200 bytes: many passes over hash segments, the same rows
    assert variants(frame(spark, rows), filter_bytes=200) == expected
    assert variants(frame(spark, rows).limit(0)) == {}


def test_filters_pass_few_others_and_all_members(spark):
    rng = np.random.default_rng(5)
    own, other = rng.integers(0, (1 << 64) - 1, (2, 50_000), dtype=np.uint64)
    filters = spelling.Filters({9: len(own)}, 1)
    words = np.zeros(filters.size, np.uint64)
    for shift in spelling.FIELDS:
        np.bitwise_or.at(words, filters.slot(9, own), np.uint64(1) << ((own >> np.uint64(shift)) & np.uint64(63)))
    assert len(filters.held(words, 9, own)) == len(own) and len(filters.held(words, 9, other)) < 0.02 * len(other)
    assert len(filters.held(words, 10, own)) == 0 and filters.size * 8 <= 2 * len(own) + 8


# 12 Best-fit packing --------------------------------------------------------------------------------------------------

def packable():
    rng = random.Random(11)
    odd = ["<|endoftext|> in a text<|endoftext|>", "it's they'll ¼ ²³ naïve\x85\xa0 \x1c x", "日本語のテキスト and more", "  \n\n \t x  ", "é" * 3000, "word " * 5000, "😀 emoji ſ ĳ ǅ"]
    texts = [None, "", *odd] + [" ".join(f"w{rng.randrange(3000)}" for _ in range(int(rng.expovariate(1 / 120)))) for _ in range(400)]
    return [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(3, texts[5]), (3, texts[5])]


@pytest.mark.parametrize(("limit", "shard"), [(2048, packing.SHARD_ITEMS), (2048, 40), (128, 100)])
def test_packing(spark, limit, shard):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = packable()
    got = packing.packed(packing.pieces(frame(spark, rows), limit), limit, shard)
    found = got.collect()
    expected = collections.Counter()
    for id_, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            data = np.asarray(ids[a:b], "<u4").tobytes()
            expected[(id_, k, a, b - a, zlib.crc32(data), data)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in found) == expected
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    least = math.ceil(sum(r.length for r in found) / limit)
    # shards of 40 pieces leave more sequences open, and packing them again brings the number down
    assert len(by) <= least * (1.02 if shard > 1000 else 1.12) + 2
    whole = {r.sequence_id: (r.length, len(r.ids) // 4) for r in packing.sequences(got).collect()}
    assert whole == {s: (sum(n for _, n in parts),) * 2 for s, parts in by.items()}


def test_packing_of_pieces_that_never_fit_together(spark):
    items = spark.range(300).select(F.col("id").alias("item"), F.lit(1500).cast("long").alias("length"))
    assert packing.placed(items, 2048, 50).select("sequence_id").distinct().count() == 300
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(packing.pieces(empty)).count() == 0


def test_a_shard_is_packed_nearly_full():
    rng = np.random.default_rng(2)
    sizes = np.sort(np.clip(rng.lognormal(6, 1, 8000).astype(np.int64), 1, 2047))[::-1]
    into, offset = packing.pack_shard(np.arange(len(sizes)), sizes, 2048)
    used = np.bincount(into, weights=sizes)
    assert used.max() <= 2048 and (used > 0).sum() <= -(-sizes.sum() // 2048) + 5


# 13 Hard negatives ------------------------------------------------------------------------------------------------------

def brute_negatives(rows):
    kept = []
    for id_, v, label in rows:
        if id_ is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((id_, (label + 1) % 10 if id_ % 7 == 0 else label, [max(-(1 << 26), min((1 << 26) - 1, math.floor(256 * float(np.float32(x))))) for x in v]))
    out = []
    for id_, label, v in kept:
        if id_ % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i, m) for i, m, w in kept)
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != id_][:5]:
            fits = [(t, i) for t, i, m in scored if m != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(id_, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    monkeypatch.setattr(hard_negatives, "CELL", 2)
    monkeypatch.setattr(hard_negatives, "ZONES", 4)
    monkeypatch.setattr(hard_negatives, "READ", 5)
    monkeypatch.setattr(hard_negatives, "HITS", 64)
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(1, 900):
        c = centres[i % 5]
        rows.append((i, [x + rng.gauss(0, 0.2) for x in c], i % 5 if rng.random() < 0.8 else rng.randrange(10)))
    copy = rows[99][1]
    rows += [(1000 + i, copy, i % 3) for i in range(120)]  # ties
    rows += [(5000, None, 1), (5001, [1.0, None], 1), (5100, [float("nan")] * 6, 2), (5200, [1.0, float("inf")], 2), (5300, [0.5] * 6, None), (None, copy, 1), (5400, [], 3), (5500, [0.5, 0.5], 3), (5600, [1e6, -1e6, 0.1], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).withColumns({"v": F.lit("x"), "block": F.lit(1), "key": F.lit(2), "rank": F.lit(3)})
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df).collect())
    expected = brute_negatives(rows)
    assert got == expected and len({r[0] for r in got}) > 10
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_hilbert_neighbours_and_bounds():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hard_negatives.hilbert_keys(cells, 3)
    order = np.lexsort(keys.T[::-1])
    assert len(np.unique(keys, axis=0)) == 512 and (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()
    rng = np.random.default_rng(1)
    points, anchors = rng.integers(-300, 300, (40, 5)).astype(np.int32), rng.integers(-300, 300, (7, 5)).astype(np.int32)
    least, most = hard_negatives.bounds(anchors, points.min(0)[None], points.max(0)[None])
    inner = hard_negatives.products(anchors, points)
    assert (least <= inner).all() and (inner <= most).all()
    large = np.full((2, 3), 1 << 26, np.int32)
    assert hard_negatives.products(large, large)[0, 0] == 3 << 52
