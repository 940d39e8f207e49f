"""Frame sets against all pairs, in blocks of several sizes."""

import random
from itertools import combinations

import pytest

from tessera.functions import hashes
from tessera.operators import framesets, hamming, matching

SCHEMA = "key string, sha256 string, vpdq array<struct<h: string, q: int, t: bigint>>"


def table(spark, rows):
    return spark.createDataFrame([(k, s, None if f is None else [(h, q, n) for n, (h, q) in enumerate(f)]) for k, s, f in rows], SCHEMA)


def rows_of(rng):
    hexed = lambda: f"{rng.getrandbits(256):064x}"
    near = lambda h, n: f"{int(h, 16) ^ sum(1 << b for b in rng.sample(range(256), n)):064x}"
    common, rows = hexed(), []
    for i in range(60):
        f = [(hexed(), rng.choice([10, 35, None])) for _ in range(rng.randint(1, 12))]
        if i % 2:
            f.append((common[:62] + f"{i % 7:02x}", 90))
        if i % 3 == 0 and rows:
            f += [(near(h, rng.randint(0, 50)), q) for h, q in rng.choice(rows)[2] if len(h) == 64]
        if i % 10 == 7:
            f = [(near(h, rng.randint(0, 20)), q) for h, q in rows[-1][2] if len(h) == 64]
        if i % 9 == 0:
            f += [("", 90), (f[0][0].upper(), 90), ("ab12", 90), (f[0][0] + "77", 40)]
        rows.append((f"k{i * 7 % 60:02}", None if i % 4 == 0 else "" if i % 4 == 1 else f"s{i // 9}", f))
    return [*rows, ("none", "s", None), ("empty", "s", [])]


def brute(rows, distance, share):
    sets = {}
    for key, sha, f in rows:
        listed = [(h, 100 if q is None else q) for h, q in f or [] if h]
        good = {h for h, q in listed if q >= 35}
        tokens = {(b, int(h[4 * b : 4 * b + 4], 16)) for h in good for b in range(16) if h[4 * b : 4 * b + 4]}
        sets[key] = (sha, max(1, min(8, -(-len(listed) // 5))), tokens, good)
    close = lambda x, y: len(x) >= 64 and len(y) >= 64 and (int(x[:64], 16) ^ int(y[:64], 16)).bit_count() <= distance
    seeds, found = {}, {}
    for left, right in combinations(sorted(sets), 2):
        (s, n, t, g), (s2, n2, t2, g2) = sets[left], sets[right]
        if len(t & t2) >= min(n, n2) and not (s and s == s2):
            seeds[left, right] = (len(t & t2), min(n, n2))
            ml, mr = (sum(any(close(x, y) for y in b) for x in a) for a, b in ((g, g2), (g2, g)))
            if min(ml / len(g), mr / len(g2)) >= share and ml:
                found[left, right] = (ml, len(g), mr, len(g2))
    return seeds, found


@pytest.mark.parametrize("block", [7, 1_000])
@pytest.mark.parametrize("slider", [0, 60, 99])
def test_blocks_give_all_pairs(spark, block, slider):
    rows, limit = rows_of(random.Random(slider)), hashes.limits(slider)
    seeds, found = brute(rows, limit["vpdq_distance"], limit["vpdq_match"])
    a = table(spark, rows)
    assert len(seeds) > 300 and found
    assert {(r.left, r.right): (r.shared, r.required) for r in framesets.candidates(a, block).collect()} == seeds
    got = framesets.matched(a, int(limit["vpdq_distance"]), limit["vpdq_match"], block).collect()
    assert {(r.left, r.right): (r.ml, r.nl, r.mr, r.nr) for r in got} == found and len(got) == len(found)


def test_pairs_are_neither_shuffled_nor_broadcast(spark):
    a = table(spark, rows_of(random.Random(5)))
    for df in (matching.vpdq_candidates(a), matching.vpdq_stage(a, 99)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1
    assert matching.vpdq_candidates(a.filter("vpdq is null")).isEmpty()


@pytest.mark.parametrize("count,radius", [(2, 6), (2, 18), (8, 23), (8, 48), (8, 140), (3, 40)])
def test_hashes_in_blocks_give_all_pairs(spark, monkeypatch, count, radius):
    monkeypatch.setattr(hamming, "SMALL_BLOCK", 20)
    rng = random.Random(radius)
    values = [rng.getrandbits(32 * count) for _ in range(60)]
    values += [v ^ sum(1 << b for b in rng.sample(range(32 * count), rng.randrange(1, min(2 * radius, 60)))) for v in values]
    values = list(dict.fromkeys(values))
    lanes = lambda v: [v >> 32 * (count - 1 - k) & 0xFFFFFFFF for k in range(count)]
    held = spark.createDataFrame([(i, lanes(v)) for i, v in enumerate(values)], "id long, h array<long>")
    df = hamming.block_pairs(held, len(values), count, radius)
    got = sorted((min(r.x, r.y), max(r.x, r.y), r.distance) for r in df.collect())
    assert got == [(i, j, d) for i, j in combinations(range(len(values)), 2) if (d := (values[i] ^ values[j]).bit_count()) <= radius] and got
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_million_hashes_are_compared_in_blocks():
    assert not hamming.plan(1_200_000, [600_000] * 64, 18, matching.NESTED_LOOP_ROWS).bands
    assert not hamming.plan(1_200_000, [600_000] * 256, 23, matching.NESTED_LOOP_ROWS).bands
    assert hamming.plan(1_000_000_000, [500_000_000] * 64, 3, matching.NESTED_LOOP_ROWS).bands
