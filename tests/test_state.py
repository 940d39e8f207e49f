"""Streams with keyed state against the same over finished tables."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.streaming import state


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def brute_inventory(listings):
    """Size, etag and whether missing, of each key."""
    newest, out = max(g for g, _ in listings), {}
    for g, rows in sorted(listings):
        for key, size, etag in rows:
            out[key] = (size, etag, g < newest)
    return out


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2] + [(0, 1, 1, 2, 0, 2)])
def test_inventory_state_in_any_order(spark, tmp_path, order):
    rng = random.Random(4)
    listings = [(g, [(f"k{i}", 1 + i % 3 + (g if i % 5 == 0 else 0), f"e{i % 2}") for i in range(12) if rng.random() < 0.6]) for g in (1, 2, 3)]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    seen = set()
    for n, at in enumerate(order):
        g, rows = listings[at]
        put(spark, [(g, k, s, e, None) for k, s, e in rows], state.LISTED, source)
        seen.add(at)
        if n in (1, len(order) - 1):  # stopped in between, and gone on from the checkpoint
            changes = state.run_changes(spark, source, out, check, files_per_batch=1)
            got = {r.key: (r.size, r.etag, r.deleted) for r in state.current(changes).collect()}
            assert got == brute_inventory([listings[i] for i in seen])
    before = changes.count()
    put(spark, [(2, k, s, e, None) for k, s, e in listings[1][1]], state.LISTED, source)  # the same again
    again = state.run_changes(spark, source, out, check, files_per_batch=1)
    assert again.count() == before


def test_publications_with_errors(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for run in range(4):
        n = 9 + run
        rows += [(run, i, "failed" if rng.random() < 0.4 else None, i == n - 1) for i in range(n)]
    expected = []
    for run in range(4):
        done = 0
        for _, i, error, last in [r for r in rows if r[0] == run]:
            done += error is None
            if done and done % 3 == 0:
                expected.append((run, i, done, "multiple"))
            if last:
                expected.append((run, i, done, "end"))
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for lo, hi in ((0, 4), (4, 7), (7, 99)):
        put(spark, [r for r in rows if lo <= r[1] < hi][::-1], state.RESULT, source)
    got = state.run_publications(spark, source, out, check, 3, files_per_batch=1)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    whole = spark.createDataFrame(rows, state.RESULT)
    assert sorted(tuple(r) for r in state.publication_points(whole, 3).select(*[F.col(c) for c in ("run", "ordinal", "completed", "reason")]).collect()) == sorted(expected)
    # an error right after a multiple publishes again
    assert any(a[:1] + a[2:] == b[:1] + b[2:] and a[3] == "multiple" for a, b in itertools.pairwise(sorted(expected)))
