"""Media operators with stand-in decoders, and the upload batches."""

import hashlib

from pyspark.sql import functions as F

from tessera.operators import media
from tessera.sources.tables import Snapshots, list_objects, read_bytes
from tessera.streaming import scan


def test_fingerprints_and_errors(spark):
    def decode(content, extension):
        if extension == "bad":
            raise ValueError("x" * 5000)
        return {"phash": content[:8].hex(), "width": len(content), "vpdq_hashes": [{"h": "ab", "q": 1, "t": 0}]}

    rows = spark.createDataFrame([("a", bytearray(b"12345678"), "jpg"), ("b", bytearray(b"q"), "bad"), ("c", None, "jpg")], "key string, content binary, extension string")
    got = {r.key: r for r in media.fingerprints(rows, decode).collect()}
    assert (got["a"].sha256, got["a"].phash, got["a"].width, got["a"].scan_error) == (hashlib.sha256(b"12345678").hexdigest(), b"12345678".hex(), 8, None)
    assert got["b"].sha256 and len(got["b"].scan_error) == 1000 and got["c"].sha256 is None and got["c"].scan_error


def test_frame_scores(spark):
    frames = spark.createDataFrame([("a", bytearray(b"1")), ("a", bytearray(b"22"))], "key string, content binary")
    load = lambda: lambda contents: [{"len": float(len(c))} for c in contents]
    assert sorted(r.score for r in media.frame_scores(frames, load).collect()) == [1.0, 2.0]


def test_samples(spark):
    frames = spark.createDataFrame([("a", i, 10) for i in range(7)] + [("one", 0, 10)], "key string, idx int, delay int")
    assert sorted((r.idx, r.t) for r in media.animation_samples(frames, 3).collect()) == [(0, 0), (3, 30), (6, 60)]
    kept, since, expected = media.preview_samples(frames.filter("key = 'a'"), 3), 0, []
    for i in range(7):
        since += 20
        if i % 3 == 0:
            expected.append((i, since))
            since = 0
    assert sorted((r.idx, r.delay) for r in kept.collect()) == expected


def test_listing_and_uploads(spark, tmp_path):
    folder = tmp_path / "media"
    (folder / "d").mkdir(parents=True)
    for name, content in (("d/a.jpg", b"123"), ("d/b.TXT", b"1"), ("empty.gif", b"")):
        (folder / name).write_bytes(content)
    found = list_objects(spark, str(folder))
    assert [(r.key.rsplit("media/")[-1], r.size, r.media_type) for r in found.collect()] == [("d/a.jpg", 3, "image")]
    assert list_objects(spark, str(folder), keep_all=True).count() == 2  # Spark's file source lists no empty files
    assert {r.sha256 for r in read_bytes(spark, str(folder / "d")).collect()} == {hashlib.sha256(x).hexdigest() for x in (b"123", b"1")}
    store = Snapshots(spark, str(tmp_path / "index"))
    merge = scan.merge_uploads(store, 500)
    batch = spark.createDataFrame([(0, "a.jpg", "jpg", 1), (1, "a.jpg", "jpg", 2), (2, "b.txt", "txt", 1), (3, "c.gif", "gif", 600 * 1024 * 1024)], "ordinal long, key string, ext string, size long")
    merge(batch, 0)
    merge(batch, 0)
    assert [(r.key, r.size) for r in store.read().collect()] == [("a.jpg", 1)] and store.versions() == [1]
    assert store.read().select(F.max("ordinal")).first()[0] is not None
