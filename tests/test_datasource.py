"""The raw listing, published documents and the reader of the tag index."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import order, tags
from tessera.sources import datasource
from tessera.sources.datasource import Conflict, KeyRange, ListingSource, raw_listing, update_index, version_of, write_index


def put(root, name, data=b"x"):
    at = os.path.join(root, name)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "wb") as f:
        f.write(data)


def test_raw_listing_keeps_empty_objects_and_prunes_folders(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    for n, data in (("a/1.jpg", b"abc"), ("a/empty.png", b""), ("a/deep/er/2.GIF", b"ab"), ("b/3.mp4", b"a"), ("b/noext", b""), (".hidden", b""), ("top.webm", b"abcd")):
        put(root, n, data)
    got = {r.key: (r.size, r.extension, r.media_type) for r in raw_listing(spark, root).collect()}
    assert got == {
        "a/1.jpg": (3, "jpg", "image"), "a/empty.png": (0, "png", "image"), "a/deep/er/2.GIF": (2, "gif", "image"), "b/3.mp4": (1, "mp4", "video"), "b/noext": (0, "", "image"), ".hidden": (0, "hidden", "image"), "top.webm": (4, "webm", "video"),
    }
    assert raw_listing(spark, root).rdd.getNumPartitions() == 3
    pushed = raw_listing(spark, root).filter(F.startswith("key", F.lit("a/")))
    assert pushed.rdd.getNumPartitions() == 2 and pushed.count() == 3
    assert {r.key for r in raw_listing(spark, root).filter("key > 'a/z'").collect()} == {"b/3.mp4", "b/noext", "top.webm"}
    assert {r.key for r in raw_listing(spark, root).filter("key >= 'b/noext' and size = 0").collect()} == {"b/noext"}
    assert KeyRange(start="a/b").may_hold("a/") and not KeyRange(start="b").may_hold("a/") and KeyRange(after="a/b").may_hold("a/") and not KeyRange(after="b").may_hold("a/")


def test_listing_stream_goes_on_after_its_key(spark, tmp_path):
    root, out, check = str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.dataSource.register(ListingSource)

    def run():
        stream = spark.readStream.format("object_listing").option("path", root).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.key, r.size) for r in spark.read.schema(datasource.LISTING).parquet(out).collect())

    for n in ("2024/01", "2024/02"):
        put(root, n, b"")
    assert run() == [("2024/01", 0), ("2024/02", 0)]
    put(root, "2024/03", b"abc")
    put(root, "2025/01", b"a")
    assert run() == [("2024/01", 0), ("2024/02", 0), ("2024/03", 3), ("2025/01", 1)] == run()


def test_index_is_published_in_order_and_only_over_what_was_read(spark, tmp_path):
    path = str(tmp_path / "index.json")
    items = spark.range(2_000).select((F.lit(2_000) - F.col("id")).alias("ordinal"), F.format_string('k"%04d', "id").alias("key"), F.lit("jpg").alias("ext"), F.col("id").alias("size")).repartition(7)
    write_index(items, path, 5, "")
    with open(path) as f:
        document = json.load(f)
    assert (document["version"], document["generated_at"], document["count"]) == (1, 5, 2_000)
    assert document["items"] == [{"key": f'k"{i:04}', "ext": "jpg", "size": i} for i in range(1_999, -1, -1)]
    with pytest.raises(Conflict):
        write_index(items.limit(3), path, 6, "")
    with open(path) as f:
        assert json.load(f) == document
    assert os.listdir(tmp_path) == ["index.json"]

    tries = []

    def mutate(rows):
        tries.append(1)
        if len(tries) == 1:  # another writer comes first
            write_index(items.limit(1), path, 7, version_of(path))
        n = rows.count()
        return None if len(tries) > 2 else spark.createDataFrame([(0, "new", "png", n)], "ordinal long, key string, ext string, size long")

    update_index(spark, path, mutate, 8)
    with open(path) as f:
        assert json.load(f)["items"] == [{"key": "new", "ext": "png", "size": 1}] and len(tries) == 2
    stands = version_of(path)
    assert update_index(spark, path, mutate, 9) == stands
    write_index(items.limit(0), path, 10, stands)
    with open(path) as f:
        assert json.load(f)["items"] == []


def js_reader(body):
    """The reader's rule, row by row."""
    try:
        d = json.loads(body)
    except ValueError:
        return [], []
    if not isinstance(d, dict) or d.get("version") != 1:
        return [], []
    listed = lambda n: d[n] if isinstance(d.get(n), list) else []
    whole = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and x == int(x) and abs(x) < 1 << 53
    text = lambda x: "" if x in (None, False, 0, "") or isinstance(x, (list, dict)) else "true" if x is True else str(x)
    at = lambda e, k: e[k] if k < len(e) else None
    entries = [(i, text(at(e, 0)), int(at(e, 1))) for i, e in enumerate(listed("catalog")) if isinstance(e, list) and text(at(e, 0)) and whole(at(e, 1)) and at(e, 1) > 0]
    ids = {i for i, *_ in entries}
    items = [
        (e[0], str(e[1]).lower(), [int(x) for x in e[2]]) for e in listed("items")
        if isinstance(e, list) and len(e) == 3 and isinstance(e[0], str) and e[0].startswith("gallery/") and str(e[1]).lower() in ("jpg", "gif", "mp4")
        and isinstance(e[2], list) and len(e[2]) <= 512 and all(whole(x) and x in ids for x in e[2])
    ]
    return entries, items


def test_tag_document_reader(spark, monkeypatch):
    good = {"version": 1, "catalog": [["x", 3], ["", 2], ["y", 0], ["z", 1.0], [7, 2], "no", ["w", 2.5], [None, 1], ["v", True], ["u", 4, "more"]], "items": [
        ["gallery/a.jpg", "JPG", [0, 3]], ["gallery/b.gif", "gif", []], ["other/c.jpg", "jpg", [0]], ["gallery/d.bmp", "bmp", [0]], ["gallery/e.mp4", "mp4", [1]], ["gallery/f.mp4", "mp4", [0, 0, 9]],
        ["gallery/g.jpg", "jpg", ["0"]], ["gallery/h.jpg", "jpg", [0.0]], ["gallery/i.jpg", "jpg", [0.5]], ["gallery/j.jpg", "jpg"], [5, "jpg", [0]], "k", ["gallery/l.jpg", "jpg", [0] * 513], ["gallery/m.jpg", "jpg", [0] * 512], ["gallery/n.jpg", "jpg", [99]], ["gallery/o.jpg", "jpg", [None]],
    ]}
    bodies = [json.dumps(good), json.dumps({**good, "version": 2}), json.dumps({**good, "version": "1"}), "{broken", "[]", "null", "3", "{}", json.dumps({**good, "catalog": {}}), json.dumps({**good, "items": 5})]
    for body in bodies:
        entries, items = tags.read_tag_document(spark.createDataFrame([(body,)], "body string"))
        expected = js_reader(body)
        assert sorted(tuple(r) for r in entries.select("id", "name", "count").collect()) == expected[0], body
        assert sorted(tuple(r) for r in items.select("key", "ext", "tags").collect()) == sorted(expected[1]), body
    monkeypatch.setattr(tags, "MOST_ITEMS", 15)
    assert tags.read_tag_document(spark.createDataFrame([(bodies[0],)], "body string"))[1].isEmpty()


def test_tag_document_is_written_by_tasks(spark, tmp_path):
    rng = random.Random(2)
    path = str(tmp_path / "tags.json")
    rows = [(f"gallery/{i:03}.jpg", "jpg", rng.sample(["a", "b", 'c"', "d", "é"], rng.randrange(4))) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ext string, tags array<string>").repartition(5)
    tags.write_tag_document(df, path, 0.4, "m", "2024", "")
    with open(path) as f:
        document = json.load(f)
    count = {t: sum(t in x for *_, x in rows) for t in ["a", "b", 'c"', "d", "é"]}
    named = sorted(count.items(), key=lambda x: (-x[1], x[0]))
    assert document["catalog"] == [list(x) for x in named] and document["tagged_count"] == 200 and document["threshold"] == 0.4
    ids = {t: i for i, (t, _) in enumerate(named)}
    assert document["items"] == [[k, e, [ids[t] for t in x]] for k, e, x in rows]
    _, items = tags.read_tag_document(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"))
    assert items.count() == 200


def test_numbers_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(500)]
    got = order.numbered(spark.createDataFrame(rows, "a int, b int").repartition(6), "n", F.desc("a"), F.asc("b")).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda x: (-x[0], x[1])) and sorted(r.n for r in got) == list(range(500))
