"""Slots of decontamination: consistency inside a window and between windows, numbers in words, texts of one id."""

import itertools
import random

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import decontamination  # noqa: E402

ITEM = "Ann has {} pens and Bob has {} pens so how many pens do they have in all when put together"


def found(spark, texts, item):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}


def covered(item, text, cover=decontamination.COVER):
    """Item words under consistent windows, by a walk over all pairs of windows of equal template; shares no code with the operator but the template."""
    (iw, isl), (dw, dsl) = decontamination.template(item), decontamination.template(text)
    size = min(8, len(iw))
    held = [(k - j, k, j) for k in range(len(dw) - size + 1) for j in range(len(iw) - size + 1) if dw[k : k + size] == iw[j : j + size] and sum(not s for s in isl[j : j + size]) >= 4]

    def fits(j, k, known):
        new = dict(known)
        for a, b in zip(isl[j : j + size], dsl[k : k + size], strict=True):
            if a or b:
                if any((x == a) != (y == b) for x, y in new.items()):
                    return None
                new[a] = b
        return new

    def walk(own, known, got):
        n = 0
        for _, k, j in own:
            new = fits(j, k, known)
            if new is not None:
                known.update(new)
                got.update(range(j, j + size))
                n += 1
        return n

    copies = [list(g) for _, g in itertools.groupby(sorted(held), key=lambda x: x[0])]
    for own in copies:
        own.sort(key=lambda x: x[1])
    copies.sort(key=lambda own: (-walk(own, {}, set()), own[0][1]))
    known, got = {}, set()
    for own in copies:
        walk(own, known, got)
    return len(got) >= cover * len(iw)


def test_one_value_to_two_and_two_to_one_in_a_window(spark):
    same, other = ITEM.format(3, 3), ITEM.format(3, 4)
    doc = "Eve has {} pens and Dan has {} pens so how many pens do they have in all when put together"
    window = "Ann has {} pens Bob has {} pens"  # one window, so nothing else can cover the item
    assert found(spark, [doc.format(5, 5), doc.format(7, 7), ITEM.format(9, 9)], same) == {0, 1, 2}
    assert found(spark, ["Eve has 4 pens Dan has 5 pens", "Eve has 6 pens Dan has 6 pens", "Eve has 6 pens Eve has 6 pens"], window.format(3, 3)) == {1}
    assert found(spark, ["Eve has 7 pens Dan has 7 pens", "Eve has 6 pens Dan has 8 pens", "Eve has 6 pens Eve has 8 pens"], window.format(3, 4)) == {1}
    assert decontamination.judge([(0, 0, ["e", "", "4", "", "", "d", "", "5"], ["a", "", "3", "", "", "b", "", "3"])]) == (0, 0)
    assert decontamination.judge([(0, 0, ["e", "", "7", "", "", "d", "", "7"], ["a", "", "3", "", "", "b", "", "4"])]) == (0, 0)
    assert decontamination.judge([(0, 0, ["e", "", "7", "", "", "d", "", "8"], ["a", "", "3", "", "", "b", "", "4"])]) == (8, 4)
    assert found(spark, [other], other) == {0}


def test_numbers_in_words(spark):
    item = "A baker sold twelve loaves on the first day and twenty-one loaves on the next so how many were sold"
    texts = [item.replace("twelve", "thirty").replace("twenty-one", "ninety"), item.replace("twelve", "30").replace("twenty-one", "17"), item.replace("twelve", "some").replace("loaves", "pies")]
    assert found(spark, texts, item) == {0, 1}
    assert decontamination.template("Twelve men, twenty-one women")[0] == ["<number>", "men", "<number>", "women"]


def test_texts_of_one_id_are_judged_by_themselves(spark):
    item = "in the year of the great flood the miller and his three sons went down to the river to look for the old wheel"
    words = item.split()
    docs = spark.createDataFrame([(1, " ".join(words[:9])), (1, " ".join(words[14:])), (2, item), (2, "a clean text"), (2, item), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.covered) for r in decontamination.contaminated(docs, items).collect()] == [(2, 1, len(words))]
    assert sorted((r.doc_id or 0, r.text) for r in decontamination.clean_documents(docs, items).collect()) == sorted([(1, " ".join(words[:9])), (1, " ".join(words[14:])), (2, "a clean text"), (0, item)])


def test_contamination_equals_a_plain_walk(spark):
    rng = random.Random(13)
    names, verbs, nouns = ["Ann", "Bob", "Eve", "Dan", "Kim"], "has buys sells finds keeps loses".split(), "pens cups hats nuts".split()

    def sentence():
        return f"{rng.choice(names)} {rng.choice(verbs)} {rng.randrange(2, 6)} {rng.choice(nouns)} and {rng.choice(verbs)} {rng.randrange(2, 6)} {rng.choice(nouns)} for {rng.choice(names)} who"

    items = [" ".join(sentence() for _ in range(3)) for _ in range(12)]

    def changed(text):
        swap = dict(zip(names, rng.sample(names, 5), strict=True)) if rng.random() < 0.7 else {}
        digits = dict(zip("2345", rng.sample("2345789", 4), strict=True)) if rng.random() < 0.7 else {}
        return " ".join(rng.choice(names) if w in names and rng.random() < 0.1 else swap.get(w, digits.get(w, w)) for w in text.split())

    docs = [changed(rng.choice(items)) if rng.random() < 0.7 else " ".join(sentence() for _ in range(3)) for _ in range(60)]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    expected = {(i, j) for i, d in enumerate(docs) for j, item in enumerate(items) if covered(item, d)}
    assert got == expected and 10 < len(got) < 500
