"""Defined cases that the other tests leave out: empty tables in the pipeline's stages, very long texts, clashing columns by value."""

import os

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
from tessera.llm import decontamination, jaccard_join, license_scan, quality_classifier  # noqa: E402

DATA = os.environ.get("TESSERA_TESTDATA", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
NOTICE = "This work is licensed under the GNU General Public License, version 3."


@given
def test_pipeline_stages_of_an_empty_table(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        assert out.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns)


@given
def test_pipeline_cuts_a_text_once(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    line = "the miller and his three sons went down to the river to look for the old wheel"
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    rows = spark.createDataFrame([(1, f"{line}\na first text"), (2, f"{line}\na second one"), (3, line)], "doc_id long, text string")
    out = corpus_pipeline.fresh_lines(spark, docs.drop("doc_id", "text").join(rows, F.lit(True), "right").select(*docs.columns), DATA)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {tuple(r) for r in out.select("doc_id", "text", "n_chars").collect()} == {(1, f"{line}\na first text", len(line) + 13), (2, "a second one", 12)}


@given
def test_very_long_texts_of_joins_and_scans(spark):
    text = "\n".join(r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("text is not null").orderBy("doc_id").limit(100).collect())
    item = "in the year of the great flood the miller and his three sons went down to the river to look for the old wheel"
    rows = [(1, text), (2, text + " and a little more at its end"), (3, f"{text}\n{item}\n{NOTICE}"), (4, text[: len(text) // 2]), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(df).collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, items).collect()} == {(3, 9)}
    found = license_scan.license_scan(df).filter("confirmed").select("doc_id", "family").collect()
    assert (3, "gpl") in {tuple(r) for r in found}
    scored = quality_classifier.scored(df, quality_classifier.fit(df))
    assert {r.doc_id for r in scored.filter("bad_probability between 0 and 1").collect()} == {1, 2, 3, 4, 5}


def test_clashing_columns_do_not_change_results(spark):
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:25], "else"])), (4, "other words that stand alone here"), (5, NOTICE)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clash = plain.withColumns({c: F.lit("clash") for c in ("copy", "id", "n", "sig", "words", "said", "line", "row", "component_id", "kept", "covered", "component", "token")})
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    same = lambda f: sorted(map(tuple, f(plain).collect()), key=repr) == sorted(map(tuple, f(clash).collect()), key=repr)
    assert same(jaccard_join.jaccard_classes) and same(license_scan.license_scan)
    assert same(lambda df: decontamination.contaminated(df, items)) and decontamination.clean_documents(clash, items).columns == clash.columns


@given
def test_licences_that_are_denied_or_only_spoken_of(spark):
    given_ = {
        1: "This library isn't covered by the GNU General Public License.", 2: "Code under the Apache License is excluded from this bundle.", 3: "Many lawyers read the GNU General Public License aloud.",
        4: "Mozilla Public License critics gathered", 5: "He insists all rights reserved. to the crown were lost", 6: "Nobody here is bound by it, and the GNU Lesser General Public License was never meant.",
    }
    real = {
        11: ("gpl", NOTICE), 12: ("proprietary", "All rights reserved."), 13: ("proprietary", "Copyright (c) 2021 Some Press. All rights reserved."), 14: ("mpl", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
        15: ("gpl", "This program is distributed under the GNU General Public License."), 16: ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    }
    rows = [*given_.items(), *((k, t) for k, (_, t) in real.items())]
    corpus = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id > 20").select("doc_id", "text")  # ordinary paragraphs to learn from
    found = license_scan.license_scan(corpus.union(spark.createDataFrame(rows, "doc_id long, text string"))).filter("confirmed and doc_id <= 20")
    confirmed = {r.doc_id: r.family for r in found.collect()}
    assert confirmed == {k: f for k, (f, _) in real.items()}
