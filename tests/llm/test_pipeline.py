import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    random.seed(6)
    words = {"en": [f"the{k}" for k in range(80)], "de": [f"und{k}ß" for k in range(80)]}
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        rows.append((i, "\n".join(" ".join(random.choice(words[lang]) for _ in range(12)) for _ in range(5)), lang, f"s{i % 3}", 1))
    copy = rows[4][1]
    rows += [(100, copy, "en", "s0", 1), (101, None, None, None, None), (102, "123 456", "en", "s1", 7), (103, copy.replace("\n", " "), "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {101, 102}
    lines = pipeline.fuzzy_lines(spark, kept, "")
    assert {r.doc_id: r.text for r in lines.collect()}[100] == "" and lines.filter("n_chars <> length(text)").count() == 0
    near = pipeline.near_duplicates(spark, docs.unionByName(docs.filter("doc_id = 4")), "")
    ids = sorted(r.doc_id for r in near.collect())
    assert ids == sorted({r[0] for r in rows} - {100, 103})
    mixed = pipeline.mixture(spark, near, "")
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 2 * near.count()
    assert pipeline.packed(spark, mixed, "").count() > 0
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
