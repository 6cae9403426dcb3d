"""Toxicity and language: held-out quality, and every odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm import language, queries, toxicity
from patronage.llm.common import crc32_mod, read

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    values, inverse, count = np.unique(np.asarray(scores), return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    labels = np.asarray(labels, bool)
    assert len(order) == len(labels)
    return (rank[labels].sum() - labels.sum() * (labels.sum() + 1) / 2) / labels.sum() / (~labels).sum()


@pytest.fixture(scope="module")
def toxic_model(spark):
    labels = read(spark, SF, "labels").where(crc32_mod("doc_id", 3) != 1)
    return toxicity.train(read(spark, SF, "documents"), labels)


def test_toxicity_held_out(spark):
    rows = queries.op1_compression_toxicity(spark, SF).join(read(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert queries.op1_compression_toxicity(spark, SF).count() == read(spark, SF, "documents").count()
    assert auc([r["score"] for r in rows], [r["toxic"] for r in rows]) > 0.8
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_toxic_beginnings_ignore_copies():
    plain = [f"the cat{i} sat{i % 7} on every mat{i % 11} near house{i % 5}" for i in range(300)]
    rude = [f"the cat{i} is word{i % 13} gribblen word{i % 29} and gribblous thing{i % 31}" for i in range(60)]
    copies = ["only here vocabulista occurs in copies"] * 60
    found = toxicity.toxic_beginnings(rude + copies, plain)
    assert b"gribbl" in found and b"vocabulista" not in found


def test_toxicity_edge(edge, empty, toxic_model):
    out = toxicity.score(edge, toxic_model)
    assert out.columns == [c for c in edge.columns if c != "score"] + ["score"]
    rows = out.collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    nothing = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4, 10)}
    assert len(nothing) == 1
    assert toxicity.score(empty, toxic_model).count() == 0


def test_toxicity_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 0), (7, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        model = toxicity.train(edge, labels)
        assert {r["score"] for r in toxicity.score(edge, model).collect()} == {0.0}


def test_words_of_any_length():
    assert toxicity.words_of("A" * 150 + " b") == [b"a" * 64, b"a" * 64, b"a" * 22, b"b"]


def test_language_held_out(spark):
    rows = queries.op2_hierarchical_language(spark, SF).join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge(spark, edge, empty):
    model = language.train(read(spark, SF, "documents"))
    assert dict(model.families) == {"germanic": ("de", "en"), "romance": ("es", "fr")}
    rows = {r["doc_id"]: r for r in language.identify(edge, model).collect()}
    assert {d for d, r in rows.items() if r["lang_pred"] == "und"} == {2, 3, 4, 10}
    assert all(rows[d]["score"] == 0.0 for d in (2, 3, 4, 10))
    assert language.identify(edge, model).columns == [c for c in edge.columns if c != "score"] + ["lang_pred", "score"]
    assert language.identify(empty, model).count() == 0
    numbers = language.identify(spark.createDataFrame([(1, "123 ½ ²"), (2, "1a")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] == "und" for r in sorted(numbers)] == [True, False]


def test_language_without_examples(edge):
    model = language.train(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(edge, model).collect()} == {"und"}


def test_three_languages_of_a_family(spark):
    rows = [(i, " ".join(w + str(i % 3) for w in words), lang) for i in range(60)
            for lang, words in (("nl", ["het", "een", "zijn"]), ("sv", ["och", "att", "det"]), ("de", ["und", "der", "ist"]), ("xx", ["qua", "quo", "qui"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert dict(model.families) == {"germanic": ("de", "nl", "sv"), "other": ("xx",)}
    assert all(r["lang"] == r["lang_pred"] for r in language.identify(docs, model).collect())


def test_long_text_counts_every_stretch():
    text = "the quick brown fox " * 120_000
    assert np.allclose(language.features(text)[:-1], language.features(text[:400_000])[:-1], atol=1e-3)
