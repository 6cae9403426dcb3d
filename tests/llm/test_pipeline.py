"""The pipeline against a stage-by-stage brute-force version, and every query's registration."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from checks.run import compare, connect
from patronage.llm import language, queries, toxicity
from patronage.llm.common import read
from tests.llm.test_lines import brute
from tests.llm.test_near import jaccard, shingle_set
from tests.llm.test_packing import one_by_one
from tests.llm.test_simhash import groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with planted cases: texts that say nothing, copies, near-equal lines, toxic documents."""
    rng = random.Random(11)
    base = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in read(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 160").collect()]
    rude = ["gribblen", "zortish", "quaxel"]
    rows, labels = [], []
    for doc, text, lang, source in base:
        words = text[:1500].split(" ")
        toxic = doc % 5 == 0
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words) + 1), rng.choice(rude))
        rows.append((doc, " ".join(words), lang, source))
        labels.append((doc, 1, int(toxic)))
    rows += [(1000, None, "en", None), (1001, "", "en", "s"), (1002, "123 456 !!", None, "s"), (None, "the of and to in that is was", "en", "s")]
    rows += [(1003, rows[1][1], "en", "s"), (1004, rows[2][1] + "!", "en", "s")]
    root = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages_against_brute_force(spark, folder):
    docs = read(spark, folder, "documents")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        given = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, folder).cache()
        rows = docs.collect()
        out[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns and len({r["doc_id"] for r in rows}) == len(rows)
        got = {r["doc_id"]: r for r in rows}
        if name == "language_id":
            assert set(given) - set(got) == {1000, 1001, 1002}
            assert all(got[d] == given[d] for d in got)
        elif name == "toxicity":
            gone = set(given) - set(got)
            planted = {d for d in given if d is not None and d < 160 and d % 5 == 0}
            assert len(gone & planted) >= 0.9 * len(planted) and len(gone - planted) <= 3
        elif name == "line_dedup":
            surplus = brute([(d, r["text"]) for d, r in given.items() if d is not None], shortest=1)
            assert surplus[1003] and surplus[1004]
            for d, r in given.items():
                kept = [x for i, x in enumerate(r["text"].split("\n")) if i not in surplus.get(d, [])]
                assert got[d]["text"] == "\n".join(kept) and got[d]["n_chars"] == len(got[d]["text"])
        elif name == "simhash_near_dedup":
            own = {d: shingle_set(r["text"]) for d, r in given.items()}
            named = sorted(d for d in own if d is not None)
            labels = groups([(a, b) for a in named for b in named if a < b and jaccard(own[a], own[b]) >= 0.8], named)
            assert {d for d in got if d is not None} == set(labels.values())
            assert None in got
        else:
            encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
            want = []
            for d, r in given.items():
                n = len(encode(r["text"], add_special_tokens=False).ids) + 1
                want += [(d, p, min(2048, n - at)) for p, at in enumerate(range(0, n, 2048))]
            assert sorted((r["doc_id"] or -1, r["piece"], r["length"]) for r in rows) == sorted((d or -1, p, n) for d, p, n in want)
            free, full = one_by_one([n for _, _, n in want], 2048)
            assert len({r["sequence_id"] for r in rows}) == len(free) + full
    assert before


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 50


def test_pipeline_without_rows_or_knowledge(spark, folder, tmp_path):
    docs = read(spark, folder, "documents")
    read(spark, folder, "labels").where("false").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    nothing = docs.where("false").withColumn("lang", F.lit(None).cast("string"))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    for start in (nothing, unlabelled):
        at = start
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, str(tmp_path))
        assert (at.count() > 0) == (start is unlabelled)


def test_odd_documents_go_through(spark, edge, folder):
    at = edge
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, folder)
        assert at.columns == edge.columns
    assert corpus_pipeline.STAGES[-1][1](spark, at, folder).count() > 0


def test_names():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == set(map(str, range(1, 14)))
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert language.UNKNOWN == "und" and toxicity.THRESHOLD == 0.7


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None
