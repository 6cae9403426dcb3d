"""What a stage of the pipeline leaves in memory: the size of batches, and what workers keep of operators before."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from patronage.llm import language
from patronage.llm.common import BATCH_BYTES, BATCH_LIMIT, per_worker


@pytest.fixture
def unlimited(spark):
    """The session without a limit on batches, before and after."""
    spark.conf.unset(BATCH_LIMIT)
    yield spark
    spark.conf.unset(BATCH_LIMIT)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:1])
def test_a_stage_sends_long_texts_in_small_batches(unlimited, name, stage):
    docs = unlimited.range(4000).selectExpr("id as doc_id", "repeat('ab cd ', 1500) as text", "'en' as lang").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "n": [batch.num_rows]})

    assert stage(unlimited, docs, "").count() == 4000
    found = docs.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r["n"] for r in found) == 4000 and max(r["bytes"] for r in found) < 2 * BATCH_BYTES


def test_a_limit_of_the_session_stays(unlimited):
    unlimited.conf.set(BATCH_LIMIT, "1000000")
    corpus_pipeline.STAGES[0][1](unlimited, unlimited.createDataFrame([], "doc_id long, text string, lang string"), "")
    assert unlimited.conf.get(BATCH_LIMIT) == "1000000"


def test_language_tasks_drop_what_other_operators_left(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the text")], "doc_id long, text string")
    model = language.fit(np.stack([language.features(t) for t in ("the of and", "der die das")]), ["en", "de"])
    tasks = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: tasks.append(run) or self)
    language.identify(docs, model)
    per_worker(("encoder", "another"), list).append("piece")
    given = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["the text"], "identified_text": ["the text"]})
    assert [b.num_rows for b in tasks[0](iter([given]))] == [1]
    assert per_worker(("encoder", "another"), list) == []
