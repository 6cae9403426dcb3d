"""Repeated short lines are taken out by the query and the pipeline; blank ones stay."""

import corpus_pipeline
from patronage.llm import queries


def test_short_repeats_go_and_blank_lines_stay(spark, docs_frame, tmp_path):
    docs = docs_frame([(1, "Share\n\n \nfirst text"), (2, "Share\n\n \nShare\nshare"), (None, "Share\nother")])
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["text"], list(r["removed"]), r["kept_lines"]) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: ("Share\n\n \nfirst text", [], 4), 2: ("\n \nshare", [0, 3], 3), None: ("other", [0], 1)}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()} == {d: t for d, (t, _, _) in got.items()}
