"""The language stage against foreign and gibberish texts."""

import random

import corpus_pipeline
from patronage.llm.common import read


def test_planted_texts_go_and_clean_ones_stay(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rng = random.Random(1)
    gibberish = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxyz", k=rng.randint(2, 9))) for _ in range(80)) for _ in range(5)]
    foreign = ["Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5, "快速的棕色狐狸跳过了懒狗。" * 20,
               "Zażółć gęślą jaźń, wszystko było już wcześniej powiedziane przez nich wszystkich. " * 5,
               "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 5]
    planted = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(gibberish + foreign)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(planted), "").collect()}
    assert not {d for d in kept if d >= 10**9}
    lettered = {r["doc_id"] for r in docs.where("text rlike '\\\\p{L}'").collect()}
    assert len(lettered & kept) >= 0.98 * len(lettered)
    print("kept", len(lettered & kept), "of", len(lettered))
