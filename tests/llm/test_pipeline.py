from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_ngram_jaccard_join import brute as components
from tests.llm.test_substring_dedup import brute as repeats


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(83, 0, 0), (84, 0, 0), (87, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    item = docs.where("doc_id = 10").first()["text"] or ""
    spark.createDataFrame([(1, item if len(item.split()) > 20 else docs.where("doc_id = 92").first()["text"])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_take_effect_in_order(spark, docs, folder):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "SentencePiece encoding"]
    now = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/stage{k}")
        out = spark.read.parquet(f"{folder}/stage{k}")
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count(), name
        if k < 4:
            assert out.columns == docs.columns
        if k == 1:
            assert set(after) == {i for i, (_, c) in components(list(before.items())).items() if c == i}
        if k == 2:
            want = repeats(list(before.items()))
            assert set(after) == set(before)
            for i, r in after.items():
                assert len((r["text"] or "").encode().split()) == want[i][0] - want[i][1]
                assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
        if k == 4:
            assert set(after) == set(before) and all(r["lossless"] for r in after.values())
        now = out
    assert sorted(r["doc_id"] for r in pipeline.run(spark, folder).select("doc_id").collect()) == sorted(after)


def test_empty_tables_and_rows_of_every_kind(spark, docs, folder, tmp_path):
    """No rows at all; then nulls, repeated rows and ids, and columns that the operators use themselves."""
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    long = "some words that go on and on " * 4000
    rows = [(None, None, None, None, None), (1, "one text here", "zz", "s", 13), (1, "one text here", "zz", "s", 13), (1, "another one", None, "s", None), (None, "no id", "zz", "s", 5), (2, "", "zz", "s", 0), (3, long, "zz", "s", len(long))]
    odd = spark.createDataFrame(rows, docs.schema).selectExpr("*", "1 as n", "2 as print", "3 as row", "'x' as pieces", "4 as at", "5 as h", "6 as spans")
    now = odd
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == 4 or out.columns == odd.columns
        out.write.parquet(f"{tmp_path}/odd{k}")
        now = spark.read.parquet(f"{tmp_path}/odd{k}")
    assert sorted(str(r["doc_id"]) for r in now.collect()) == ["1", "1", "2", "3", "None", "None"] and now.where("not lossless").count() == 0
