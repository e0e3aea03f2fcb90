import corpus_pipeline
from conftest import SF0001
from quarry.llm import near_dup
from quarry.llm._common import table
from quarry.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_a_table(spark):
    """Each stage against its operator's own result on what its predecessor kept."""
    docs = table(spark, SF0001, "documents")
    kept = {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dup", "decontaminate", "segmentation"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.write_stage(stage(spark, docs, SF0001), f"test-{name}")
        if name != "segmentation":
            assert docs.columns == COLUMNS and docs.schema == table(spark, SF0001, "documents").schema
            kept[name] = {r["doc_id"]: r for r in docs.collect()}
            assert set(kept[name]) <= set(before)
            if name != "line_dedup":
                assert all(kept[name][i] == before[i] for i in kept[name])
    wanted = {r["doc_id"] for r in QUERIES["op2_quality"](spark, SF0001).collect() if r["predicted"] == 1}
    assert set(kept["quality"]) == wanted
    assert set(kept["line_dedup"]) == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"].values() if r["text"] != kept["quality"][r["doc_id"]]["text"])
    rows = spark.createDataFrame(list(kept["line_dedup"].values()), table(spark, SF0001, "documents").schema)
    found = near_dup.near_duplicates(rows, "doc_id", "text", 5, 0.8).where("kept").collect()
    assert set(kept["near_dup"]) == {r["doc_id"] for r in found}
    assert set(kept["decontaminate"]) < set(kept["near_dup"])
    out = docs.collect()
    assert {r["doc_id"] for r in out} == set(kept["decontaminate"]) and all(r["round_trip"] for r in out)


def test_odd_rows(spark, tmp_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x " * 50000, "en", "s", 1), (None, "no id", "en", None, 5),
            (None, "no id", "en", None, 5), (4, "same words here again", "en", "s", 9), (4, "same words here again", "en", "s", 9),
            (5, "Same words here again", "en", "t", 9)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, "x y"), (3, "same words here again and then some more")], "item_id long, text string")
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    bench.write.parquet(f"{tmp_dir}/benchmark.parquet")
    for given in (rows, []):
        spark.createDataFrame(given, schema).write.mode("overwrite").parquet(f"{tmp_dir}/documents.parquet")
        got = corpus_pipeline.run(spark, tmp_dir).collect()
        assert len({r["doc_id"] for r in got}) == (5 if given else 0)
        if given:
            assert {r["doc_id"] for r in got} == {1, 2, 3, 4, None}
            assert len([r for r in got if r["doc_id"] == 4]) == 2  # two samples of one kept row
