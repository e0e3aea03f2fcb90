from conftest import SF0001
from quarry.llm import segmentation
from quarry.llm._common import table
from quarry.llm.queries import QUERIES, sentencepiece_model


def test_ids_of_the_query_decode_to_the_texts(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF0001, "documents").collect()}
    rows = segmentation.decode(QUERIES["op9_segmentation"](spark, SF0001), "ids", "decoded", sentencepiece_model()).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(len(r["ids"]) == r["n_pieces"] and r["round_trip"] == (r["decoded"] == texts[r["doc_id"]]) for r in rows)
