import pytest
from tokenizers import Tokenizer

from quarry.llm import token_counts
from quarry.llm.queries import tokenizer_source

ODD = [None, "", " ", "a", "  two  blanks \n\n\tand tabs ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext",
       "Größe naïve 中文字符 עברית ١٢٣ 12345 it's we'll I'D", "é" * 50, "  x​ ý ﬁ Ⅷ ²", "🙂🙂 ok",
       "x" * 5000, "the cat sat. " * 20000, "\x00\x01\u0085 a", "﻿bom", "𝒳𐞥 𞤀"]


@pytest.fixture(scope="module")
def source():
    return tokenizer_source("byte_bpe_50k.json")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_counts_are_the_librarys(spark, source):
    tok = Tokenizer.from_str(source)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(frame(spark, ODD * 2), "doc_id", "text", source).collect()}
    assert len(got) == 2 * len(ODD)
    for i, t in enumerate(ODD * 2):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024), t


def test_table_size_does_not_change_counts(spark, source):
    docs = frame(spark, ODD)
    few = token_counts.count_tokens(docs, "doc_id", "text", source, table_size=3).collect()
    many = token_counts.count_tokens(docs, "doc_id", "text", source).collect()
    assert sorted(few) == sorted(many)
    lengths = token_counts.frequent_lengths(docs, "text", source, table_size=50)
    assert len(lengths) == 50 and all(len(p) <= 64 for p in lengths)


def test_other_tokenizers_go_through_the_library(spark):
    word = tokenizer_source("word_bpe_49k.json")
    tok = Tokenizer.from_str(word)
    tok.no_truncation()
    tok.no_padding()
    assert not token_counts.two_tier(word)
    texts = ["Hello  WORLD again", "", None, "a" * 300]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(spark, texts), "doc_id", "text", word).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_small_cache_and_empty_table(spark, source, monkeypatch):
    tok = Tokenizer.from_str(source)
    lengths = token_counts._Lengths({" the": 1}, tok)
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 5)
    for i in range(50):
        assert lengths[f" word{i}"] == len(tok.encode(f" word{i}").ids)
    assert len(lengths) < 10 and lengths[" the"] == 1
    assert token_counts.count_tokens(frame(spark, []), "doc_id", "text", source).count() == 0


def test_null_and_repeated_ids(spark, source):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = token_counts.count_tokens(docs, "doc_id", "text", source).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 2), ("1", 2), ("None", 2)]
