"""Queries without SQL against brute force on whole tables."""

import hashlib
import math
import zlib

from tokenizers import Tokenizer

from conftest import SF0001
from quarry.llm import segmentation
from quarry.llm._common import table
from quarry.llm.queries import QUERIES, sentencepiece_model, tokenizer_source


def documents(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF0001, "documents").collect()}


def test_token_counts(spark):
    tok = Tokenizer.from_str(tokenizer_source("byte_bpe_50k.json"))
    want = {}
    for i, t in documents(spark).items():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 1024)
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op1_token_counts"](spark, SF0001).collect()} == want


def test_sharding(spark):
    def shard(i, n):
        u = lambda s: (int(hashlib.md5(f"{i}#{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
        return min(range(n), key=lambda s: (-math.log(u(s)), s))

    docs, want, slots = documents(spark), {}, {}
    for i in sorted(docs):
        data, s = (docs[i] or "").encode(), shard(i, 16)
        slots[s] = slots.get(s, -1) + 1
        want[i] = (len(data) + 1, zlib.crc32(data), "key", s, slots[s], shard(i, 17))
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op6_sharding"](spark, SF0001).collect()} == want


def test_segmentation(spark):
    v, docs = segmentation.Vocabulary(sentencepiece_model()), documents(spark)
    rows = QUERIES["op9_segmentation"](spark, SF0001).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    for i in docs:
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and 1 <= len(mine) <= 2
        assert len({r["ids_hash"] for r in mine}) == len(mine) and all(r["log_prob"] <= 0 for r in mine)
        assert all(r["round_trip"] == ("▁" not in docs[i]) for r in mine)
        assert mine == sorted(mine, key=lambda r: -r["perturbed"])
        assert all(r["n_pieces"] <= len(v.normalise(docs[i]).encode()) for r in mine)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in table(spark, SF0001, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    want = {}
    for c in {r[0] for r in rows}:
        turns = [(r, x or "") for _, _, r, x in sorted(q for q in rows if q[0] == c)]
        learnt = "".join(x for r, x in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(learnt),
                   hashlib.sha256(learnt.encode()).hexdigest())
    assert {r["conv_id"]: tuple(r)[1:5] for r in QUERIES["op10_chat_format"](spark, SF0001).collect()} == want
