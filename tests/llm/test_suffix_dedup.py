import hashlib
import random
import re
from collections import Counter

import pytest

from quarry.llm import induced, suffix_dedup
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_windows(texts, length):
    seen = Counter()
    for t, w in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] += w
    return [[i for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1] for t, _ in texts]


def brute(rows, length):
    texts = [((t or "").encode(), 1) for _, t in rows]
    out = []
    for (key, _), (t, _), starts in zip(rows, texts, brute_windows(texts, length)):
        mask = bytearray(len(t))
        for i in starts:
            mask[i:i + length] = b"\1" * length
        left = bytes(b for b, x in zip(t, mask) if not x)
        out.append((key, len(t), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("memory, base, block", [(1 << 20, 1 << 20, 1 << 18), (50, 1 << 20, 3), (1 << 20, 0, 1 << 18), (50, 3, 2)])
def test_induced_windows(memory, base, block, monkeypatch):
    """Equal to counting, with queues in memory and on disk, names sorted in memory and by recursion."""
    monkeypatch.setattr(induced, "BLOCK", block)
    rnd = random.Random(memory + base)
    for _ in range(150):
        letters = rnd.choice([b"a", b"ab", b"abc", b"\x00\xff", b"abcdefgh"])
        length = rnd.choice([1, 2, 5, 9, 20])
        make = lambda n: bytes(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
        pool = [make(40) for _ in range(3)]
        texts = [(b"".join(rnd.choice([rnd.choice(pool), make(9)]) for _ in range(rnd.randint(0, 4))), rnd.choice([1, 1, 2]))
                 for _ in range(rnd.randint(1, 6))]
        got = [x.tolist() for x in induced.windows_repeated(iter(texts), length, memory, base)]
        assert got == brute_windows(texts, length)


def cases(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["ab", "cé", "dd", "é", "x\x00", "\n", " "])
    pool = ["".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(5)]
    rows = [(1, None), (2, ""), (3, "short"), (None, pool[0] * 2), (4, "a" * 300), (4, "a" * 31), (5, "ab" * 90)]
    for i in range(6, 40):
        rows.append((i, "".join(rnd.choice([rnd.choice(pool), word(), word()]) for _ in range(rnd.randint(1, 6)))))
    return rows + rows[8:12]


@pytest.mark.parametrize("hot, shard", [(1 << 20, 1 << 20), (60, 200), (0, 1 << 20)])
def test_equal_to_counting(spark, hot, shard):
    """Nulls, empty and repeated rows, periodic texts; anchors split down to single windows."""
    rows = cases(hot)
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id int, text string, sha string")
    got = suffix_dedup.remove_repeats(df, "doc_id", "text", length=30, gram=8, hot=hot, shard=shard, memory=1000)
    assert got.columns == ["doc_id", *suffix_dedup.RESULT]
    assert result(got) == brute(rows, 30)


def test_empty_table_and_clash(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert suffix_dedup.remove_repeats(df, "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df.withColumnRenamed("doc_id", "n_bytes"), "n_bytes", "text")


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op11_suffix_dedup"](spark, SF)) == brute(rows, 200)
