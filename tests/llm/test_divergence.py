import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import divergence

PATTERN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, ranks):
    docs = [(r[0] or "", r[1] or "", PATTERN.findall((r[2] or "").translate(UPPER))) for r in rows]
    freq, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, terms in docs:
        groups.add((lang, source))
        freq.update({(lang, t) for t in terms})
    kept = defaultdict(list)
    for (lang, t), n in freq.items():
        if n >= min_docs:
            kept[lang].append(t)
    for lang, source, terms in docs:
        counts[lang, source].update(t for t in terms if freq[lang, t] >= min_docs)
        counts[lang].update(t for t in terms if freq[lang, t] >= min_docs)
    p = lambda c, t, v: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, source in groups:
        v, mine = len(kept[lang]), counts[lang, source]
        pairs = [(-sum(f(p(mine, t, v), p(counts[lang, o], t, v)) for t in kept[lang]), o.encode())
                 for la, o in groups if la == lang and o != source]
        terms = [(-f(p(mine, t, v), p(counts[lang], t, v)), t.encode()) for t in kept[lang]
                 if mine[t] and p(mine, t, v) > p(counts[lang], t, v)]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out += [(lang, source, part, x.decode(), -y, i) for i, (y, x) in enumerate(found, 1)]
    return sorted(out)


def rows(seed, n=120):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "Émile", "naïve", "x", "日本", "Zed", "q1w", "ÀB", "don't", *[f"w{chr(97 + i)}" for i in range(20)]]
    return [(rnd.choice(["en", "fr", None, "de"][: 3 if i else 4]), rnd.choice(["hot", "hot", "b", "c", None]),
             rnd.choice([None, "", "..."]) if rnd.random() < .1 else
             " ".join(rnd.choice(words) + rnd.choice(["", ".", "\n", "\x00", "\x7f"]) for _ in range(rnd.randint(1, 30))))
            for i in range(n)]


@pytest.mark.parametrize("shard, round_bytes, held", [(4096, 1 << 26, 2048), (3, 1 << 26, 0), (3, 40, 2)])
def test_equal_to_counting(spark, monkeypatch, shard, round_bytes, held):
    """Small shards, several broadcast rounds and early hand-on give the same; a lang without kept terms, too."""
    monkeypatch.setattr(divergence, "SHARD", shard)
    data = rows(shard) + [("xx", "a", "rare"), ("xx", "b", None), ("xx", "b", None)]
    df = spark.createDataFrame([(*r, "n") for r in data], "lang string, source string, text string, slot string")
    got = divergence.audit(df, "text", "lang", "source", min_docs=5, ranks=3, round_bytes=round_bytes, held=held)
    assert sorted(tuple(r) for r in got.collect()) == brute(data, 5, 3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(df, "text", "lang", "source").count() == 0


def test_minimal_perfect_hash():
    rnd = random.Random(3)
    for n in (1, 2, 5, 100, 3000):
        terms = sorted({str(rnd.random()).encode() for _ in range(n)})
        seed, disp, stored = divergence.build_hash(terms)
        assert sorted(stored) == terms
        look = divergence._Lookup([{"shards": 1, "shard": 0, "size": len(terms), "seed": seed, "disp": disp.tobytes(),
                                    "terms": b"\n".join(stored), "first": 7}])
        assert sorted(look.slots(terms)) == list(range(7, 7 + n))
        assert (look.slots([b"absent", b"other"]) == -1).all()


def test_share_is_exact():
    rnd = random.Random(4)
    for _ in range(2000):
        total = rnd.randint(2, 10**14)
        count = rnd.randint(0, total)
        assert divergence.share(np.array([count]), total)[0] == 1 + 10**9 * count // total
