import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quarry.llm import repair
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
INK = re.compile("[^\x20\x09-\x0d]")
RULE = re.compile("(s?(ua)+)?")


def after_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]  # also those without rows
        if way:
            text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
            out[conv] += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:100], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def brute(rows):
    """Least (cost, audit) by dynamic programming over (row, state) with whole strings."""
    result = []
    for conv, items in after_damage(rows).items():
        seen, faults = set(), []
        for _, role, text in items:
            ink = INK.findall(text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in items if t is not None]
        pairs = list(zip([r[:1] for _, r, _ in items], [r[:1] for _, r, _ in items][1:]))
        after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        n = len(items)
        # Backward, since the least whole string starts with the least letter.
        back = {"": (0, "", ()), "a": (0, "", ()), "u": (2, "I", ("assistant:",)), "s": (4, "II", ("user:", "assistant:"))}
        for i in range(n - 1, -1, -1):
            _, role, text = items[i]
            must, late = faults[i] in ("blank", "duplicate"), faults[i] == "truncated"
            now = {}
            for s in back:
                options = [(back[s][0] + 3, "D" + back[s][1], back[s][2])]
                if not must:
                    to = after.get((s, role[:1]))
                    if to is not None:
                        options.append((back[to][0] + late, "K" + back[to][1], (f"{role}:{text}",) + back[to][2]))
                    for new in ("user", "assistant"):
                        to = after.get((s, new[0]))
                        if to is not None:
                            options.append((back[to][0] + 2 + late, "R" + back[to][1], (f"{new}:{text}",) + back[to][2]))
                now[s] = min(options, key=lambda o: o[:2])
            for _ in range(3):
                for s in now:
                    for new in ("user", "assistant"):
                        to = after.get((s, new[0]))
                        if to is not None:
                            option = (now[to][0] + 2, "I" + now[to][1], (f"{new}:",) + now[to][2])
                            now[s] = min(now[s], option, key=lambda o: o[:2])
            back = now
        cost, audit, lines = back[""]
        if not items:
            cost, audit, lines = 0, "", ()
        initials = "".join(x[:1] for x in lines)
        assert RULE.fullmatch(initials)
        result.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                       *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                       sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit,
                       hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result, key=str)


def talks(seed, conversations=40):
    rnd = random.Random(seed)
    rows = []
    for c in [None, *range(conversations)]:
        turn = rnd.randint(0, 5)
        for i in range(rnd.choice([1, 2, 3, 5, 9, 30])):
            turn += rnd.choice([0, 1, 1, 1, 2])
            role = rnd.choice(["user", "assistant"]) if i % 2 else rnd.choice(["user", "assistant", "system", "tool", "", None, "user"])
            text = rnd.choice(["Hi.", "ok", None, "", " \t\n", "Well?\x0b ", "one. two", f"é{rnd.random()}!", f"x{rnd.random()}", "."])
            rows.append((c, rnd.choice([turn, turn, turn, None]), role, text))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string, fault string, at int"


def result(df):
    assert df.columns == ["conv_id", *repair.RESULT]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, chunk, buckets", [(1, 4096, 3), (2, 2, 3), (3, 1, 5), (4, 5, 1)])
def test_equal_to_dynamic_programming(spark, seed, chunk, buckets):
    """Nulls, blanks, ties, repeated rows; chunks from one row to whole conversations."""
    rows = talks(seed)
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)
    assert result(repair.repair(df, "conv_id", "turn", "role", "text", chunk, buckets)) == brute(rows)


def test_hot_conversation_that_never_converges(spark):
    """Reroled rows alternate, so vectors stay apart: passes grow with the logarithm of the chunks."""
    rows = [(1, i, "tool", f"t{i}.") for i in range(400)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)
    marked = repair.with_faults(repair.damaged(df, "conv_id", "turn", "role", "text"), 4)
    _, passes = repair.stitched(repair.chunks(marked, 8))
    assert passes <= 5
    assert result(repair.repair(df, "conv_id", "turn", "role", "text", 8)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair(df, "conv_id", "turn", "role", "text").count() == 0
    with pytest.raises(ValueError):
        repair.repair(df.withColumnRenamed("conv_id", "cost"), "cost", "turn", "role", "text")


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op12_conversation_repair"](spark, SF)) == brute(rows)
