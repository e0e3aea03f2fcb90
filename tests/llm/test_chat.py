import hashlib
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from quarry.llm import chat

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests

PARTS = st.lists(st.sampled_from([*chat.CONTROL_STRINGS, "\\", "<", "[", "<|", "\n", "é", "ok", " ", "/INST]"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_escape_is_reversible_and_complete(text):
    t = chat.TurnTemplate()
    out = t.escape(text)
    assert t.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL_STRINGS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "tool\n<|end|>"]), PARTS), max_size=80))
def test_spans_of_prefixes(turns):
    t, talk, out = chat.TurnTemplate(), chat.Conversation(chat.TurnTemplate(), window=4), ""
    for i, (role, text) in enumerate(turns):
        row = talk.add(role, text)
        assert not row["rewrites"] and row["kept"] == len(out)
        out = out[:row["kept"]] + row["added"]
        assert out == t.render(turns[:i + 1])
        assert t.unescape(row["added"][row["text_from"]:row["text_to"]]) == text
        assert t.read(row["added"]) == (role, text)
        assert len(talk.turns) <= 8


class LastOnly(chat.TurnTemplate):
    """Writes the text of the last turn alone: rewrites history."""

    def render(self, turns):
        return "".join(f"<{r}>{t if i + 1 == len(turns) else '-'}|" for i, (r, t) in enumerate(turns))


class System(chat.TurnTemplate):
    """Numbers the turns: a window does not render like the whole."""

    def render(self, turns):
        return "".join(f"<{i}:{r}>{t}|" for i, (r, t) in enumerate(turns))


def test_templates_that_rewrite_or_count():
    talk = chat.Conversation(LastOnly())
    assert not talk.add("u", "aa")["rewrites"]
    row = talk.add("u", "bb")
    assert row["rewrites"] and row["kept"] == 3 and row["text_from"] is None
    talk, out = chat.Conversation(System(), window=2), ""
    for i in range(20):
        row = talk.add("u", f"t{i}")
        out = out[:row["kept"]] + row["added"]
        assert out == System().render([("u", f"t{j}") for j in range(i + 1)])


class Late(chat.TurnTemplate):
    """Rewrites the first turn when the 70th comes."""

    def render(self, turns):
        return "".join(f"<{r}>{'-' if i == 0 and len(turns) >= 70 else t}|" for i, (r, t) in enumerate(turns))


def test_late_rewrites_are_noticed():
    talk, out = chat.Conversation(Late()), ""
    turns = [("u", f"t{i}") for i in range(100)]
    rewrites = []
    for i, turn in enumerate(turns):
        row = talk.add(*turn)
        out = out[:row["kept"]] + row["added"]
        assert out == Late().render(turns[:i + 1])
        rewrites += [i] if row["rewrites"] else []
    assert rewrites == [69]


def brute(rows):
    out = {}
    for cid in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == cid)
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        out[cid] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(learnt),
                    hashlib.sha256(learnt.encode()).hexdigest(), len(chat.TurnTemplate().render([(r, x) for _, r, x in turns])))
    return out


def test_digests(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 1, "assistant", "b\n\\<|end|>"), (1, 0, "user", None),
            (2, None, None, "no role"), (2, None, None, "no role"), (None, 3, "assistant", "no id"), (3, 0, "assistant", "")]
    rows += [(9, i, ("user", "assistant")[i % 2], f"<s> {i}" * (i % 9)) for i in range(700)] + [(4, 0, "assistant", "é🙂" * 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as added", "1 as id")
    got = chat.read_back(chat.format_turns(df, "conv_id", "turn", "role", "text"), "conv_id").collect()
    assert {r["conv_id"]: tuple(r)[1:6] for r in got} == brute(rows) and not any(r["rewrites"] for r in got)


def test_rewriting_template_has_no_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "aa"), (1, 1, "assistant", "bb")], "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(df, "conv_id", "turn", "role", "text", LastOnly())
    row = chat.read_back(turns, "conv_id", LastOnly()).first()
    assert row["rewrites"] and row["loss_sha256"] is None and row["formatted_chars"] == len("<user>-|<assistant>bb|")


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(df, "conv_id", "turn", "role", "text"), "conv_id").count() == n
