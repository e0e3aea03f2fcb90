"""Chat formatting by incremental black-box rendering (operator 10).

The template is a black box that renders a list of (role, text) turns. Each conversation is
rendered prefix by prefix; consecutive outputs are compared, and what the newer one adds is
the new turn's span. Two more renders of the same prefix, with one-letter texts in its last
turn, show how much of the span stands before and after the text, and so where the loss mask
lies. A template whose newer output does not begin with the older one rewrites history; the
turn that did it is marked, with the length both outputs share.

Rows stream through a task in (conversation, turn) order. For a template that declares its turns
independent, a task holds a window of turns of one conversation; for any other, the conversation's
turns so far, which each new turn renders again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strings that chat tokenizers read as control tokens.
CONTROL_STRINGS = ["<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
                   "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


class TurnTemplate:
    """Marks each turn ``<|turn|>role<|text|>text<|end|>`` and escapes control strings.

    A control string inside a role or text gets a backslash after its first character, and
    one that already has backslashes there gets one more, so the escape can be undone. A
    turn without a role has an empty one."""

    local = True  # a turn's rendering depends on that turn alone

    def __init__(self, control: Iterable[str] = CONTROL_STRINGS):
        heads: dict[str, list[str]] = {}
        for c in control:
            heads.setdefault(c[0], []).append(c[1:])
        forms = [f"{re.escape(h)}(?=\\\\*(?:{'|'.join(map(re.escape, sorted(rest)))}))" for h, rest in heads.items()]
        back = [f"(?<={re.escape(h)})\\\\(?=\\\\*(?:{'|'.join(map(re.escape, sorted(rest)))}))" for h, rest in heads.items()]
        self._escape, self._unescape = re.compile("|".join(forms)), re.compile("|".join(back))

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: m.group() + "\\", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub("", text)

    def render(self, turns: list[tuple[str, str]]) -> str:
        return "".join(f"<|turn|>{self.escape(r)}<|text|>{self.escape(t)}<|end|>\n" for r, t in turns)

    def read(self, span: str) -> tuple[str, str]:
        """(role, text) of one turn's span of the output."""
        role, _, rest = span.removeprefix("<|turn|>").partition("<|text|>")
        return self.unescape(role), self.unescape(rest.removesuffix("<|end|>\n"))


def shared_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    return len(a) if b.startswith(a) else len(os.path.commonprefix([a, b]))


def shared_suffix(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    return n


class Conversation:
    """Renders one conversation's prefixes as its turns come in.

    Prefixes start at the first turn, however many there are, so that a template that rewrites
    history late is noticed. Only where the template's own class (not one it derives from) declares
    ``local``, prefixes of more than ``2 * window`` turns start at a later turn, if the newest turn
    renders alike from there."""

    def __init__(self, template, window: int = 32):
        self.template, self.window = template, window
        self.turns: list[tuple[str, str]] = []
        self.out, self.dropped, self.retry = "", 0, 2 * window

    def add(self, role: str, text: str) -> dict:
        """Span of the new turn: the output is ``old[:kept] + added``; the turn's text is
        ``added[text_from:text_to]`` as the template writes it."""
        render = self.template.render
        older, turns = self.out, [*self.turns, (role, text)]
        new = render(turns)
        kept = shared_prefix(older, new)
        rewrites = kept < len(older)
        added = new[kept:]
        a, b = render([*self.turns, (role, "A")]), render([*self.turns, (role, "B")])
        head, tail = len(os.path.commonprefix([a, b])), shared_suffix(a, b)
        row = {"kept": self.dropped + kept, "added": added, "rewrites": rewrites}
        if rewrites or head < kept or head + tail > len(new):
            row |= {"text_from": None, "text_to": None}
        else:
            row |= {"text_from": head - kept, "text_to": len(new) - tail - kept}
        self.turns, self.out = turns, new
        if vars(type(self.template)).get("local", False) and len(turns) >= self.retry:
            self._shorten(added)
        return row

    def _shorten(self, added: str) -> None:
        late = self.turns[-self.window:]
        before, after = self.template.render(late[:-1]), self.template.render(late)
        if after == before + added and self.out.endswith(added):
            self.dropped += len(self.out) - len(after)
            self.turns, self.out = late, after
            self.retry = 2 * self.window
        else:
            self.retry = 2 * len(self.turns)


def format_turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str,
                 template=None, loss_roles: tuple[str, ...] = ("assistant",), window: int = 32) -> DataFrame:
    """One row per turn: (id, turn_no, role, kept, added, text_from, text_to, loss, rewrites).

    The formatted conversation after a turn is ``previous[:kept] + added`` (for a template
    that never rewrites, the ``added`` strings joined). ``text_from``/``text_to`` bound the
    turn's text inside ``added``; ``loss`` says whether that is under the loss mask, and it is
    false where the span is unknown because the template rewrote history in this turn.

    Turns are taken by (turn, role, text), nulls first; a null role or text is empty; rows with
    a null id are one conversation; repeated rows are turns of their own; other columns,
    whatever their names, are not read; an empty table gives an empty result. Rows come
    conversation by conversation, in turn order, within each partition. A conversation is
    read by one task, turn by turn, which keeps at most ``2 * window`` of its turns, or all of
    them for a template that does not declare its turns independent.
    """
    template = template or TurnTemplate()
    kind = rows.schema[id_col].dataType.simpleString()
    turns = (rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"),
                         F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .repartition("id").sortWithinPartitions("id", "turn", "role", "text"))
    schema = (f"id {kind}, turn_no bigint, role string, kept bigint, added string, "
              "text_from bigint, text_to bigint, loss boolean, rewrites boolean")

    def spans(batches):
        import pyarrow as pa

        now, talk, no = object(), None, 0
        fields = pa.schema([("turn_no", pa.int64()), ("role", pa.string()), ("kept", pa.int64()), ("added", pa.string()),
                            ("text_from", pa.int64()), ("text_to", pa.int64()), ("loss", pa.bool_()), ("rewrites", pa.bool_())])
        for batch in batches:
            out = []
            for key, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(),
                                       batch.column(3).to_pylist(), strict=True):
                if key != now:
                    now, talk, no = key, Conversation(template, window), 0
                row = talk.add(role, text)
                out.append(row | {"turn_no": no, "role": role,
                                  "loss": role in loss_roles and row["text_from"] is not None})
                no += 1
            made = pa.Table.from_pylist(out, schema=fields).combine_chunks()
            columns = [made[f.name].combine_chunks() for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *fields.names])

    return turns.mapInArrow(spans, schema).withColumnRenamed("id", id_col)


def read_back(formatted: DataFrame, id_col: str, template=None) -> DataFrame:
    """Digests of each formatted conversation, read from :func:`format_turns`' output alone.

    (id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites). A task
    keeps two running hashes. A conversation whose history the template rewrote has null turn
    and loss columns."""
    template = template or TurnTemplate()
    kind = formatted.schema[id_col].dataType.simpleString()
    schema = (f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint, rewrites boolean")

    def digest(batches):
        import pyarrow as pa

        id_type, none, state, key = None, object(), None, None
        now = none

        def close():
            turns, loss, n, chars, length, rewrote = state
            return {"n_turns": n, "turns_sha256": None if rewrote else turns.hexdigest(),
                    "loss_chars": None if rewrote else chars, "loss_sha256": None if rewrote else loss.hexdigest(),
                    "formatted_chars": length, "rewrites": rewrote}

        def batch_of(keys, rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, id_type), pa.array([r["n_turns"] for r in rows], pa.int64()),
                 pa.array([r["turns_sha256"] for r in rows], pa.string()),
                 pa.array([r["loss_chars"] for r in rows], pa.int64()),
                 pa.array([r["loss_sha256"] for r in rows], pa.string()),
                 pa.array([r["formatted_chars"] for r in rows], pa.int64()),
                 pa.array([r["rewrites"] for r in rows], pa.bool_())],
                names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

        for batch in batches:
            id_type = batch.column(0).type
            keys, rows = [], []
            for key, r in zip(batch.column(0).to_pylist(), batch.select(
                    ["kept", "added", "text_from", "text_to", "loss", "rewrites"]).to_pylist(), strict=True):
                if key != now:
                    if now is not none:
                        keys.append(now)
                        rows.append(close())
                    now, state = key, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False]
                state[2] += 1
                state[4] = r["kept"] + len(r["added"])
                state[5] |= r["rewrites"]
                if state[5]:
                    continue
                role, text = template.read(r["added"])
                state[0].update(f"{role}\n{text}\n".encode())
                if r["loss"]:
                    learnt = template.unescape(r["added"][r["text_from"]:r["text_to"]])
                    state[1].update(learnt.encode())
                    state[3] += len(learnt)
            yield batch_of(keys, rows)
        if now is not none:
            yield batch_of([now], [close()])

    return formatted.withColumnRenamed(id_col, "id").mapInArrow(digest, schema).withColumnRenamed("id", id_col)
