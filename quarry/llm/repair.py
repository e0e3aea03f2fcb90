"""Least-cost repair of damaged conversations by rank-convergence parallel Viterbi (operator 12).

A conversation is repaired if the initials of its roles read ``(s?(ua)+)?``. Edits in order: Keep
a row (0), Rerole it to user or assistant (2), Delete it (3), Insert an empty user or assistant row
(2); a row that stays though it is truncated adds 1, blank and duplicate rows must go. Among the
cheapest edit strings the ASCII-least one is wanted (D < I < K < R).

The states are 0 (nothing yet), 1 (after s), 2 (after u), 3 (after a); 0 and 3 may end. In each
state every letter leads to one state, so the least audit follows from *backward costs*: at each
row, take the least letter whose cost plus the cost behind it is the cost at hand. Only differences
between the four costs matter, and these are found in parallel:

1. Rows get an order id from a range sort on (conversation, turn, role, text), and faults from the
   first id of each (conversation, role, text). Blocks of ``chunk`` ids of one conversation form a
   *chunk*, a string of one letter per row.
2. Every chunk runs backward at once, the last from the true end costs, the others from a
   speculative vector of equal costs.
3. *Fix-up passes.* A chunk whose next chunk begins with other costs than it assumed (up to a
   constant) runs again, until at one row its vector is parallel to the stored one, from where on
   nothing changes. Passes go on until no chunk differs. Where vectors never become parallel (a
   row of reroled roles alternates), pass ``p`` carries the vector through up to ``4**p``
   neighbouring chunks, so passes grow with the logarithm of the chunks.
4. The stitched costs give, for each chunk and each of the four states it may start in, the audit
   and the last state. The states are chained over chunks, the letters go back to the rows.
5. One pass over a conversation's rows in order builds audit, cost and digest.

Rows: a null role or text is one space, also in the hash that picks the damage (as are null ids and
turns there). Rows of one turn are ordered by role, the text's first 100 characters and its hash. Null ids are one conversation. Empty
and very long texts are like others; repeated rows are duplicates. An empty table gives no rows.
Other columns, whatever their names, are not read. One conversation's rows pass one task in the
last step (a digest is a chain), which holds its audit; all other steps split a hot conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import write_stage

CHUNK = 4096
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
END = (0, 4, 2, 0)  # cost of ending in each state: insert u, a as needed
INSERTED = (2, 2, 3, 2)  # state after an inserted or reroled row: the alternation leaves one choice
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
ROLE = {2: "user", 3: "assistant"}  # role that leads to the state
# Row letters: x must go; s, u, a, o (other) by initial; the capital is truncated.


def _closed(v: list[int]) -> tuple[int, ...]:
    """Costs with inserts before the next row, less their least."""
    for _ in range(2):
        v = [min(v[s], 2 + v[INSERTED[s]]) for s in range(4)]
    low = min(v)
    return tuple(x - low for x in v)


@lru_cache(maxsize=None)
def _row_costs(letter: str, s: int, behind: tuple[int, ...]) -> tuple:
    """(edit, cost with what is behind, next state) of each edit of a row, inserts aside."""
    out = [("D", 3 + behind[s], s)]
    if letter != "x":
        late = letter.isupper()
        to = KEPT[letter.lower()][s]
        if to is not None:
            out.append(("K", late + behind[to], to))
        out.append(("R", 2 + late + behind[INSERTED[s]], INSERTED[s]))
    return tuple(out)


@lru_cache(maxsize=None)
def step(letter: str, behind: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row from the costs behind it, both up to a constant."""
    return _closed([min(c for _, c, _ in _row_costs(letter, s, behind)) for s in range(4)])


@lru_cache(maxsize=None)
def choice(letter: str, s: int, behind: tuple[int, ...]) -> tuple[str, int]:
    """The least cheapest edits before and of a row in state ``s``: (edits, next state)."""
    def best(state: int, inserts: int) -> tuple[int, str, int]:
        found = [(c, e, to) for e, c, to in _row_costs(letter, state, behind)]
        if inserts:
            c, e, to = best(INSERTED[state], inserts - 1)
            found.append((c + 2, "I" + e, to))
        return min(found)
    _, edits, to = best(s, 2)
    return edits, to


def ending(s: int) -> str:
    return "I" * (END[s] // 2)


def backward(letters: str, end: tuple[int, ...], known: list | None = None) -> list[tuple[int, ...]]:
    """Costs at every row of a chunk, ``[-1]`` those behind it. With ``known`` (an earlier run) it
    stops where the vector is the known one: from there on nothing changes."""
    out = known[:] if known else [None] * (len(letters) + 1)
    out[-1] = end
    for i in range(len(letters) - 1, -1, -1):
        v = step(letters[i], out[i + 1])
        if known and known[i] == v:
            break
        out[i] = v
    return out


def trace(letters: str, costs: list, s: int) -> tuple[list[str], int]:
    out = []
    for letter, behind in zip(letters, costs[1:]):
        edits, s = choice(letter, s, behind)
        out.append(edits)
    return out, s


# ------------------------------------------------------------------------------- damage and faults
def damaged(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turn, role, text): dropped, emptied, cut, repeated and reroled rows by a hash of id and turn."""
    blank = F.lit(" ")
    text = F.coalesce(F.col(text_col).cast("string"), blank)
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    way = F.crc32(key.cast("binary")) % 20
    out = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), blank).alias("role"),
                      text.alias("text"), way.alias("way")).where("way != 0")
    return out.select("id", "turn", F.when(F.col("way") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                      F.when(F.col("way") == 1, F.lit("")).when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                      F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def with_faults(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows in order with ``at`` (order id) and their first fault: blank, duplicate, truncated or null."""
    sort = ["id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 100), F.sha2("text", 256), "copy"]
    # Equal rows are dealt by a seeded number, so that one row met very often has several ranges.
    rows = rows.withColumn("salt", F.rand(7)).repartitionByRange(buckets, *sort, "salt").sortWithinPartitions(*sort, "salt")
    rows = write_stage(rows.select("id", "turn", "role", "text", F.monotonically_increasing_id().alias("at")), "repair-rows")
    same = F.sha2(F.concat(F.col("role"), F.lit("\x00"), F.col("text")), 256)
    keyed = rows.select("id", "at", F.struct(F.length("role"), same).alias("same"))
    first = keyed.groupBy("id", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    inked = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = (F.when(inked == "", "blank").when(F.col("first").isNull(), "duplicate")
             .when(~F.substring(inked, -1, 1).isin(".", "!", "?"), "truncated"))
    return rows.join(first, "at", "left").withColumn("fault", fault)


# ------------------------------------------------------------------------------- chunks
def chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """(id, block, ats, letters): one row per stretch of at most ``chunk`` rows of a conversation."""
    first = initial(F.col("role"))
    plain = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))
    letter = (F.when(F.col("fault").isin("blank", "duplicate"), F.lit("x"))
              .when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain))
    one = F.struct(F.col("at"), letter.alias("letter"))
    out = rows.groupBy("id", F.expr(f"at div {chunk}").alias("block")).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    return out.select("id", "block", F.col("rows.at").alias("ats"), F.concat_ws("", F.col("rows.letter")).alias("letters"))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs chunks backward that assumed other costs than the next chunk has (``due``); carries the
    vector on to the chunk before, if it is in the same stretch (``group``)."""
    carried = None
    for batch in batches:
        ends, starts, again = [], [], []
        for x in batch.to_pylist():
            assumed, due = x["end"] and tuple(x["end"]), tuple(x["due"])
            if carried and carried[0] == (x["id"], x["group"]):
                due = carried[1]
            if assumed == due:
                start = tuple(x["start"])
            else:
                known = backward(x["letters"], assumed) if assumed else None
                start = backward(x["letters"], due, known)[0]
            carried = ((x["id"], x["group"]), start)
            ends.append(list(due))
            starts.append(list(start))
            again.append(assumed != due)
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("block"), pa.array(ends, kind), pa.array(starts, kind),
                                          pa.array(again, pa.bool_())], names=["id", "block", "end", "start", "ran"])


def stitched(parts: DataFrame) -> tuple[DataFrame, int]:
    """(id, block, end): costs behind each chunk, and the passes it took."""
    kind = parts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, block bigint, end array<int>, start array<int>, ran boolean"
    order = Window.partitionBy("id").orderBy("block")  # of a chunk's costs alone, not its rows
    known = parts.select("id", "block", F.lit(None).cast("array<int>").alias("end"), F.lit(None).cast("array<int>").alias("start"))
    passes = 0
    while True:
        last = F.lead("block").over(order).isNull()
        true_end, guess = F.array(*map(F.lit, END)), F.array(*[F.lit(0)] * 4)
        asked = known.withColumn("due", F.when(last, true_end).otherwise(F.coalesce(F.lead("start").over(order), guess)))
        asked = asked.withColumn("no", F.row_number().over(Window.partitionBy("id").orderBy(F.col("block").desc())) - 1)
        if passes:
            asked = write_stage(asked, "repair-asked")
            if asked.where("end != due").isEmpty():
                return known.select("id", "block", "end"), passes
        # Pass 0 runs each chunk by itself; pass p carries on through stretches of 4**p chunks.
        asked = asked.withColumn("group", F.expr(f"no div {4 ** passes if passes else 1}"))
        ran = _same(asked, parts.select("id", "block", "letters")).repartition("id", "group").sortWithinPartitions("id", "group", F.col("block").desc())
        ran = ran.select("id", "block", "group", "end", "start", "due", "letters").mapInArrow(_vectors, schema)
        known = write_stage(ran.select("id", "block", "end", "start"), "repair-vectors")
        passes += 1


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on (id, block), null ids equal."""
    right = right.withColumnRenamed("id", "_id").withColumnRenamed("block", "_block")
    return left.join(right, F.col("id").eqNullSafe(F.col("_id")) & (F.col("block") == F.col("_block"))).drop("_id", "_block")


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last state of each chunk for each state it may start in."""
    for batch in batches:
        to = []
        for letters, end in zip(batch.column("letters").to_pylist(), batch.column("end").to_pylist()):
            costs = backward(letters, tuple(end))
            to.append([trace(letters, costs, s)[1] for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("block"), pa.array(to, pa.list_(pa.int32()))],
                                         names=["id", "block", "to"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First state of each chunk: the states chained through a conversation's chunks."""
    now, s = object(), 0
    for batch in batches:
        out = []
        for key, to in zip(batch.column("id").to_pylist(), batch.column("to").to_pylist()):
            if key != now:
                now, s = key, 0
            out.append(s)
            s = to[s]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("block"), pa.array(out, pa.int32())],
                                         names=["id", "block", "first"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, edits) of every row of a chunk, given its first state."""
    for batch in batches:
        ats, edits = [], []
        for x in batch.to_pylist():
            costs = backward(x["letters"], tuple(x["end"]))
            ats += x["ats"]
            edits += trace(x["letters"], costs, x["first"])[0]
        yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(edits, pa.string())], names=["at", "edits"])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, cost, digest and illegal neighbours of each conversation, its rows in order."""
    now, state, kind = object(), None, None

    def opened():
        return {"audit": [], "cost": 0, "illegal": 0, "before": None, "s": 0, "sha": hashlib.sha256(), "any": False}

    def put(x, role, text):
        x["sha"].update((("\n" if x["any"] else "") + f"{role}:{text}").encode())
        x["any"] = True

    def insert(x):
        x["s"] = INSERTED[x["s"]]
        put(x, ROLE[x["s"]], "")
        x["cost"] += 2

    def batch_of(done):
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in done], kind), pa.array([x["illegal"] for _, x in done], pa.int64()),
             pa.array([x["cost"] for _, x in done], pa.int64()), pa.array(["".join(x["audit"]) for _, x in done], pa.string()),
             pa.array([x["sha"].hexdigest() for _, x in done], pa.string())],
            names=["id", "illegal", "cost", "audit", "repaired_sha256"])

    def close(x):
        for _ in ending(x["s"]):
            insert(x)
            x["audit"].append("I")
        return x

    for batch in batches:
        kind, done = batch.column("id").type, []
        for key, role, text, fault, edits in zip(*(batch.column(c).to_pylist() for c in ("id", "role", "text", "fault", "edits"))):
            if key != now:
                if state is not None:
                    done.append((now, close(state)))
                now, state = key, opened()
            x = state
            if x["before"] is not None and x["before"] + role[:1] not in ("su", "ua", "au"):
                x["illegal"] += 1
            x["before"] = role[:1]
            for e in edits:
                if e == "I":
                    insert(x)
                elif e == "D":
                    x["cost"] += 3
                else:
                    x["cost"] += (2 if e == "R" else 0) + (fault == "truncated")
                    x["s"] = INSERTED[x["s"]] if e == "R" else KEPT[role[:1]][x["s"]]
                    put(x, ROLE[x["s"]] if e == "R" else role, text)
            x["audit"].append(edits)
        if done:
            yield batch_of(done)
    if state is not None:
        yield batch_of([(now, close(state))])


def repair(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, chunk: int = CHUNK,
           buckets: int | None = None) -> DataFrame:
    """Every conversation of ``rows``, damaged and repaired: (id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256); see the module text."""
    if id_col in RESULT:
        raise ValueError(f"id column {id_col!r} is named like a result column")
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema[id_col].dataType.simpleString()
    marked = write_stage(with_faults(damaged(rows, id_col, turn_col, role_col, text_col), buckets), "repair-faults")
    parts = write_stage(chunks(marked, chunk), "repair-chunks")
    ends, _ = stitched(parts)
    known = write_stage(_same(parts, ends), "repair-ends")
    maps = known.select("id", "block", "letters", "end").mapInArrow(_traces, f"id {kind}, block bigint, to array<int>")
    first = maps.repartition("id").sortWithinPartitions("id", "block").mapInArrow(_chained, f"id {kind}, block bigint, first int")
    edits = _same(known, write_stage(first, "repair-states")).mapInArrow(_edits, "at bigint, edits string")
    ordered = marked.select("id", "at", "role", "text", "fault").join(edits, "at").repartition("id").sortWithinPartitions("id", "at")
    fixed = ordered.mapInArrow(_repaired, f"id {kind}, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    turns = marked.groupBy("id", "turn").agg(*[F.sum((F.col("fault") == f).cast("bigint")).alias(f)
                                               for f in ("blank", "duplicate", "truncated")])
    counts = turns.groupBy("id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"),
                                     *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    every = rows.select(F.col(id_col).alias("_conv")).distinct()
    out = every.join(counts, F.col("_conv").eqNullSafe(F.col("id")), "left").drop("id")
    out = out.join(fixed, F.col("_conv").eqNullSafe(F.col("id")), "left").drop("id")
    zero = F.lit(0).cast("bigint")
    return out.select(F.col("_conv").alias(id_col),
                      *[F.coalesce(F.col(c).cast("bigint"), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
