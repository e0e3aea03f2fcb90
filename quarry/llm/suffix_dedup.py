"""Removal of repeated byte strings by induced suffix sorting of shards (operator 11).

Every byte that a string of ``length`` bytes covers goes if that string also starts at another
place, in another text or in the same one.

1. *Anchors.* A window (``length`` bytes from one place) is known by the least hash among its
   64-byte strings, so equal windows have equal anchors. Neighbouring windows with one anchor form
   a *piece*. Texts are hashed once, in Arrow batches; equal texts go on as one, with their number.
2. *Pieces.* Only anchors met twice, in two texts or at two places of one, can hold repeated windows. Their pieces are
   cut out of the texts; equal pieces go on as one, again with their number.
3. *Hot anchors.* If the distinct pieces of an anchor hold over ``hot`` bytes, they are cut into
   smaller pieces, whose key is the part that all windows of the smaller piece share, until none
   holds more or a piece is one window. Equal windows get the same cuts, so no link is lost.
4. *Shards.* Pieces are dealt by key into shards of about ``shard`` bytes. Each task sorts the
   suffixes of its shard by external induction (:mod:`induced`) and marks the windows whose class
   of equal windows stands in two or more places.
5. The marked starts go back to the texts that hold the pieces; each text loses their union.

Rows: a null text counts as empty. A null id is kept, repeated rows and repeated ids give one row
each. Texts under ``length`` bytes, empty ones and empty tables lose nothing. Texts are read whole;
a text is one row of one task, as Spark holds it. Columns other than id and text are not read, so
their names cannot clash; an id column named like a result column raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import write_stage
from .induced import windows_repeated

LENGTH = 200
GRAM = 64
BLOCK = 1 << 16  # window starts hashed at once, about
PLACE = np.uint64((1 << 24) - 1)  # bits of a hash that give way to its place in the block
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def _powers(base: int, n: int) -> np.ndarray:
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


class _Hasher:
    """Hashes of all ``gram``-byte strings of a block of bytes."""

    def __init__(self, gram: int):
        self.gram, self.up, self.down = gram, np.ones(0, np.uint64), np.ones(0, np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.up):
            self.up, self.down = _powers(_MULTIPLIER, 2 * n), _powers(pow(_MULTIPLIER, -1, 1 << 64), 2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[self.gram:] - sums[:-self.gram]) * self.down[:n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: from running minima of blocks, both ways."""
    n = len(h)
    rows = np.concatenate([h, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def _anchor_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the place of the least; of equal ones (by their first 40
    bits) the leftmost, so that equal windows have it at the same distance."""
    low = _least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), width)
    return (low & PLACE).astype(np.int64)


def pieces(texts: list[bytes], length: int, hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first window) of the pieces of texts, in order; each ends where the text's next
    one starts. Texts are hashed some at a time, long ones in blocks."""
    found = [(np.empty(0, np.int64),) * 3]
    width = length - hasher.gram + 1

    def hashed(group):
        data = np.frombuffer(b"".join(x for _, _, x in group), np.uint8)
        sizes = np.array([len(x) for _, _, x in group])
        begins = np.cumsum(sizes) - sizes
        h = hasher(data)
        place = _anchor_places(h, width)
        new = np.empty(len(place), bool)
        new[0], new[1:] = True, place[1:] != place[:-1]
        new[begins] = True
        for e in begins[1:]:  # windows that reach into the next text
            new[e - length + 1:e] = False
        at = np.flatnonzero(new)
        part = np.searchsorted(begins, at, "right") - 1
        text, offset = (np.array([x[i] for x in group]) for i in (0, 1))
        found.append((text[part], h[place[at]].view(np.int64), at - begins[part] + offset[part]))

    group, total = [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text) - length + 1, BLOCK):
            group.append((i, a, text[a:a + BLOCK + length - 1]))
            total += len(group[-1][2])
            if total >= BLOCK:
                hashed(group)
                group, total = [], 0
    if group:
        hashed(group)
    return tuple(np.concatenate(x) for x in zip(*found))


def _binary(column) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(gram)
        for batch in batches:
            texts = _binary(batch.column("_text"))
            text, keys, firsts = pieces(texts, length, hasher)
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"),
                pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
                pa.array([len(x) for x in texts], pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(keys, pa.int64())),
                pa.ListArray.from_arrays(at, pa.array(firsts, pa.int64())),
            ], names=["_id", "sha", "n_bytes", "keys", "firsts"])
    return run


def _piece_id(key: int, piece: bytes) -> bytes:
    return hashlib.blake2b(int(key).to_bytes(8, "little", signed=True) + piece, digest_size=16).digest()


_PIECE = "uid bigint, first bigint, key bigint, n bigint, cid binary, piece binary"


def _emit(rows: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      names=["uid", "first", "key", "n", "cid", "piece"])


def _batched(rows: Iterator, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[-1]) + 64
        if total > size:
            yield _emit(held)
            held, total = [], 0
    if held:
        yield _emit(held)


def _cut(length: int):
    """Pieces of each text whose anchors are met twice (``at``: their places in the text's list)."""
    def rows(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("uid", "n", "at", "keys", "firsts")]
            for text, uid, n, at, keys, firsts in zip(_binary(batch.column("text")), *cols):
                firsts.append(len(text) - length + 1)
                for i in at:
                    piece = text[firsts[i]:firsts[i + 1] + length - 1]
                    yield uid, firsts[i], keys[i], n, _piece_id(keys[i], piece), piece
    return lambda batches: _batched(rows(batches))


def _split(length: int, gram: int, grid: int):
    """Smaller pieces of hot ones: windows of one anchor place and one cell of ``grid`` starts.

    The key is the part that the cell's windows share, at its place next to the anchor; equal
    windows have the anchor at the same distance, hence the same cell and the same shared part."""
    def rows(batches):
        hasher = _Hasher(gram)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("uid", "first", "n")]
            for piece, uid, first, n in zip(_binary(batch.column("piece")), *cols):
                place, m = _anchor_places(hasher(np.frombuffer(piece, np.uint8)), length - gram + 1), len(piece) - length + 1
                ahead = place - np.arange(m)
                cell = ahead // grid
                cuts = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]) | (place[1:] != place[:-1])) + 1, [m]])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    c, p = int(cell[a]), int(place[a])
                    lo, hi = p - c * grid, p - (c * grid + grid - 1) + length  # shared by the cell's windows
                    shared = piece[max(lo, 0):hi]
                    key = int.from_bytes(hashlib.blake2b(b"%d:%d:" % (grid, c) + shared, digest_size=8).digest(),
                                         "little", signed=True)
                    part = piece[a:b + length - 1]
                    yield uid, first + a, key, n, _piece_id(key, part), part
    return lambda batches: _batched(rows(batches))


def _sorted_shard(length: int, memory: int):
    """Marks the repeated windows of one shard (all rows of the task)."""
    def run(batches):
        ids = []

        def texts():
            for batch in batches:
                for cid, piece, n in zip(batch.column("cid").to_pylist(), _binary(batch.column("piece")),
                                         batch.column("n").to_pylist()):
                    ids.append(cid)
                    yield piece, n

        marked = windows_repeated(texts(), length, memory)
        for a in range(0, len(ids), 4096):
            out = []
            for cid, at in zip(ids[a:a + 4096], marked[a:a + 4096]):
                if len(at):
                    cut = np.flatnonzero(np.diff(at) != 1)
                    out.append((cid, [{"a": int(x), "b": int(y)} for x, y in
                                      zip(at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])])]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.binary()),
                 pa.array([y for _, y in out], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                names=["cid", "runs"])
    return run


def _keep(length: int):
    """What is left of each text after the union of its repeated windows is taken out."""
    def run(batches):
        for batch in batches:
            removed, spans, shas = [], [], []
            for text, cuts in zip(_binary(batch.column("text")), batch.column("cuts").to_pylist()):
                left, at, n_spans = hashlib.sha256(), 0, 0
                end = 0
                gone = 0
                for x in sorted((c["a"], c["b"] + length) for c in cuts):
                    if x[0] > end or n_spans == 0:
                        left.update(text[at:x[0]])
                        n_spans += 1
                        gone += x[1] - x[0]
                    else:
                        gone += max(0, x[1] - end)
                    end = max(end, x[1])
                    at = end
                left.update(text[at:])
                removed.append(gone)
                spans.append(n_spans)
                shas.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("sha"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)],
                names=["sha", "n_removed", "n_spans", "kept_sha256"])
    return run


def _sieved(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows that may have their key in ``wanted``, so that long rows need not be shuffled for a join
    that drops them. A bitmap of 2**24 bits is broadcast, at most 4 MB whatever the tables hold."""
    h = F.xxhash64(key)
    word, bit = F.shiftrightunsigned(h, 46).alias("word"), h.bitwiseAND(F.lit(63)).cast("int")
    bits = wanted.select(word, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits"))
    bits = bits.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    asked = F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn("word", word).join(F.broadcast(bits), "word").where(asked).drop("word", "bits")


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int | None = None,
                   shard: int = 4 << 20, hot: int = 256 << 10, memory: int = 64 << 20) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``; see the module text.

    ``shard``: bytes of distinct pieces a shard holds about; ``hot``: bytes of distinct pieces of
    one key above which it is split; ``memory``: bytes of queued tuples a task holds in memory."""
    if id_col in RESULT:
        raise ValueError(f"id column {id_col!r} is named like a result column")
    gram = gram or min(GRAM, max(1, length // 3))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    seen = rows.mapInArrow(_anchors(length, gram), f"_id {id_type}, sha binary, n_bytes bigint, "
                                                   "keys array<bigint>, firsts array<bigint>")
    seen = write_stage(seen.withColumn("uid", F.monotonically_increasing_id()), "repeats-anchors")
    # One row per distinct text, with the number of its copies.
    classes = seen.where(F.size("keys") > 0).groupBy("sha").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n"))
    each = write_stage(seen.select("uid", "keys", "firsts").join(classes, "uid"), "repeats-texts")
    met = each.select("n", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("n").alias("c")).where("c > 1").select("key")
    met = write_stage(met, "repeats-met")  # stored, so that the join below reads shuffles on both sides and a hot key can be split
    lists = each.select("uid", F.posexplode("keys").alias("no", "key")).join(met, "key").groupBy("uid").agg(F.collect_list("no").alias("at"))
    lists = write_stage(each.join(lists, "uid"), "repeats-lists")
    texts = rows.where(F.octet_length("_text") >= length).select(
        F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("sha"), "_text")
    texts = _sieved(texts, lists, "sha").groupBy("sha").agg(F.first("_text").alias("text"))
    held = write_stage(texts.join(lists, "sha"), "repeats-held", "zstd")

    found = write_stage(held.select("uid", "n", "at", "keys", "firsts", "text").mapInArrow(_cut(length), _PIECE), "repeats-pieces", "zstd")
    grid = max(1, length // 4)
    places, parts = [], []
    while True:
        distinct = write_stage(found.groupBy("cid").agg(F.first("key").alias("key"), F.first("piece").alias("piece"),
                                                        F.sum("n").alias("n")), "repeats-distinct", "zstd")
        bytes_of = distinct.groupBy("key").agg(F.sum(F.length("piece")).alias("bytes"), F.max(F.length("piece")).alias("widest"))
        busy = write_stage(bytes_of.where(f"bytes > {hot} and widest > {length}").select("key"), "repeats-hot")
        if grid == 0 or busy.isEmpty():
            places.append(found.select("uid", "first", "cid"))
            parts.append(distinct)
            break
        places.append(found.join(busy, "key", "left_anti").select("uid", "first", "cid"))
        parts.append(distinct.join(busy, "key", "left_anti"))
        split = found.join(busy, "key", "left_semi").select("uid", "first", "n", "piece")
        found = write_stage(split.mapInArrow(_split(length, gram, grid), _PIECE), "repeats-pieces", "zstd")
        grid //= 2
    distinct, where = parts[0], places[0]
    for part, place in zip(parts[1:], places[1:]):
        distinct, where = distinct.unionByName(part), where.unionByName(place)
    total = distinct.agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = max(1, -(-total // shard))
    marked = distinct.select("key", "cid", "piece", "n").repartition(shards, "key").mapInArrow(
        _sorted_shard(length, memory), "cid binary, runs array<struct<a: bigint, b: bigint>>")
    marked = write_stage(marked, "repeats-marked")
    cuts = where.join(marked, "cid").select("uid", "first", F.explode("runs").alias("r")).groupBy("uid").agg(
        F.collect_list(F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b")).alias("b"))).alias("cuts"))
    left = held.select("uid", "sha", "text").join(cuts, "uid").select("sha", "text", "cuts").mapInArrow(
        _keep(length), "sha binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    left = write_stage(left, "repeats-left")
    zero = F.lit(0).cast("bigint")
    return seen.select(F.col("_id").alias(id_col), "sha", "n_bytes").join(left, "sha", "left").select(
        id_col, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"))
