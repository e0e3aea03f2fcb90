"""MinHash near-duplicates by a signature-coordinate inverted join (operator 7).

A text's words give a set of shingles, and the set a signature of ``coordinates`` min-hashes.
Equal sets are one class from the start. Each class is posted under its (coordinate, value)
tokens. Two sets of the wanted similarity agree in at least ``t`` coordinates but for a chance
below ``miss``, so:

* prefix: in a global order of tokens, rare ones first, such a pair shares a token among the
  first ``coordinates - t + 1`` of each, and only those are posted; a token of one class alone
  pairs nothing and just uses up the prefix, so most classes post nothing;
* skip: the long lists of frequent tokens outside the prefixes are never merged; their share of
  the collisions is counted by comparing the two signatures of a pair;
* pairs with at least ``t`` collisions are confirmed on the full shingle sets.

A list never gives all its pairs at once. Its members are paired with its first member alone,
which connects most groups of copies at one comparison per copy. Members of lists that still have
two components are posted anew under the rarest shingles of their full sets, as few as the
similarity allows for each two sizes, and members of different components meet there, in rounds
of 4, 32, 256 ... heads per list. Every two members end up compared, connected or ruled out.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sliced, worker_state, write_stage

_M = (1 << 64) - 1
WORD_CACHE = 250_000         # word hashes kept by one worker, about 180 bytes each
ROWS_TOGETHER = 512          # rows of an Arrow batch turned into Python texts at once
BROADCAST_ROWS = 2_000_000   # ids; 8 bytes each


@lru_cache
def match_threshold(similarity: float, coordinates: int, miss: float = 1e-6) -> int:
    """Largest t such that sets of this similarity agree in fewer than t coordinates with a
    chance of at most ``miss`` (binomial tail)."""
    tail = 0.0
    for t in range(coordinates + 1):
        tail += math.comb(coordinates, t) * similarity ** t * (1 - similarity) ** (coordinates - t)
        if tail > miss:
            return t
    return coordinates


class _Hashes(dict):
    """{word: 64-bit hash}, bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, k: int, hashes: dict):
    """Sorted 64-bit hashes of the distinct k-word shingles of a text.

    A-Z are lower-cased and words are runs of other bytes than blank and \\t to \\r. A text of
    fewer than k words has its whole word sequence as one shingle; one without words has none."""
    import numpy as np

    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    size = min(k, n)
    h = np.full(n - size + 1, (0x9E3779B97F4A7C15 * size) & _M, dtype=np.uint64)
    for j in range(size):
        h = (h ^ w[j:n - size + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _multipliers(coordinates: int):
    """Fixed odd multipliers and masks, one pair per coordinate."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(20240607))
    return (rng.integers(0, _M, coordinates, dtype=np.uint64, endpoint=True) | np.uint64(1),
            rng.integers(0, _M, coordinates, dtype=np.uint64, endpoint=True))


def signature(shingles, multipliers, bits: int):
    """One token per coordinate: the upper bits of its min-hash, the coordinate in the lowest."""
    import numpy as np

    a, s = multipliers
    low = np.full(len(a), _M, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(low, ((shingles[None, at:at + 2048] ^ s[:, None]) * a[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(a), dtype=np.uint64)


def _lists(arrays):
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _signatures(docs: DataFrame, id_col: str, text_col: str, k: int, coordinates: int) -> DataFrame:
    """(id, n, fp_a, fp_b, tokens): set size, 128-bit fingerprint of the set, signature."""
    bits = max(1, (coordinates - 1).bit_length())

    def sign(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        hashes = worker_state("near-dup", "words", None, _Hashes)
        mult = _multipliers(coordinates)
        for batch in sliced(batches, ROWS_TOGETHER):
            n, prints, tokens = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(text, k, hashes)
                n.append(len(s))
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                prints.append((d >> 64, d & _M))
                tokens.append(signature(s, mult, bits) if len(s) else s)
            fp = np.array(prints, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), _lists(tokens)],
                names=["id", "n", "fp_a", "fp_b", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(sign, f"id {kind}, n bigint, fp_a bigint, fp_b bigint, tokens array<bigint>"))


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, ids: DataFrame) -> DataFrame:
    """(cid, shingles): full sets of the documents in ``ids`` (a column ``cid``)."""
    def full(batches):
        import pyarrow as pa

        hashes = worker_state("near-dup", "words", None, _Hashes)
        for batch in sliced(batches, ROWS_TOGETHER):
            sets = [shingle_set(t, k, hashes) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["cid", "shingles"])

    # Ids are 8 bytes; beyond the bound the join shuffles.
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("cid"), F.col(text_col).alias("text")).join(ids, "cid", "left_semi")
            .mapInArrow(full, f"cid {kind}, shingles array<bigint>").dropDuplicates(["cid"]))


def _prefix_postings(classes: DataFrame, coordinates: int, t: int) -> DataFrame:
    """(token, cid, n): each class under the rarest tokens of its signature, as far as the
    prefix goes, where another class is posted too."""
    tokens = classes.select("cid", "n", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    held = tokens.join(shared, "token")
    rank = F.expr("row_number() over (partition by cid order by df, token)")
    of = F.expr("count(*) over (partition by cid)")  # a class has at most `coordinates` rows
    # The tokens of this class alone come first in the order and are not among these rows.
    prefix = (held.select("token", "cid", "n", rank.alias("rank"), of.alias("held"))
              .where(F.col("rank") <= F.lit(coordinates - t + 1) - (F.lit(coordinates) - F.col("held")))
              .select("token", "cid", "n"))
    prefix = write_stage(prefix, "prefixes")
    lists = prefix.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    place = F.expr("row_number() over (partition by token order by cid)")
    return write_stage(prefix.join(lists, "token").withColumn("place", place), "postings")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node each node of an edge list (a, b) is connected with.

    Alternating large-star and small-star steps; each leaves edges from a node to a smaller one.
    The loop ends when every node has one edge, to a node that has none: that one is the smallest."""
    # Edges run from the larger node to the smaller one.
    now = write_stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .where("u <> v").distinct(), name)
    while not _stars(now):
        # Large star: of a node's neighbours only the smaller ones can lower its minimum.
        low = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = now.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        # Small star: the smaller neighbours of a node, and the node, go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        new = large.join(low, "u").select(moved.alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = write_stage(new, name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _stars(edges: DataFrame) -> bool:
    """Whether no start u of an edge (u, v) has a second edge or ends another one."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("starts"), F.lit(0).alias("ended")),
                             F.struct(F.col("v").alias("node"), F.lit(0).alias("starts"), F.lit(1).alias("ended"))))
    return (edges.select(ends.alias("e")).select("e.*")
            .groupBy("node").agg(F.sum("starts").alias("starts"), F.max("ended").alias("ended"))
            .where("starts > 1 or (starts = 1 and ended = 1)").isEmpty())


def _collide(pairs: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least t coordinates."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("tokens").alias(f"tokens_{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= t).select("a", "b"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"shingles_{x}"))
    common = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("bigint")
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(F.lit(100) * common >= F.lit(percent) * union).select("a", "b"))


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with the current component of each ``cid`` as ``label``."""
    members = members.drop("label")
    if labels is None:
        return members.withColumn("label", F.col("cid"))
    return (members.join(labels, members["cid"] == labels["node"], "left")
            .withColumn("label", F.coalesce("label", "cid")).drop("node"))


def _open_lists(members: DataFrame, key: str, tried: int) -> DataFrame:
    """Members of the lists that have two components and a member that has not been a head."""
    mixed = (members.groupBy(key).agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                      F.max("place").alias("last"))
             .where(F.col("last") > tried).where("lo < hi").select(key))
    return members.join(mixed, key, "left_semi")


def _set_postings(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, cid, n, label, rank, place): members under the rarest shingles of their sets.

    Sets of n and m shingles with the wanted similarity have ``need`` = percent * (n + m) /
    (100 + percent) of them in common, so in any order of shingles they share one among the first
    n - need + 1 and m - need + 1. ``rank`` is a shingle's place in its set, rare ones first;
    those of one member alone come first and are not posted."""
    who = members.groupBy("cid").agg(F.first("n").alias("n"), F.first("label").alias("label"))
    held = sets.join(who, "cid").select("cid", "n", "label", F.explode("shingles").alias("shingle"))
    counts = held.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    # The most a partner of any size allows, for a start: n - percent * n / 100 + 1.
    ranked = (held.join(counts, "shingle")
              .withColumn("rank", F.expr("n - count(*) over (partition by cid) + "
                                         "row_number() over (partition by cid order by df, shingle)"))
              .where(F.lit(100) * (F.col("n") - F.col("rank") + 1) >= F.lit(percent) * F.col("n")).drop("df"))
    return ranked.withColumn("place", F.expr("row_number() over (partition by shingle order by rank, cid)"))


def link_classes(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int,
                 similarity: float, coordinates: int, miss: float) -> DataFrame | None:
    """(node, label) of the classes that are linked with others; None if none is."""
    t = match_threshold(similarity, coordinates, miss)
    percent = round(similarity * 100)
    postings = _prefix_postings(classes, coordinates, t)
    ids = postings.select("cid").distinct()
    sets = write_stage(_sets(docs, id_col, text_col, k, ids), "sets")
    candidates = classes.join(ids, "cid", "left_semi").select("cid", "tokens")
    # Every member meets the first of its list.
    meet = postings.select("cid", "n", F.expr("first(cid) over (partition by token order by place)").alias("a"),
                           F.expr("first(n) over (partition by token order by place)").alias("m"))
    pairs = (meet.where("cid <> a").where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
             .select("a", F.col("cid").alias("b")).distinct())
    near = write_stage(_collide(pairs, candidates, t), "collisions")
    links = write_stage(_confirm(near, sets, percent), "links")
    labels = None if links.isEmpty() else components(links)
    # Members of lists with two components are matched by the prefixes of their full sets.
    rest = write_stage(_open_lists(_labelled(postings, labels), "token", 1), "open-lists")
    if rest.isEmpty():
        return labels
    lists = write_stage(_open_lists(_set_postings(rest, sets, percent), "shingle", 0), "set-postings")
    tried, heads = 0, 4
    need = f"{percent} * (n + m) / (100.0 + {percent})"
    while not lists.isEmpty():
        # Members tried + 1 .. tried + heads of each open list meet its later members.
        first = lists.where(F.col("place").between(tried + 1, tried + heads)).select(
            "shingle", F.col("cid").alias("a"), F.col("n").alias("m"), F.col("rank").alias("rank_a"),
            F.col("place").alias("place_a"), F.col("label").alias("label_a"))
        pairs = (lists.join(first, "shingle")
                 .where(f"place > place_a and label <> label_a and rank - 1 <= n - {need} and rank_a - 1 <= m - {need}")
                 .select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b")).distinct())
        found = write_stage(_confirm(pairs, sets, percent), "links")
        tried, heads = tried + heads, heads * 8
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
        lists = write_stage(_open_lists(_labelled(lists, labels), "shingle", tried), "set-postings")
    return labels


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8,
                    coordinates: int = 64, miss: float = 1e-6) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts are linked if the Jaccard similarity of their shingle sets (:func:`shingle_set`) is at
    least ``similarity`` (in whole per cent); ``component_id`` is the smallest id reachable over
    links, the id itself included; ``kept`` is whether it is the id. Null and empty texts have no
    shingles and are linked with nothing. Equal texts are linked. Repeated rows of an id give one
    result row each; rows that share an id but not the text count as one node. A row with a null
    id gets the component of the rows with its shingle set, null if they have no id either. Other
    columns, whatever their names, are not read; an empty table gives an empty result.
    """
    signed = write_stage(_signatures(docs, id_col, text_col, shingle, coordinates), "signatures")
    classes = (signed.where("n > 0").groupBy("fp_a", "fp_b")
               .agg(F.min("id").alias("cid"), F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    classes = write_stage(classes.where("cid is not null"), "classes")
    labels = link_classes(docs, classes, id_col, text_col, shingle, similarity, coordinates, miss)
    of = classes.select("fp_a", "fp_b", F.col("cid").alias("_cid"))
    if labels is not None:
        of = (of.join(labels, of["_cid"] == labels["node"], "left")
              .select("fp_a", "fp_b", F.coalesce("label", "_cid").alias("_cid")))
    rows = signed.select("id", "n", F.when(F.col("n") > 0, F.col("fp_a")).alias("fp_a"), "fp_b")
    joined = rows.join(of, ["fp_a", "fp_b"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("_cid"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
