"""Token counts by a map-side two-tier lookup (operator 1).

A byte-level BPE tokenizer cuts a text into pre-tokens and merges inside each one
alone, so a text's token count is the sum of its pre-tokens' lengths. Tier one is a
hash table {frequent pre-token: length} that every task gets by broadcast; a pre-token
it lacks is encoded once per Python worker and kept in that worker's bounded cache.

The table is made from all texts: each task keeps a bounded summary of its most
frequent pre-tokens and hands on the ``per_task`` best with their counts; the
``table_size`` with the largest sums are encoded on the driver. Pre-token occurrences
never cross the network, only those summaries do. The table decides speed alone:
lengths are the library's, whichever tier gives them.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import worker_state

# Fixed value: the split pattern of byte-level BPE tokenizers with use_regex.
BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

LONGEST_KEPT = 64        # characters; longer pre-tokens are encoded but not kept
CACHE_ENTRIES = 400_000  # of one worker, beyond the broadcast table
BLOCK = 100_000          # pre-tokens of a long text handled at a time


def two_tier(tokenizer_json: str) -> bool:
    """Whether the tokenizer is one that pre-token lengths can be added up for."""
    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"))
                for t in spec.get("added_tokens") or [])
    return (plain and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and (spec.get("model") or {}).get("type") == "BPE" and not spec["model"].get("dropout"))


class _Counter:
    """Counts tokens of whole texts inside one Python worker."""

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_padding()
        self.tok.no_truncation()
        spec = json.loads(tokenizer_json)
        self.added = two_tier(tokenizer_json)
        special = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.known = set(map(chr, range(128)))  # characters both libraries class alike
        self.odd: set[str] = set()
        self.cache = None

    def _class_alike(self, c: str) -> bool:
        """Whether the library and the pattern cut around ``c`` in the same places."""
        probe = f"a{c}a 1{c}1 .{c}. {c}{c} {c}\n{c}"
        return [p for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(probe)
                for p in [probe[a:b]]] == self.pattern.findall(probe)

    def _plain(self, text: str) -> bool:
        if text.isascii():
            return True
        new = set(text) - self.known
        for c in new - self.odd:
            (self.known if self._class_alike(c) else self.odd).add(c)
        return not (new & self.odd)

    def whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def parts(self, text: str):
        """(added-token matches, texts between them)."""
        if not self.special or not any(m in text for m in self.marks):
            return 0, [text]
        cut = self.special.split(text)
        return len(cut) - 1, cut

    def pre_tokens(self, text: str):
        """Lists of pre-tokens, a bounded number at a time."""
        if len(text) < BLOCK:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block

    def count(self, text: str, cache: dict) -> int:
        if not text:
            return 0
        if not self.added or not self._plain(text):
            return self.whole(text)
        n, texts = self.parts(text)
        return n + sum(sum(map(cache.__getitem__, block)) for t in texts for block in self.pre_tokens(t))


class _Lengths(dict):
    """{pre-token: tokens}; a miss is encoded and kept, and the kept misses are dropped
    when they reach their bound (the broadcast table stays)."""

    def __init__(self, frequent: dict, tok):
        super().__init__(frequent)
        self.frequent, self.tok = frequent, tok

    def __missing__(self, pre: str) -> int:
        n = len(self.tok.encode(pre, add_special_tokens=False).ids)
        if len(pre) <= LONGEST_KEPT:
            if len(self) > len(self.frequent) + CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[pre] = n
        return n


def frequent_lengths(docs: DataFrame, text_col: str, tokenizer_json: str,
                     table_size: int = 65_536, per_task: int = 4_096) -> dict[str, int]:
    """Tier one: {frequent pre-token: token count} from all texts of ``docs``.

    At most ``table_size`` pre-tokens of at most 64 characters, so its size has a bound."""
    if not two_tier(tokenizer_json):
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def summarise(batches):
        import pyarrow as pa

        state = worker_state("token-counts", "counter", hash(shared.value), lambda: _Counter(shared.value))
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                for block in state.pre_tokens(text):
                    seen.update(block)
                if len(seen) > 64 * per_task:  # a bounded summary of frequent items
                    seen = Counter(dict(seen.most_common(32 * per_task)))
        best = [(p, n) for p, n in seen.most_common(2 * per_task) if len(p) <= LONGEST_KEPT][:per_task]
        yield pa.RecordBatch.from_pydict(
            {"pre": pa.array([p for p, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(summarise, "pre string, n bigint")
            .groupBy("pre").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "pre").limit(table_size).collect())
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    pres = [r["pre"] for r in rows]
    out: dict[str, int] = {}
    for at in range(0, len(pres), 4096):
        some = pres[at:at + 4096]
        out.update(zip(some, (len(e.ids) for e in tok.encode_batch(some, add_special_tokens=False)), strict=True))
    return out


def count_tokens(docs: DataFrame, id_col: str, text_col: str, tokenizer_json: str,
                 limit: int = 1024, table_size: int = 65_536) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``tokenizer_json`` is the content of a tokenizer file. Counts are the library's
    without begin, end or added special tokens; special strings inside a text are found
    as the library finds them. A null or empty text has 0 bytes and 0 tokens. Rows with a
    null or repeated id stay, one result row each; other columns, whatever their names,
    are not read. An empty table gives an empty result. A text of any length is counted
    whole, in blocks of bounded memory. Tokenizers whose pre-tokens cannot be added up
    (normaliser, prefix space, non-BPE) and texts with characters that the two pattern
    engines class differently are encoded whole by the library.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((tokenizer_json, frequent_lengths(docs, text_col, tokenizer_json, table_size)))
    run = uuid.uuid4().hex

    def count(batches):
        import pyarrow as pa

        source, frequent = shared.value
        state = worker_state("token-counts", "counter", hash(source), lambda: _Counter(source))
        cache = worker_state("token-counts", "lengths", run, lambda: _Lengths(frequent, state.tok))
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([state.count(t, cache) if t else 0 for t in batch.column(2).to_pylist()], pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"),
                       F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("n_bytes"),
                       F.col(text_col).alias("text"))
    return (rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
            .select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                    (F.col("n_tokens") > F.lit(limit)).alias("over_limit")))
