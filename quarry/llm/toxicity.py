"""Toxicity scores by fuzzy lexicon matches in context (operator 4).

The lexicon is learned from labelled training rows: words that stand in many different
contexts of toxic documents and hardly in others. Its terms form a trie. A word of a text is
matched by intersecting its Levenshtein automaton (a bit-parallel one: a set of states per
number of errors) with the trie, so misspelled terms are found; the number of errors allowed
depends on the term's length. Each match gets the probability learned for its kind (exact, or
so many errors), times a context factor from the window around it: a match in quotation marks
or next to a word that reports speech counts less. A document's score combines its terms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fold, labelled_sample, worker_state, write_stage

WORD = re.compile(r"[^\W_]+(?:[@$!*'][^\W_]+)*")
# Fixed value: letters that look-alike characters stand for.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
QUOTES = "\"“”«»‘’"
# Words by which a text speaks about a term and does not use it.
REPORTING = frozenset("""said says say saying quoted quote quotes called calling term terms word words meaning means
    definition defined slur insult phrase wrote reported dijo palabra llamado mot dit wort sagte genannt""".split())
WINDOW = 80           # characters on each side of a match
QUOTED = 0.3          # factor of a match that is quoted or reported
PRIOR = 3.0           # clean contexts assumed of every term, so that rare terms weigh less
CACHE_WORDS = 500_000  # of one worker


def allowed_errors(length: int) -> int:
    """Errors allowed for a term of so many characters."""
    return 0 if length < 5 else 1 if length < 10 else 2


class Automaton:
    """Levenshtein automaton of one word: state sets as bit masks, one per number of errors.

    Bit i of mask e: the first i characters of the word match what was read with e errors."""

    def __init__(self, word: str, errors: int):
        self.n, self.errors = len(word), errors
        self.at: dict[str, int] = {}
        for i, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 1 << i
        self.all = (1 << self.n + 1) - 1

    def start(self) -> tuple:
        return tuple((1 << e + 1) - 1 & self.all for e in range(self.errors + 1))

    def step(self, state: tuple, c: str) -> tuple:
        hit, out, less = self.at.get(c, 0), [], None
        for e, now in enumerate(state):
            new = (now & hit) << 1
            if e:
                # A substituted or an inserted character, or a skipped one of the word.
                new |= state[e - 1] << 1 | state[e - 1] | less << 1
            less = new & self.all
            out.append(less)
        return tuple(out)

    def errors_at_end(self, state: tuple) -> int | None:
        end = 1 << self.n
        return next((e for e, mask in enumerate(state) if mask & end), None)


class Trie:
    """Lexicon trie; nodes know the lengths and allowed errors of the terms below."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.most = max((allowed_errors(len(t)) for t in terms), default=0)
        self.terms = set(terms)
        # By the pigeonhole principle a word within e errors of a term holds one of the term's
        # e + 1 pieces whole, moved by at most e places: a cheap test before the automaton.
        self.pieces: dict[int, dict[str, list]] = {}
        for t in terms:
            e, node = allowed_errors(len(t)), self.root
            cuts = [len(t) * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.pieces.setdefault(b - a, {}).setdefault(t[a:b], []).append((a, e, len(t)))
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def may_match(self, word: str) -> bool:
        n = len(word)
        for size, known in self.pieces.items():
            for i in range(n - size + 1):
                for a, e, length in known.get(word[i:i + size], ()):
                    if -e <= i - a <= e and -e <= n - length <= e:
                        return True
        return False

    def match(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest errors (then the smallest) and its errors."""
        if word in self.terms:
            return word, 0
        if not self.most or not self.may_match(word):
            return None
        auto = Automaton(word, self.most)
        best, stack = None, [(self.root, auto.start())]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    e = auto.errors_at_end(state)
                    if e is not None and e <= allowed_errors(len(child)) and (best is None or (e, child) < best):
                        best = (e, child)
                else:
                    after = auto.step(state, c)
                    if after[-1]:
                        stack.append((child, after))
        return (best[1], best[0]) if best else None

    def lookup(self, word: str) -> tuple[str, int] | None:
        """As :meth:`match`; look-alike characters read as letters count as one error."""
        found = self.match(word)
        if found is None and not word.isalpha():
            plain = word.translate(LOOK_ALIKE)
            if plain != word and (close := self.match(plain)):
                found = (close[0], close[1] + 1)
        return found


@dataclass
class Lexicon:
    """Terms with the probability that their document is toxic; misspellings' by errors; words
    near a term that ordinary texts use, which don't count."""

    terms: dict[str, float] = field(default_factory=dict)
    by_errors: dict[int, float] = field(default_factory=dict)
    benign: frozenset = frozenset()
    base: float = 0.01

    def weight(self, word: str, found: tuple[str, int]) -> float:
        term, errors = found
        return self.terms[term] * (1.0 if errors == 0 else self.by_errors.get(errors, 0.0))


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "toxic",
          folds: int = 3, held_out: int = 1, max_labelled: int = 30_000,
          min_contexts: int = 5, min_share: float = 0.8) -> Lexicon:
    """Learn the lexicon from labelled rows whose crc32(id) mod ``folds`` is not ``held_out``.

    At most ``max_labelled`` of them are read (the smallest id hashes). A word's support is its
    number of distinct contexts (word before, word after), so copies of a text add nothing. A
    term needs ``min_contexts`` in toxic texts and ``min_share`` of all its contexts there. The
    lexicon holds at most (toxic words read) / ``min_contexts`` terms, with ``max_labelled``
    texts as its bound. Without labelled texts of both kinds it is empty."""
    sample = labelled_sample(labels, id_col, label_col, folds, held_out, max_labelled)
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(sample), "_id").select("_text", "_y"))

    def contexts(batches):
        import pyarrow as pa
        import xxhash

        schema = pa.schema([("word", pa.string()), ("context", pa.int64()), ("y", pa.int32())])
        seen: set = set()

        def flush():
            rows = list(seen)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                                              schema=schema)

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = ["", *_words(text or ""), ""]
                seen.update((w, xxhash.xxh64_intdigest(f"{a} {b}") >> 1, y)
                            for a, w, b in zip(words, words[1:], words[2:], strict=False) if 3 < len(w) <= 40)
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    counts = (rows.mapInArrow(contexts, "word string, context bigint, y int").distinct()
              .groupBy("word").agg(F.sum(F.col("y")).alias("t"), F.sum(F.lit(1) - F.col("y")).alias("c")))
    counts = write_stage(counts, "word-contexts")
    terms_of = counts.where((F.col("t") >= min_contexts) & (F.col("t") >= min_share * (F.col("t") + F.col("c"))))
    terms = {r["word"]: r["t"] / (r["t"] + r["c"] + PRIOR) for r in terms_of.collect()}
    if not terms:
        return Lexicon()
    trie = Trie(sorted(terms))

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(w, m[1], t, c) for w, t, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
                     if w not in trie.terms and (m := trie.lookup(w))]
            yield pa.RecordBatch.from_pydict(
                {k: [f[i] for f in found] for i, k in enumerate(("word", "errors", "t", "c"))},
                schema=pa.schema([("word", pa.string()), ("errors", pa.int32()), ("t", pa.int64()), ("c", pa.int64())]))

    # Words of the sample within the allowed errors of a term: few, and bounded by the sample.
    close = counts.mapInArrow(near, "word string, errors int, t bigint, c bigint").collect()
    benign = frozenset(r["word"] for r in close if r["c"] > 0 and r["c"] >= r["t"])
    by_errors = {}
    for e in range(1, trie.most + 2):
        t = sum(r["t"] for r in close if r["errors"] == e and r["word"] not in benign)
        c = sum(r["c"] for r in close if r["errors"] == e and r["c"] < 3)
        by_errors[e] = (t + 0.8) / (t + c + 1.0)
    return Lexicon(terms, by_errors, benign)


class Scorer:
    """Scores texts inside one worker, with a bounded cache of looked-up words."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.trie, self.cache = lexicon, Trie(sorted(lexicon.terms)), {}

    def find(self, word: str):
        if word in self.cache:
            return self.cache[word]
        found = None
        if 3 < len(word) <= 64 and word not in self.lexicon.benign:
            m = self.trie.lookup(word)
            found = m and (m[0], self.lexicon.weight(word, m))
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = found
        return found

    def context(self, text: str, a: int, b: int) -> float:
        """Factor of a match at text[a:b]: quoted or reported ones count less."""
        before, after = text[max(0, a - WINDOW):a].rpartition("\n")[2], text[b:b + WINDOW].partition("\n")[0]
        opened = sum(before.count(q) for q in QUOTES)
        quoted = opened % 2 == 1 and any(q in after for q in QUOTES)
        told = REPORTING.intersection(_words(before)[-5:]) or REPORTING.intersection(_words(after)[:3])
        return QUOTED if quoted or told else 1.0

    def score(self, text: str | None) -> float:
        base = self.lexicon.base
        if not text or not self.lexicon.terms:
            return base
        low = text.lower()
        cache, miss = self.cache, object()
        hits = {}
        for w in set(WORD.findall(low)):
            found = cache.get(w, miss)
            if found is miss:
                found = self.find(w)
            if found:
                hits[w] = found
        if not hits:
            return base
        best: dict[str, float] = {}
        for m in WORD.finditer(low):
            if found := hits.get(m.group()):
                term, weight = found
                if best.get(term, 0.0) < weight:
                    best[term] = max(best.get(term, 0.0), weight * self.context(low, m.start(), m.end()))
        clean = 1.0 - base
        for p in best.values():
            clean *= 1.0 - p
        return 1.0 - clean


def score(lexicon: Lexicon, text, spark):
    """Score column of a text column. The lexicon reaches the workers by broadcast."""
    import uuid

    shared, run = spark.sparkContext.broadcast(lexicon), uuid.uuid4().hex

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        scorer = worker_state("toxicity", "scorer", run, lambda: Scorer(shared.value))
        return pd.Series([scorer.score(t) for t in texts], dtype=float)

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "toxic",
             folds: int = 3, held_out: int = 1, threshold: float = 0.7, **learn_options) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts, and texts without a match, get the base score; rows with a null or
    repeated id stay, one result row each; labels are read by id alone (null labels and ids left
    out, an id labelled both ways takes no part); other columns, whatever their names, are not
    read; empty tables give an empty result. Whole texts are read, of any length."""
    lexicon = learn(docs, labels, id_col, text_col, label_col, folds, held_out, **learn_options)
    scored = docs.select(F.col(id_col), (fold(F.col(id_col), folds) == held_out).alias("held_out"),
                         score(lexicon, F.col(text_col), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
