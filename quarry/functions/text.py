"""Text column expressions shared by the text operators.

Python's ``str.split()`` splits on Unicode whitespace and ``[^\\w\\s]`` is
Unicode-aware; Java's ``\\s``/``\\w`` are ASCII, so the classes below name the
Unicode categories explicitly (``\\p{Z}`` separators, letters, digits, marks).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and word-character classes (Java regex syntax).
WS = r"[\s\p{Z}\u001c-\u001f\u0085]"
WS_RUN = WS + "+"
NON_WORD = r"[^\p{L}\p{N}_\s\p{Z}\u001c-\u001f\u0085]"

# The 51-word stop list used by the top-words-without-stop-words report.
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "be", "been",
              "have", "has", "had", "do", "does", "did", "will", "would",
              "could", "should", "may", "might", "must", "shall", "can",
              "to", "of", "in", "for", "on", "with", "at", "by", "from",
              "and", "or", "not", "this", "that", "it", "as", "but", "if",
              "they", "them", "their", "i", "you", "he", "she", "we", "me"]


def words(text: Column) -> Column:
    """Whitespace tokens, no empty strings (``str.split()``)."""
    return F.filter(F.split(text, WS_RUN), lambda t: t != F.lit(""))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def vocab_tokens(text: Column) -> Column:
    """lower -> delete non-word, non-space characters -> whitespace tokens."""
    return words(F.regexp_replace(F.lower(text), NON_WORD, ""))


def vocab_split(text: Column) -> Column:
    """Like :func:`vocab_tokens` but may contain empty strings; for callers that
    explode and filter rows anyway (cheaper than the array filter)."""
    return F.split(F.regexp_replace(F.lower(text), NON_WORD, ""), WS_RUN)


def is_blank(text: Column) -> Column:
    """``s.strip() == ''`` (NULL counts as blank)."""
    return text.isNull() | text.rlike("^" + WS + "*$")
