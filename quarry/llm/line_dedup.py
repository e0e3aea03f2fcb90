"""Line dedup by site-relative frequency (operator 3).

Per host, the share of pages that hold a line; a line whose share exceeds a ratio is
boilerplate of that host and is dropped from all its pages. Pages with the same text count
once, so that a page copied many times does not turn its own lines into boilerplate; given a
similarity, so do near copies of one page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dup
from ._common import write_stage


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _mark(line):
    """128 bits that stand for a line."""
    return F.unhex(F.md5(line.cast("binary")))


def _marks(text_col: str):
    return F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), lambda x: F.trim(x) != ""), _mark))


def _host(host_col: str):
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def _classes_agree(docs: DataFrame, host_col: str, text_col: str, over: DataFrame, totals: DataFrame, ratio: float,
                   min_pages: int, similarity: float, shingle: int) -> DataFrame:
    """The rows of ``over`` (_host, _mark) that pass both bounds when near copies count once.

    Only pages that hold a line in question are compared. The texts are not shuffled where the
    lists are small enough for a broadcast; lines are counted class by class with partial sums."""
    lists = write_stage(over.groupBy("_host").agg(F.collect_set("_mark").alias("_over")), "lines-over")
    text = F.coalesce(F.col(text_col), F.lit(""))
    pages = (docs.select(_host(host_col).alias("_host"), _mark(text).alias("_page"), text.alias("_text"),
                         _marks(text_col).alias("_marks")).join(lists, "_host")
             .select("_host", "_page", "_text", F.array_intersect("_marks", "_over").alias("_held"))
             .where(F.size("_held") > 0))
    pages = write_stage(pages, "pages-over")
    classes = (near_dup.near_duplicates(pages, "_page", "_text", shingle, similarity)
               .select("_page", F.col("component_id").alias("_class")).distinct())
    votes = write_stage(pages.select("_host", "_page", "_held").distinct().join(classes, "_page"), "page-classes")
    copies = (votes.groupBy("_host", "_class").agg((F.count("*") - 1).alias("_n"))
              .groupBy("_host").agg(F.sum("_n").alias("_copies")))
    return (votes.select("_host", "_class", F.explode("_held").alias("_mark")).distinct()
            .groupBy("_host", "_mark").agg(F.count("*").alias("_n"))
            .join(totals, "_host").join(copies, "_host")
            .where((F.col("_n") >= min_pages) & (F.col("_n") > F.lit(ratio) * (F.col("_pages") - F.col("_copies")))))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = 0.1, min_pages: int = 5,
                similarity: float | None = None, shingle: int = 5) -> DataFrame:
    """(_host, _bad): the marks of each host's boilerplate lines.

    A host has fewer than (mean lines of a page) / ``ratio`` of them, so the list stays short
    however large the host is. Lines are counted page by page with partial sums before the
    shuffle, so no task sees all lines of a hot host or all pages of a hot line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pages = (docs.select(_host(host_col).alias("_host"), F.md5(text.cast("binary")).alias("_page"),
                         _marks(text_col).alias("_marks"))
             .groupBy("_host", "_page").agg(F.first("_marks").alias("_marks")))
    # A null mark in each page counts the host's pages along with its lines.
    counts = (pages.select("_host", F.explode(F.concat(F.array(F.lit(None).cast("binary")), "_marks")).alias("_mark"))
              .groupBy("_host", "_mark").agg(F.count("*").alias("_n"))
              .where(F.col("_mark").isNull() | (F.col("_n") >= min_pages)))
    counts = write_stage(counts, "line-counts")
    totals = counts.where("_mark is null").select("_host", F.col("_n").alias("_pages"))
    over = (counts.where("_mark is not null").join(totals, "_host")
            .where(F.col("_n") > F.lit(ratio) * F.col("_pages")))
    if similarity is not None:
        over = _classes_agree(docs, host_col, text_col, over, totals, ratio, min_pages, similarity, shingle)
    return write_stage(over.groupBy("_host").agg(F.collect_set("_mark").alias("_bad")), "boilerplate")


def drop_lines(docs: DataFrame, host_col: str, text_col: str, ratio: float = 0.1, min_pages: int = 5,
               similarity: float | None = None, shingle: int = 5) -> DataFrame:
    """``docs`` with the text cleaned, plus ``_lines`` and ``_dropped`` (line counts).

    A line is dropped if it stands in at least ``min_pages`` distinct pages of its host and in
    more than ``ratio`` of them. With a ``similarity`` this must also hold when pages that
    :func:`near_dup.near_duplicates` links count as one page, so that the lines near copies share
    do not all go. Lines end at newlines and are compared exactly; blank lines are
    never dropped. A null host is the host ''; a null text stays null (0 lines); an empty one
    stays empty; the order of the kept lines stays; repeated rows are cleaned alike; an empty
    table gives an empty result. Columns whose names begin with an underscore must not be named
    ``_host``, ``_bad``, ``_bad_host``, ``_kept``, ``_lines`` or ``_dropped``.

    The texts are not shuffled where the hosts' lists are small enough for a broadcast by
    Spark's own size estimate of the written list; beyond that the join shuffles by host, and
    the adaptive join splits a hot host."""
    clash = {"_host", "_bad", "_bad_host", "_kept", "_lines", "_dropped"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"column names in use by the operator: {sorted(clash)}")
    bad = boilerplate(docs, host_col, text_col, ratio, min_pages, similarity, shingle).withColumnRenamed("_host", "_bad_host")
    host = _host(host_col)
    text = F.col(text_col)
    kept = F.when(F.col("_bad").isNull(), _lines(text)).otherwise(
        F.filter(_lines(text), lambda x: ~F.array_contains(F.col("_bad"), _mark(x))))
    out = docs.join(bad, host == F.col("_bad_host"), "left").withColumn("_kept", kept)
    n = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    left = F.when(text.isNull(), 0).otherwise(F.size("_kept"))
    return out.select(*[F.when(text.isNotNull(), F.array_join("_kept", "\n")).alias(text_col) if c == text_col
                        else F.col(f"`{c}`") for c in docs.columns],
                      n.cast("bigint").alias("_lines"), (n - left).cast("bigint").alias("_dropped"))
