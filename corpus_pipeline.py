"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, segmentation.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over what its predecessor kept. All
but the last return the columns of ``documents``. :func:`run` writes every stage's result as
Parquet in the shared checkpoint folder and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, line_dedup, near_dup, quality, segmentation
from quarry.llm._common import table, write_stage
from quarry.llm.queries import sentencepiece_model

QUALITY_THRESHOLD = 0.3
LINE_RATIO, LINE_PAGES = 0.001, 5  # chosen from the repeated lines of three table sizes, see README
SHINGLE, SIMILARITY = 5, 0.8
SAMPLES = 2


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents scored under the threshold go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text")
    return docs.where(quality.score(model, F.col("text")) >= QUALITY_THRESHOLD)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: boilerplate lines of a source go, near copies as the next stage links them
    counting once; ``n_chars`` follows the text."""
    out = line_dedup.drop_lines(docs, "source", "text", ratio=LINE_RATIO, min_pages=LINE_PAGES,
                                similarity=SIMILARITY, shingle=SHINGLE)
    n = F.when(F.col("_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the document with the smallest id of each component stays.

    Repeated rows of that document count as one. Documents without an id cannot be named, so they
    stay, one row per text."""
    found = near_dup.near_duplicates(docs, "doc_id", "text", shingle=SHINGLE, similarity=SIMILARITY)
    gone = write_stage(found.where("doc_id is not null and not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns).dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that overlap a benchmark item go."""
    found = decontaminate.overlaps(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return decontaminate.clean(docs, "doc_id", "text", found)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: two sampled segmentations of each text, as piece ids."""
    return segmentation.sample_segmentations(docs, "doc_id", "text", sentencepiece_model(), k=SAMPLES)


STAGES = [("quality", keep_quality), ("line_dedup", dedup_lines), ("near_dup", drop_near_duplicates),
          ("decontaminate", drop_contaminated), ("segmentation", segment)]

# The fitted discriminant and the sampled segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
