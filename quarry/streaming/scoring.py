"""Scoring a stream of new rows with a fitted model (M16 on Structured Streaming).

The reference scores a file in batch; with Structured Streaming the same
transform - feature model, assembler, MLlib model - is applied to each
micro-batch. Feature transforms are stateless projections plus joins with
static code tables, which Structured Streaming supports (stream-static join).
The sink's checkpoint is an explicit shared path, so that a restarted application goes on
where the last one ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import models as MD


def score_stream(stream: DataFrame, features, model, feature_cols, id_col: str,
                 target: str, label_names: list | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Streaming DataFrame of (id, <target>) for each incoming row."""
    from ..operators.scoring import score
    x = features.transform(stream, keep=(id_col,))
    x = MD.assemble(x, feature_cols)
    return score(model, x, target, id_col, label_names, labels=labels)


def start_scoring(scored: DataFrame, out_path: str, checkpoint_path: str, trigger_seconds: int | None = None,
                  available_now: bool = False):
    """Append scored rows as Parquet; exactly-once through the checkpoint at ``checkpoint_path``.

    The same path must be given after a restart. ``available_now`` ends after the rows there."""
    w = (scored.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_path))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start(out_path)
