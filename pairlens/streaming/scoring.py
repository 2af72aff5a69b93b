"""Online scoring: diffs are scored as they arrive."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import LinearModel, batch_score


def score_stream(stream: DataFrame, model: LinearModel, features: DataFrame, key: str, patch: str) -> DataFrame:
    """Streaming scores; the case features are a static side of the join.

    Every step is stateless, so no watermark is needed and late diffs are
    scored like any other.
    """
    return batch_score(model, stream, features, key, patch)


def run_scoring(scores: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write scores as Parquet, exactly once; default: all available files, then stop."""
    trigger = trigger or {"availableNow": True}
    return (
        scores.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trigger).start()
    )
