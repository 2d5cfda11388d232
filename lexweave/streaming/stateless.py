"""Stateless operators on streams: cleaning is a projection, matching a join with a static table, top-1 runs per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clean import Step, chain
from ..functions.similarity import similarity
from ..operators.best_match import best_match
from ..plans.pairing import is_small


def clean_stream(stream: DataFrame, column: str, steps: Iterable[Step]) -> DataFrame:
    return stream.withColumn("result", chain(steps, column))


def match_stream(stream: DataFrame, static: DataFrame, measure: str, left: str, right: str, standard: float, **parameters: Any) -> DataFrame:
    """Stream rows with every static row that a measure accepts. The static side must be small; it is checked."""
    if not is_small(static):
        raise ValueError("the static side is too large to broadcast")
    return stream.join(F.broadcast(static), similarity(measure, left, right, standard, **parameters)["success"])


def best_match_stream(stream: DataFrame, static: DataFrame, sink: Callable[[DataFrame, int], None], *, checkpoint: str, strategy: Any, threshold: float, left_col: str, right_col: str, **options: Any) -> StreamingQuery:
    """Runs the best-match join on each micro-batch and hands the result to the sink."""
    def each(batch: DataFrame, number: int) -> None:
        sink(best_match(batch, static, strategy, threshold, left_col=left_col, right_col=right_col, **options), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
