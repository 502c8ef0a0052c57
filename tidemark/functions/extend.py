"""Where users add to the engine: signals of their own, and a table function that opens events up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import signals as S


def register_signal(name: str, column: Callable[[int], Column] | None = None, of_window: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
    """Adds a signal after the others: a Column of a window's size, or a function of a matrix whose rows are full windows. A name is taken once."""
    if name in S.SIGNALS:
        raise ValueError(f"{name} is registered")
    if (column is None) == (of_window is None):
        raise ValueError("one of column and of_window is needed")
    if of_window is not None:
        S.OF_WINDOW[name] = of_window
        S.SIGNALS[name] = lambda w: S.of_windows(w, {"s": of_window}).getField("s")
    else:
        S.SIGNALS[name] = column


def unregister_signal(name: str) -> None:
    S.SIGNALS.pop(name)
    S.OF_WINDOW.pop(name, None)


@F.udtf(returnType="series_id string, event_id bigint, seq bigint")
class EventRows:
    """The rows from an event's first to its last."""

    def eval(self, series_id: str, event_id: int, first: int, last: int) -> Iterator[tuple]:
        for seq in range(first, last + 1):
            yield series_id, event_id, seq


def register_functions(spark: SparkSession) -> None:
    """``event_rows(series_id, event_id, first, last)`` for SQL."""
    spark.udtf.register("event_rows", EventRows)
