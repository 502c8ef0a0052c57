"""Drift of each series against its own first values, in batch form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.drift import psi
from tidemark.functions.signals import PIECE


def with_level(rows: DataFrame, threshold: float = 0.25) -> DataFrame:
    """``psi`` (0 while warming up), ``drift`` and ``level`` from a nullable ``psi``."""
    p: Column = F.col("psi")
    level = F.when(p.isNull(), "warmup").when(p > 0.25, "significant").when(p > 0.1, "moderate").otherwise("stable")
    return rows.withColumns({"level": level, "drift": F.coalesce(p > threshold, F.lit(False)), "psi": F.coalesce(p, F.lit(0.0))})


def drift_status(series: DataFrame, reference_size: int = 300, window: int = 300, bins: int = 10, threshold: float = 0.25, every: int = 50, size: int = PIECE, again: bool = True) -> DataFrame:
    """(series_id, seq, psi, drift, level) of every row. The index is computed every ``every`` rows (and, with ``again``, while it is 0) and holds in between.

    A task takes ``size`` rows of a series, the window before them, and the series' first values.
    """
    reach = window + every
    n = series.groupBy("series_id").agg(F.floor((F.count(F.lit(1)) - 1) / size).alias("last"))
    own = F.sequence(F.floor(F.col("seq") / size), F.least(F.floor((F.col("seq") + reach) / size), F.col("last")))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("last"))
    rows = series.select("series_id", "seq", "value").join(n, "series_id").withColumn("piece", F.explode(F.when(F.col("seq") < reference_size, everywhere).otherwise(own)))

    def walk(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        seq, x, first = g["seq"].to_numpy(), g["value"].to_numpy(), int(key[1]) * size
        reference = x[seq < reference_size]
        out = np.full(len(x), np.nan)
        current = 0.0
        # The rows that may change the index: from the last multiple of ``every`` before the piece on.
        ready = reference_size + window - 1
        start = max(ready, (first + 1) // every * every - 1)
        begin = len(x) - int((seq >= max(0, start - window + 1)).sum())
        for i in np.flatnonzero(seq >= start):
            if again and current == 0.0 or (seq[i] + 1) % every == 0:
                current = psi(reference, x[max(begin, i - window + 1) : i + 1], bins)
            out[i] = current
        mine = (seq >= first) & (seq < first + size)
        return pd.DataFrame({"series_id": key[0], "seq": seq[mine], "psi": pd.array(np.where(np.isnan(out), None, out)[mine], dtype="Float64")})

    kind = series.schema["series_id"].dataType.simpleString()
    return with_level(rows.groupBy("series_id", "piece").applyInPandas(walk, f"series_id {kind}, seq long, psi double"), threshold)
