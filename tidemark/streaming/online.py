"""The forecast-residual detector as a stateful stream, with the results of the batch form; sessions of flagged points under a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.drift import Monitor
from tidemark.operators.drift import with_level

RESULT = "series_id string, seq long, ts timestamp, value double, z double, is_anomaly boolean"
Sink = Callable[[DataFrame, int], None]
STATE = "i long, ewma double, ring array<double>"


def _score(values: np.ndarray, state: tuple, alpha: float, probation: int, window: int, least: int) -> tuple[np.ndarray, tuple]:
    """Distances of the next values of a series, and its state after them: their number, the average, the last residuals."""
    i, avg, ring = state
    ring = list(ring)
    z = np.zeros(len(values))
    for k, v in enumerate(values):
        r = 0.0 if avg is None else v - avg
        avg = v if avg is None else alpha * v + (1 - alpha) * avg
        if i >= probation and len(ring) >= least:
            h = np.array(ring)
            sd = h.std()
            z[k] = abs(r - h.mean()) / sd if sd > 0 else 0.0
        ring = (ring + [float(r)])[-window:]
        i += 1
    return z, (i, None if avg is None else float(avg), ring)


def _group(key: str, rows: Iterator[tuple], state: tuple, gap_steps: int) -> tuple[list[tuple], tuple]:
    """Events that the next (seq, ts, value) flags of a series close, and its open event after them. A null value closes it."""
    n, first, last, last_seq, size, peak_ts, peak = state
    out = []
    for seq, ts, value in rows:
        ends = pd.isna(value)
        if size and (ends or seq - last_seq > gap_steps):
            out.append((key, n, first, last, size, peak_ts, peak))
            n, size = n + 1, 0
        if ends:
            continue
        if not size:
            first, peak_ts, peak = ts, ts, value
        elif value > peak:
            peak_ts, peak = ts, value
        last, last_seq, size = ts, seq, size + 1
    return out, (n, first, last, last_seq, size, peak_ts, peak)


def online_scores(stream: DataFrame, alpha: float = 0.2, threshold: float = 10.0, probation: int = 0, window: int = 200, least: int = 20) -> DataFrame:
    """Scores (series_id, seq, ts, value) rows as they come (ts may be missing); the state of a series is its count, average and last residuals. Rows of one micro-batch are taken by seq."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        z, after = _score(rows["value"].to_numpy(), state.get if state.exists else (0, None, []), alpha, probation, window, least)
        state.update(after)
        yield pd.DataFrame({"series_id": key[0], "seq": rows["seq"], "ts": rows["ts"], "value": rows["value"], "z": z, "is_anomaly": z >= threshold})

    stream = stream if "ts" in stream.columns else stream.withColumn("ts", F.lit(None).cast("timestamp"))
    return stream.groupBy("series_id").applyInPandasWithState(step, RESULT, STATE, "append", "NoTimeout")


EVENT = "series_id string, event_id long, start_ts timestamp, end_ts timestamp, size long, peak_ts timestamp, peak_value double"
_OPEN = "n long, first timestamp, last timestamp, last_seq long, size long, peak_ts timestamp, peak double"
_NEW = (0, None, None, None, 0, None, None)


def online_events(flags: DataFrame, gap_steps: int = 20) -> DataFrame:
    """Events of flagged (series_id, seq, ts, signal_value) rows, each given out when a flag more than ``gap_steps`` rows later closes it.

    A row with a null signal_value ends a series' feed: it closes the open event. The state of a series is its open event; rows of one micro-batch are taken by seq.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        out, after = _group(key[0], rows[["seq", "ts", "signal_value"]].itertuples(index=False), state.get if state.exists else _NEW, gap_steps)
        state.update(after)
        yield pd.DataFrame(out, columns=["series_id", "event_id", "start_ts", "end_ts", "size", "peak_ts", "peak_value"])

    return flags.groupBy("series_id").applyInPandasWithState(step, EVENT, _OPEN, "append", "NoTimeout")


def run_stream(source: DataFrame, checkpoint: str, on_result: Sink | None = None, on_event: Sink | None = None, threshold: float = 10.0, gap_steps: int = 20, alpha: float = 0.2, probation: int = 0, window: int = 200, least: int = 20) -> StreamingQuery:
    """Scores (series_id, seq, ts, value) rows and groups their flags as they come, in one query.

    For every micro-batch ``on_result`` gets a frame of results and its number, ``on_event`` one of the events that closed. A row with a null value ends the feed of its series.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        held = state.get if state.exists else (0, None, [], *_NEW)
        real = rows["value"].notna().to_numpy()
        z = np.zeros(len(rows))
        z[real], scorer = _score(rows["value"].to_numpy()[real], held[:3], alpha, probation, window, least)
        flag = real & (z >= threshold)
        told = [(q, t, v if ok else None) for q, t, v, ok in zip(rows["seq"], rows["ts"], z, flag, strict=True)]
        events, group = _group(key[0], (x for x, keep in zip(told, flag | ~real, strict=True) if keep), held[3:], gap_steps)
        state.update((*scorer, *group))
        yield pd.DataFrame({"kind": 0, "series_id": key[0], "seq": rows["seq"], "ts": rows["ts"], "value": rows["value"], "z": z, "is_anomaly": flag})[real]
        yield pd.DataFrame([(1, *e) for e in events], columns=["kind", "series_id", "event_id", "start_ts", "end_ts", "size", "peak_ts", "peak_value"])

    def deliver(df: DataFrame, number: int) -> None:
        df.persist()
        for kind, sink, schema in ((0, on_result, RESULT), (1, on_event, EVENT)):
            if sink is not None:
                sink(df.where(F.col("kind") == kind).select(*[f.split()[0] for f in schema.split(", ")]), number)
        df.unpersist()

    both = f"kind int, {RESULT}, {EVENT.removeprefix('series_id string, ')}"

    def whole(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        for part in step(key, frames, state):
            yield part.reindex(columns=[f.split()[0] for f in both.split(", ")])

    rows = source.select("series_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = rows.groupBy("series_id").applyInPandasWithState(whole, both, f"{STATE}, {_OPEN}", "append", "NoTimeout")
    return out.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flag_sessions(flags: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(series_id, start, end, size) of flagged points that are less than ``gap`` apart; rows later than ``late`` are left out."""
    w = flags.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "series_id").agg(F.count(F.lit(1)).alias("size"))
    return w.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "size")


def online_drift(stream: DataFrame, reference_size: int = 300, window: int = 300, bins: int = 10, threshold: float = 0.25, every: int = 50) -> DataFrame:
    """``drift_status`` of a stream; the state of a series is its two windows. ``Retrainer`` takes its rows in ``foreachBatch``."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        seen, ref, ring, value = state.get if state.exists else (0, [], [], 0.0)
        m = Monitor(reference_size, window, bins, every, seen, list(ref), list(ring), value)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [m.push(float(v)) for v in rows["value"]]
        state.update((m.seen, m.reference, m.ring, m.value))
        yield pd.DataFrame({"series_id": key[0], "seq": rows["seq"], "psi": pd.array(out, dtype="Float64")})

    held = "seen long, reference array<double>, ring array<double>, value double"
    return with_level(stream.groupBy("series_id").applyInPandasWithState(step, "series_id string, seq long, psi double", held, "append", "NoTimeout"), threshold)
