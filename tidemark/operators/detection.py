"""Calibration bands, weighted flags, events, forecast residuals and evaluation."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.signals import SIGNALS, along, in_pieces, with_signals

# Weights of single signals and of pairs that are flagged together.
WEIGHTS = {
    "volatility": 0.5, "zscore": 0.5, "momentum": 0.3, "entropy": 0.3, "entropy_fine": 0.2, "entropy_coarse": 0.2, "acceleration": 0.3,
    "volatility+zscore": 0.8, "volatility+momentum": 0.6, "volatility+acceleration": 0.5, "zscore+momentum": 0.6, "zscore+acceleration": 0.5,
    "zscore+entropy": 0.4, "momentum+acceleration": 0.4, "entropy+entropy_fine": 0.3, "entropy+entropy_coarse": 0.3, "entropy_fine+entropy_coarse": 0.3,
}
# Fixed values: (true positive, false positive, false negative) weights of the scoring profiles.
PROFILES = {"standard": (1.0, 0.11, 1.0), "reward_low_fp": (1.0, 0.22, 1.0), "reward_low_fn": (1.0, 0.11, 2.0)}


def robust_band(signals: DataFrame, names: list[str], calib: int | Column, k: float) -> DataFrame:
    """(series_id, signal_name, n, center, lower, upper): median and k times the spread of the sorted values at n // 4 and 3n // 4, over seq < calib."""
    long = signals.where(F.col("seq") < calib).unpivot(["series_id"], names, "signal_name", "value").where("value IS NOT NULL")
    v = F.sort_array(F.collect_list("value"))
    g = long.groupBy("series_id", "signal_name").agg(v.alias("v")).withColumn("n", F.size("v"))
    at = lambda i: F.element_at("v", (i + 1).cast("int"))
    mid = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    spread = at(F.floor(3 * F.col("n") / 4)) - at(F.floor(F.col("n") / 4))
    return g.select("series_id", "signal_name", F.col("n").cast("long").alias("n"), mid.alias("center"), (mid - k * spread).alias("lower"), (mid + k * spread).alias("upper"))


def flagged(signals: DataFrame, names: list[str], calib: int | Column = 600, k: float = 6.0, prefix: DataFrame | None = None) -> DataFrame:
    """Rows from ``calib`` on, with a flag for each signal: strictly outside its band. The bands, a row for each series, join by series.

    ``prefix``: the rows before ``calib`` with their signals, where they are cheaper to compute than by ``signals`` once more.
    """
    calib = calib if isinstance(calib, Column) else F.lit(calib)
    band = robust_band(signals if prefix is None else prefix, names, calib, k).groupBy("series_id").pivot("signal_name", names).agg(F.first("lower").alias("lo"), F.first("upper").alias("hi"))
    joined = signals.where(F.col("seq") >= calib).join(band, "series_id")
    return joined.withColumns({f"flag_{n}": F.coalesce((F.col(n) > F.col(f"{n}_hi")) | (F.col(n) < F.col(f"{n}_lo")), F.lit(False)) for n in names})


def detect(series: DataFrame, calib: int = 600, k: float = 6.0, w: int = 30, names: tuple[str, ...] = tuple(SIGNALS), weights: dict[str, float] = WEIGHTS, threshold: float = 0.1, gap_steps: int | None = 20, gap_seconds: float | None = None) -> DataFrame:
    """The weighted detector from end to end: signals, robust bands from the first ``calib`` rows, flags, scores, events.

    A series of fewer than twice as many rows is calibrated on its first half. Signals are computed once: bands see the first rows alone.
    """
    sized = series.join(series.groupBy("series_id").agg(F.least(F.lit(calib), F.floor(F.count(F.lit(1)) / 2)).cast("long").alias("calib")), "series_id")
    first = with_signals(sized.where(F.col("seq") < F.col("calib")), w, names)
    points = anomalies(flagged(with_signals(sized, w, names), list(names), F.col("calib"), k, first), list(names), threshold, weights)
    return events(points, gap_steps, gap_seconds)


def mean_band(signals: DataFrame, names: list[str], calib: int, k: float = 4.0) -> DataFrame:
    """(series_id, signal_name, n, threshold): mean and k population deviations over seq < calib; an upper bound only."""
    long = signals.where(F.col("seq") < calib).unpivot(["series_id"], names, "signal_name", "value").where("value IS NOT NULL")
    return long.groupBy("series_id", "signal_name").agg(F.count(F.lit(1)).alias("n"), (F.avg("value") + k * F.stddev_pop("value")).alias("threshold"))


def above(signals: DataFrame, band: DataFrame, names: list[str]) -> DataFrame:
    """(series_id, seq, signal_name, value) of the values strictly above the threshold of ``mean_band``."""
    long = signals.unpivot(["series_id", "seq"], names, "signal_name", "value").where("value IS NOT NULL")
    return long.join(band.select("series_id", "signal_name", "threshold"), ["series_id", "signal_name"]).where("value > threshold").select("series_id", "seq", "signal_name", "value")


def adaptive_band(rows: DataFrame, value: str = "value", window: int = 400, k: float = 3.0) -> DataFrame:
    """``rows`` with ``center``, ``lower`` and ``upper`` from the up to ``window`` values before each one: as ``robust_band``, moving."""
    def add(x: DataFrame) -> DataFrame:
        v = x.withColumn("v", F.sort_array(F.collect_list(value).over(along().rowsBetween(-window, -1)))).withColumn("n", F.size("v"))
        at = lambda i: F.get("v", i.cast("int"))
        mid = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
        v = v.withColumns({"center": F.when(F.col("n") > 0, mid), "spread": k * (at(F.floor(3 * F.col("n") / 4)) - at(F.floor(F.col("n") / 4)))})
        return v.withColumns({"lower": F.col("center") - F.col("spread"), "upper": F.col("center") + F.col("spread")}).drop("v", "n", "spread")

    return in_pieces(rows, add, window)


def weighted_score(weights: dict[str, float] = WEIGHTS) -> Column:
    """Sum of the weights of flagged signals and pairs; keys of three parts or more never match."""
    total = F.lit(0.0)
    for key, w in weights.items():
        parts = [p.strip() for p in key.split("+")]
        if len(parts) == 1 or len(set(parts)) == 2 == len(parts):
            hit = F.lit(True)
            for p in parts:
                hit = hit & F.col(f"flag_{p}")
            total = total + F.when(hit, w).otherwise(0.0)
    return total


def anomalies(flags: DataFrame, names: list[str], threshold: float = 0.1, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(series_id, seq, ts, score, signal_name, signal_value): rows scoring at least the threshold, with the strongest flagged signal; ties go by registration order."""
    best = F.array_max(F.array(*[F.when(F.col(f"flag_{n}"), F.struct(F.abs(F.col(n)).alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("s"))) for i, n in enumerate(names)]))
    rows = flags.withColumn("score", weighted_score({x: y for x, y in weights.items() if all(p.strip() in names for p in x.split("+"))})).where(F.col("score") >= threshold).withColumn("b", best)
    return rows.select("series_id", "seq", "ts", "score", F.coalesce("b.s", F.lit("composite")).alias("signal_name"), F.coalesce("b.v", F.lit(0.0)).alias("signal_value"))


def events(points: DataFrame, gap_steps: int | None = 20, gap_seconds: float | None = None) -> DataFrame:
    """(series_id, event_id from 0, start_ts, end_ts, size, peak_ts, peak_value): flagged points whose gap is no larger than ``gap`` belong together; the first of equal peaks counts."""
    w = along()
    if gap_seconds is not None:
        new = ~F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6 <= gap_seconds, F.lit(False))
    else:
        new = ~F.coalesce(F.col("seq") - F.lag("seq").over(w) <= gap_steps, F.lit(False))
    grouped = points.withColumn("new", new.cast("int")).withColumn("event_id", F.sum("new").over(w) - 1)
    peak = F.max(F.struct(F.col("signal_value").alias("v"), (-F.col("seq")).alias("s"), "ts"))
    return grouped.groupBy("series_id", "event_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("size"), peak.alias("p")).select("series_id", "event_id", "start_ts", "end_ts", "size", F.col("p.ts").alias("peak_ts"), F.col("p.v").alias("peak_value"))


def averages_before(x: np.ndarray, alpha: float) -> np.ndarray:
    """The exponential average before each value (the first value itself at first), by blocks: a triangle of weights in each, one number from block to block."""
    size = 64
    blocks = np.pad(x.astype(float), (0, -len(x) % size)).reshape(-1, size)
    k = np.arange(size)
    keep = 1.0 - alpha
    inside = blocks @ (alpha * np.where(k[:, None] >= k, keep ** np.maximum(k[:, None] - k, 0), 0.0)).T
    carry, c = np.empty(len(blocks)), x[0] if len(x) else 0.0
    for i in range(len(blocks)):
        carry[i], c = c, inside[i, -1] + keep**size * c
    after = (inside + carry[:, None] * keep ** (k + 1)).ravel()[: len(x)]
    return np.concatenate((x[:1], after[:-1]))


def _memory(alpha: float) -> int:
    """Steps after which a value's weight in the average is below a double's last digit."""
    return 1 if alpha >= 1 else math.ceil(42 / -math.log(1 - alpha))


def ewma_residuals(series: DataFrame, alpha: float = 0.2) -> DataFrame:
    """``series`` with ``residual``: the value minus the average before it (0 at the first). A piece starts its average early enough to forget how."""
    rows = series.select("series_id", "seq", "ts", "value")

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        return g.assign(residual=g["value"].to_numpy() - averages_before(g["value"].to_numpy(), alpha))

    return in_pieces(rows, lambda x: x.groupBy("series_id").applyInPandas(walk, T.StructType([*x.schema.fields, T.StructField("residual", T.DoubleType())])), _memory(alpha))


def _probation(series: DataFrame, share: float, most: int) -> DataFrame:
    return series.groupBy("series_id").agg(F.least((F.count(F.lit(1)) * F.lit(share)).cast("int"), F.lit(most)).alias("probation"))


def residual_z(residuals: DataFrame, share: float = 0.15, most: int = 750, window: int = 200, least: int = 20, column: str = "residual") -> DataFrame:
    """``z``: distance of a residual from the mean of up to ``window`` before it in their population deviations; 0 in the probation, with a short history or without spread."""
    w = along().rowsBetween(-window, -1)
    sd, c = F.stddev_pop(column).over(w), F.col(column)
    ok = (F.col("seq") >= F.col("probation")) & (F.count(column).over(w) >= least) & (sd > 0)
    z = F.when(ok, F.abs(c - F.avg(column).over(w)) / sd).otherwise(0.0)
    return in_pieces(residuals.join(_probation(residuals, share, most), "series_id"), lambda x: x.withColumn("z", z), window).drop("probation")


def forecast_scores(series: DataFrame, configs: list[tuple[float, int]], share: float = 0.15, most: int = 750, least: int = 20) -> DataFrame:
    """(series_id, seq, ts, value, alpha, resid_window, z) of several detectors in one scan: each piece of a series is scored by all of them."""
    rows = series.select("series_id", "seq", "ts", "value").join(_probation(series, share, most), "series_id")

    def score(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        x, late, out = g["value"].to_numpy(), (g["seq"] >= g["probation"]).to_numpy(), []
        for alpha, window in configs:
            r = x - averages_before(x, alpha)
            out.append(g.assign(alpha=alpha, resid_window=window, z=np.where(late, distances(r, window, least), 0.0)))
        return pd.concat(out)

    reach = max(_memory(a) + w for a, w in configs)
    kind = lambda x: T.StructType([*x.schema.fields, T.StructField("alpha", T.DoubleType()), T.StructField("resid_window", T.IntegerType()), T.StructField("z", T.DoubleType())])
    return in_pieces(rows, lambda x: x.groupBy("series_id").applyInPandas(score, kind(x)), reach).drop("probation")


def distances(r: np.ndarray, window: int, least: int) -> np.ndarray:
    """Of each value from the mean of up to ``window`` before it, in their population deviations; 0 where fewer than ``least`` are there or without spread."""
    out = np.zeros(len(r))
    if len(r) > window:
        past = np.lib.stride_tricks.sliding_window_view(r, window)[:-1]
        sd = past.std(1)
        out[window:] = np.where(sd > 0, np.abs(r[window:] - past.mean(1)) / np.where(sd > 0, sd, 1), 0.0)
    for i in range(max(least, 1), min(window, len(r))):
        sd = r[:i].std()
        out[i] = abs(r[i] - r[:i].mean()) / sd if sd > 0 else 0.0
    if window < least:
        out[:] = 0.0
    return out


def weighted_surprise(signals: DataFrame, weights: dict[str, float], window: int = 200, least: int = 30, ready: tuple[str, ...] = ()) -> DataFrame:
    """``surprise``: weighted mean of each signal's distance from its last ``window`` values, over rows where all of ``ready`` (without it, the weighted signals) are there; 0 elsewhere.

    Signals of weight 0 are not read; without any weight the surprise is 0. Warm-up rows are a prefix of a series, so frames never hold any of them.
    """
    names = [n for n, x in weights.items() if x]
    if not names:
        return signals.withColumn("surprise", F.lit(0.0))
    there = [F.col(n).isNotNull() for n in (ready or names)]
    w = Window.partitionBy("series_id", "ready").orderBy("seq").rowsBetween(-window, -1)
    rows = signals.withColumn("ready", reduce(lambda a, b: a & b, there))
    total = F.lit(0.0)
    for n in names:
        sd = F.stddev_pop(n).over(w)
        total = total + F.when(F.col("ready") & (F.count(n).over(w) >= least) & (sd > 1e-9), F.abs(F.col(n) - F.avg(n).over(w)) / sd * weights[n]).otherwise(0.0)
    return in_pieces(rows, lambda x: x.withColumn("surprise", total / sum(weights[n] for n in names)), window).drop("ready")


def weighted_detector(series: DataFrame, weights: dict[str, float], w: int = 30, feature_window: int = 200, resid_window: int = 200, share: float = 0.15, most: int = 750, least: int = 20, min_window: int = 30) -> DataFrame:
    """``series`` with ``surprise`` and ``z``: the distance of the weighted surprise from its own last ``resid_window`` values, zeros among them. Rows count from where all signals are there."""
    names = tuple(SIGNALS)
    surprised = weighted_surprise(with_signals(series, w, names), {n: weights.get(n, 0.0) for n in names}, feature_window, min_window, names)
    return residual_z(surprised.select(*series.columns, "surprise"), share, most, resid_window, least, "surprise")


def sigmoid(x: Column) -> Column:
    return F.when(x > 3.0, -1.0).otherwise(2.0 / (1.0 + F.exp(5.0 * x)) - 1.0)


def label_points(series: DataFrame, windows: DataFrame) -> DataFrame:
    """``label`` 1 where a window of the series holds the time, ends included. Windows are few for a series and meet its rows as one array."""
    w = windows.groupBy("series_id").agg(F.collect_list(F.struct("w_start", "w_end")).alias("ws"))
    hit = F.exists("ws", lambda x: (F.col("ts") >= x.w_start) & (F.col("ts") <= x.w_end))
    return series.join(w, "series_id", "left").withColumn("label", F.coalesce(hit, F.lit(False)).cast("int")).drop("ws")


def evaluate(found: DataFrame, windows: DataFrame, mode: str) -> DataFrame:
    """(series_id, tp, fp, missed, precision, recall). Peak: an event matches the first window that holds its peak; overlap: every window that it touches."""
    if mode not in ("peak", "overlap"):
        raise ValueError(mode)
    e, w = found.alias("e"), windows.alias("w")
    on = (F.col("e.peak_ts") >= F.col("w.w_start")) & (F.col("e.peak_ts") <= F.col("w.w_end")) if mode == "peak" else (F.col("e.start_ts") <= F.col("w.w_end")) & (F.col("w.w_start") <= F.col("e.end_ts"))
    pairs = e.join(w, (F.col("e.series_id") == F.col("w.series_id")) & on).select("e.series_id", "e.event_id", "w.window_id")
    if mode == "peak":
        pairs = pairs.groupBy("series_id", "event_id").agg(F.min("window_id").alias("window_id"))
    hits = pairs.groupBy("series_id").agg(F.countDistinct("event_id").alias("tp"), F.countDistinct("window_id").alias("hit"))
    n_e, n_w = found.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_e")), windows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_w"))
    z = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = n_w.join(n_e, "series_id", "full").join(hits, "series_id", "left").select("series_id", z("tp").alias("tp"), z("hit").alias("hit"), z("n_e").alias("n_e"), z("n_w").alias("n_w"))
    return rows.select("series_id", "tp", (F.col("n_e") - F.col("tp")).alias("fp"), (F.col("n_w") - F.col("hit")).alias("missed"), F.coalesce(F.try_divide("tp", "n_e"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("hit", "n_w"), F.lit(0.0)).alias("recall"))


def flags_by_time(series: DataFrame, points: DataFrame) -> DataFrame:
    """(series_id, seq) of the rows whose time a flagged point has: rows of the same time are all flagged."""
    return series.join(points.select("series_id", "ts").distinct(), ["series_id", "ts"], "left_semi").select("series_id", "seq")


def nab_raw(series: DataFrame, flags: DataFrame, windows: DataFrame, profile: str = "standard", probation: DataFrame | None = None, by: str | None = None, values: list[float] | None = None) -> DataFrame:
    """(series_id, raw, null_score, perfect, windows, caught): the earliest detection in each window counts by its place, others by their distance from the window before.

    flags: (series_id, seq) of detections. ``probation`` (series_id, probation): windows that end before that row, and detections before it, do not count.
    ``by``: a further column of ``flags`` (a threshold, say) whose ``values`` are scored apart.
    """
    tp, fp, fn = PROFILES[profile]
    keys = ["series_id", by] if by else ["series_id"]
    idx = series.join(windows, "series_id").where("ts >= w_start AND ts <= w_end").groupBy("series_id", "window_id").agg(F.min("seq").alias("s"), F.max("seq").alias("e"))
    if probation is not None:
        idx = idx.join(probation, "series_id").where("e >= probation").drop("probation")
        flags = flags.join(probation, "series_id").where("seq >= probation").drop("probation")
    grid = idx if by is None else idx.withColumn(by, F.explode(F.array(*map(F.lit, values or []))))
    inside = flags.alias("f").join(idx.alias("i"), (F.col("f.series_id") == F.col("i.series_id")) & F.col("f.seq").between(F.col("i.s"), F.col("i.e"))).select("f.*", "i.window_id", "i.s", "i.e")
    first = inside.groupBy(*keys, "window_id").agg(F.min("seq").alias("d"))
    span = F.greatest(F.col("e") - F.col("s"), F.lit(1))
    hit = grid.join(first, [*keys, "window_id"], "left").select(*keys, F.when(F.col("d").isNull(), F.lit(-fn)).otherwise(tp * sigmoid((F.col("d") - F.col("e")) / span)).alias("part"), F.lit(1).alias("window"), F.col("d").isNotNull().cast("int").alias("hit"))
    outside = flags.join(inside.select(*keys, "seq").distinct(), [*keys, "seq"], "left_anti").alias("f")
    before = outside.join(idx.alias("i"), (F.col("f.series_id") == F.col("i.series_id")) & (F.col("i.e") < F.col("f.seq")), "left").groupBy(*[f"f.{c}" for c in keys], "f.seq").agg(F.max(F.struct(F.col("i.e").alias("e"), F.col("i.s").alias("s"))).alias("w"))
    rel = F.when(F.col("w.e").isNull(), 4.0).otherwise((F.col("seq") - F.col("w.e")) / F.greatest(F.col("w.e") - F.col("w.s"), F.lit(1)))
    miss = before.select(*keys, (fp * sigmoid(rel)).alias("part"), F.lit(0).alias("window"), F.lit(0).alias("hit"))
    top = 2.0 / (1.0 + float(np.exp(-5.0))) - 1.0
    total = hit.union(miss).groupBy(*keys).agg(F.sum("part").alias("raw"), F.sum("window").alias("windows"), F.sum("hit").alias("caught"))
    return total.select(*keys, "raw", (F.col("windows") * -fn).alias("null_score"), (F.col("windows") * tp * top).alias("perfect"), "windows", "caught")


def nab_normalized(files: DataFrame, *by: str) -> DataFrame:
    """(``by``, score): 0 for no detection at all, 100 for a perfect one, over all files; 0 where there is nothing to gain."""
    total = files.groupBy(*by).agg(F.sum("raw").alias("r"), F.sum("null_score").alias("n"), F.sum("perfect").alias("p"))
    return total.select(*by, F.when(F.col("p") == F.col("n"), 0.0).otherwise(100 * (F.col("r") - F.col("n")) / (F.col("p") - F.col("n"))).alias("score"))


def report_text(files: DataFrame, corpus: DataFrame | None = None, most: int = 200) -> str:
    """A table of ``evaluate`` rows by series, ``most`` of them at most, and a line of ``corpus_scores``."""
    lines = [f"{'series':<40}{'TP':>6}{'FP':>6}{'missed':>8}{'precision':>11}{'recall':>8}"]
    for r in files.orderBy("series_id").limit(most).collect():
        lines.append(f"{r['series_id']:<40}{r['tp']:>6}{r['fp']:>6}{r['missed']:>8}{r['precision']:>11.3f}{r['recall']:>8.3f}")
    for r in corpus.collect() if corpus is not None else []:
        lines.append(f"{r['files']} series: precision {r['precision']:.3f}, recall {r['recall']:.3f}, F1 {r['f1']:.3f}")
    return "\n".join(lines)


def corpus_scores(files: DataFrame, *by: str) -> DataFrame:
    """(``by``, files, precision, recall, f1) of ``evaluate``: means over files, and F1 of the means."""
    mean = files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return mean.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def timestamp_gaps(series: DataFrame, multiplier: float = 3.0) -> DataFrame:
    """(series_id, seq, gap_seconds, multiple): steps longer than ``multiplier`` times the series' median step."""
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(along()).cast("timestamp"))) / 1e6
    rows = series.withColumn("gap_seconds", gap).where("gap_seconds IS NOT NULL")
    mid = rows.groupBy("series_id").agg(F.median("gap_seconds").alias("m"))
    return rows.join(mid, "series_id").where((F.col("m") > 0) & (F.col("gap_seconds") > multiplier * F.col("m"))).select("series_id", "seq", "gap_seconds", F.bround(F.col("gap_seconds") / F.col("m"), 1).alias("multiple"))


def timestamp_report(series: DataFrame, multiplier: float = 3.0) -> DataFrame:
    """(series_id, kind, seq, gap_seconds, multiple): ``gap`` rows of ``timestamp_gaps``; one ``parse_error`` row instead for a series in which a time is missing or the median step is 0.

    A series of fewer than two rows has nothing to report.
    """
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(along()).cast("timestamp"))) / 1e6
    state = series.withColumn("g", gap).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("there"), F.median("g").alias("m")).where("n > 1")
    bad = state.where("there < n OR m = 0")
    none = F.lit(None).cast("double")
    wrong = bad.select("series_id", F.lit("parse_error").alias("kind"), F.lit(None).cast("long").alias("seq"), none.alias("gap_seconds"), none.alias("multiple"))
    good = timestamp_gaps(series.join(bad.select("series_id"), "series_id", "left_anti"), multiplier)
    return good.select("series_id", F.lit("gap").alias("kind"), "seq", "gap_seconds", "multiple").union(wrong)


def psi(reference: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """(series_id, psi): population stability between two sets of values, in bins between the reference's quantiles; shares below 1e-6 count as that."""
    q = reference.groupBy("series_id").agg(F.array_distinct(F.percentile("value", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("q"))
    place = F.size(F.filter(F.slice("q", 2, F.size("q") - 2), lambda e: e <= F.col("value")))
    share = lambda df, name: df.join(q, "series_id").withColumn("bin", place).groupBy("series_id", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy("series_id"))).drop("n")
    all_bins = q.select("series_id", F.explode(F.sequence(F.lit(0), F.size("q") - 2)).alias("bin"))
    both = all_bins.join(share(reference, "r"), ["series_id", "bin"], "left").join(share(current, "c"), ["series_id", "bin"], "left")
    r, c = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(1e-6)) for x in ("r", "c"))
    return both.groupBy("series_id").agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))
