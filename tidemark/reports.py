"""Registered queries that compose operators: range metrics, corpus reports, detectors of several stages, traders, sources and stores; and the SQL of each."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import signals as S
from tidemark.operators import detection as D
from tidemark.operators import market as M
from tidemark.operators import metrics
from tidemark.plans import evolving as E
from tidemark.plans import lifecycle as L
from tidemark.plans import models
from tidemark.queries import (
    _SCORES, ALONG, BASE, CARD, EWMA, FAST, LABELS, LAST, NONCAUSAL, PX, SIG, SIGNAL_NAMES, W30, Z60, W, card, detect_sql, detector_scores, grouped_sql, labels, prices, profit_sql, query, r6, residuals, rounded, signals_sql, simple_events,
)
from tidemark.sources import tables as T
from tidemark.sources.tables import series, table

# Thresholds of the sweeps.
NAB_THRESHOLDS = [3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 15.0, 20.0]
AFF_THRESHOLDS = [1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 15.0]
CONFIGS = {"champion": (0.2, 200), "#2 slow": (0.1, 200), "#3 short": (0.3, 100)}


# SQL of the NAB scores. ``d``: (series_id, k, seq) detections by k, ``ks``: (k), ``prob``: (series_id, p).
def nab_sql(detections: str, ks: str, tp: float = 1.0, fp: float = 0.11, fn: float = 1.0, prob: str = "SELECT DISTINCT series_id, 0 AS p FROM s") -> str:
    sig = lambda x: f"CASE WHEN {x} > 3 THEN -1.0 ELSE 2 / (1 + exp(5.0 * ({x}))) - 1 END"
    return f"""{LABELS}, ks AS ({ks}), prob AS ({prob}),
i AS (SELECT * FROM (SELECT s.series_id, lab.window_id, min(seq) AS a, max(seq) AS b FROM s JOIN lab ON s.series_id = lab.series_id AND s.ts BETWEEN lab.w_start AND lab.w_end GROUP BY ALL) JOIN prob USING (series_id) WHERE b >= p),
d AS (SELECT x.* FROM ({detections}) x JOIN prob USING (series_id) WHERE seq >= p),
ins AS (SELECT d.series_id, d.k, d.seq, i.window_id FROM d JOIN i ON d.series_id = i.series_id AND d.seq BETWEEN i.a AND i.b),
hit AS (SELECT i.series_id, ks.k, i.window_id, i.a, i.b, min(ins.seq) AS f FROM i CROSS JOIN ks LEFT JOIN ins ON i.series_id = ins.series_id AND i.window_id = ins.window_id AND ins.k = ks.k GROUP BY ALL),
parts AS (SELECT series_id, k, CASE WHEN f IS NULL THEN -{fn} ELSE {tp} * ({sig("(f - b) / greatest(b - a, 1)")}) END AS r, 1 AS w, (f IS NOT NULL)::INT AS c FROM hit
  UNION ALL SELECT o.series_id, o.k, {fp} * (CASE WHEN w.b IS NULL THEN -1.0 ELSE {sig("(o.seq - w.b) / greatest(w.b - w.a, 1)")} END), 0, 0
  FROM (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.series_id = d.series_id AND ins.k = d.k AND ins.seq = d.seq)) o LEFT JOIN LATERAL (SELECT a, b FROM i WHERE i.series_id = o.series_id AND i.b < o.seq ORDER BY b DESC LIMIT 1) w ON true),
raw AS (SELECT series_id, k, sum(r) AS raw, sum(w) AS windows, sum(c) AS caught, -{fn} * sum(w) AS null_score, {tp} * (2 / (1 + exp(-5.0)) - 1) * sum(w) AS perfect FROM parts GROUP BY series_id, k),
nab AS (SELECT k, CASE WHEN sum(perfect) = sum(null_score) THEN 0 ELSE 100 * (sum(raw) - sum(null_score)) / (sum(perfect) - sum(null_score)) END AS score FROM raw GROUP BY k)"""


# SQL of the range metrics. ``zl``: (gid, seq, z, label).
CURVE = """nn AS (SELECT gid, count(*) AS n, sum(label) AS p FROM zl GROUP BY gid HAVING sum(label) > 0),
seg AS (SELECT gid, min(seq) AS s, max(seq) AS e FROM (SELECT gid, seq, seq - row_number() OVER (PARTITION BY gid ORDER BY seq) AS g FROM zl WHERE label = 1) GROUP BY gid, g),
od AS MATERIALIZED (SELECT gid, z, row_number() OVER (PARTITION BY gid ORDER BY z DESC, seq) - 1 AS r FROM zl),
kk AS MATERIALIZED (SELECT gid, unnest(range(250)) AS k, n FROM nn),
kr AS MATERIALIZED (SELECT gid, k, CASE WHEN k = 249 THEN n - 1 ELSE trunc(k * ((n - 1) / 249.0::DOUBLE))::BIGINT END AS r FROM kk),
cut AS MATERIALIZED (SELECT kr.gid, kr.k, od.z AS c FROM kr JOIN od ON od.gid = kr.gid AND od.r = kr.r),
base AS (SELECT cut.gid, k, any_value(c) AS c, count(*) FILTER (WHERE z >= c) AS npred, coalesce(sum(label) FILTER (WHERE z >= c), 0) AS l FROM cut JOIN zl USING (gid) GROUP BY cut.gid, k),
buf AS (SELECT zl.gid, zl.seq, zl.z, CASE WHEN zl.seq > e THEN zl.seq - e ELSE s - zl.seq END AS d FROM zl JOIN seg USING (gid) WHERE label = 0 AND (zl.seq BETWEEN e + 1 AND e + 50 OR zl.seq BETWEEN s - 50 AND s - 1))"""
VUS = CURVE + """,
ws AS (SELECT w FROM range(101) AS t(w)),
ext AS (SELECT gid, w, seq, any_value(z) AS z, least(1.0, sum(sqrt(1 - d / w))) AS x FROM buf JOIN ws ON d <= w // 2 GROUP BY gid, w, seq),
xs AS (SELECT cut.gid, w, k, sum(x) AS x FROM cut JOIN ext ON cut.gid = ext.gid AND ext.z >= cut.c GROUP BY cut.gid, w, k),
r1 AS (SELECT gid, w, s, e, CASE WHEN coalesce(lag(e) OVER (PARTITION BY gid, w ORDER BY s) + w // 2 >= s - w // 2, false) THEN 0 ELSE 1 END AS st FROM seg, ws),
r2 AS (SELECT gid, w, s, e, sum(st) OVER (PARTITION BY gid, w ORDER BY s) AS isl FROM r1),
r3 AS (SELECT gid, w, isl, min(s) - w // 2 AS lo, max(e) + w // 2 AS hi FROM r2 GROUP BY gid, w, isl),
r4 AS (SELECT r3.gid, w, isl, max(z) AS m FROM r3 JOIN zl ON zl.gid = r3.gid AND zl.seq BETWEEN lo AND hi GROUP BY r3.gid, w, isl),
ex AS (SELECT r4.gid, w, k, avg((m >= c)::INT) AS ex FROM r4 JOIN cut USING (gid) GROUP BY r4.gid, w, k),
pt AS (SELECT b.gid, ex.w, b.k, least((l + coalesce(x, 0)) / ((p + p + coalesce(x, 0)) / 2), 1) * ex AS tpr, (npred - l - coalesce(x, 0)) / (n - (p + p + coalesce(x, 0)) / 2) AS fpr, (l + coalesce(x, 0)) / npred AS prec
  FROM base b JOIN nn USING (gid) JOIN ex ON ex.gid = b.gid AND ex.k = b.k LEFT JOIN xs ON xs.gid = b.gid AND xs.k = b.k AND xs.w = ex.w),
st AS (SELECT *, tpr - coalesce(lag(tpr) OVER q, 0) AS dt, fpr - coalesce(lag(fpr) OVER q, 0) AS df, tpr + coalesce(lag(tpr) OVER q, 0) AS tt FROM pt WINDOW q AS (PARTITION BY gid, w ORDER BY k)),
ar AS (SELECT gid, w, sum(dt * prec) AS pr, sum(df * tt / 2) + any_value((1 - fpr) * (1 + tpr) / 2) FILTER (WHERE k = 249) AS roc FROM st GROUP BY gid, w),
vus AS (SELECT gid, sum(roc) / 101 AS roc, sum(pr) / 101 AS pr FROM ar GROUP BY gid)"""
RANGE = CURVE + """,
ext AS (SELECT gid, seq, any_value(z) AS z, least(1.0, sum(sqrt(1 - d / 100))) AS x FROM buf GROUP BY gid, seq),
tot AS (SELECT nn.gid, p + coalesce(sum(x), 0) AS total FROM nn LEFT JOIN ext USING (gid) GROUP BY nn.gid, p),
xs AS (SELECT cut.gid, k, sum(x) AS x FROM cut JOIN ext ON cut.gid = ext.gid AND ext.z >= cut.c GROUP BY cut.gid, k),
on_ AS (SELECT gid, seq, z FROM zl WHERE label = 1 UNION SELECT gid, seq, z FROM ext),
r4 AS (SELECT gid, max(z) AS m FROM (SELECT *, seq - row_number() OVER (PARTITION BY gid ORDER BY seq) AS g FROM on_) GROUP BY gid, g),
ex AS (SELECT r4.gid, k, avg((m >= c)::INT) AS ex FROM r4 JOIN cut USING (gid) GROUP BY r4.gid, k),
pt AS (SELECT b.gid, b.k, least((l + coalesce(x, 0)) / ((p + total) / 2), 1) * ex AS tpr, (npred - l - coalesce(x, 0)) / (n - (p + total) / 2) AS fpr, (l + coalesce(x, 0)) / npred AS prec
  FROM base b JOIN nn USING (gid) JOIN tot USING (gid) JOIN ex ON ex.gid = b.gid AND ex.k = b.k LEFT JOIN xs ON xs.gid = b.gid AND xs.k = b.k),
st AS (SELECT *, tpr - coalesce(lag(tpr) OVER q, 0) AS dt, fpr - coalesce(lag(fpr) OVER q, 0) AS df, tpr + coalesce(lag(tpr) OVER q, 0) AS tt, prec + coalesce(lag(prec) OVER q, 1) AS pp FROM pt WINDOW q AS (PARTITION BY gid ORDER BY k)),
auc AS (SELECT gid, sum(dt * pp / 2) AS pr, sum(df * tt / 2) + any_value((1 - fpr) * (1 + tpr) / 2) FILTER (WHERE k = 249) AS roc FROM st GROUP BY gid)"""


def affiliation_sql(thresholds: list[float]) -> str:
    """CTEs from ``zl`` that end in ``aff``: (gid, t, precision, recall, f1)."""
    ts = ", ".join(f"({t})" for t in thresholds)
    return f"""an AS (SELECT gid, count(*) AS n FROM zl GROUP BY gid),
asg AS (SELECT gid, min(seq) AS s, max(seq) + 1 AS e FROM (SELECT gid, seq, seq - row_number() OVER (PARTITION BY gid ORDER BY seq) AS g FROM zl WHERE label = 1) GROUP BY gid, g),
tz AS (SELECT gid, s, e, coalesce((lag(e) OVER q + s) / 2, 0)::DOUBLE AS a, coalesce((e + lead(s) OVER q) / 2, n)::DOUBLE AS b FROM asg JOIN an USING (gid) WINDOW q AS (PARTITION BY gid ORDER BY s)),
th AS (SELECT t::DOUBLE AS t FROM (VALUES {ts}) AS v(t)),
pred AS (SELECT gid, t, min(seq) AS x0, max(seq) + 1 AS x1 FROM (SELECT gid, t, seq, seq - row_number() OVER (PARTITION BY gid, t ORDER BY seq) AS g FROM zl JOIN th ON z >= t) GROUP BY gid, t, g),
ax AS (SELECT tz.gid, t, s, e, a, b, greatest(x0, a) AS x0, least(x1, b) AS x1 FROM tz JOIN pred USING (gid) WHERE least(x1, b) > greatest(x0, a)),
pb AS (SELECT *, list_sort(list_distinct(list_concat([x0, x1], list_filter([s::DOUBLE, e::DOUBLE, s - (b - e), e + (s - a)], lambda k: k > x0 AND k < x1)))) AS br FROM ax),
pq AS (SELECT gid, t, s, e, a, b, unnest(br[1:-2]) AS lo, unnest(br[2:]) AS hi FROM pb),
pz AS (SELECT gid, t, s, sum((hi - lo) * CASE WHEN (lo + hi) / 2 BETWEEN s AND e THEN 1 ELSE (greatest(0, s - a - greatest(s - (lo + hi) / 2, (lo + hi) / 2 - e)) + greatest(0, b - e - greatest(s - (lo + hi) / 2, (lo + hi) / 2 - e))) / (b - a) END) / sum(hi - lo) AS p FROM pq GROUP BY gid, t, s),
mid AS (SELECT *, lead(x0) OVER (PARTITION BY gid, t, s ORDER BY x0) AS nx FROM ax),
mk AS (SELECT gid, t, s, e, a, b, list([x0, x1]) AS xs, flatten(list(list_filter([x0, x1, (x0 + a) / 2, (x1 + a) / 2, (x0 + b) / 2, (x1 + b) / 2, (x1 + nx) / 2], lambda k: k IS NOT NULL))) AS ms FROM mid GROUP BY gid, t, s, e, a, b),
rb AS (SELECT *, list_sort(list_distinct(list_concat([s::DOUBLE, e::DOUBLE], list_filter(ms, lambda k: k > s AND k < e)))) AS br FROM mk),
rq AS (SELECT gid, t, s, e, a, b, xs, unnest(br[1:-2]) AS lo, unnest(br[2:]) AS hi FROM rb),
rd AS (SELECT *, list_min(list_transform(xs, lambda x: greatest(x[1] - (lo + hi) / 2, (lo + hi) / 2 - x[2], 0))) AS d FROM rq),
rz AS (SELECT gid, t, s, sum((hi - lo) * CASE WHEN d <= 0 THEN 1 ELSE 1 - (least(d, (lo + hi) / 2 - a) + least(d, b - (lo + hi) / 2)) / (b - a) END) / any_value(e - s) AS r FROM rd GROUP BY gid, t, s),
pr2 AS (SELECT tz.gid, th.t, avg(p) AS precision, avg(coalesce(r, 0)) AS recall FROM tz CROSS JOIN th LEFT JOIN pz ON pz.gid = tz.gid AND pz.t = th.t AND pz.s = tz.s LEFT JOIN rz ON rz.gid = tz.gid AND rz.t = th.t AND rz.s = tz.s GROUP BY tz.gid, th.t),
aff AS (SELECT *, CASE WHEN precision IS NULL OR precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr2)"""


# Series go by number there: strings through many joins upset some versions of the SQL engine.
_NM = "nm AS (SELECT series_id, row_number() OVER (ORDER BY series_id) AS gid FROM (SELECT DISTINCT series_id FROM s))"
ZL = f"{EWMA}, {LABELS}, {_NM}, zl AS MATERIALIZED (SELECT nm.gid, z.seq, any_value(z.z) AS z, max((lab.window_id IS NOT NULL)::INT) AS label FROM z JOIN nm USING (series_id) LEFT JOIN lab ON z.series_id = lab.series_id AND z.ts BETWEEN lab.w_start AND lab.w_end GROUP BY nm.gid, z.seq)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, seq, z, label) of the forecast detector."""
    return D.label_points(residuals(spark, sf_dir), labels(spark, sf_dir))


@query("range_auc", f"WITH {ZL}, {RANGE} SELECT series_id, round(roc, 5) + 0.0 AS roc, round(pr, 5) + 0.0 AS pr FROM auc JOIN nm USING (gid)")
def range_auc(spark, sf_dir):
    return metrics.range_auc(scored(spark, sf_dir)).withColumns({c: F.round(c, 5) + 0.0 for c in ("roc", "pr")})


@query("vus", f"WITH {ZL}, {VUS} SELECT series_id, round(roc, 5) + 0.0 AS roc, round(pr, 5) + 0.0 AS pr FROM vus JOIN nm USING (gid)")
def vus(spark, sf_dir):
    return metrics.vus(scored(spark, sf_dir)).withColumns({c: F.round(c, 5) + 0.0 for c in ("roc", "pr")})


@query("affiliation", f"WITH {ZL}, {affiliation_sql([2.5])} SELECT series_id, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1 FROM aff JOIN nm USING (gid)")
def affiliation(spark, sf_dir):
    return metrics.affiliation(scored(spark, sf_dir), [2.5]).select("series_id", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("tab_report", f"WITH {ZL}, {VUS}, {affiliation_sql(AFF_THRESHOLDS)}, one AS (SELECT left(series_id, 1) AS dataset, pr FROM vus JOIN nm USING (gid)), best AS (SELECT t, avg(f1) AS f1 FROM aff GROUP BY t ORDER BY f1 DESC, t LIMIT 1) SELECT dataset, round(avg(pr), 5) + 0.0 AS vus_pr, count(*)::BIGINT AS n, any_value(best.t) AS best_threshold, round(any_value(best.f1), 6) + 0.0 AS best_aff_f1 FROM one, best GROUP BY ROLLUP (dataset)")
def tab_report(spark, sf_dir):
    """Mean VUS-PR of each dataset and of the corpus, and the threshold with the best mean affiliation F1 (the first of equal ones)."""
    rows = scored(spark, sf_dir)
    one = metrics.vus(rows).select(F.substring("series_id", 1, 1).alias("dataset"), F.col("pr").alias("score"))
    sweep = metrics.affiliation(rows, AFF_THRESHOLDS).groupBy("threshold").agg(F.avg("f1").alias("f1"))
    best = sweep.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b"))
    return L.report(one).join(F.broadcast(best)).select("dataset", (F.round("score", 5) + 0.0).alias("vus_pr"), "n", (-F.col("b.t")).alias("best_threshold"), r6(F.col("b.f1")).alias("best_aff_f1"))


def _distance_sql(window: int) -> str:
    w = f"(PARTITION BY det, series_id ORDER BY seq ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN seq >= least(floor(count(*) OVER (PARTITION BY det, series_id) * 0.15::DOUBLE), 750) AND count(*) OVER {w} >= 20 AND stddev_pop(residual) OVER {w} > 0 THEN abs(residual - avg(residual) OVER {w}) / stddev_pop(residual) OVER {w} ELSE 0 END"


_NUMBERED = f"{BASE.replace('s AS (', 's0 AS (', 1)}, {_NM.replace('FROM s)', 'FROM s0)')}, s AS MATERIALIZED (SELECT gid AS series_id, seq, ts, value FROM s0 JOIN nm USING (series_id)), {LABELS.replace('lab AS (', 'lab0 AS (', 1)}, lab AS MATERIALIZED (SELECT gid AS series_id, window_id, w_start, w_end FROM lab0 JOIN nm USING (series_id))"
_CFG = ", ".join(f"({i}, {a}::DOUBLE, {w})" for i, (a, w) in enumerate(CONFIGS.values()))
_SHADOW_ZL = f"""RECURSIVE {_NUMBERED}, cfg AS (SELECT * FROM (VALUES {_CFG}) AS v(det, alpha, win)),
e AS (SELECT det, alpha, win, series_id, seq, ts, value, 0.0::DOUBLE AS residual, value AS avg FROM s, cfg WHERE seq = 0
  UNION ALL SELECT e.det, e.alpha, e.win, s.series_id, s.seq, s.ts, s.value, s.value - e.avg, e.alpha * s.value + (1 - e.alpha) * e.avg FROM e JOIN s ON s.series_id = e.series_id AND s.seq = e.seq + 1),
zs AS MATERIALIZED (SELECT det, series_id, seq, ts, CASE WHEN win = 200 THEN {_distance_sql(200)} ELSE {_distance_sql(100)} END AS z FROM e),
zl AS MATERIALIZED (SELECT zs.series_id * {len(CONFIGS)} + det AS gid, zs.seq, any_value(zs.z) AS z, max((lab.window_id IS NOT NULL)::INT) AS label FROM zs LEFT JOIN lab ON zs.series_id = lab.series_id AND zs.ts BETWEEN lab.w_start AND lab.w_end GROUP BY zs.series_id, det, zs.seq)"""
_DET = "CASE vus.gid % 3 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CONFIGS)) + " END"


@query("shadow_scores", f"WITH {_SHADOW_ZL}, {VUS}, {affiliation_sql([2.5])} SELECT {_DET} AS detector, series_id AS unit, round(pr, 5) + 0.0 AS score, round(f1, 6) + 0.0 AS aff_f1 FROM vus JOIN aff USING (gid) JOIN nm ON nm.gid = vus.gid // 3")
def shadow_scores(spark, sf_dir):
    """Champion and challengers score the same series in one scan; VUS-PR and affiliation F1 (flags from 2.5) of each."""
    return L.shadow_scores(series(spark, sf_dir), labels(spark, sf_dir), CONFIGS).select("detector", "unit", (F.round("score", 5) + 0.0).alias("score"), r6(F.col("aff_f1")).alias("aff_f1"))


@query("champion_alerts", f"WITH {EWMA}, pts AS (SELECT series_id, seq, ts, z FROM z WHERE z >= 4), {grouped_sql('pts', 'z')} SELECT series_id, event_id, start_ts, end_ts, size, peak_ts, round(peak_value, 6) + 0.0 AS peak_value FROM ev")
def champion_alerts(spark, sf_dir):
    return L.alerts(series(spark, sf_dir), (0.2, 200), 4.0).withColumn("peak_value", r6(F.col("peak_value")))


# Corpus reports
for _p, (_tp, _fp, _fn) in D.PROFILES.items():

    @query(f"nab_{_p}", f"WITH {BASE}, {nab_sql('SELECT series_id, 0 AS k, seq FROM s WHERE value > 180', 'SELECT 0 AS k', _tp, _fp, _fn)} SELECT '{_p}' AS profile, round(score, 6) + 0.0 AS score FROM nab")
    def nab_profile(spark, sf_dir, p=_p):
        s = series(spark, sf_dir)
        raw = D.nab_raw(s, s.where("value > 180").select("series_id", "seq"), labels(spark, sf_dir), p)
        return D.nab_normalized(raw).select(F.lit(p).alias("profile"), r6(F.col("score")).alias("score"))


@query("forecast_sweep", f"WITH {EWMA}, {nab_sql('SELECT series_id, t AS k, seq FROM z JOIN (SELECT unnest(' + str(NAB_THRESHOLDS) + ')::DOUBLE AS t) ON z >= t', 'SELECT unnest(' + str(NAB_THRESHOLDS) + ')::DOUBLE AS k', prob='SELECT series_id, least(floor(count(*) * 0.15::DOUBLE), 750) AS p FROM s GROUP BY series_id')} SELECT k AS threshold, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY score DESC, k) = 1 AS best FROM nab")
def forecast_sweep(spark, sf_dir):
    """The NAB score of the forecast detector at each threshold, outside its probation; the first of the best is marked."""
    s, z = series(spark, sf_dir), residuals(spark, sf_dir)
    flags = z.select("series_id", "seq", "z", F.explode(F.array(*map(F.lit, NAB_THRESHOLDS))).alias("threshold")).where("z >= threshold").drop("z")
    probation = s.groupBy("series_id").agg(F.least((F.count(F.lit(1)) * F.lit(0.15)).cast("int"), F.lit(750)).alias("probation"))
    got = D.nab_normalized(D.nab_raw(s, flags, labels(spark, sf_dir), probation=probation, by="threshold", values=NAB_THRESHOLDS), "threshold")
    best = got.agg(F.max(F.struct("score", (-F.col("threshold")).alias("t"))).alias("b"))
    return got.join(F.broadcast(best)).select("threshold", r6(F.col("score")).alias("score"), (F.col("threshold") == -F.col("b.t")).alias("best"))


_BENCH_EVAL = "SELECT ev.series_id, ev.event_id, lab.window_id FROM ev JOIN lab ON ev.series_id = lab.series_id AND ev.start_ts <= lab.w_end AND lab.w_start <= ev.end_ts"


@query("flags_by_time", f"WITH {BASE}, {detect_sql(100, 1.5, half=False)} SELECT s.series_id, s.seq FROM s SEMI JOIN pts ON s.series_id = pts.series_id AND s.ts = pts.ts")
def flags_by_time(spark, sf_dir):
    """Rows that share their time with a flagged point."""
    names, s = list(S.SIGNALS), series(spark, sf_dir)
    return D.flags_by_time(s, D.anomalies(D.flagged(S.with_signals(s, W), names, 100, 1.5), names))


@query("corpus_benchmark", f"WITH {BASE}, {detect_sql(100, 1.5, half=False)}, {grouped_sql('pts', 'signal_value')}, {nab_sql('SELECT DISTINCT s.series_id, 0 AS k, s.seq FROM s SEMI JOIN pts ON s.series_id = pts.series_id AND s.ts = pts.ts', 'SELECT 0 AS k', prob='SELECT DISTINCT series_id, 100 AS p FROM s')}, q AS ({_BENCH_EVAL}), f AS (SELECT series_id, coalesce((SELECT count(DISTINCT event_id) FROM q WHERE q.series_id = x.series_id) / nullif((SELECT count(*) FROM ev WHERE ev.series_id = x.series_id), 0), 0) AS p, (SELECT count(DISTINCT window_id) FROM q WHERE q.series_id = x.series_id) / 3 AS r FROM (SELECT DISTINCT series_id FROM s) x) SELECT count(*)::BIGINT AS files, round(avg(p), 6) + 0.0 AS precision, round(avg(r), 6) + 0.0 AS recall, round(CASE WHEN avg(p) + avg(r) > 0 THEN 2 * avg(p) * avg(r) / (avg(p) + avg(r)) ELSE 0 END, 6) + 0.0 AS f1, round((SELECT any_value(score) FROM nab), 6) + 0.0 AS nab FROM f")
def corpus_benchmark(spark, sf_dir):
    """Mean precision and recall over series, F1 of the means, and the NAB score of rows at the events' times after the calibration."""
    names, s, lab = list(S.SIGNALS), series(spark, sf_dir), labels(spark, sf_dir)
    points = D.anomalies(D.flagged(S.with_signals(s, W), names, 100, 1.5), names)
    scores = D.corpus_scores(D.evaluate(D.events(points), lab, "overlap"))
    probation = s.select("series_id", F.lit(100).alias("probation")).distinct()
    nab = D.nab_normalized(D.nab_raw(s, D.flags_by_time(s, points), lab, probation=probation))
    return scores.join(F.broadcast(nab)).select("files", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], r6(F.col("score")).alias("nab"))


@query("corpus_f1", f"WITH {BASE}, {LABELS}, pts AS (SELECT series_id, seq, ts, value FROM s WHERE value > 150), {grouped_sql('pts', 'value')}, q AS ({_BENCH_EVAL}), f AS (SELECT series_id, coalesce((SELECT count(DISTINCT event_id) FROM q WHERE q.series_id = x.series_id) / nullif((SELECT count(*) FROM ev WHERE ev.series_id = x.series_id), 0), 0) AS p, (SELECT count(DISTINCT window_id) FROM q WHERE q.series_id = x.series_id) / 3 AS r FROM (SELECT DISTINCT series_id FROM s) x) SELECT count(*)::BIGINT AS files, round(avg(p), 6) + 0.0 AS precision, round(avg(r), 6) + 0.0 AS recall, round(CASE WHEN avg(p) + avg(r) > 0 THEN 2 * avg(p) * avg(r) / (avg(p) + avg(r)) ELSE 0 END, 6) + 0.0 AS f1 FROM f")
def corpus_f1(spark, sf_dir):
    out = D.corpus_scores(D.evaluate(simple_events(spark, sf_dir), labels(spark, sf_dir), "overlap"))
    return out.select("files", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


# Detectors of several stages
_ALLW = {"zscore": 2.0, "momentum": 1.0, "volatility": 0.5}


def weighted_sql(frame: str, weights: dict[str, float]) -> str:
    """CTEs that end in ``wz``: (series_id, seq, ts, value, surprise, z) of the weighted detector over ``frame``."""
    w = "(PARTITION BY series_id ORDER BY seq ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)"
    parts = " + ".join(f"(CASE WHEN count(*) OVER {w} >= 30 AND stddev_pop({n}) OVER {w} > 1e-9 THEN {x} * abs({n} - avg({n}) OVER {w}) / stddev_pop({n}) OVER {w} ELSE 0 END)" for n, x in weights.items())
    return f"""{signals_sql(frame, list(weights), "wsig")}, wr AS (SELECT series_id, seq, ts, value, ({parts}) / {sum(weights.values())} AS surprise FROM wsig WHERE seq >= {W - 1} UNION ALL SELECT series_id, seq, ts, value, 0.0 FROM wsig WHERE seq < {W - 1}),
wz AS (SELECT *, CASE WHEN seq >= least(floor(count(*) OVER (PARTITION BY series_id) * 0.15::DOUBLE), 750) AND count(*) OVER {w} >= 20 AND stddev_pop(surprise) OVER {w} > 1e-12 THEN abs(surprise - avg(surprise) OVER {w}) / stddev_pop(surprise) OVER {w} ELSE 0 END AS z FROM wr)"""


@query("weighted_detector", f"WITH {BASE}, {weighted_sql('s', _ALLW)} SELECT series_id, seq, round(surprise, 6) + 0.0 AS surprise, round(z, 5) + 0.0 AS z FROM wz")
def weighted_detector(spark, sf_dir):
    """Both stages: the weighted surprise of the signals, and its distance from its own past."""
    return D.weighted_detector(series(spark, sf_dir), _ALLW).select("series_id", "seq", r6(F.col("surprise")).alias("surprise"), (F.round("z", 5) + 0.0).alias("z"))


def _agent_sql(follow: bool) -> str:
    way = "" if follow else "-"
    return f"WITH {profit_sql(BASE + ', ' + PX + ', ' + weighted_sql('px', _ALLW) + f', ps AS (SELECT series_id, seq, ts, value, CASE WHEN z >= 2 AND seq >= 5 THEN {way}0.5 * sign(value / lag(value, 5) OVER {ALONG} - 1) ELSE 0 END::DOUBLE AS position FROM wz)')}{CARD} SELECT series_id, sharpe, total_return, max_drawdown, trades FROM card"


for _mode in ("follow", "fade"):

    @query(f"trading_agent_{_mode}", _agent_sql(_mode == "follow"))
    def trading_agent(spark, sf_dir, follow=_mode == "follow"):
        rows = M.trading_agent(prices(spark, sf_dir), _ALLW, 2.0, 0.5, follow)
        return card(rows).select("series_id", "sharpe", "total_return", "max_drawdown", "trades")


_POLICY = [0.3, -0.2, 0.1, 0.0, 0.0, 0.5, -0.1, 0.2, 0.0, 0.1]
_VOL = f"CASE WHEN count(ret) OVER {LAST.format(19)} >= 10 THEN stddev_pop(ret) OVER {LAST.format(19)} ELSE 0 END"
_STATE = ", ".join((f"CASE WHEN count(*) OVER {LAST.format(59)} >= 30 AND stddev_pop({n}) OVER {LAST.format(59)} > 1e-12 THEN greatest(-5, least(5, {n} / stddev_pop({n}) OVER {LAST.format(59)})) ELSE 0 END" if n in E.SIGNED else f"CASE WHEN count(*) OVER {LAST.format(59)} >= 30 AND stddev_pop({n}) OVER {LAST.format(59)} > 1e-12 THEN greatest(-5, least(5, ({n} - avg({n}) OVER {LAST.format(59)}) / stddev_pop({n}) OVER {LAST.format(59)})) ELSE 0 END") + f" AS {n}" for n in SIGNAL_NAMES)
_MATRIX = f"{BASE}, {PX}, {signals_sql('px')}, zero AS (SELECT series_id, seq, ts, value, value / lag(value) OVER {ALONG} - 1 AS ret, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in SIGNAL_NAMES) + f" FROM sig), mx AS (SELECT series_id, seq, ts, value, {_VOL} AS vol, {_STATE} FROM zero)"


@query("signal_matrix", f"WITH {_MATRIX} SELECT series_id, seq, " + ", ".join(f"round({n}, 5) + 0.0 AS {n}" for n in ("momentum", "zscore", "volatility", "entropy")) + " FROM mx")
def signal_matrix(spark, sf_dir):
    """Signals on comparable scales: signed ones over their deviation, others as distances from their mean."""
    rows = E.states(prices(spark, sf_dir), SIGNAL_NAMES)
    return rows.select("series_id", "seq", *[(F.round(F.col("state")[SIGNAL_NAMES.index(n)], 5) + 0.0).alias(n) for n in ("momentum", "zscore", "volatility", "entropy")])


_TARGET = "tanh(" + " + ".join(f"{w} * {n}" for w, n in zip(_POLICY, SIGNAL_NAMES, strict=True)) + " + 0.05)"


@query("policy_trader", f"WITH {profit_sql(_MATRIX + f', ps AS (SELECT series_id, seq, ts, value, greatest(-1, least(1, {_TARGET} * CASE WHEN vol > 1e-9 THEN 0.1 / sqrt(252) / vol ELSE 0 END))::DOUBLE AS position FROM mx)')}{CARD} SELECT series_id, round(sharpe, 4) + 0.0 AS sharpe, round(total_return, 4) + 0.0 AS total_return, round(max_drawdown, 4) + 0.0 AS max_drawdown, round(exposure, 4) + 0.0 AS exposure, round(turnover, 4) + 0.0 AS turnover FROM card")
def policy_trader(spark, sf_dir):
    """A linear policy over the signal matrix, sized by the volatility target."""
    rows = M.policy_positions(E.states(prices(spark, sf_dir), SIGNAL_NAMES), _POLICY, 0.05)
    return card(rows).select("series_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("sharpe", "total_return", "max_drawdown", "exposure", "turnover")])


def profile_sql(m: int) -> str:
    """CTEs that end in ``mp``: (series_id, seq, profile), by the self join of all windows; and ``pp``, the largest of the windows that cover a row."""
    return f"""pw AS (SELECT series_id, seq, list(value) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS v, count(*) OVER (PARTITION BY series_id) AS n FROM s),
pu AS (SELECT series_id, seq, CASE WHEN list_stddev_pop(v) > 1e-10 THEN list_transform(v, lambda x: (x - list_avg(v)) / list_stddev_pop(v)) ELSE list_transform(v, lambda x: 0.0::DOUBLE) END AS v FROM pw WHERE len(v) = {m} AND n >= {2 * m}),
mp AS (SELECT a.series_id, a.seq, sqrt(greatest(0, {2 * m} * (1 - max(list_dot_product(a.v, b.v)) / {m}))) AS profile FROM pu a JOIN pu b ON a.series_id = b.series_id AND abs(a.seq - b.seq) > {m // 2} GROUP BY a.series_id, a.seq),
pp AS (SELECT s.series_id, s.seq, coalesce(max(profile) OVER (PARTITION BY s.series_id ORDER BY s.seq ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW), 0) AS profile FROM s LEFT JOIN mp USING (series_id, seq))"""


@query("matrix_profile", f"WITH {BASE}, {profile_sql(100)} SELECT series_id, seq, round(profile, 5) + 0.0 AS profile FROM mp")
def matrix_profile(spark, sf_dir):
    return metrics.matrix_profile(series(spark, sf_dir), 100).select("series_id", "seq", (F.round("profile", 5) + 0.0).alias("profile"))


def _rank_sql(c: str) -> str:
    return f"(row_number() OVER (PARTITION BY series_id ORDER BY round({c}, 5), seq) - 1) / (count(*) OVER (PARTITION BY series_id) - 1)"


@query("oracle_scores", f"WITH {BASE}, {NONCAUSAL}, {profile_sql(64)} SELECT series_id, seq, round(greatest({_rank_sql('profile')}, {_rank_sql('robust')}), 6) + 0.0 AS score FROM pp JOIN nc USING (series_id, seq)")
def oracle_scores(spark, sf_dir):
    """The larger of two ranks: a row's worst covering window by the matrix profile, and its distance from a centred average."""
    s = series(spark, sf_dir)
    both = M.noncausal_residual(s).join(metrics.point_profile(s, 64).select("series_id", "seq", "profile"), ["series_id", "seq"])
    both = both.withColumns({"profile": F.round("profile", 5), "robust": rounded(rounded(F.col("robust"), 6), 5)})
    return both.select("series_id", "seq", r6(F.greatest(L.rank01("profile"), L.rank01("robust"))).alias("score"))


# Examples for models
@query("window_examples", f"WITH {BASE}, {LABELS}, a AS (SELECT *, list(value) OVER {W30} AS v, stddev_pop(value) OVER {W30} AS sd, avg(value) OVER {W30} AS m FROM s), l AS (SELECT a.series_id, seq, max((lab.window_id IS NOT NULL)::INT) AS label FROM a LEFT JOIN lab ON a.series_id = lab.series_id AND ts BETWEEN w_start AND w_end GROUP BY ALL) SELECT series_id, seq, round(CASE WHEN sd > 0 THEN (v[1] - m) / sd ELSE 0 END, 6) + 0.0 AS first, round(CASE WHEN sd > 0 THEN (v[-1] - m) / sd ELSE 0 END, 6) + 0.0 AS last, len(v) AS size, label FROM a JOIN l USING (series_id, seq) WHERE seq >= {W - 1}")
def window_examples(spark, sf_dir):
    x = models.window_examples(series(spark, sf_dir), labels(spark, sf_dir))
    return x.select("series_id", "seq", r6(F.col("x")[0]).alias("first"), r6(F.col("x")[W - 1]).alias("last"), F.size("x").cast("long").alias("size"), "label")


@query("file_examples", f"WITH {BASE}, {LABELS}, {signals_sql()}, l AS (SELECT s.series_id, s.seq, max((lab.window_id IS NOT NULL)::INT) AS label FROM s LEFT JOIN lab ON s.series_id = lab.series_id AND ts BETWEEN w_start AND w_end GROUP BY ALL) SELECT series_id, seq, label, " + ", ".join(f"round({n}, 5) + 0.0 AS {n}" for n in SIGNAL_NAMES) + " FROM sig JOIN l USING (series_id, seq) WHERE momentum IS NOT NULL")
def file_examples(spark, sf_dir):
    rows = models.examples(series(spark, sf_dir), labels(spark, sf_dir), SIGNAL_NAMES)
    return rows.select("series_id", "seq", "label", *[(F.round(n, 5) + 0.0).alias(n) for n in SIGNAL_NAMES])


@query("next_values", f"WITH {BASE}, a AS (SELECT *, list(value) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS x FROM s) SELECT series_id, seq, x[1] AS oldest, x[-1] AS newest, round(list_sum(x), 6) + 0.0 AS total, value AS y FROM a WHERE seq >= 10")
def next_values(spark, sf_dir):
    rows = S.in_pieces(series(spark, sf_dir), lambda x: x.withColumn("x", S.next_values(10)), 10).where("x IS NOT NULL")
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return rows.select("series_id", "seq", F.col("x")[0].alias("oldest"), F.col("x")[9].alias("newest"), r6(total).alias("total"), F.col("value").alias("y"))


@query("model_nab", f"WITH {BASE}, {nab_sql('SELECT series_id, 0 AS k, seq FROM s WHERE value / 200 >= 0.85', 'SELECT 0 AS k')} SELECT round(score, 6) + 0.0 AS score FROM nab")
def model_nab(spark, sf_dir):
    """The NAB score of rows that a model gives a probability of 0.85 or more; here the value over 200 stands for it."""
    s = series(spark, sf_dir).withColumn("p", F.col("value") / 200)
    return models.nab_of_flags(s, labels(spark, sf_dir), 0.85).select(r6(F.col("score")).alias("score"))


@query("timestamp_report", f"WITH {BASE.replace('s AS (', 's0 AS (', 1)}, s AS (SELECT series_id, seq, value, CASE WHEN series_id = 'view' AND seq = 7 THEN NULL ELSE ts END AS ts FROM s0), g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER {ALONG})) / 1e6 AS gap FROM s), m AS (SELECT series_id, count(*) AS n, count(ts) AS there, median(gap) AS m FROM g GROUP BY series_id) SELECT series_id, 'parse_error' AS kind, -1::BIGINT AS seq, NULL::DOUBLE AS gap_seconds FROM m WHERE there < n OR m = 0 UNION ALL SELECT g.series_id, 'gap', seq, round(gap, 3) + 0.0 FROM g JOIN m USING (series_id) WHERE there = n AND m > 0 AND gap > 3 * m")
def timestamp_report(spark, sf_dir):
    """Gaps by series; a series with a missing time has one row that says so."""
    s = series(spark, sf_dir).withColumn("ts", F.when(~((F.col("series_id") == "view") & (F.col("seq") == 7)), F.col("ts")))
    return D.timestamp_report(s).select("series_id", "kind", F.coalesce("seq", F.lit(-1).cast("long")).alias("seq"), (F.round("gap_seconds", 3) + 0.0).alias("gap_seconds"))


@query("backtest", f"WITH {profit_sql(BASE + ', ' + PX + ', zz AS (SELECT *, ' + Z60 + ' AS z FROM px)' + f', ps AS (SELECT *, CASE WHEN z >= 1 AND seq >= 5 THEN 0.7 * sign(value / lag(value, 5) OVER {ALONG} - 1) ELSE 0 END::DOUBLE AS position FROM zz)')} SELECT series_id, seq, position, round(pnl, 8) + 0.0 AS pnl FROM pl")
def backtest(spark, sf_dir):
    """Positions and profit of a rule on scores; here the price's rolling distance is the score."""
    scored = prices(spark, sf_dir).withColumn("z", M.rolling_z(F.col("value")))
    return M.backtest(scored, 1.0, 0.7).select("series_id", "seq", "position", (F.round("pnl", 8) + 0.0).alias("pnl"))


# Promotion
@query("sign_test", "SELECT w::INTEGER AS wins, n::INTEGER AS n, round(CASE WHEN n = 0 THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM range(41) AS r(k) WHERE k >= w AND k <= n) END, 6) + 0.0 AS p FROM (SELECT DISTINCT (event_id % 21)::BIGINT AS n FROM events) JOIN (SELECT DISTINCT (event_id % 21)::BIGINT AS w FROM events) ON w <= n")
def sign_test(spark, sf_dir):
    """Chance of at least so many wins of n fair tosses, for every pair that the table's ids give."""
    n = table(spark, sf_dir, "events").select((F.col("event_id") % 21).cast("int").alias("n")).distinct()
    pairs = n.withColumn("wins", F.explode(F.sequence(F.lit(0), "n")))
    return pairs.select("wins", "n", r6(L.sign_test_of(F.col("wins"), F.col("n"))).alias("p"))


_TURNS = "u AS (SELECT unit, detector, score, dense_rank() OVER (ORDER BY unit) - 1 AS turn FROM sc), r AS (SELECT a.turn, a.unit, a.detector, avg(a.score - b.score) OVER q AS delta, sum((a.score > b.score)::INT) OVER q AS wins, sum((a.score < b.score)::INT) OVER q AS losses FROM u a JOIN u b ON a.turn = b.turn AND b.detector = 'd0' WHERE a.detector <> 'd0' WINDOW q AS (PARTITION BY a.detector ORDER BY a.turn))"


@query("promotion_evidence", f"WITH {_SCORES}, {_TURNS} SELECT turn::INTEGER AS turn, detector, round(delta, 6) + 0.0 AS delta, wins::BIGINT AS wins, losses::BIGINT AS losses FROM r")
def promotion_evidence(spark, sf_dir):
    """What each decision of the sequential promotion looks at while d0 is champion: gains, wins and losses over all units so far."""
    return L.evidence(detector_scores(spark, sf_dir), "d0").withColumn("delta", r6(F.col("delta")))


@query("sequential_promotion")
def sequential_promotion(spark, sf_dir):
    rows = detector_scores(spark, sf_dir).withColumn("unit", F.lpad(F.col("unit").cast("string"), 12, "0"))
    return L.sequential_promotion(rows, "d0", min_units=20, min_delta=0.0, alpha=0.2).select("turn", "live", r6(F.col("adaptive")).alias("adaptive"), r6(F.col("static")).alias("static"), "promoted")


# Sources and stores: written to the shared folder and read again
def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/source-{uuid.uuid4().hex[:12]}"


@query("csv_stream", "SELECT event_type AS name, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq, date_trunc('second', ts) AS ts, value FROM events WHERE event_id % 7 <> 0")
def csv_stream(spark, sf_dir):
    """Event types as CSV streams with a header; rows whose value does not parse are left out, fractions of seconds are cut off."""
    e = table(spark, sf_dir, "events")
    bad = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    out = _folder(spark)
    e.select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"), bad.alias("value"), "event_id").repartition(1, "event_type").sortWithinPartitions("event_type", "event_id").drop("event_id").write.partitionBy("event_type").csv(out, header=True)
    rows = T.read_stream_csv(spark, f"{out}/*")
    return rows.select(F.regexp_extract("series_id", "event_type=([^/]+)", 1).alias("name"), "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query("csv_prices", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, value FROM events WHERE event_type = 'view' AND event_id % 5 <> 0")
def csv_prices(spark, sf_dir):
    out = _folder(spark)
    e = table(spark, sf_dir, "events").where("event_type = 'view'").orderBy("event_id")
    bad = F.when(F.col("event_id") % 5 == 0, F.lit("-")).otherwise(F.col("value").cast("string"))
    e.select(F.col("ts").cast("string").alias(" Date "), bad.alias("CLOSE")).coalesce(1).write.csv(out, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return T.read_prices_csv(spark, out).select("seq", "value")


@query("json_windows", f"WITH {BASE}, {LABELS} SELECT series_id, window_id, w_start, w_end FROM lab")
def json_windows(spark, sf_dir):
    """Label windows as a JSON object of lists, with a comment key and fractions of seconds, and back."""
    lab = labels(spark, sf_dir).orderBy("series_id", "window_id").collect()
    held: dict[str, object] = {"_comment": "windows by series"}
    for r in lab:
        held.setdefault(r["series_id"], []).append([f"{r['w_start']}.000000", str(r["w_end"])])
    out = _folder(spark)
    spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.text(out)
    rows = T.read_windows_json(spark, out)
    return rows.select("series_id", F.col("window_id").cast("long").alias("window_id"), F.col("w_start").cast("timestamp_ntz").alias("w_start"), F.col("w_end").cast("timestamp_ntz").alias("w_end"))


@query("channel_meta", "SELECT 'f' || c_custkey AS file_name, c_mktsegment AS dataset_name, c_custkey::INTEGER AS time_steps, round(c_acctbal, 2) + 0.0 AS anomaly_rate FROM customer WHERE c_custkey % 2 = 0 AND upper(c_mktsegment) = 'BUILDING' AND c_custkey <= 1000 ORDER BY file_name LIMIT 50")
def channel_meta(spark, sf_dir):
    """The description file of a corpus, its typed columns, and the univariate files of one dataset up to a length, by name."""
    c = table(spark, sf_dir, "customer")
    out = _folder(spark)
    c.select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file_name"), F.col("c_mktsegment").alias("dataset_name"), F.when(F.col("c_custkey") % 2 == 0, " true ").otherwise("False").alias("if_univariate"), F.lit("").alias("train_lens"), F.lit("x").alias("test_lens"), F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("time_steps"), F.round("c_acctbal", 2).cast("string").alias("anomaly_rate")).write.csv(out, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return T.select_channels(T.read_channel_meta(spark, out), "building", 1000, 50).select("file_name", "dataset_name", "time_steps", (F.col("anomaly_rate") + 0.0).alias("anomaly_rate"))


@query("tab_univariate", "SELECT user_id::VARCHAR AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::VARCHAR AS ts, value, (event_id % 2)::INTEGER AS label FROM events")
def tab_univariate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    channels = F.explode(F.array(F.struct(F.col("value").alias("data"), F.lit("value").alias("cols")), F.struct((F.col("event_id") % 2).cast("double").alias("data"), F.lit("label").alias("cols"))))
    return T.univariate(T.pivot_channels(e.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").cast("string").alias("date"), channels.alias("c")).select("file", "date", "c.data", "c.cols")))


@query("labelled_series", f"WITH {BASE}, lw AS (SELECT DISTINCT series_id FROM s WHERE series_id < 'm') SELECT series_id, seq FROM s SEMI JOIN lw USING (series_id)")
def labelled_series(spark, sf_dir):
    return T.labelled(series(spark, sf_dir), labels(spark, sf_dir).where("series_id < 'm'")).select("series_id", "seq")


def _store(spark: SparkSession, sf_dir: str) -> T.RunStore:
    """Two runs of a series and its signals."""
    store = T.open_store(spark, _folder(spark))
    rows = S.with_signals(series(spark, sf_dir).where("series_id = 'view'"), W, tuple(FAST)).select("seq", "ts", "value", *FAST)
    for name in ("first", "second"):
        store.write(store.begin_run(name), rows, FAST)
    return store


_VIEW = SIG.replace("FROM events)", "FROM events WHERE event_type = 'view')")


@query("store_signal", f"WITH {_VIEW} SELECT seq, ts, 'momentum' AS signal_name, round(momentum, 6) + 0.0 AS value FROM sig")
def store_signal(spark, sf_dir):
    """A signal of a run as it was written, nulls included."""
    return _store(spark, sf_dir).signal(2, "momentum").select("seq", "ts", "signal_name", r6(F.col("value")).alias("value"))


@query("store_stream", f"WITH {_VIEW} SELECT seq, ts, value FROM s")
def store_stream(spark, sf_dir):
    return _store(spark, sf_dir).stream(1).select("seq", "ts", "value")


@query("store_names", "SELECT r::BIGINT AS run_id, source, 'value' AS channel, unnest(['acceleration', 'momentum', 'volatility', 'zscore']) AS signal_name FROM (VALUES (1, 'first'), (2, 'second')) AS v(r, source)")
def store_names(spark, sf_dir):
    """Runs by number with their channels and signals."""
    store = _store(spark, sf_dir)
    out = None
    for run in (1, 2):
        one = store.runs().where(F.col("run_id") == run).join(store.channels(run)).join(store.signal_names(run)).select("run_id", "source", "channel", "signal_name")
        out = one if out is None else out.union(one)
    return out


@query("store_run_summary", "SELECT 2::BIGINT AS run_id, count(*)::BIGINT AS stream_points, min(ts) AS first_ts, max(ts) AS last_ts, 'value' AS channels, 'acceleration,momentum,volatility,zscore' AS signals FROM events WHERE event_type = 'view'")
def store_run_summary(spark, sf_dir):
    out = _store(spark, sf_dir).summary(2)
    return out.select("run_id", "stream_points", "first_ts", "last_ts", F.array_join("channels", ",").alias("channels"), F.array_join("signals", ",").alias("signals"))
