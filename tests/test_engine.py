"""Signals against plain numpy, events, store, registry, and every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import queries as Q
from tidemark.__main__ import main as command
from tidemark.functions import extend, ranges
from tidemark.functions import signals as S
from tidemark.operators import detection as D
from tidemark.operators import market as M
from tidemark.operators import metrics
from tidemark.plans import lifecycle as L
from tidemark.sources import service
from tidemark.sources import tables as T
from tidemark.streaming.online import online_events, run_stream

SF = "/root/testdata/sf0.001"


def rows(spark, values):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "series_id string, seq long, value double")


def last(spark, values, column):
    return rows(spark, values).select("seq", column.alias("s")).orderBy("seq").collect()[-1]["s"]


def test_signal_values(spark):
    assert last(spark, [10, 20, 30], S.momentum(3)) == 10.0
    assert last(spark, [0, 1, 4], S.acceleration(3)) == 2.0
    assert last(spark, [1, 2, 3, 4], S.entropy(4, 4)) == 2.0
    assert last(spark, [1, 1, 1, 1], S.entropy(4, 4)) == 0.0
    assert last(spark, [5] * 8, S.flatness(8)) == 0.0


@pytest.mark.parametrize("w", [7, 10, 31])
def test_envelope_is_the_analytic_signal(spark, w):
    x = np.random.default_rng(w).normal(size=w)
    d = np.fft.fft(x - x.mean())
    h = np.zeros(w)
    h[0] = 1
    h[1 : (w + 1) // 2] = 2
    if w % 2 == 0:
        h[w // 2] = 1
    assert last(spark, x, S.envelope(w)) == pytest.approx(abs(np.fft.ifft(d * h)[-1]), rel=1e-9)


def test_window_too_small():
    with pytest.raises(ValueError):
        S.momentum(1)


def test_store_round_trip(spark, tmp_path):
    store = T.RunStore(spark, str(tmp_path))
    run = store.begin_run("test")
    s = Q.series(spark, SF).where("series_id = 'view'").withColumn("momentum", S.momentum(30)).select("seq", "ts", "value", "momentum")
    store.write(run, s, ["momentum"])
    assert store.stream(run).count() == s.count() == store.signal(run, "momentum").count()
    assert store.begin_run("again") == run + 1
    with pytest.raises(KeyError):
        store.summary(99)


def test_service_reads_the_store(spark, tmp_path):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    store = T.open_store(spark, str(tmp_path / "runs"))
    assert service.answer(store, "/runs", "k", "k") == (200, [])
    s = Q.series(spark, SF).where("series_id = 'view'").withColumn("momentum", S.momentum(30)).select("seq", "ts", "value", "momentum")
    store.write(store.begin_run("test"), s, ["momentum"])
    server = service.serve(store, "secret")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path, key="secret": json.load(urlopen(Request(f"http://127.0.0.1:{server.server_port}{path}", headers={"X-API-Key": key})))
    try:
        n = s.count()
        assert get("/health", "")["status"] == "ok" and get("/runs")[0]["source"] == "test" and get("/runs/1")["stream_points"] == n == get("/runs/1")["signal_rows"]
        assert get("/runs/1/signals") == ["momentum"] and get("/runs/1/signals?channel=other") == []
        assert [p["value"] is None for p in get("/runs/1/signals/momentum")][:30] == [True] * 29 + [False] and len(get("/runs/1/stream")) == n
        for path, key, status in (("/runs", "wrong", 401), ("/runs/9", "secret", 404), ("/nothing", "secret", 404)):
            with pytest.raises(HTTPError) as e:
                get(path, key)
            assert e.value.code == status
    finally:
        server.shutdown()
    assert service.answer(store, "/runs", None, "any")[0] == 401
    with pytest.raises(ValueError):
        T.open_store(spark, str(tmp_path / "x.db"))


def test_users_add_signals_and_open_events(spark):
    extend.register_signal("span", of_window=lambda x: x.max(1) - x.min(1))
    try:
        got = S.with_signals(rows(spark, [1, 5, 2, 9]), 3, ("momentum", "span")).orderBy("seq").collect()
        assert [r["span"] for r in got] == [None, None, 4.0, 7.0]
        with pytest.raises(ValueError):
            extend.register_signal("span", column=S.momentum)
    finally:
        extend.unregister_signal("span")
    extend.register_functions(spark)
    spark.createDataFrame([("a", 0, 3, 5), ("b", 1, 7, 7)], "series_id string, event_id long, first long, last long").createOrReplaceTempView("found")
    assert [tuple(r) for r in spark.sql("SELECT r.* FROM found, LATERAL event_rows(series_id, event_id, first, last) r ORDER BY 1, 3").collect()] == [("a", 0, 3), ("a", 0, 4), ("a", 0, 5), ("b", 1, 7)]


def test_report_and_command_line(spark, capsys):
    files = D.evaluate(Q.simple_events(spark, SF), Q.labels(spark, SF), "overlap")
    text = D.report_text(files, D.corpus_scores(files))
    assert len(text.split("\n")) == 7 and "5 series" in text
    command(["list"])
    assert "detect_events" in capsys.readouterr().out


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"window_size": 30, "scorer_weights": {"zscore": 0.5}}')
    assert T.read_config(str(tmp_path / "c.json"))["scorer_weights"] == {"zscore": 0.5}


def test_csv_skips_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,value\n2024-01-01 00:00:00,1\nbad,notanumber\n2024-01-01 00:05:00.5,2\n2024-01-01 00:10:00,3\n")
    got = T.read_stream_csv(spark, str(tmp_path / "a.csv")).orderBy("seq").collect()
    assert [r["value"] for r in got] == [1.0, 2.0, 3.0] and got[1]["ts"] is not None


def test_registry(spark, tmp_path):
    r = L.Registry(spark, str(tmp_path / "r"))
    assert r.champion() is None and r.latest() is None and r.candidate("m") is None
    with pytest.raises(ValueError):
        L.shadow_configs(r)
    r.register(("a", {"alpha": 0.2}, {"m": 1.0}), notes="first")
    r.register(("b", {"alpha": 0.1, "resid_window": 50}, {"m": 1.0}), ("c", {}, {}))
    assert r.candidate("m").name == "a" and r.latest().name == "c" and r.best("x") is None and r.get(1).notes == "first" and r.get(1).created_at is not None
    r.promote(2)
    again = L.Registry(spark, str(tmp_path / "r"))
    assert again.best("m").id == 1 and again.champion().name == "b" and again.candidate("m").id == 2
    again.promote(1)
    assert r.champion().name == "a" and L.shadow_configs(r) == {"champion": (0.2, 200), "#2 b": (0.1, 50), "#3 c": (0.2, 200)}
    with pytest.raises(KeyError):
        again.promote(7)


def test_four_positions(spark):
    """Positions 1, 1, 0, -1 over four rows: the last change counts for turnover, not for profit."""
    rows = spark.createDataFrame([("a", i, 100.0 + i, p) for i, p in enumerate((1.0, 1.0, 0.0, -1.0))], "series_id string, seq long, value double, position double")
    r = M.scorecard(M.with_profit(rows)).first()
    pnl = [1 / 100 - 0.0003, 1 / 101, -0.0003]
    assert (r["exposure"], r["time_in_market"], r["turnover"], r["trades"]) == (0.75, 0.75, 0.75, 3)
    assert r["total_return"] == pytest.approx(np.prod(1 + np.array(pnl)) - 1) and r["sharpe"] == pytest.approx(np.mean(pnl) / np.std(pnl) * math.sqrt(252))


def test_noncausal_residual_in_numpy(spark):
    x = np.random.default_rng(4).normal(size=300)
    x[150] += 20
    r = np.abs(x - np.convolve(x, np.ones(20) / 20, "same"))
    want = (r - np.median(r)) / (1.4826 * np.median(np.abs(r - np.median(r))))
    got = [g["robust"] for g in M.noncausal_residual(rows(spark, x)).orderBy("seq").collect()]
    assert got == pytest.approx(list(want)) and int(np.argmax(got)) == 150 and min(got) < 0
    assert [g["robust"] for g in M.noncausal_residual(rows(spark, [3.0])).collect()] == [0.0]


def test_averages_and_distances():
    x = np.random.default_rng(5).normal(size=500)
    avg, want = x[0], []
    for v in x:
        want.append(avg)
        avg = 0.2 * v + 0.8 * avg
    assert D.averages_before(x, 0.2) == pytest.approx(want, abs=1e-12) and len(D.averages_before(x[:0], 0.2)) == 0
    z = D.distances(x, 50, 20)
    assert list(z[:20]) == [0.0] * 20 and z[30] == pytest.approx(abs(x[30] - x[:30].mean()) / x[:30].std()) and z[400] == pytest.approx(abs(x[400] - x[350:400].mean()) / x[350:400].std())


def test_pieces_of_a_long_series(spark, monkeypatch):
    """Pieces of 40 rows give the same as one piece, for windows, averages and numbers of rows."""
    s = rows(spark, np.random.default_rng(6).normal(size=300)).withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(seq as int))"))
    whole = {f: f(s).orderBy("seq").collect() for f in (lambda x: S.with_signals(x, 10), lambda x: D.forecast_scores(x, [(0.5, 30), (0.9, 20)]).orderBy("alpha"), lambda x: D.adaptive_band(x, window=20))}
    monkeypatch.setattr(S.in_pieces, "__defaults__", (0, 40))
    key = lambda r: [round(v, 9) if isinstance(v, float) else v for v in r]
    for f, want in whole.items():
        assert sorted(map(key, f(s).collect()), key=str) == sorted(map(key, want), key=str)
    again = T.with_long_seq(s.select("series_id", "ts", "seq", "value").withColumnRenamed("seq", "at"), "series_id", ["ts", "at"], "value")
    assert again.join(s.select("seq", F.col("value").alias("v")), "seq").where("value = v").count() == 300


def test_zero_weights_and_short_series(spark):
    s = rows(spark, range(12)).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    assert {r["surprise"] for r in D.weighted_surprise(s, {"value": 0.0}).collect()} == {0.0}
    assert metrics.matrix_profile(s, 8).count() == 0 and {r["profile"] for r in metrics.point_profile(s, 8).collect()} == {0.0}
    assert D.detect(s).count() == 0


def test_moments_round_as_in_sql():
    """Means and deviations of moving windows have the digits of the SQL engine, also where a value stands many times in a row."""
    rng = np.random.default_rng(12)
    for x in (rng.exponential(50, 3000), np.repeat(rng.exponential(50, 50).round(2), 60)):
        for w in (10, 30, 100):
            con = duckdb.connect()
            con.register("t", pd.DataFrame({"i": np.arange(len(x)), "x": x}))
            want = con.sql(f"SELECT avg(x) OVER w AS a, stddev_samp(x) OVER w AS s FROM t WINDOW w AS (ORDER BY i ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) ORDER BY i").fetchnumpy()
            at = np.arange(len(x) - w + 1)
            mean, deviation = S.moments_of(np.lib.stride_tricks.sliding_window_view(x, w), at)
            assert (mean == want["a"][w - 1 :]).all() and (deviation == want["s"][w - 1 :]).all()


@pytest.mark.parametrize(("name", "bins"), [("entropy_coarse", 4), ("entropy", 8), ("entropy_fine", 16)])
def test_entropies_round_as_in_sql(name, bins):
    """Windows with the same counts in other bins tie but for rounding, so entropies have the digits of the SQL."""
    x = np.random.default_rng(14).exponential(50, 3000).round(2)
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"series_id": "s", "seq": np.arange(len(x)), "ts": 0, "value": x}))
    want = con.sql(f"WITH s AS (SELECT * FROM t), {Q.signals_sql(names=[name])} SELECT {name} AS e FROM sig WHERE seq >= 29 ORDER BY seq").fetchnumpy()["e"]
    assert (S.entropy_of(np.lib.stride_tricks.sliding_window_view(x, 30), bins) == want).all()


def in_steps(spark, folder, name, where="true"):
    """Rows of a query and of its SQL over events that stand 60 times in a row each."""
    duckdb.sql(f"COPY (SELECT event_id * 60 + i AS event_id, ts, user_id, event_type, value, props FROM '{SF}/events.parquet', range(60) AS r(i) WHERE {where}) TO '{folder}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got = Q.QUERIES[name](spark, str(folder))
    return sorted(map(tuple, got.collect())), sorted(con.sql(Q.ORACLES[name]).select(*got.columns).fetchall())


def test_ties_with_a_band_are_as_in_sql(spark, tmp_path):
    """Every value stands 60 times in a row, so z-scores equal the edge of their band but for rounding."""
    got, want = in_steps(spark, tmp_path, "detect_sensitive")
    assert got == want


@pytest.mark.parametrize("name", ["noncausal_residual", "oracle_scores"])
def test_ranks_of_steps_are_as_in_sql(spark, tmp_path, name):
    """Distances from a centred average are nothing but rounding where a value stands often in a row; ranks follow them."""
    got, want = in_steps(spark, tmp_path, name, "event_type = 'click' AND event_id < 400")
    assert len(got) > 3000 and got == want


def test_profile_by_pieces(spark):
    x = np.random.default_rng(7).normal(size=120)
    got = [r["profile"] for r in metrics.matrix_profile(rows(spark, x), 9, 25).orderBy("seq").collect()]
    p = ranges.matrix_profile(x, 9)
    assert got == pytest.approx(list(p))
    points = [r["profile"] for r in metrics.point_profile(rows(spark, x), 9).orderBy("seq").collect()]
    assert points == pytest.approx([max(p[max(0, i - 8) : i + 1]) for i in range(120)])


def test_best_matches_are_exact():
    """Single precision only leaves pairs out: results are those of all products in double precision, also where near copies lie closer together than single precision tells, within a block and between two."""
    rng = np.random.default_rng(15)
    noise, wave = rng.exponential(50, 5200).round(2), np.sin(np.arange(5200) / 7) + 1e-7 * rng.normal(size=5200)
    for x, m in ((noise, 20), (wave, 16), (np.concatenate((wave[:900], noise)), 12)):
        z = ranges.unit_windows(x, m)
        every = np.arange(len(z))
        is_open = every % 7 > 0
        want = ranges.best_match(z, 0, z, 0, m // 2)
        w = ranges.Windows(x, every, every, is_open)
        got = ranges.best_matches(w, w, m, m // 2)[0]
        assert got[is_open] == pytest.approx(want[is_open], abs=1e-15)
        k = 2100
        a, b = (ranges.Windows(x, every[part], every[part], is_open[part]) for part in (slice(0, k), slice(k, None)))
        by_row, by_column = ranges.best_matches(a, b, m, m // 2)
        assert by_row[a.open] == pytest.approx(ranges.best_match(z[:k], 0, z[k:], k, m // 2)[a.open], abs=1e-15)
        assert by_column[b.open] == pytest.approx(ranges.best_match(z[k:], k, z[:k], 0, m // 2)[b.open], abs=1e-15)


def test_tiles_grow_with_rows(spark):
    """Blocks of a series do not grow in number with its rows, so what tiles are sent and send back does not grow with the pairs of pieces."""
    x = np.random.default_rng(16).normal(size=1500)
    profile = metrics.matrix_profile(rows(spark, x), 9, 25)
    assert [p for _, p in sorted((r["seq"], r["profile"]) for r in profile.collect())] == pytest.approx(list(ranges.matrix_profile(x, 9)))
    sent = {}

    def walk(node):
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        for child in [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)
        if node.nodeName() == "Exchange":
            sent[node.id()] = node.metrics().apply("dataSize").value()

    walk(profile._jdf.queryExecution().executedPlan())
    assert 0 < sum(sent.values()) < 1000 * 1500, sent


def test_profile_of_copies(spark):
    """Windows whose values come again far enough away have distance 0 without a comparison; near copies, flat stretches and all others agree with the row by row profile."""
    rng = np.random.default_rng(9)
    once, still = rng.normal(size=70), np.full(40, 3.0)
    x = np.concatenate((once, rng.normal(size=30), still, once, [5.0, 6.0] * 6, still, once[:20], 2 * once[20:60] + 1))
    for m, size in ((9, 25), (9, 1000), (16, 64)):
        got = {r["seq"]: r["profile"] for r in metrics.matrix_profile(rows(spark, x), m, size).collect()}
        want = ranges.matrix_profile(x, m)
        assert sorted(got) == list(range(len(want))) and [got[i] for i in range(len(want))] == pytest.approx(list(want), abs=1e-6)
        assert {got[i] for i in range(70 - m + 1)} == {0.0}
    one, two = ranges.fingerprints(np.array([0.0, 1.0, 2.0, -0.0, 1.0, 2.0, 1.0, 0.0]), 3)
    assert one[0] == one[3] and two[0] == two[3] and len(set(one.tolist())) == 5


def test_profile_of_steps(spark):
    """Values that stand many times in a row: windows of two values in the same pattern have distance 0 without a comparison, whatever the values; windows of three meet in blocks of several pieces."""
    x = np.repeat(np.random.default_rng(13).exponential(50, 25).round(2), 15)
    for m, size in ((16, 40), (16, 1000), (22, 64)):
        got = {r["seq"]: r["profile"] for r in metrics.matrix_profile(rows(spark, x), m, size).collect()}
        want = ranges.matrix_profile(x, m)
        assert sorted(got) == list(range(len(want))) and [got[i] for i in range(len(want))] == pytest.approx(list(want), abs=1e-6)
        pairs = [i for i in range(len(want)) if len(set(x[i : i + m])) == 2]
        assert len(pairs) > len(want) // 3 and {got[i] for i in pairs} == {0.0}
    one, two = ranges.fingerprints(np.array([1.0, 1.0, 5.0, 2.0, 2.0, 9.0, 9.0, 2.0]), 3)
    assert one[0] == one[3] and two[0] == two[3] and len(set(one.tolist())) == 5


def test_point_profile_of_copies(spark):
    """Points of a series that is repeated whole are all at distance 0, exactly, and a lone spike between copies is not."""
    x = np.random.default_rng(10).normal(size=60)
    got = [r["profile"] for r in metrics.point_profile(rows(spark, np.tile(x, 3)), 8).orderBy("seq").collect()]
    assert got == [0.0] * 180
    got = [r["profile"] for r in metrics.point_profile(rows(spark, np.concatenate((x, [50.0], x))), 8).orderBy("seq").collect()]
    assert got[60] > 0 and got[:53] == [0.0] * 53


def test_univariate_files_are_checked(spark):
    long = lambda *r: spark.createDataFrame(r, "file string, date string, data double, cols string")
    good = T.univariate(T.pivot_channels(long(("f", "10", 2.0, "v"), ("f", "9", 1.0, "v"), ("f", "9", 0.0, "label"), ("f", "10", 1.0, "label"))))
    assert [tuple(r) for r in good.orderBy("seq").collect()] == [("f", 0, "1", 1.0, 0), ("f", 1, "2", 2.0, 1)]
    for bad in (long(("f", "1", 1.0, "u"), ("f", "1", 1.0, "v"), ("f", "1", 0.0, "label")), long(("f", "1", 1.0, "v"), ("f", "2", 1.0, "v"), ("f", "1", 0.0, "label"))):
        with pytest.raises(Exception, match="f: "):
            T.univariate(T.pivot_channels(bad)).collect()
    with pytest.raises(ValueError):
        T.univariate(T.pivot_channels(long(("f", "1", 1.0, "v"))))


def test_stream_runtime(spark, tmp_path):
    """Results and closed events reach their sinks; a null value ends the feed and closes the last event."""
    x = np.random.default_rng(8).normal(0, 1, 200)
    x[[100, 103, 150]] += 60
    feed = [("a", i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", float(v)) for i, v in enumerate(x)] + [("a", 200, "2024-01-01 01:00:00", None)]
    src = str(tmp_path / "in")
    spark.createDataFrame(feed, "series_id string, seq long, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("series_id string, seq long, ts timestamp, value double").parquet(src)
    got: dict[str, list] = {"results": [], "events": []}
    run_stream(stream, str(tmp_path / "c"), lambda df, _: got["results"].extend(df.collect()), lambda df, _: got["events"].extend(df.collect()), threshold=6.0).awaitTermination(120)
    assert len(got["results"]) == 200 and [r["seq"] for r in sorted(got["results"], key=lambda r: r["seq"]) if r["is_anomaly"]][0] == 100
    assert [(r["event_id"], r["start_ts"].second, r["size"]) for r in sorted(got["events"], key=lambda r: r["event_id"])] == [(0, 40, 2), (1, 30, 1)]


def test_events_of_a_stream(spark, tmp_path):
    flags = [("a", q, v) for q, v in ((3, 1.0), (10, 2.0), (31, 2.0), (32, None), (60, 9.0))]
    src = str(tmp_path / "in")
    spark.createDataFrame(flags, "series_id string, seq long, signal_value double").withColumn("ts", F.timestamp_seconds("seq")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("series_id string, seq long, signal_value double, ts timestamp").parquet(src)
    q = online_events(stream, 20).writeStream.format("memory").queryName("events_of").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("events_of").orderBy("event_id").select("event_id", "size", F.unix_seconds("start_ts"), F.unix_seconds("peak_ts"), "peak_value").collect()
    assert [tuple(r) for r in got] == [(0, 2, 3, 10, 2.0), (1, 1, 31, 31, 2.0)]


def test_replay_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.csv").write_text(f"timestamp,value\n2024-01-01 00:00:00,{k}\nbad,oops\n")
    q = T.replay_csv(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("replay").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["value"] for r in spark.table("replay").collect()) == [0.0, 1.0]


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.online import online_scores

    s = Q.series(spark, SF).where("series_id = 'click'").select("series_id", "seq", "value", F.lit(None).cast("timestamp_ntz").alias("ts"))
    s.select("series_id", "seq", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("series_id string, seq long, value double").parquet(str(tmp_path / "in"))
    q = online_scores(src).writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    online = {r["seq"]: r["z"] for r in spark.table("online").collect()}
    batch = {r["seq"]: r["z"] for r in D.residual_z(D.ewma_residuals(s), share=0.0).collect()}
    assert len(online) == len(batch) and all(math.isclose(online[k], batch[k], abs_tol=1e-9) for k in batch)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = Q.QUERIES[name](spark, SF).toPandas()
    want = con.sql(Q.ORACLES[name]).df()[list(got.columns)]
    assert len(got) == len(want)
    key = lambda df: sorted(map(lambda r: tuple("nan" if x != x else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r), df.itertuples(index=False)))
    assert key(got) == key(want)
