"""Drift, retraining, search, models and the evolving trader."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import drift, ranges, signals
from tidemark.operators import market
from tidemark.operators.drift import drift_status
from tidemark.plans import evolving as E
from tidemark.plans import lifecycle as L
from tidemark.plans import models as M
from tidemark.plans.search import Gene, search


def shifted(spark, n=400):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 1, n), rng.normal(6, 1, n)))
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, seq long, value double"), x


def test_drift_is_seen_in_batch_and_stream(spark, tmp_path):
    from tidemark.streaming.online import online_drift

    s, x = shifted(spark)
    rows = drift_status(s, 200, 200, every=20).orderBy("seq").collect()
    assert [r["level"] for r in rows[:399]] == ["warmup"] * 399 and not rows[399]["drift"] and rows[-1]["drift"]
    assert rows[399]["psi"] == drift.psi(x[:200], x[200:400]) and rows[418]["psi"] == rows[399]["psi"] and rows[419]["psi"] == drift.psi(x[:200], x[220:420])
    s.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    q = online_drift(src, 200, 200, every=20).writeStream.format("memory").queryName("drift").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["seq"]: r["psi"] for r in spark.table("drift").collect()} == {r["seq"]: r["psi"] for r in rows}
    assert drift_status(s.limit(0)).count() == 0
    pieces = drift_status(s, 200, 200, every=20, size=150).orderBy("seq").collect()
    assert [tuple(r) for r in pieces] == [tuple(r) for r in rows]


def test_drift_index_of_zero_is_computed_again(spark):
    """A window like the reference has index 0, which is looked at again at once."""
    x = list(range(10)) * 4 + [50] * 20
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, seq long, value double")
    for size in (1000, 7):
        got = [r["psi"] for r in drift_status(s, 10, 10, every=15, size=size).orderBy("seq").collect()]
        m = drift.Monitor(10, 10, 10, 15)
        assert got == [v or 0.0 for v in map(m.push, map(float, x))]


def test_drift_edges_are_those_of_the_sql(spark):
    """Values of two decimals lie on edges; the last digit of an edge decides their bin, and the query holds an index of 0 until the next step as its SQL does."""
    import duckdb

    rng, con = np.random.default_rng(0), duckdb.connect()
    for n in (300, 37):
        x = np.round(rng.exponential(50, n), 2)
        want = con.execute("SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) FROM (SELECT unnest(?) AS x)", [x.tolist()]).fetchone()[0]
        assert drift.edges(x).tolist() == want
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(list(range(10)) * 4 + [50] * 20)], "series_id string, seq long, value double")
    assert [r["psi"] > 0 for r in drift_status(s, 10, 10, every=20, again=False).orderBy("seq").collect()] == [False] * 59 + [True]


def test_retrainer_climbs_and_starts_anew(spark, tmp_path):
    assert [drift.spawn_count(drift.severity(p)) for p in (0.3, 0.375, 0.5)] == [4, 7, 12]
    assert [drift.severity_of_score(x) for x in (0.0, 0.15, 0.3, 0.9)] == [1.0, 0.5, 0.0, 0.0]
    r = L.Retrainer(L.Registry(spark, str(tmp_path / "r")))
    assert [len(r.see(p)) for p in (0.1, 0.3, 0.3, 0.375, 0.5, 0.5, 0.1, 0.3)] == [0, 4, 0, 3, 5, 0, 0, 4]
    assert r.registry.get(1).name == "retrain_a0.15_w200"


def test_decision_and_its_reasons(spark):
    scores = lambda **d: spark.createDataFrame([(k, i, float(x)) for k, v in d.items() for i, x in enumerate(v)], "detector string, unit int, score double")
    base = [0.1] * 10
    assert L.decide(scores(c=base), "c")["reason"] == "no challengers"
    won = L.decide(scores(c=base, x=[0.2] * 10, y=[0.15] * 10), "c")
    assert won["promote"] and won["challenger"] == "x" and won["wins"] == 10 and won["p"] == 1 / 1024
    assert "not below" in L.decide(scores(c=base, x=[0.9] + [0.05] * 9), "c")["reason"]
    assert "below 0.5" in L.decide(scores(c=base, x=[0.2] * 10), "c", min_delta=0.5)["reason"]
    with pytest.raises(ValueError):
        L.decide(scores(c=base, x=[0.2] * 9), "c")


def test_sequential_promotion_compares_all_units(spark):
    units = [{"a": 0.0, "b": 0.1, "c": 0.0} for _ in range(10)] + [{"a": 0.0, "b": 0.1, "c": 5.0} for _ in range(30)]
    table = lambda u: spark.createDataFrame([(i, k, v) for i, x in enumerate(u) for k, v in x.items()], "unit int, detector string, score double")
    got = L.sequential_promotion(table(units), "a", min_units=8).orderBy("turn").collect()
    changes = [(r["turn"], r["promoted"]) for r in got if r["promoted"]]
    assert changes[0] == (7, "b") and [n for _, n in changes] == ["b", "c"] and [r["live"] for r in got[:9]] == ["a"] * 8 + ["b"]
    assert got[-1]["static"] == 0.0 and got[-1]["adaptive"] == 5.0
    assert L.sequential_promotion(table(units[:5]), "a", min_units=8).where("promoted IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        L.sequential_promotion(table(units), "z")


def test_sequential_promotion_of_many_units(spark):
    """4,000 units that decide at each turn: the sign test costs a few terms, not a sum over all tosses of large binomials."""
    for n in (256, 257, 900):
        for k in (0, 1, n // 2 - 9, n // 2, n // 2 + 1, n // 2 + 30, n):
            assert ranges.sign_test(k, n) == pytest.approx(float(sum(math.comb(n, j) for j in range(k, n + 1)) / 2**n), rel=1e-11)
    rng = np.random.default_rng(8)
    rows = [(i, d, float(v)) for d in "ab" for i, v in enumerate(rng.normal(0.001 * (d == "b"), 1, 4000))]
    start = time.process_time()
    got = L.sequential_promotion(spark.createDataFrame(rows, "unit int, detector string, score double"), "a", min_delta=-1.0, alpha=1e-9)
    assert got.count() == 4000 and time.process_time() - start < 5


def test_run_promotion_moves_the_champion(spark, tmp_path):
    """A challenger with a short memory wins on every series and becomes champion; without ``apply`` nothing moves."""
    rng, rows, wins = np.random.default_rng(1), [], []
    for k in range(6):
        x = np.cumsum(rng.normal(0, 1, 300))
        x[200 + k : 204 + k] += 12
        rows += [(f"s{k}", i, float(v)) for i, v in enumerate(x)]
        wins.append((f"s{k}", 0, 200 + k, 203 + k))
    ts = lambda c: F.timestamp_seconds(F.col(c)).cast("timestamp_ntz")
    series = spark.createDataFrame(rows, "series_id string, seq long, value double").withColumn("ts", ts("seq"))
    windows = spark.createDataFrame(wins, "series_id string, window_id long, a long, b long").select("series_id", "window_id", ts("a").alias("w_start"), ts("b").alias("w_end"))
    r = L.Registry(spark, str(tmp_path / "r"))
    r.register(("slow", {"ewma_alpha": 0.05, "resid_window": 100}, {}), ("fast", {"ewma_alpha": 0.6, "resid_window": 100}, {}))
    r.promote(1)
    out = L.run_promotion(r, series, windows, window=10, alpha=0.2, apply=False)
    assert out["challenger"] == "#2 fast" and out["units"] == 6 and r.champion().id == 1
    if L.run_promotion(r, series, windows, window=10, alpha=0.2)["promote"]:
        assert r.champion().id == 2


def test_search_nears_the_optimum():
    genes = [Gene("x", -5, 5), Gene("k", 0, 9, True)]
    f = lambda p: -((p[:, 0] - 2) ** 2) - (p[:, 1] - 3) ** 2
    best, top, history = search(genes, f, 30, 40, seed=1)
    assert best["k"] == 3 and abs(best["x"] - 2) < 0.2 and history == sorted(history) and search(genes, f, 30, 40, seed=1)[0] == best
    assert -5 <= best["x"] <= 5 and top <= 0


def test_splits():
    names = [f"f{i}" for i in range(10)]
    a, b = M.split_series(names)
    assert len(b) == 3 and sorted(a + b) == names
    assert sorted(sum(M.fold_series(names, 3), [])) == names
    with pytest.raises(ValueError):
        M.split_series(["one"])


def test_classifiers_part_two_clouds(spark):
    rng = np.random.default_rng(5)
    rows = [(*map(float, rng.normal(0, 1, 2)), 0) for _ in range(100)] + [(*map(float, rng.normal(8, 1, 2)), 1) for _ in range(20)]
    df = spark.createDataFrame(rows, "u double, v double, label int").cache()
    for model in (M.fit_logistic(df, ["u", "v"]), M.fit_encoder(df, ["u", "v"], (4,))):
        assert M.point_report(M.probabilities(model, df), 0.5).first()["f1"] > 0.95
    with pytest.raises(ValueError):
        M.fit_logistic(df.where("label = 0"), ["u", "v"])
    best, top, history = M.tune_logistic(df, df, ["u", "v"], 2, 1)
    assert 0.1 <= best["threshold"] <= 0.9 and top > 0.9 and len(history) == 1


def test_trader_by_hand(spark):
    price, held = np.array([100.0, 110.0, 99.0]), np.array([[1.0, -1.0, -1.0]])
    assert E.profits(price, held, 0.001)[0] == pytest.approx([0.1 - 0.001, 0.1 - 0.002])
    rng = np.random.default_rng(2)
    path = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 140)))
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(path)] + [("short", 0, 1.0)], "series_id string, seq long, value double")
    plan = E.Plan(lookback=60, every=30, cooldown=30, size=6, generations=2)
    names = ["momentum", "volatility"]
    rows = E.states(s, names, 10, 20)
    got = E.evolve_traders(rows, names, plan).collect()
    assert [r["series_id"] for r in got] == ["a"] and got == E.evolve_traders(rows, names, plan).collect() and got[0]["max_drawdown"] <= 0
    assert rows.where(F.size("state") != 2).isEmpty()


def test_trader_of_many_blocks(spark):
    """Blocks of several tasks and buckets give what a plain walk over the rows gives; rows reach a task by bucket; equity beyond a double still has a fall."""
    sharpe, total, fall = E.cards(np.append(np.full(2000, 1.0), -0.5)[None], 252)
    assert np.isinf(total[0]) and fall[0] == -0.5
    rng, plan, names = np.random.default_rng(3), E.Plan(lookback=40, every=20, cooldown=40, size=4, generations=1), ["momentum", "zscore"]
    path = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 2300)))
    rows = E.states(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(path)], "series_id string, seq long, value double"), names, 10, 20).cache()
    got = E.evolve_traders(rows, names, plan).first()
    blocks = E.block_table(rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")), plan)
    rivals = E.evolve_rivals(rows, blocks, names, plan)
    assert "bucket" in rivals._jdf.queryExecution().optimizedPlan().toString()
    pop = np.array([r["genome"] for r in rivals.orderBy("block").collect()])
    at = [(r["t"], r["b"], r["mid"]) for r in blocks.orderBy("block").collect()][1:]
    g = rows.orderBy("seq").toPandas()
    price, state, scale = g["value"].to_numpy(), np.stack(g["state"].to_list()), g["scale"].to_numpy()
    position, best, since, swaps = np.zeros(len(price)), 0, plan.lookback - plan.cooldown, 0
    for k, (t, b, m) in enumerate(at, 1):
        position[t:b] = E.held_by(pop[[best]], state[t:b], scale[t:b], 1.0)[0]
        one = [E.fitness(pop[[i]], price[m:b], state[m:b], scale[m:b], plan)[0] for i in (best, k)]
        if one[1] - one[0] >= plan.margin and b - since >= plan.cooldown:
            best, since, swaps = k, b, swaps + 1
    want = E.cards(E.profits(price[40:], position[None, 40:], plan.cost), plan.periods)
    assert len(at) > E.BLOCKS and got["swaps"] == swaps > 0 and [got["sharpe"], got["total_return"], got["max_drawdown"]] == pytest.approx([x[0] for x in want])


def test_states_are_the_rolling_scales(spark):
    """Arrays of a piece at once give what the window expressions give, a still stretch and nulls among the returns included."""
    x = np.concatenate((np.random.default_rng(4).normal(100, 5, 90), np.full(90, 7.0)))
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, seq long, value double")
    got = E.states(s, ["momentum", "entropy"], 10, 20).orderBy("seq").collect()
    rows = market.with_returns(signals.with_signals(s, 10, ("momentum", "entropy")).na.fill(0.0, ["momentum", "entropy"]))
    want = rows.select("seq", market.rolling_scale(F.col("momentum"), 20).alias("m"), market.rolling_z(F.col("entropy"), 20).alias("e"), market.volatility_target(market.realised_volatility(20)).alias("s")).orderBy("seq").collect()
    assert [v for r in got for v in (*r["state"], r["scale"])] == pytest.approx([v for r in want for v in (r["m"], r["e"], r["s"])], abs=1e-9)


def test_price_walks_agree_however_rows_lie(spark, tmp_path):
    from tidemark.sources import tables as T

    a = T.synthetic_prices(spark, 3, 500, seed=4)
    assert a.where("value > 0").count() == 1500
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, T.synthetic_prices(spark, 3, 500, seed=4).repartition(7).collect()))
    (tmp_path / "m.csv").write_text("file_name,dataset_name,if_univariate,train_lens,test_lens,time_steps,anomaly_rate\na.csv,X,true,10,,30,0.5\nb.csv,Y,False,x,1,2,\n")
    got = [tuple(r)[2:] for r in T.read_channel_meta(spark, str(tmp_path / "m.csv")).orderBy("file_name").collect()]
    assert got == [(True, 10, None, 30, 0.5), (False, None, 1, 2, None)]


def test_store_lists(spark, tmp_path):
    from tidemark.sources import tables as T

    store = T.RunStore(spark, str(tmp_path))
    assert store.channels(1).isEmpty() and store.signal_names(1).isEmpty()
    run = store.begin_run("x")
    s = spark.createDataFrame([(0, 1.0, 2.0, None)], "seq long, value double, b double, a double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    store.write(run, s, ["b", "a"])
    assert [r[0] for r in store.signal_names(run).collect()] == ["a", "b"] and [r[0] for r in store.channels(run).collect()] == ["value"]
