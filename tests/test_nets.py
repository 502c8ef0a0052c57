"""Networks against finite differences, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import nets
from tidemark.operators import detection as D
from tidemark.operators import market as M
from tidemark.plans import evolving as E
from tidemark.plans import models, neural, traders


def differences(f, parts, k=1e-6):
    out = []
    for p in parts:
        g = np.zeros_like(p)
        for i in np.ndindex(p.shape):
            p[i] += k
            up = f()
            p[i] -= 2 * k
            g[i] = (up - f()) / (2 * k)
            p[i] += k
        out.append(g)
    return out


@pytest.mark.parametrize("label", [False, True])
def test_recurrent_gradient(label):
    rng = np.random.default_rng(0)
    x, y, net = rng.normal(size=(7, 5)), (rng.random(7) > 0.5).astype(float), nets.Recurrent(3, 1, label)

    def loss():
        p = net.predict(x)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if label else float(((p - y) ** 2).mean())

    for a, b in zip(net.gradient(x, y, net.parts), differences(loss, net.parts), strict=True):
        assert a == pytest.approx(b, abs=1e-6)


def test_policy_gradient():
    rng = np.random.default_rng(2)
    ret, p = rng.normal(0, 0.01, 30), rng.normal(0, 0.5, 31)

    def loss():
        pnl = p[:-1] * ret - 0.0003 * np.abs(np.diff(np.concatenate(([0.0], p[:-1]))))
        low = np.minimum(pnl, 0)
        return (-pnl.mean() / (pnl.std(ddof=1) + 1e-8) + np.sqrt((low * low).mean() + 1e-12)) * np.sqrt(252)

    assert nets.policy_gradient(p, ret, 0.0003, 1.0, 252) == pytest.approx(differences(loss, [p])[0], abs=1e-4)


def waves(spark, n=400, k=3):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(k):
        x = np.sin(np.arange(n) / 3) + rng.normal(0, 0.05, n)
        x[300 + s : 304 + s] += 3
        rows += [(f"s{s}", i, float(v)) for i, v in enumerate(x)]
    ts = F.timestamp_seconds("seq").cast("timestamp_ntz")
    series = spark.createDataFrame(rows, "series_id string, seq long, value double").withColumn("ts", ts)
    windows = spark.createDataFrame([(f"s{s}", 0, 298 + s, 306 + s) for s in range(k)], "series_id string, window_id long, a long, b long")
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    return series, windows.select("series_id", "window_id", at("a").alias("w_start"), at("b").alias("w_end"))


def test_forecasters(spark):
    series, _ = waves(spark)
    for scored in (neural.neural_scores(series, epochs=60, w=8), neural.neural_scores(series, w=8, model=neural.pool_forecaster(series, 8, epochs=60))):
        rows = scored.where("series_id = 's0'").orderBy("seq").collect()
        assert len(rows) == 400 and all(r["z"] == 0 for r in rows[:60]) and 300 <= max(rows, key=lambda r: r["z"])["seq"] <= 304
    short = series.where("seq < 20")
    assert {r["residual"] for r in neural.forecast_residuals(short).collect()} == {0.0} and neural.pool_forecaster(short) is None


def test_window_classifier(spark):
    series, windows = waves(spark, k=4)
    rows = models.window_examples(series, windows, 12).cache()
    model = neural.fit_window_classifier(rows, epochs=80)
    scored = neural.window_probabilities(model, rows)
    mean = {r["label"]: r["p"] for r in scored.groupBy("label").agg(F.avg("p").alias("p")).collect()}
    assert mean[1] > mean[0] + 0.3
    threshold, score = neural.best_threshold(scored, windows)
    assert score == models.nab_of_flags(scored, windows, threshold).first()["score"]
    assert len(neural.cross_validate(rows, windows, 2, epochs=5)) == 2
    with pytest.raises(ValueError):
        neural.fit_window_classifier(rows.where("label = 0"))


def test_traders(spark):
    rng = np.random.default_rng(6)
    price = 100 * np.exp(np.cumsum(0.002 * np.sign(np.sin(np.arange(500) / 20)) + rng.normal(0, 0.002, 500)))
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(price)], "series_id string, seq long, value double").withColumn("ts", F.timestamp_seconds("seq").cast("timestamp_ntz"))
    states = E.states(s, ["momentum", "zscore", "volatility"])
    got = {r["trader"]: r for r in traders.compare_traders(s, states, [1.0, 0.0, 0.0], 60).collect()}
    assert got["buy_hold"]["total_return"] == pytest.approx(price[-1] / price[0] - 1, abs=4e-4) and got["neural"]["sharpe"] > 0
    folds = traders.evolve_agents(s, 2, size=6, generations=2).orderBy("fold").collect()
    assert [r["fold"] for r in folds] == [0, 1] and len(folds[0]["genome"]) == 13
    genome = dict(zip([g.name for g in traders.trader_genes(list(traders.NAMES))], folds[0]["genome"], strict=True))
    far = traders.signal_distances(s).orderBy("seq").toPandas()
    want = traders.agent_positions(np.stack(far["far"].to_list()), price, folds[0]["genome"])
    agent = M.trading_agent(s, **traders.agent_of(genome)).orderBy("seq").toPandas()["position"].to_numpy()
    assert np.allclose(agent, want)


def test_weights_are_learned(spark):
    series, windows = waves(spark, 400, 2)
    best, top, history = traders.learn_weights(series, windows, 4, 2, window=10)
    assert set(best) == set(traders.NAMES) and history == sorted(history) and 0 < top <= 1
    rows = D.label_points(traders.signal_distances(series), windows)
    assert traders.macro_score(rows, [[best[n] for n in traders.NAMES]], 10)[0] == pytest.approx(top)
