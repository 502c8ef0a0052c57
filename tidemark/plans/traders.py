"""Agents and weights that a genetic search finds: signal distances are computed once by Spark, genomes are scored where the rows lie."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals as S
from tidemark.functions.ranges import vus_parts
from tidemark.operators import detection as D
from tidemark.operators import market as M
from tidemark.plans.evolving import cards, profits
from tidemark.plans.search import Gene, search, trader_genes

NAMES = tuple(S.SIGNALS)


def signal_distances(series: DataFrame, w: int = 30, window: int = 200, least: int = 30) -> DataFrame:
    """``far``: each signal's distance from its last values as an array, zeros in the warm-up; what any weights need of a series."""
    rows = S.with_signals(series, w, NAMES)
    for n in NAMES:
        rows = D.weighted_surprise(rows, {n: 1.0}, window, least, NAMES).withColumnRenamed("surprise", f"far_{n}")
    return rows.select("series_id", "seq", "ts", "value", F.array(*[f"far_{n}" for n in NAMES]).alias("far"))


def _scores(far: np.ndarray, weights: np.ndarray, prefix: int, window: int = 200, least: int = 20) -> np.ndarray:
    """The weighted detector's scores from signal distances."""
    surprise = far @ weights / (weights.sum() or 1.0)
    z = D.distances(surprise, window, least)
    z[:prefix] = 0.0
    return z


def agent_of(genome: dict[str, float]) -> dict:
    """Settings of ``market.trading_agent`` from a genome."""
    return {"weights": {n: genome[n] for n in NAMES}, "follow": genome.get("mode", 1.0) >= 0.5, "threshold": genome["threshold"], "size": genome["size"]}


def agent_positions(far: np.ndarray, price: np.ndarray, genome: Sequence[float], k: int = 5) -> np.ndarray:
    """Positions of the agent that the genome (in the order of ``trader_genes``) describes."""
    g = np.asarray(genome, float)
    weights, (mode, threshold, size) = g[: len(NAMES)], g[len(NAMES) :]
    z = _scores(far, weights, min(int(0.15 * len(price)), 750))
    move = np.zeros(len(price))
    move[k:] = np.where(price[:-k] > 0, np.sign(price[k:] / np.where(price[:-k] > 0, price[:-k], 1) - 1), 0)
    return np.where(z >= threshold, move * size * (1 if mode >= 0.5 else -1), 0.0)


def _card(price: np.ndarray, position: np.ndarray, cost: float, periods: int) -> tuple[float, float, float, int]:
    sharpe, total, fall = (float(x[0]) for x in cards(profits(price, position[None], cost), periods))
    return sharpe, total, fall, int(np.count_nonzero(np.diff(np.concatenate(([0.0], position)))))


def evolve_agents(prices: DataFrame, folds: int = 3, first: float = 0.5, size: int = 16, generations: int = 8, least_trades: int = 20, cost: float = 0.0003, periods: int = 252, seed: int = 0) -> DataFrame:
    """(series_id, fold, genome, train_fitness, sharpe, total_return, max_drawdown, trades, buy_hold): walk-forward, each fold's agent evolved on what lies before it.

    Fitness is the Sharpe ratio, 5 less for agents that hardly trade. Every (series, fold) is a task of its own. A series too short for its folds gives none.
    """
    genes = trader_genes(list(NAMES))
    rows = signal_distances(prices)
    n = prices.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    edges = n.select("series_id", "n", F.floor(F.col("n") * F.lit(first)).alias("a")).withColumn("step", F.floor((F.col("n") - F.col("a")) / folds)).where("step >= 1 AND a >= 1")
    parts = edges.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).select("series_id", "fold", (F.col("a") + F.col("fold") * F.col("step")).alias("lo"), F.when(F.col("fold") == folds - 1, F.col("n")).otherwise(F.col("a") + (F.col("fold") + 1) * F.col("step")).alias("hi"))
    held = rows.join(parts, "series_id").where("seq < hi")
    columns = ["series_id", "fold", "genome", "train_fitness", "sharpe", "total_return", "max_drawdown", "trades", "buy_hold"]

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        price, far, lo = g["value"].to_numpy(), np.stack(g["far"].to_list()), int(g["lo"].iloc[0])

        def score(pop: np.ndarray) -> np.ndarray:
            got = [_card(price[:lo], agent_positions(far[:lo], price[:lo], p), cost, periods) for p in pop]
            return np.array([c[0] - 5.0 * (c[3] < least_trades) for c in got])

        best, top, _ = search(genes, score, size, generations, seed + int(key[1]) + 1)
        genome = [best[x.name] for x in genes]
        test = _card(price[lo:], agent_positions(far[lo:], price[lo:], genome), cost, periods)
        hold = cards(price[None, lo + 1 :] / price[None, lo:-1] - 1, periods)[0][0]
        return pd.DataFrame([(key[0], key[1], genome, top, *test, hold)], columns=columns)

    return held.groupBy("series_id", "fold").applyInPandas(one, "series_id string, fold int, genome array<double>, train_fitness double, sharpe double, total_return double, max_drawdown double, trades int, buy_hold double")


def macro_score(rows: DataFrame, pop: np.ndarray, window: int = 100, parts: int = 8) -> np.ndarray:
    """Mean VUS-PR over labelled series for each row of weights: one job for a generation; genomes of a series are shared out over tasks."""
    pop = np.asarray(pop, float)

    def score(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        far, y = np.stack(g["far"].to_list()), g["label"].to_numpy()
        mine = [i for i in range(len(pop)) if i % parts == key[1]]
        if not y.any() or not mine:
            return pd.DataFrame(columns=["i", "score"])
        prefix = min(int(0.15 * len(y)), 750)
        return pd.DataFrame({"i": mine, "score": [vus_parts(y, _scores(far, pop[i], prefix), window, range(window + 1))[1] / (window + 1) for i in mine]})

    dealt = rows.select("series_id", "seq", "far", "label").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(min(parts, len(pop)) - 1))))
    got = dealt.groupBy("series_id", "part").applyInPandas(score, "i int, score double").groupBy("i").agg(F.avg("score").alias("s")).collect()
    out = np.full(len(pop), -np.inf)
    for r in got:
        out[r["i"]] = r["s"]
    return out


def learn_weights(series: DataFrame, windows: DataFrame, size: int = 12, generations: int = 6, window: int = 100, seed: int = 0) -> tuple[dict[str, float], float, list[float]]:
    """(weights, their mean VUS-PR, best so far by generation) of the weighted detector over labelled series."""
    rows = D.label_points(signal_distances(series), windows).persist()
    try:
        return search([Gene(n, 0.0, 1.0) for n in NAMES], lambda pop: macro_score(rows, pop, window), size, generations, seed)
    finally:
        rows.unpersist()


def compare_traders(prices: DataFrame, states: DataFrame, weights: list[float], epochs: int = 100, seed: int = 0) -> DataFrame:
    """(series_id, trader, sharpe, total_return, max_drawdown, exposure) of a linear policy, a neural one and buying and holding."""
    from tidemark.plans.neural import neural_positions

    held = {
        "linear": M.policy_positions(states, weights).select("series_id", "seq", "value", "position"),
        "neural": neural_positions(states, seed=seed, epochs=epochs),
        "buy_hold": prices.select("series_id", "seq", "value", F.lit(1.0).alias("position")),
    }
    out = None
    for name, rows in held.items():
        one = M.scorecard(M.with_profit(rows)).select("series_id", F.lit(name).alias("trader"), "sharpe", "total_return", "max_drawdown", "exposure")
        out = one if out is None else out.union(one)
    return out
