"""A trader that evolves its linear policy as a series goes on: the rivals of all blocks evolve side by side, then a walk over their scores tells who trades when."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import signals as S
from tidemark.operators import market as M
from tidemark.plans.search import policy_genes, search

#: Signals whose sign counts: scaled, not centred.
SIGNED = ("momentum", "acceleration", "zscore")


def states(prices: DataFrame, names: list[str], w: int = 30, z: int = 60, target: float = 0.1, vol_window: int = 20) -> DataFrame:
    """(series_id, seq, value, state array, scale): signals on comparable scales (0 in the warm-up) and the volatility target's multiplier."""
    known = S.with_signals(prices.select("series_id", "seq", "value"), w, tuple(names))

    def moving(g: pa.Table) -> pa.Table:
        g = g.sort_by("seq")
        cols = [M.moving_scale(_numbers(g[n])[0], z, scaled=n in SIGNED) for n in names]
        _, vol, count = M.moving_moments(*_numbers(g["ret"]), vol_window)
        state = pa.ListArray.from_arrays(np.arange(0, len(g) * len(names) + 1, len(names), dtype=np.int32), np.stack(cols, 1).ravel())
        return g.select(["series_id", "seq", "value"]).append_column("state", state).append_column("vol", pa.array(np.where(count >= max(5, vol_window // 2), vol, 0.0)))

    def add(rows: DataFrame) -> DataFrame:
        rows = M.with_returns(rows).select("series_id", "seq", "value", "ret", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
        schema = T.StructType([*rows.schema.fields[:3], T.StructField("state", T.ArrayType(T.DoubleType())), T.StructField("vol", T.DoubleType())])
        return rows.groupBy("series_id").applyInArrow(moving, schema)

    return S.in_pieces(known, add, z + vol_window).select("series_id", "seq", "value", "state", M.volatility_target(F.col("vol"), target).alias("scale"))


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether they are there)."""
    there = column.is_valid().to_numpy()
    return column.fill_null(0.0).to_numpy(), there


@dataclass(frozen=True)
class Plan:
    lookback: int = 252
    every: int = 63
    held: float = 0.33
    margin: float = 0.1
    cooldown: int = 126
    size: int = 16
    generations: int = 10
    cost: float = 0.0003
    periods: int = 252
    most: float = 1.0


def profits(price: np.ndarray, position: np.ndarray, cost: float) -> np.ndarray:
    """Of each policy (row) and step."""
    before = np.concatenate((np.zeros((len(position), 1)), position[:, :-1]), 1)
    return position[:, :-1] * (price[1:] / price[:-1] - 1) - cost * np.abs(position - before)[:, :-1]


def cards(pnl: np.ndarray, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sharpe, total return, largest fall) of each row."""
    if not pnl.shape[1]:
        return (np.zeros(len(pnl)),) * 3
    with np.errstate(over="ignore", invalid="ignore"):
        sd, eq = pnl.std(1), np.cumprod(1 + pnl, 1)
        sharpe = np.where(sd > 0, pnl.mean(1) / np.where(sd > 0, sd, 1) * np.sqrt(periods), 0.0)
        fall = (eq / np.maximum.accumulate(eq, 1) - 1).min(1)
    for i in np.flatnonzero(~np.isfinite(eq).all(1)):
        fall[i] = _fall(pnl[i])
    return sharpe, eq[:, -1] - 1, fall


def _fall(pnl: np.ndarray) -> float:
    """The largest fall where the equity itself is beyond a double: its share of the peak goes from step to step."""
    share = least = 1.0
    for x in pnl[1:].tolist():
        share = min(share * (1 + x), 1.0)
        least = min(least, share)
    return least - 1


def block_table(sizes: DataFrame, plan: Plan) -> DataFrame:
    """(series_id, block, t, b, a, mid) from (series_id, n): block k is traded from t to b; its rival evolves on a to mid and is held against the champion on mid to b.

    Block -1 has the first champion's rows, 0 to ``lookback``. All rivals depend on rows alone, not on who is champion, so all blocks evolve at once.
    """
    long = sizes.where(F.col("n") > plan.lookback + 2).select("series_id", "n", F.explode(F.sequence(F.lit(-1).cast("long"), F.floor((F.col("n") - plan.lookback - 1) / plan.every))).alias("block"))
    t = long.withColumn("t", F.lit(plan.lookback) + F.col("block") * plan.every).withColumn("b", F.least(F.col("t") + plan.every, "n"))
    t = t.withColumn("a", F.greatest(F.col("b") - plan.lookback, F.lit(0)))
    mid = F.col("a") + F.greatest(F.lit(1), ((F.col("b") - F.col("a")) * (1 - plan.held)).cast("long"))
    first = F.col("block") < 0
    return t.select("series_id", "block", "t", "b", F.when(first, 0).otherwise(F.col("a")).alias("a"), F.when(first, plan.lookback).otherwise(mid).alias("mid"))


def held_by(pop: np.ndarray, state: np.ndarray, scale: np.ndarray, most: float) -> np.ndarray:
    """Positions of each policy (row) over the rows of ``state``."""
    return np.clip(np.tanh(pop[:, :-1] @ state.T + pop[:, -1:]) * scale, -most, most)


def fitness(pop: np.ndarray, price: np.ndarray, state: np.ndarray, scale: np.ndarray, plan: Plan) -> np.ndarray:
    sharpe, _, fall = cards(profits(price, held_by(pop, state, scale, plan.most), plan.cost), plan.periods)
    return sharpe + 3.0 * fall


#: Blocks that one task evolves, and rows of a bucket in which rows and blocks meet.
BLOCKS, BUCKET = 32, 2048


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, states, scales) by seq."""
    rows = rows.sort_by("seq").combine_chunks()
    state = rows["state"].combine_chunks()
    return rows["value"].to_numpy(), state.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1), rows["scale"].to_numpy()


def evolve_rivals(rows: DataFrame, blocks: DataFrame, names: list[str], plan: Plan, seed: int = 0) -> DataFrame:
    """(series_id, block, b, mid, genome, value, state, scale): a search for each block of each series and what the block trades, ``state`` without ends of rows.

    A task takes ``BLOCKS`` blocks with the rows between their first and last, so rows are computed once for the searches and the walk.
    """
    genes = policy_genes(names)
    blocks = blocks.withColumn("part", F.floor(F.col("block") / BLOCKS))
    spans = blocks.groupBy("series_id", "part").agg(F.min(F.least("a", F.greatest("t", F.lit(0)))).alias("lo"), F.max(F.greatest("mid", "b")).alias("hi"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor((F.col("hi") - 1) / BUCKET))))
    near = rows.select("series_id", "seq", "value", "state", "scale").withColumn("bucket", F.floor(F.col("seq") / BUCKET))
    train = near.join(spans, ["series_id", "bucket"]).where("seq >= lo AND seq < hi").select(*[F.col(c).alias(c) for c in ("series_id", "part", "seq", "value", "state", "scale")])
    lists = pa.list_(pa.float64())
    schema = pa.schema([("series_id", pa.string()), *[(c, pa.int64()) for c in ("block", "b", "mid")], *[(c, lists) for c in ("genome", "value", "state", "scale")]])

    def some(g: pa.Table, r: pa.Table) -> pa.Table:
        price, state, scale = _arrays(g)
        first, out = pc.min(g["seq"]).as_py(), []
        for name, block, t, b, lo, mid in zip(*(r[c].to_pylist() for c in ("series_id", "block", "t", "b", "a", "mid")), strict=True):
            at, own = slice(lo - first, mid - first), slice(max(t, 0) - first, b - first)
            if block < 0:
                own = at
            best, _, _ = search(genes, lambda pop, at=at: fitness(pop, price[at], state[at], scale[at], plan), plan.size, plan.generations, seed * 100_003 + block + 1)
            out.append((name, block, b, mid, [best[x.name] for x in genes], price[own], state[own].ravel(), scale[own]))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return train.groupBy("series_id", "part").cogroup(blocks.groupBy("series_id", "part")).applyInArrow(some, "series_id string, block long, b long, mid long, " + ", ".join(f"{c} array<double>" for c in ("genome", "value", "state", "scale")))


def evolve_traders(rows: DataFrame, names: list[str], plan: Plan = Plan(), seed: int = 0) -> DataFrame:
    """A scorecard for each series of ``states``, adaptive and static. Series of at most lookback + 2 rows give none.

    A rival replaces the champion where it gains ``margin`` on the block's held rows and the last change is ``cooldown`` rows ago.
    """
    blocks = block_table(rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")), plan)
    rivals = evolve_rivals(rows, blocks, names, plan, seed)
    columns = ["series_id", "swaps", "sharpe", "total_return", "max_drawdown", "static_sharpe", "static_return", "static_drawdown"]
    schema = pa.schema([(columns[0], pa.string()), (columns[1], pa.int64()), *[(c, pa.float64()) for c in columns[2:]]])

    def walk(r: pa.Table) -> pa.Table:
        r = r.sort_by("block").combine_chunks()
        price, state, scale = (r[c].combine_chunks().flatten().to_numpy() for c in ("value", "state", "scale"))
        state = state.reshape(len(price), -1)
        pop, at = np.array(r["genome"].to_pylist()), np.stack([r[c].to_numpy() for c in ("b", "mid")], 1)
        # Only the champion of the moment and the block's rival are scored, so the walk is linear in the blocks.
        position, start, best, since, swaps = np.zeros(len(price)), plan.lookback, 0, plan.lookback - plan.cooldown, 0
        for k, (b, m) in enumerate(at[1:], 1):
            if b - since < plan.cooldown:
                continue
            champion, rival = fitness(pop[[best, k]], price[m:b], state[m:b], scale[m:b], plan)
            if rival - champion >= plan.margin:
                position[start:b] = held_by(pop[[best]], state[start:b], scale[start:b], plan.most)[0]
                start, best, since, swaps = b, k, b, swaps + 1
        position[start:] = held_by(pop[[best]], state[start:], scale[start:], plan.most)[0]
        both = np.stack((position, held_by(pop[:1], state, scale, plan.most)[0]))[:, plan.lookback :]
        sharpe, total, fall = cards(profits(price[plan.lookback :], both, plan.cost), plan.periods)
        return pa.table([[x] for x in (r["series_id"][0].as_py(), swaps, sharpe[0], total[0], fall[0], sharpe[1], total[1], fall[1])], schema=schema)

    return rivals.groupBy("series_id").applyInArrow(walk, "series_id string, swaps long, " + ", ".join(f"{c} double" for c in columns[2:]))
