"""Embedding near-dedup: NN-descent over the distinct vectors of each label.

A first neighbour graph comes from blocks of random hyperplanes; joins of neighbours of neighbours refine it until few lists change. Edges at the
threshold are kept. Where a list is full of such edges it is saturated and may hide links: it is enlarged and refined again, and a vector that fills the larger
list too is compared exactly with all rows of its label in other components, and the members of each component among themselves, tile by tile, so that every link of a saturated vector counts.
An audit compares vectors drawn by hash from components of every size with all rows; while its recall is low anywhere, more blocks and rounds follow, and after the
last of them every vector is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, parts_for, slices, sorted_groups
from tidemark.llm.components import connected_components
from tidemark.llm.topk import usable

#: Partners in a list, and in the enlarged lists of saturated vectors.
K, ENLARGED = 8, (32,)
#: The first graph has TREES trees at least; in large labels so many that a pair at the threshold shares a block of one of them but for a chance of APART.
TREES, APART = 4, 0.03
#: Vectors of a block of the first graph, and of a tile.
LEAF, TILE = 256, 512
#: Vectors of the audit from each range of component sizes, about, and the recall below which more rounds follow.
AUDIT, RECALL, TRIES = 512, 0.97, 3


def _rows(vectors: pd.Series) -> np.ndarray:
    """Unit vectors from the bytes of doubles."""
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best distinct partners of each a."""
    order = np.lexsort((b, -sim, a))
    a2, b2 = a[order], b[order]
    pair = np.lexsort((np.arange(len(a2)), b2, a2))
    dup = np.zeros(len(a2), bool)
    dup[pair[1:]] = (a2[pair[1:]] == a2[pair[:-1]]) & (b2[pair[1:]] == b2[pair[:-1]])
    order, a2 = order[~dup], a2[~dup]
    first = np.searchsorted(a2, a2)
    return order[np.arange(len(a2)) - first < k]


def _keep_best(edges: DataFrame, k: int, wide: DataFrame | None = None) -> DataFrame:
    """(a, b, sim): each a's k best partners, ``room`` of them for those that ``wide`` (id, room) names. The group of an a holds few rows: its list for each task that found some."""
    if wide is None:
        edges, room = edges.withColumn("room", F.lit(k)), F.lit(k)
    else:
        edges, room = edges.join(wide.withColumnRenamed("id", "a"), "a", "left").withColumn("room", F.coalesce("room", F.lit(k))), F.col("room")
    top = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("s"), F.col("b").alias("b")))), F.lit(1), room)
    return edges.groupBy("a", "room").agg(top.alias("t")).select("a", F.explode("t").alias("e")).select("a", F.col("e.b").alias("b"), (-F.col("e.s")).alias("sim"))


EDGE = "a long, b long, sim double"


def _label_sizes(reps: DataFrame, threshold: float) -> DataFrame:
    """(lab, bits, trees): a pair at the threshold falls on one side of a plane with the chance ``side``, of all planes of a tree with side ** bits."""
    side = 1 - float(np.arccos(np.clip(threshold, -1, 1))) / np.pi
    bits = reps.groupBy("lab").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / LEAF))).cast("int").alias("bits"))
    return bits.withColumn("trees", F.greatest(F.lit(TREES), F.ceil(float(np.log(APART)) / F.log(1 - F.pow(F.lit(side), F.col("bits")))).cast("int")))


def _block_edges(reps: DataFrame, sizes: DataFrame, dim_seed: int, times: int, k: int, first: int = 0) -> DataFrame:
    """Best k partners of each vector within blocks of random hyperplanes, from ``times`` times its label's number of trees after the ``first`` times; blocks beyond 2 * LEAF are dealt by hash into pieces."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.to_pandas()
            parts = []
            for (dim, trees), g in f.groupby([f["v"].map(len) // 8, "trees"]):
                x = np.frombuffer(b"".join(g["v"]), np.float64).reshape(-1, dim)
                for t in range(first * trees, (first + times) * trees):
                    planes = np.random.default_rng((dim_seed, t)).normal(size=(int(dim), 24))
                    signs = (x @ planes > 0).astype(np.int64) @ (1 << np.arange(24, dtype=np.int64))
                    parts.append(pd.DataFrame({"id": g["id"], "v": g["v"], "lab": g["lab"], "bits": g["bits"], "tree": t, "dim": dim, "sig": signs}))
            if parts:
                p = pd.concat(parts)
                p["sig"] = p["sig"] & (np.left_shift(1, p["bits"].to_numpy(np.int64)) - 1)
                yield pa.RecordBatch.from_pandas(p[["id", "v", "lab", "tree", "dim", "sig"]].astype({"tree": "int32", "dim": "int32"}), preserve_index=False)

    sized = reps.join(F.broadcast(sizes), "lab") if sizes.count() < 10_000 else reps.join(sizes, "lab")
    keyed = sized.select("id", "v", "lab", "bits", "trees").mapInArrow(keys, "id long, v binary, lab long, tree int, dim int, sig long")
    n = keyed.groupBy("lab", "tree", "dim", "sig").agg(F.count(F.lit(1)).alias("n"))
    dealt = keyed.join(n, ["lab", "tree", "dim", "sig"]).withColumn("piece", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / (2 * LEAF))))

    def block(g: pd.DataFrame) -> pd.DataFrame:
        ids, x = g["id"].to_numpy(), _rows(g["v"])
        s = x @ x.T
        np.fill_diagonal(s, -2)
        m = min(k, len(ids) - 1)
        if m < 1:
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64"})
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        return pd.DataFrame({"a": np.repeat(ids, m), "b": ids[top].ravel(), "sim": np.take_along_axis(s, top, 1).ravel()})

    return dealt.groupBy("lab", "tree", "dim", "sig", "piece").applyInPandas(block, EDGE)


def _descend(edges: DataFrame, reps: DataFrame, k: int, wide: DataFrame | None = None, most: int = 0) -> DataFrame:
    """One round: the neighbours of each vector, either way, meet as candidates of one another. ``wide``: (id, room) of enlarged lists, of ``most`` at most."""
    full = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
    room = F.lit(k)
    if wide is not None:
        full, room = full.join(wide.withColumnRenamed("id", "a"), "a", "left"), F.coalesce("room", F.lit(k))
    worst = full.select("a", F.when(F.col("n") >= room, F.col("low")).otherwise(-2.0).alias("floor"))
    k = max(k, most)
    either = edges.select(F.col("a").alias("at"), F.col("b").alias("id")).union(edges.select(F.col("b").alias("at"), F.col("a").alias("id"))).distinct()
    # A vector that very many lists name meets them in pieces of hashed partners, not all at once.
    deg = either.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    either = either.join(deg, "at").withColumn("piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (4 * k))))
    seen = either.join(reps.select("id", "v"), "id").join(worst.withColumnRenamed("a", "id"), "id", "left")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            a, b, sim = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            keep = _best(a, b, sim, k)
            return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(sim[keep])], ["a", "b", "sim"])

        for g in sorted_groups(batches, 2):
            ids, floor = g.column(2).to_numpy(), g.column(4).to_numpy()
            x = np.frombuffer(b"".join(g.column(3).to_pylist()), np.float64).reshape(len(ids), -1)
            s = x @ x.T
            np.fill_diagonal(s, -3)
            i, j = np.nonzero(s > floor[:, None])
            if len(i):
                held.append((ids[i], ids[j], s[i, j]))
            if len(held) > 500:
                yield out()
        if held:
            yield out()

    dealt = seen.select("at", F.col("piece").cast("long"), "id", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor")).repartition("at", "piece").sortWithinPartitions("at", "piece")
    return dealt.mapInArrow(meet, EDGE)


def _links_within(reps: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """(id, links): links of each vector of a component to all others of it, counting copies, by tiles."""
    members = reps.join(comps, reps["id"] == comps["node"]).select("id", "v", "copies", F.col("component").alias("comp"))
    # Eight tiles at least, of 128 to TILE vectors: a component of any size is many tasks, a large one is not copied more often than it must.
    size = F.count(F.lit(1))
    n = members.groupBy("comp").agg(F.ceil(size / F.greatest(F.lit(TILE / 4), F.least(F.lit(TILE), size / 8))).cast("int").alias("tiles"), size.alias("n"))
    placed = members.join(n, "comp").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    pairs = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("id", "v", "copies", "comp", "t", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"))

    def tile(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        left, right = g[g["t"] == i], g[g["t"] == j]
        s = _rows(left["v"]) @ _rows(right["v"]).T if len(left) and len(right) else np.zeros((len(left), len(right)))
        hit = (s >= threshold) & (left["id"].to_numpy()[:, None] != right["id"].to_numpy())
        out = [pd.DataFrame({"id": left["id"], "links": hit @ right["copies"].to_numpy()})]
        if i != j:
            out.append(pd.DataFrame({"id": right["id"], "links": hit.T @ left["copies"].to_numpy()}))
        return pd.concat(out)

    # Dealt by tile: the joins before left all tiles of a component in one partition.
    rows = n.agg(F.coalesce(F.sum(F.col("n") * F.col("tiles")), F.lit(0))).first()[0]
    return pairs.repartition(parts_for(reps.sparkSession, rows, 8 * TILE), "comp", "i", "j").groupBy("comp", "i", "j").applyInPandas(tile, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _saturated(edges: DataFrame, threshold: float, k: int, wide: DataFrame | None = None) -> DataFrame:
    """(id) of the vectors whose lists are full of edges at the threshold: further links may have been cut off."""
    n = edges.where(F.col("sim") >= threshold).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if wide is not None:
        return n.join(wide, "id", "left").where(F.col("n") >= F.coalesce("room", F.lit(k))).select("id")
    return n.where(F.col("n") >= k).select("id")


def _links_across(reps: DataFrame, comps: DataFrame, picked: DataFrame, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): links of the picked vectors with rows of other components, exactly; a names the component of the picked one.

    The picked vectors of a component lie in tiles, each with a centre and the largest angle to it. A row meets a tile unless its angle to the centre
    excludes every link (triangle inequality), so a dense group costs other rows one product a tile.
    """
    named = reps.join(comps, reps["id"] == comps["node"], "left").select("id", "lab", "v", F.coalesce("component", "id").alias("comp"), (F.octet_length("v") / 8).cast("int").alias("dim"))
    named = scratch.save(named, f"{name}-named")
    own = named.join(picked, "id", "left_semi")
    tiles = own.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    placed = scratch.save(own.join(tiles, "comp").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles"))), f"{name}-placed")

    def centre(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = _rows(g["v"])
        c = x.sum(0)
        c = c / np.sqrt(c @ c) if c @ c > 1e-12 else x[0]
        far = np.arccos(np.clip((x @ c).min(), -1, 1)) + np.arccos(np.clip(threshold, -1, 1))
        return pd.DataFrame({"lab": [key[0]], "dim": [key[1]], "comp": [key[2]], "t": [key[3]], "c": [c.tobytes()], "low": [np.cos(far) - 1e-7 if far < np.pi else -2.0]})

    centres = scratch.save(placed.groupBy("lab", "dim", "comp", "t").applyInPandas(centre, "lab long, dim int, comp long, t long, c binary, low double"), f"{name}-centres")
    groups = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = named.groupBy("lab", "dim").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("shards")).join(centres.groupBy("lab", "dim").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks")), ["lab", "dim"])
    many = scratch.save(many.withColumn("groups", F.least("shards", F.lit(groups).cast("long"))), f"{name}-many")
    shards = named.join(many, ["lab", "dim"]).groupBy("lab", "dim", "groups", F.pmod(F.xxhash64("id"), F.col("shards")).alias("s")).agg(F.collect_list(F.struct("id", "comp", "v")).alias("rows"))
    blocks = centres.join(many, ["lab", "dim"]).groupBy("lab", "dim", "groups", F.pmod(F.xxhash64("comp", "t"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("comp", "t", "c", "low")).alias("tiles"))
    dealt = shards.withColumn("g", F.pmod(F.col("s"), F.col("groups"))).join(blocks.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups"), ["lab", "dim", "g"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows, tile = pd.DataFrame(part.column(0)[0].as_py()), pd.DataFrame(part.column(1)[0].as_py())
            hit = (_rows(rows["v"]) @ _rows(tile["c"]).T >= tile["low"].to_numpy()) & (rows["comp"].to_numpy()[:, None] != tile["comp"].to_numpy())
            i, j = np.nonzero(hit)
            for at in range(0, len(i), 4 * TILE):
                a, b = i[at : at + 4 * TILE], j[at : at + 4 * TILE]
                yield pa.RecordBatch.from_arrays([pa.array(tile["comp"].to_numpy()[b]), pa.array(tile["t"].to_numpy()[b]), pa.array(rows["id"].to_numpy()[a]), pa.array(rows["v"].to_numpy()[a], pa.binary())], ["comp", "t", "id", "v"])

    met = scratch.save(dealt.select("rows", "tiles").mapInArrow(near, "comp long, t long, id long, v binary"), f"{name}-met")
    pieces = met.groupBy("comp", "t").agg(F.ceil(F.count(F.lit(1)) / (4 * TILE)).alias("pieces"))
    left = placed.join(pieces, ["comp", "t"]).select("comp", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "id", "v", F.lit(True).alias("own"))
    right = met.join(pieces, ["comp", "t"]).select("comp", "t", F.pmod(F.xxhash64("id"), F.col("pieces")).alias("piece"), "id", "v", F.lit(False).alias("own"))

    def linked(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        mine, other = g[g["own"]], g[~g["own"]]
        # A tile's vectors share a component, so one link joins the other row to all of them.
        hit = (_rows(mine["v"]) @ _rows(other["v"]).T >= threshold).any(0) if len(mine) and len(other) else np.zeros(len(other), bool)
        return pd.DataFrame({"a": key[0], "b": other["id"].to_numpy()[hit]}).astype("int64")

    return scratch.save(left.union(right).groupBy("comp", "t", "piece").applyInPandas(linked, "a long, b long").distinct(), f"{name}-across")


def _label(embeddings: DataFrame) -> Column:
    """Whole numbers as they are, other labels by a 64-bit hash of their value."""
    kind = embeddings.schema["label"].dataType
    if isinstance(kind, T.IntegralType):
        return F.col("label").cast("long")
    value = F.col("label") + F.lit(0).cast(kind) if isinstance(kind, T.FractionalType) else F.col("label")  # -0.0 is 0.0
    return F.when(F.col("label").isNotNull(), F.xxhash64(value))


def near_vectors(embeddings: DataFrame, threshold: float = 0.93, k: int = K, audit: bool = True) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors are compared by cosine in double precision where their labels, of whatever type, are equal and not null and their dimensions agree. Null, empty and zero
    vectors and those with null or non-finite components link with nothing. Equal vectors of a label are compared once and count as links of one another. Rows
    with a null vec_id come back with no links and their null as component. Rows of one vec_id are one entry with several vectors: they share links and component. Extra columns are not read.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "nn")
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"), _label(embeddings).alias("lab"))
    good = F.coalesce(usable("e"), F.lit(False)) & F.col("lab").isNotNull() & F.col("vec_id").isNotNull()
    # Scaled by the largest component first, so that squares neither overflow nor vanish; -0.0 counts as 0.0.
    big = F.array_max(F.transform("e", lambda x: F.abs(x)))
    scaled = rows.where(good).withColumn("big", big).where("big > 0").select("vec_id", "lab", "big", "e")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = [np.array(v) / b for v, b in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            data = [((v / np.sqrt(v @ v)) + 0.0).tobytes() for v in vs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["vec_id", "lab", "v"])

    units = scratch.save(scaled.mapInArrow(unit, "vec_id long, lab long, v binary"), "units")
    reps = scratch.save(units.groupBy("lab", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "reps")
    sizes = scratch.save(_label_sizes(reps, threshold), "sizes")
    edges = scratch.save(_keep_best(_block_edges(reps, sizes, 5, 1, k), k), "g0")
    n = reps.count()
    step, wide, most = 0, None, ENLARGED[-1]
    for go in range(TRIES):
        for _ in range(4):
            found = edges.union(_descend(edges, reps, k, wide, most if wide is not None else k))
            new = scratch.save(_keep_best(found, k, wide), f"g{step + 1}")
            # The rounds stop when hardly any edge at the threshold is new outside saturated lists, which are compared exactly and of which a hot group has most.
            strong = new.where(F.col("sim") >= threshold)
            open_ = strong.join(_saturated(new, threshold, k, wide).withColumnRenamed("id", "a"), "a", "left_anti")
            fresh = open_.join(edges.select("a", "b"), ["a", "b"], "left_anti").count()
            few = fresh <= 0.01 * open_.count()
            scratch.drop(f"g{step}")
            edges, step = new, step + 1
            if few:
                break
        # Saturated lists are enlarged and refined again; what fills the larger list too is compared exactly.
        for room in ENLARGED:
            full = scratch.save(_saturated(edges, threshold, k, wide).withColumn("room", F.lit(room)), f"full{step}")
            if full.isEmpty():
                break
            old = full if wide is None else wide.join(full, "id", "left_anti").union(full)
            wide = scratch.save(old, f"wide{step}")
            new = scratch.save(_keep_best(edges.union(_descend(edges, reps, k, wide, room)), k, wide), f"g{step + 1}")
            scratch.drop(f"g{step}", f"full{step}")
            edges, step = new, step + 1
        strong = edges.where(F.col("sim") >= threshold).select("a", "b")
        comps = connected_components(strong, scratch, f"cc{go}")
        across = _links_across(reps, comps, _saturated(edges, threshold, k, wide), threshold, scratch, f"sat{go}")
        if not across.isEmpty():
            comps = connected_components(strong.union(across), scratch, f"cs{go}")
        if not audit or n == 0:
            break
        # Links inside a component are all counted below, so the audit asks whether the ends of a link share one.
        if _audit(reps, comps, threshold) >= RECALL:
            break
        if go == TRIES - 1:
            across = across.union(_links_across(reps, comps, reps.select("id"), threshold, scratch, "all"))
            comps = connected_components(strong.union(across), scratch, "ca")
            break
        more = _block_edges(reps, sizes, 5, 2, k, first=2 * go + 1)
        new = scratch.save(_keep_best(edges.union(more), k, wide), f"g{step + 1}")
        scratch.drop(f"g{step}")
        edges, step = new, step + 1
    links = _links_within(reps, comps, threshold)
    per_rep = scratch.save(reps.select("lab", "v", "id", "copies").join(links, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left").select("lab", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "links")
    scratch.keep("units", "links")
    named = units.join(per_rep, ["lab", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~good | (F.coalesce(big, F.lit(0.0)) <= 0)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _audit(reps: DataFrame, comps: DataFrame, threshold: float) -> float:
    """Least recall over ranges of component sizes, a link counting as found where both ends share a component.

    Every vector that has links counts alike, by the share of them that were found. Vectors alone and those in components of up to 7 form one range: what
    the former miss is weighed against what the latter have.
    """
    # Every pair inside a component is compared in the end: what matters is that the sample's true partners are in the sample's components.
    named = reps.join(comps, reps["id"] == comps["node"], "left").select("id", "lab", "v", F.coalesce("component", "id").alias("comp"))
    size = named.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    level = F.when(F.col("size") == 1, 0).otherwise(1 + F.floor(F.log2("size") / 3).cast("int")).alias("level")
    count = {r["level"]: r["n"] for r in size.select(level, "size").groupBy("level").agg(F.sum("size").alias("n")).collect()}
    step = F.lit(1)
    for x, m in count.items():
        step = F.when(F.col("level") == x, max(1, m // AUDIT)).otherwise(step)
    some = named.join(size, "comp").select("id", "lab", "v", "comp", level).where(F.pmod(F.xxhash64("id", F.lit(11)), step) == 0).toPandas()
    if some.empty:
        return 1.0
    ids, labs, comp, vs = some["id"].to_numpy(), some["lab"].to_numpy(), some["comp"].to_numpy(), list(some["v"])

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.to_pandas()
            for dim, g in f.groupby(f["v"].map(len) // 8):
                at = np.array([i for i, v in enumerate(vs) if len(v) == dim * 8], int)
                if len(at):
                    s = np.frombuffer(b"".join(vs[i] for i in at), np.float64).reshape(-1, dim) @ _rows(g["v"]).T
                    hit = (s >= threshold) & (labs[at][:, None] == g["lab"].to_numpy()) & (ids[at][:, None] != g["id"].to_numpy())
                    same = hit & (comp[at][:, None] == g["comp"].to_numpy())
                    any_ = hit.any(1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at][any_]), pa.array(hit.sum(1)[any_]), pa.array(same.sum(1)[any_])], ["id", "links", "found"])

    seen = named.mapInArrow(against, "id long, links long, found long").groupBy("id").agg((F.sum("found") / F.sum("links")).alias("share")).toPandas()
    some = some.drop(columns=["v"]).merge(seen, on="id", how="left")
    linked: dict[int, float] = {}
    found: dict[int, float] = {}
    for x, g in some.groupby("level"):
        each = count[x] / len(g)
        linked[max(x, 1)] = linked.get(max(x, 1), 0) + each * g["share"].notna().sum()
        found[max(x, 1)] = found.get(max(x, 1), 0) + each * g["share"].sum()
    return min((found[x] / n for x, n in linked.items() if n), default=1.0)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.vec_id LEFT JOIN n ON e.vec_id = n.vec_id
"""
