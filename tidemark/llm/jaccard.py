"""N-gram Jaccard join by prefix trees.

Each document is the set of its distinct word n-grams. Equal sets are compared once. N-grams of rare words come first in one global order (from a fixed-size
sketch of word counts over all documents), and two sets that are similar enough share an n-gram of their prefixes in that order. Sizes are parted into bands that the bound
spans at most two of; all sets of a prefix n-gram in a band and the next one meet in the star of the smallest of them (the hub): there they are stored in a compressed trie, common n-grams first, and each open set walks the trie, adding up
overlaps node by node, leaving subtrees whose remaining lengths cannot reach the bound or that are linked with it already. Stars beyond a
size are cut into chunks that each hold the hub; what is not linked with the hub then meets every chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Fingerprints, Scratch, combine, mix, slices, sorted_groups, word_hashes
from tidemark.llm.components import connected_components

#: Words of an n-gram; similarity in percent.
N, PERCENT = 3, 90
#: Cells of the sketch of word counts (4 bytes each) and the pieces in which it is summed.
SKETCH, PIECES = 1 << 20, 64
#: N-grams of a chunk of a star, about.
CHUNK = 1_500_000


def ngram_set(text: bytes | None, n: int = N, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of a text's n-grams, and how common each is expected to be (with ``counts``: the sum of its words' log counts).

    With fewer than n words all of them are one n-gram; ASCII letters count in lower case.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = min(n, len(words))
    hashes = word_hashes(words)
    start = np.arange(len(words) - size + 1)
    grams = Fingerprints(hashes).spans(start, start + size)
    if counts is None:
        return np.unique(grams), np.zeros(0, np.int64)
    grams, first = np.unique(grams, return_index=True)
    rate = counts[_cell(hashes)].astype(np.int64)
    return grams, sum(rate[i : len(rate) - size + 1 + i] for i in range(size))[first]


def least_overlap(n: int, percent: int) -> int:
    """Of a set of n with any set that is similar enough."""
    return -(-n * percent // 100)


def shared_grams(n: int) -> int:
    """How many n-grams of its prefix a set of n has in common with any set that is similar enough: a longer prefix makes that more than one."""
    return 1 + n * 3 // 100


def _cell(s: np.ndarray) -> np.ndarray:
    return (mix(s) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def word_rates(rows: DataFrame) -> np.ndarray:
    """16 * log2 of a sketch of word counts over all texts: how often the words of each cell occur. Of fixed size, whatever the input."""
    step = SKETCH // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(SKETCH, np.int64), False
        for part in slices(batches):
            words = [w for t in part.column(1).to_pylist() if t for w in t.lower().split()]
            total += np.bincount(_cell(word_hashes(words)), minlength=SKETCH)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int64()), pa.array([total[i * step : (i + 1) * step].astype(np.int32).tobytes() for i in range(PIECES)], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(c, np.int32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.log2(v + 1.0).tobytes() for v in sums.values()], pa.binary())], ["piece", "counts"])

    kind = "piece long, counts binary"
    out = np.zeros(SKETCH)
    for piece, c in rows.select("doc_id", "text").mapInArrow(count, kind).repartition(PIECES, "piece").mapInArrow(add, kind).collect():
        out[piece * step : (piece + 1) * step] = np.frombuffer(c, np.float64)
    return (16 * out).astype(np.int16)


class Trie:
    """Sets in lexicographic order of their ranks, stored as a compressed trie; sizes and places of the sets below each node."""

    def __init__(self, sets: list[np.ndarray]):
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))
        flat, ends = rank[inverse], np.cumsum([len(s) for s in sets])
        ranked = [np.sort(flat[e - len(s) : e]) for s, e in zip(sets, ends, strict=True)]
        self.order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">i4").tobytes())
        self.rows = [ranked[i] for i in self.order]
        self.size = np.array([len(r) for r in self.rows])
        self.vocab = len(values)
        # node: (depth from, depth to, row that spells it, first row below, end of rows below, children)
        self.nodes: list[list] = [[0, 0, 0, 0, len(sets), []]]
        stack = [0]
        for i, row in enumerate(self.rows):
            shared = 0
            if i:
                prev = self.rows[i - 1]
                m = min(len(prev), len(row))
                differ = np.flatnonzero(prev[:m] != row[:m])
                shared = int(differ[0]) if len(differ) else m
            last = None
            while self.nodes[stack[-1]][1] > shared:
                last = stack.pop()
                self.nodes[last][4] = i
            top = stack[-1]
            if last is not None and self.nodes[top][1] < shared:  # split the branch that was left
                mid = len(self.nodes)
                self.nodes.append([self.nodes[top][1], shared, self.nodes[last][2], self.nodes[last][3], 0, [last]])
                self.nodes[last][0] = shared
                self.nodes[top][5][-1] = mid
                stack.append(mid)
                top = mid
            leaf = len(self.nodes)
            self.nodes.append([self.nodes[top][1], len(row), i, i, 0, []])
            self.nodes[top][5].append(leaf)
            stack.append(leaf)
        for k in stack:
            self.nodes[k][4] = len(sets)
        start, self.depth, speller, self.first, self.end = (np.array([n[i] for n in self.nodes]) for i in range(5))
        self.low = np.array([self.size[n[3] : n[4]].min() for n in self.nodes])
        self.high = np.array([self.size[n[3] : n[4]].max() for n in self.nodes])
        # The ranks that each node adds to its path, one node after another.
        self.text = np.concatenate([self.rows[n[2]][n[0] : n[1]] for n in self.nodes])
        self.to = np.cumsum(self.depth - start)
        self.since = self.to - (self.depth - start)
        self.last = np.array([self.rows[n[2]][n[1] - 1] if n[1] else -1 for n in self.nodes])
        self.n_children = np.array([len(n[5]) for n in self.nodes])
        self.at_child = np.cumsum(self.n_children) - self.n_children
        self.child = np.array([c for n in self.nodes for c in n[5]], np.int64)
        # Sets that end at a node come first among those below it.
        self.ends = np.array([self.nodes[n[5][0]][3] if n[5] else n[4] for n in self.nodes])

    def partners(self, row: np.ndarray, percent: int, skip: np.ndarray) -> list[int]:
        """Places of the sets that are similar to ``row``, leaving out subtrees whose sets are all in ``skip``; a level of the trie at a time."""
        n, found = len(row), []
        has = np.zeros(self.vocab, bool)
        has[row] = True
        shared = np.concatenate(([0], np.cumsum(has[self.text])))
        open_ = np.concatenate(([0], np.cumsum(~skip)))
        k, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(k):
            live = open_[self.end[k]] > open_[self.first[k]]
            k, overlap = k[live], overlap[live]
            overlap = overlap + shared[self.to[k]] - shared[self.since[k]]
            depth = self.depth[k]
            left = n - np.searchsorted(row, self.last[k], side="right")
            # Of the sizes below, the best is where both remainders are used up.
            size = np.clip(depth + left, self.low[k], self.high[k])
            live = (100 + percent) * (overlap + np.minimum(left, size - depth)) >= percent * (n + size)
            k, overlap, depth = k[live], overlap[live], depth[live]
            hit = (self.size[self.first[k]] == depth) & ((100 + percent) * overlap >= percent * (n + depth))
            for i, j in zip(self.first[k[hit]], self.ends[k[hit]], strict=True):
                found += [int(x) for x in range(i, j) if not skip[x]]
            many = self.n_children[k]
            overlap = np.repeat(overlap, many)
            k = self.child[np.repeat(self.at_child[k] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        return found


def link_sets(sets: list[np.ndarray], percent: int, open_first: list[int], queries: list[int] | None = None) -> np.ndarray:
    """A label for each set, equal where links connect them. ``open_first``: sets to walk first (a hub). ``queries``: only their links count, if given."""
    trie = Trie(sets)
    place = np.empty(len(sets), np.int64)
    place[trie.order] = np.arange(len(sets))
    label = np.arange(len(sets))  # by place

    def walk(p: int) -> None:
        for q in trie.partners(trie.rows[p], percent, label == label[p]):
            if label[q] != label[p]:
                label[label == label[p]] = label[q]

    for i in open_first:
        walk(place[i])
    if queries is None:
        main = int(np.flatnonzero(label == np.bincount(label).argmax())[0])  # of two linked sets, one at least is walked
        for p in range(len(sets)):
            if label[p] != label[main]:
                walk(p)
    else:
        for i in queries:
            walk(place[i])
    return label[place]


def _bands(rows: DataFrame) -> DataFrame:
    """(gram, band, first, low): the smallest set of each n-gram and band of sizes, and that of the band below, where another set is in the band or beside it.

    Minima and counts are combined before the shuffle, so an n-gram that very many sets share is no row of its own anywhere.
    """
    own = rows.groupBy("gram", "band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("n_shingles", "class_id")).alias("first"))
    none = F.lit(None).cast("struct<n_shingles:bigint,class_id:bigint>")
    told = F.explode(F.array(F.struct("band", "n", "first", none.alias("low")), F.struct((F.col("band") + 1).alias("band"), F.lit(1).cast("long").alias("n"), none.alias("first"), F.col("first").alias("low")), F.struct((F.col("band") - 1).alias("band"), F.lit(1).cast("long").alias("n"), none.alias("first"), none.alias("low")))).alias("t")
    return own.select("gram", told).select("gram", "t.*").groupBy("gram", "band").agg(F.sum("n").alias("n"), F.max("first").alias("first"), F.max("low").alias("low")).where("first IS NOT NULL AND n > 1").drop("n")


def _edges(ids: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    order = np.lexsort((ids, label))
    lab, who = label[order], ids[order]
    first = np.searchsorted(lab, lab)
    return [(int(who[f]), int(w)) for f, w in zip(first, who, strict=True) if who[f] != w]


def similar_sets(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row.

    class_id is the smallest doc_id with the same set, component_id the smallest that links reach (100 * intersection >= percent * union). Null and empty texts have
    an empty set and link with nothing; rows with a null doc_id link with nothing and have null ids; repeated rows and rows of one doc_id are one document. Extra
    columns are not read; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    counts = word_rates(rows)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, names, prefixes = [], [], []
            for t in part.column(1).to_pylist():
                s, c = ngram_set(t, n, counts)
                sizes.append(len(s))
                names.append(s.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(combine(s, s, 5)).tobytes() if len(s) else None)
                p = min(len(s), len(s) - least_overlap(len(s), percent) + shared_grams(len(s)))
                rare = np.argpartition(c, p - 1) if p < len(s) else np.arange(len(s))
                if len(s):
                    rare = np.flatnonzero(c <= c[rare[:p]].max())
                    rare = rare[np.lexsort((s[rare], c[rare]))[:p]]
                prefixes.append(s[rare].view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "name", "prefix"])

    table = scratch.save(rows.mapInArrow(describe, "doc_id long, n_shingles long, name binary, prefix array<long>"), "sets")
    real = table.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch.save(real.groupBy("name").agg(F.min("doc_id").alias("class_id")), "classes")
    firsts = real.join(classes, "name").where("doc_id = class_id").select("class_id", "n_shingles", F.explode("prefix").alias("gram"))
    # Similar sets lie in one band of sizes or in two that follow each other; a little wider than the bound, against rounding.
    width = 1.0001 * max(math.log(100 / percent), 1e-6)
    shared = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("gram")
    met = scratch.save(firsts.join(shared, "gram").withColumn("band", F.floor(F.log("n_shingles") / width)), "met")
    near = met.join(_bands(met).select("gram", "band"), ["gram", "band"])
    # A set with a partner meets it in as many n-grams as its smallest partner's prefix promises; sets that meet fewer have none.
    least = F.ceil(F.col("n_shingles") * percent / 100)
    some = near.groupBy("class_id", "n_shingles").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= 1 + F.floor(least * 3 / 100)).select("class_id")
    runs = scratch.save(near.join(some, "class_id", "left_semi"), "runs")
    hubs = F.explode(F.array_compact(F.array("first.class_id", "low.class_id"))).alias("hub")
    star = scratch.save(runs.join(_bands(runs), ["gram", "band"]).select(hubs, "class_id", "n_shingles").where("hub <> class_id").distinct(), "star")
    scratch.drop("met", "runs")
    sizes = star.groupBy("hub").agg(F.ceil(F.sum("n_shingles") / CHUNK).cast("int").alias("chunks"))
    own = sizes.select("hub", F.col("hub").alias("class_id"), "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    dealt = star.join(sizes, "hub").select("hub", "class_id", "chunks", F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int").alias("chunk"))
    member = scratch.save(own.union(dealt), "members")
    texts = rows.withColumnRenamed("doc_id", "class_id").hint("merge")
    placed = texts.join(member, "class_id")

    def in_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within each (star, chunk); kind 1 names what a cut star has left unlinked with its hub."""
        out: list[tuple[int, int, int, int]] = []
        for g in sorted_groups(batches, 2):
            hub, ids, texts_ = g.column(0)[0].as_py(), g.column(2).to_numpy(), g.column(4).to_pylist()
            if len(ids) > 1:
                label = link_sets([ngram_set(t, n)[0] for t in texts_], percent, list(np.flatnonzero(ids == hub)[:1]))
                out += [(0, a, b, 0) for a, b in _edges(ids, label)]
                if g.column(3)[0].as_py() > 1:
                    near = set(label[ids == hub])
                    out += [(1, hub, int(i), 0) for i, x in zip(ids, label, strict=True) if x not in near]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip("kabc", o, strict=True)) for o in out], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip("kabc", o, strict=True)) for o in out], schema)

    schema = pa.schema([("k", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])
    by_chunk = placed.select("hub", F.col("chunk").cast("long"), "class_id", "chunks", "text").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk")
    found = scratch.save(by_chunk.mapInArrow(in_star, "k int, a long, b long, c long"), "found")
    edges = found.where("k = 0").select("a", "b")
    rest = found.where("k = 1").select(F.col("a").alias("hub"), F.col("b").alias("class_id")).distinct()
    if not rest.isEmpty():
        edges = edges.union(_across(scratch.save(rest, "rest"), star, member, texts, n, percent))
    comps = connected_components(edges, scratch)
    named = classes.join(comps, classes["class_id"] == comps["node"], "left").select("name", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    named = scratch.save(named, "named")
    scratch.keep("sets", "named")
    out = table.join(named, "name", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _across(rest: DataFrame, star: DataFrame, member: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of what cut stars have left unlinked with their hubs, with every chunk of the star: tiles of a block of the rest and a chunk."""
    sized = rest.join(star, ["hub", "class_id"])
    blocks = sized.groupBy("hub").agg(F.ceil(F.sum("n_shingles") / CHUNK).cast("int").alias("blocks"))
    chunks = member.groupBy("hub").agg(F.max("chunks").alias("chunks"))
    left = rest.join(blocks, "hub").join(chunks, "hub").select("hub", F.pmod(F.xxhash64("class_id"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "class_id", F.lit(1).alias("open"))
    right = member.join(blocks, "hub").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), "chunk", "class_id", F.lit(0).alias("open"))
    rows = left.union(right).groupBy("hub", "block", "chunk", "class_id").agg(F.max("open").alias("open"))
    placed = texts.join(rows, "class_id")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 3):
            ids, open_, texts_ = g.column(3).to_numpy(), g.column(4).to_numpy(), g.column(5).to_pylist()
            label = link_sets([ngram_set(t, n)[0] for t in texts_], percent, [], list(np.flatnonzero(open_ == 1)))
            pairs = _edges(ids, label)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])

    dealt = placed.select("hub", "block", F.col("chunk").cast("long"), "class_id", "open", "text").repartition("hub", "block", "chunk").sortWithinPartitions("hub", "block", "chunk")
    return dealt.mapInArrow(tile, "a long, b long")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON a.doc_id = x.doc_id JOIN n y ON b.doc_id = y.doc_id
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
