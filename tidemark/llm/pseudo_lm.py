"""Masked pseudo-likelihood: a bidirectional window network predicts every word from the words on both sides.

The network sees the classes of two words on either side and how often the two nearest words occur; from one hidden layer it gives the gates of four
predictions of the masked word and the class distribution of the third of them:

* the word after its left neighbour, and the word before its right neighbour, from counts of word pairs;
* the word by its class: P(class | window) * P(word | class), from word counts;
* a word that no other document has, letter by letter, by byte pairs of such words.

Words and pairs are counted over all documents, whatever their number, and a document is always judged by the counts of the other ones, in training too.
A document's score is the sum of its words' conditional log probabilities.

Exchange: documents keep to hashed shards, keys of words and pairs (47 bits of a hash) travel in packed blobs to ranges of keys, counts travel back in the
order of the keys. The shards' documents are then stored as blocks of numbers. Each block trains in one round, from common weights, in the order of its
documents; weights are averaged as integers. So nothing depends on how rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, Words, combine, dealt, slices, sorted_groups

#: Classes: the most frequent words, and all others by a band of their count and their shape.
OWN, BANDS, SHAPES = 24, (2, 8, 64, 1024), 4
CLASSES = OWN + (len(BANDS) + 1) * SHAPES
HIDDEN, SIDE, EXPERTS = 16, 2, 4
#: Each block of about BLOCK words trains in one round, in steps of STEP words; there every word is a target.
ROUNDS, BLOCK, STEP = 4, 50_000, 1024
#: Text of a shard, and of a range of keys, about.
SHARD_BYTES, RANGE_BYTES = 3e6, 8e6
_KEY = np.uint64((1 << 48) - 2)
_SHAPES = [(2 * SIDE * (CLASSES + 1), HIDDEN), (2, HIDDEN), (HIDDEN,), (HIDDEN, EXPERTS + CLASSES), (EXPERTS + CLASSES,)]
_SIZES = [int(np.prod(s)) for s in _SHAPES]
#: Weights are averaged as integers in this unit.
_UNIT = float(1 << 20)
REPLY = "shard long, range long, counts binary, top array<struct<key:long,n:long>>"
BLOCKS = "block long, ids array<long>, lengths array<int>, cls binary, own binary, pair binary, novel binary, idx array<int>, n array<long>"


def summed(df: DataFrame) -> np.ndarray | None:
    """Sum of the vectors of integers (binary) in the rows of ``df``, in two streaming steps of which none holds more than one vector; None without rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in slices(batches, 16):
            for v in part.column(0).to_pylist():
                total = np.frombuffer(v, np.int64).copy() if total is None else total + np.frombuffer(v, np.int64)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    few = max(1, int(df.sparkSession.sparkContext.defaultParallelism))
    out = df.repartition(few).mapInArrow(add, "v binary").repartition(1).mapInArrow(add, "v binary").collect()
    return np.frombuffer(bytes(out[0][0]), np.int64) if out else None


class Shard:
    """The words of some texts, and the distinct keys of its words (even) and of its pairs of neighbours (odd)."""

    def __init__(self, texts: list[bytes | None]):
        self.words = Words(texts)
        self.lengths, self.doc, h = self.words.lengths, self.words.doc.astype(np.int32), self.words.hash
        self.linked = self.doc[1:] == self.doc[:-1]  # of each word but the last: whether the next one is in its document
        keys = np.concatenate((h & _KEY, combine(h[:-1], h[1:], 31)[self.linked] & _KEY | np.uint64(1)))
        # Sorting numbers in place beats sorting places: the keys' high bits with the place behind them. Where low bits matter, the plain way.
        n, low = len(keys), np.uint64(max(16, len(keys).bit_length()))
        packed = keys >> (low - np.uint64(16))
        packed <<= low
        packed |= np.arange(n, dtype=np.uint64)
        packed.sort()
        packed &= (np.uint64(1) << low) - np.uint64(1)
        order = packed.astype(np.int32 if n < 1 << 31 else np.int64)
        del packed
        keys = keys[order]
        if (keys[1:] < keys[:-1]).any():
            again = np.argsort(keys, kind="stable")
            order, keys = order[again], keys[again]
        self.order, self.new = order, np.append(True, keys[1:] != keys[:-1])[:n]
        cut = np.flatnonzero(self.new)
        self.keys, self.counts = keys[cut], np.diff(np.append(cut, n))

    def elsewhere(self, totals: np.ndarray) -> np.ndarray:
        """How often each word, and then each pair, occurs in other documents. Places of a key are in order, and so are documents."""
        n = len(self.order)
        doc = np.concatenate((self.doc, self.doc[:-1][self.linked]))[self.order]
        cut = np.flatnonzero(self.new | np.append(True, doc[1:] != doc[:-1])[:n])
        own = np.diff(np.append(cut, n))
        out = np.empty(n, np.int64)
        out[self.order] = np.repeat(totals[np.cumsum(self.new)[cut] - 1] - own, own)
        return out

    def classes(self, totals: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Class of each word. ``top``: the keys of the words with classes of their own."""
        m = len(self.words)
        kind = np.searchsorted(BANDS, totals, "right").astype(np.uint8) * np.uint8(SHAPES) + np.uint8(OWN)
        at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
        here = np.flatnonzero(self.keys[at] == top)
        kind[at[here]] = here
        each = np.empty(len(self.order), np.uint8)
        each[self.order] = np.repeat(kind, self.counts)
        each = each[:m]
        shape = _HEAD[self.words.bytes[self.words.start]]
        shape = np.where((shape < 2) & ~_LETTER[self.words.bytes[self.words.end - 1]], 2, shape)
        return np.where(each < OWN, each, each + shape).astype(np.uint8)


_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
#: Shape of a word by its first byte: capital 1, other letter 0, no letter 3; a letter's word that ends with none is 2.
_HEAD = np.array([3 if not _LETTER[b] else int(65 <= b <= 90) for b in range(256)], np.uint8)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Number of the range that holds a key; it grows with the key."""
    return ((keys >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, all first bytes before all second ones: sorted keys and small counts pack well so."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(packed: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(packed) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(width, -1).T
    return out.view(np.uint64).ravel()


def neighbours(cls: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """2 * SIDE x words: rows of the embedding for the classes around each word; beyond a document's ends stands the class CLASSES."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(cls)) + SIDE * (doc + 1)
    padded = np.full(len(cls) + SIDE * (len(lengths) + 1), CLASSES, np.int32)
    padded[place] = cls
    return np.stack([padded[place + d] + (CLASSES + 1) * k for k, d in enumerate(d for d in range(-SIDE, SIDE + 1) if d)])


def spelling(novel: list[bytes], pairs: np.ndarray) -> np.ndarray:
    """Log probability of each word by its byte pairs, 0 at both ends. pairs: 256 x 256 log probabilities."""
    if not novel:
        return np.zeros(0)
    flat = np.frombuffer(b"\0" + b"\0".join(novel) + b"\0", np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(novel)), [len(w) + 1 for w in novel])
    return np.bincount(word, pairs[flat[:-1], flat[1:]], len(novel))


class Block:
    """What the network needs of some documents: their windows and the experts' probabilities; with ``pairs`` also the spelling of novel words."""

    def __init__(self, lengths: np.ndarray, cls: bytes, own: bytes, pair: bytes, novel: bytes, totals: np.ndarray, pairs: np.ndarray | None):
        self.lengths = np.asarray(lengths, np.int64)
        self.cls = np.frombuffer(cls, np.uint8).astype(np.int64)
        log_n = np.frombuffer(own, np.float16).astype(np.float32)  # -1: in no other document
        log_pair = np.frombuffer(pair, np.float16).astype(np.float32)  # of the word and the next one; -1: nowhere else
        n = len(self.cls)
        ends = np.cumsum(self.lengths)
        begins, ends = (ends - self.lengths)[self.lengths > 0], ends[self.lengths > 0] - 1
        # Column 0: of the word before, column 1: of the next word; beyond a document's ends: -2.
        around = np.full((n, 2), -2, np.float32)
        around[1:, 0], around[:-1, 1] = log_n[:-1], log_n[1:]
        around[begins, 0] = around[ends, 1] = -2
        both = np.full((n, 2), -1, np.float32)
        both[1:, 0], both[:, 1] = log_pair[:-1], log_pair
        both[begins, 0] = -1
        self.near = neighbours(self.cls, self.lengths)
        # A row for each expert, as numpy takes long over many short rows.
        self.open = np.ascontiguousarray((around >= 0).T)
        self.novel = log_n < 0
        self.experts = np.empty((3, n), np.float32)
        self.experts[:2] = np.where((both >= 0).T & self.open, np.exp(np.minimum(both - around, 0)).T, 0)
        self.around = np.append(around / 8, np.ones((n, 1), np.float32), 1)  # with a 1 for the bias
        self.experts[2] = np.where(self.novel, 0, np.exp(np.minimum(log_n - np.log(np.maximum(totals, 1.0)).astype(np.float32)[self.cls], 0)))
        if pairs is not None:
            self.log_spelled = np.zeros(n)
            self.log_spelled[self.novel] = spelling(novel.split(b"\0") if self.novel.any() else [], pairs)
            self.log_alone = np.where(self.novel, self.log_spelled, log_n - np.log(max(totals.sum(), 1.0)))

    def __len__(self) -> int:
        return len(self.cls)


class Network:
    """Embeddings of classes by place, the neighbours' frequency, a hidden layer; out come gates and class scores."""

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(3)
            self.parts = [rng.normal(0, 0.1, s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in _SHAPES]
        else:
            self.parts = [p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, np.cumsum(_SIZES)[:-1]), _SHAPES, strict=True)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def forward(self, b: Block, at: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hidden, rows of the gates and of the class distribution before its division, its sums) of some words; experts that the window rules out get no gate."""
        e, num, bias, out, out_bias = self.parts
        h = b.around[at] @ np.append(num, bias[None], 0)
        for k in range(2 * SIDE):
            h += e.take(b.near[k, at], 0)
        np.tanh(h, out=h)
        s = np.ascontiguousarray(out.T) @ h.T
        s += out_bias[:, None]
        g, c = s[:EXPERTS], s[EXPERTS:]
        g -= g.max(0)
        c -= c.max(0)
        np.exp(s, out=s)
        g[:2] *= b.open[:, at]
        g /= g.sum(0)
        return h, s, c.sum(0)

    def shares(self, b: Block, at: slice, s: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """What each expert adds to the probability of the word; of a novel word only its gate, as the spelling does not matter to what the others add."""
        n, novel = s.shape[1], b.novel[at]
        parts = np.empty((EXPERTS, n), np.float32)
        np.multiply(s[:3], b.experts[:, at], out=parts[:3])
        parts[2] *= s[EXPERTS + b.cls[at], np.arange(n)] / sums
        np.maximum(parts[2], np.where(novel, np.float32(0), np.float32(1e-30)), out=parts[2])
        parts[3] = np.where(novel, np.maximum(s[3], np.float32(1e-30)), np.float32(0))
        return parts

    def log_prob(self, b: Block) -> np.ndarray:
        out = np.empty(len(b))
        for i in range(0, len(b), 2048):
            at = slice(i, i + 2048)
            _, s, z = self.forward(b, at)
            out[at] = np.log(self.shares(b, at, s, z).sum(0)) + b.log_spelled[at]
        return out

    def step(self, b: Block, at: slice, sums: list[np.ndarray], rate: float) -> None:
        """One AdaGrad step up the mean log probability."""
        h, d, z = self.forward(b, at)
        r, n = self.shares(b, at, d, z), len(h)
        r /= r.sum(0) * np.float32(n)
        rows = np.arange(n)
        # From gates and classes to how their scores should move.
        d[:EXPERTS] /= -n
        d[:EXPERTS] += r
        d[EXPERTS:] *= -(r[2] / z)
        d[EXPERTS + b.cls[at], rows] += r[2]
        gh = d.T @ self.parts[3].T
        gh *= 1 - h * h
        ge = np.empty(_SHAPES[0], np.float32)
        one = np.zeros((n, CLASSES + 1), np.float32)
        rows *= CLASSES + 1
        for k in range(2 * SIDE):
            low = k * (CLASSES + 1)
            here = rows + (b.near[k, at] - low)
            one.ravel()[here] = 1
            np.matmul(one.T, gh, out=ge[low : low + CLASSES + 1])
            one.ravel()[here] = 0
        ga = b.around[at].T @ gh
        for x, grad, a in zip(self.parts, (ge, ga[:-1], ga[-1], (d @ h).T, d @ np.ones(n, np.float32)), sums, strict=True):
            a += grad * grad
            x += rate * grad / np.sqrt(a)


def _blocks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents as blocks of numbers, after words and pairs were counted over all of them. A shard adds a row (block -1) of its class and byte pair counts."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards, ranges = int(size / SHARD_BYTES) + 1, int(size / RANGE_BYTES) + 1
    text = F.col("text").cast("binary")
    # Rows without an id have the hash of their text; so they do not meet in one shard.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("tie")).withColumn("shard", F.pmod("tie", F.lit(shards)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 1):
            s = Shard(g.column(1).to_pylist())
            where = range_of(s.keys, ranges)
            cut = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, int)
            ends = np.append(cut[1:], len(where)) if len(where) else cut
            cols = [pa.array(where[cut].astype(np.int64)), pa.array([g.column(0)[0].as_py()] * len(cut), pa.int64()), pa.array([planes(s.keys[i:j], 6) for i, j in zip(cut, ends, strict=True)], pa.binary()), pa.array([planes(s.counts[i:j], 4) for i, j in zip(cut, ends, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["range", "shard", "keys", "counts"])

    asked = dealt(rows.select("shard", "text"), "shard", shards).sortWithinPartitions("shard").mapInArrow(ask, "range long, shard long, keys binary, counts binary")
    top_type = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 1):
            number, packed = g.column(0)[0].as_py(), g.column(2).to_pylist()
            keys = np.concatenate([from_planes(p, 6) for p in packed])
            n = np.concatenate([from_planes(c, 4) for c in g.column(3).to_pylist()]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            cut = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
            total = np.add.reduceat(n[order], cut)
            back = np.empty(len(n), np.int64)
            back[order] = np.repeat(total, np.diff(np.append(cut, len(n))))
            ends = np.cumsum([len(p) // 6 for p in packed])
            told = [planes(back[e - len(p) // 6 : e], 7) for p, e in zip(packed, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([g.column(1).combine_chunks(), pa.array([number] * len(told), pa.int64()), pa.array(told, pa.binary()), pa.array([None] * len(told), top_type)], ["shard", "range", "counts", "top"])
            word = order[cut]
            word, total = keys[word], np.where(keys[word] & np.uint64(1) == 0, total, 0)
            best = np.lexsort((word, -total))[:OWN]
            top = [{"key": int(word[i]), "n": int(total[i])} for i in best if total[i]]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([number], pa.int64()), pa.array([b""], pa.binary()), pa.array([top], top_type)], ["shard", "range", "counts", "top"])

    replies = scratch.save(dealt(asked, "range", ranges).sortWithinPartitions("range").mapInArrow(answer, REPLY), "replies")
    del asked
    scratch.drop()
    top = np.array([r["key"] for r in replies.where("shard = -1").select(F.explode("top").alias("t")).select("t.*").orderBy(F.col("n").desc(), "key").limit(OWN).collect()], np.uint64)
    none = F.lit(None).cast("binary")
    told = replies.where("shard >= 0").select("shard", F.lit(0).cast("long").alias("kind"), F.lit(None).cast("long").alias("doc_id"), none.alias("text"), F.col("range").alias("tie"), "counts")
    both = dealt(told.union(rows.select("shard", F.lit(1).cast("long"), "doc_id", "text", "tie", none)), "shard", shards).sortWithinPartitions("shard", "kind", F.when(F.col("kind") == 1, F.col("doc_id")), "tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("cls", pa.binary()), ("own", pa.binary()), ("pair", pa.binary()), ("novel", pa.binary()), ("idx", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
        row = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(v, schema, strict=True)], schema=schema)
        reply: tuple[int, np.ndarray] = -1, np.zeros(0, np.int64)
        for g in sorted_groups(batches, 2):
            number = g.column(0)[0].as_py()
            if g.column(1)[0].as_py() == 0:
                reply = number, np.concatenate([from_planes(c, 7) for c in g.column(5).to_pylist()]).astype(np.int64)
                continue
            ids, s = g.column(2).to_pylist(), Shard(g.column(3).to_pylist())
            totals = reply[1] if reply[0] == number else np.zeros(0, np.int64)
            m = len(s.words)
            out = s.elsewhere(totals)
            with np.errstate(divide="ignore"):
                log = np.where(out > 0, np.log(out), -1.0).astype(np.float16)
            own, pair = log[:m], np.full(m, -1, np.float16)
            pair[:-1][s.linked] = log[m:]
            cls = s.classes(totals, top) if m else np.zeros(0, np.uint8)
            novel = [w.replace(b"\0", b"\1") for w in s.words.some(np.flatnonzero(out[:m] == 0))]
            at_novel = np.concatenate(([0], np.cumsum(out[:m] == 0)))
            ends = np.concatenate(([0], np.cumsum(s.lengths)))
            i, k = 0, 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
                a, b = ends[i], ends[j]
                yield row(number << 20 | k, ids[i:j], s.lengths[i:j].tolist(), cls[a:b].tobytes(), own[a:b].tobytes(), pair[a:b].tobytes(), b"\0".join(novel[at_novel[a] : at_novel[b]]), None, None)
                i, k = j, k + 1
            flat = np.frombuffer(b"\0" + b"\0".join(novel) + b"\0", np.uint8).astype(np.int64) if novel else np.zeros(1, np.int64)
            tally = np.concatenate((np.bincount(cls, minlength=CLASSES), np.bincount(flat[:-1] * 256 + flat[1:], minlength=65_536)))
            some = np.flatnonzero(tally)
            yield row(-1, None, None, None, None, None, None, some.tolist(), tally[some].tolist())

    out = scratch.save(both.mapInArrow(encode, BLOCKS), "blocks")
    scratch.drop("replies")
    return out


def fit_lm(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, Network]:
    """(words of each class, log probabilities of byte pairs, network) from the blocks of all documents. Only the first two and the weights reach the driver."""
    tally = np.zeros(CLASSES + 65_536)
    for i, n in blocks.where("block = -1").select(F.explode(F.arrays_zip("idx", "n")).alias("t")).groupBy("t.idx").agg(F.sum("t.n")).collect():
        tally[i] = n
    totals, pairs = tally[:CLASSES], tally[CLASSES:].reshape(256, 256) + 0.05
    pairs, net = np.log(pairs / pairs.sum(1, keepdims=True)), Network()
    for r in range(ROUNDS):
        start = net.flat()

        def train(batches: Iterator[pa.RecordBatch], start: np.ndarray = start, r: int = r) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(_SIZES) + 1, np.int64)
            for part in slices(batches, 1):
                b = Block(*[part.column(i)[0].as_py() for i in range(5)], totals, None)
                if not len(b):
                    continue
                own, sums = Network(start), [np.full(s, 1e-4, np.float32) for s in _SHAPES]
                for i in range(0, len(b), STEP):
                    own.step(b, slice(i, i + STEP), sums, 0.1 / (r + 1))
                weight = min(64, 1 + 16 * len(b) // BLOCK)
                total += np.append(np.rint(own.flat().astype(np.float64) * _UNIT).astype(np.int64), 1) * weight
            if total[-1]:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

        mine = blocks.where((F.col("block") >= 0) & (F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == r))
        total = summed(mine.select("lengths", "cls", "own", "pair", "novel").mapInArrow(train, "v binary"))
        if total is not None:
            net = Network(total[:-1] / total[-1] / _UNIT)
    return totals, pairs, net


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_prob, unseen_share, context_gain) of every row, over whole texts; fits on all of ``docs``.

    unseen_share: words that no other row has; context_gain: by how much the window raises the mean log probability over that of the words alone. Null and
    empty texts have no tokens, a sum of 0 and nulls for means. Rows with a null or repeated doc_id are documents of their own. Scores are the same however rows
    lie. Extra columns are not read; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    blocks = _blocks(docs, scratch)
    totals, pairs, net = fit_lm(blocks)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            b = Block(*[part.column(i)[0].as_py() for i in range(1, 6)], totals, pairs)
            doc, m = np.repeat(np.arange(len(b.lengths)), b.lengths), len(b.lengths)
            p = net.log_prob(b)
            total = np.bincount(doc, p, m)
            some = pa.array(b.lengths == 0)
            mean = lambda x: pa.array(np.bincount(doc, x, m) / np.maximum(b.lengths, 1), mask=some.to_numpy(zero_copy_only=False))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(part.column(0)[0].as_py(), pa.int64()), pa.array(b.lengths), pa.array(total, pa.float64()), mean(p), mean(b.novel), mean(p - b.log_alone)], ["doc_id", "n_tokens", "log_likelihood", "mean_log_prob", "unseen_share", "context_gain"])

    kind = "doc_id long, n_tokens long, log_likelihood double, mean_log_prob double, unseen_share double, context_gain double"
    return blocks.where("block >= 0").select("ids", "lengths", "cls", "own", "pair", "novel").mapInArrow(score, kind)
