"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores.

Labels come for documents. Words and word beginnings that explain the toxic training documents and hardly occur in the others label their tokens
(greedy cover); the field is trained on those tokens and their surroundings with forward-backward gradients in numpy. Scoring runs over whole texts
as one exact scan of 2x2 step matrices, in chunks; what a word adds to its own and its neighbours' potentials is cached by word.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, slices

#: Labelled documents of each class that the field is fitted on, and bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 2500, 24e6
#: Hash buckets of the features.
BUCKETS = 1 << 17
CUT = 0.7
#: Words whose potentials a worker keeps.
CACHE = 100_000
_EDGE = b" \t\n\r\x0b\x0c.,!?;:%&$*#|\"'()[]{}<>-_"


def normal(word: bytes) -> str:
    """The word in lower case without signs at its ends."""
    return word.strip(_EDGE).decode("utf-8", "replace").lower()


#: CRC states after the letter that names a feature.
_NAMED = [zlib.crc32(c) for c in (b"w", b"s", b"a", b"b", b"c", b"d")]
_NO_WORD, _A_WORD = zlib.crc32(b"e") % BUCKETS, zlib.crc32(b"n") % BUCKETS


def features(word: bytes) -> list[int]:
    """Buckets of the word, its ending, its beginnings, and whether it is one."""
    if word.isascii():  # bytes are letters: the same buckets without texts
        b, crc, (w, s, *starts) = word.strip(_EDGE).lower(), zlib.crc32, _NAMED
        return [crc(b, w) % BUCKETS, crc(b[-3:], s) % BUCKETS, *[crc(b[:k], c) % BUCKETS for k, c in enumerate(starts, 3)], _A_WORD if b else _NO_WORD]
    w = normal(word)
    named = [f"w{w}", f"s{w[-3:]}", f"a{w[:3]}", f"b{w[:4]}", f"c{w[:5]}", f"d{w[:6]}", "n" if w else "e"]
    return [zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS for f in named]


WIDTH = len(features(b"x"))


def telling(toxic: list[set[str]], clean: list[set[str]], least: int = 3, purity: float = 0.97) -> set[str]:
    """Words (``=word``) and beginnings (``^begi``) that explain toxic documents, greedily by how many of them are still unexplained."""
    def marks(words: set[str]) -> set[str]:
        return {f"={w}" for w in words} | {f"^{w[:k]}" for w in words for k in (4, 5) if len(w) > k}

    where: dict[str, set[int]] = defaultdict(set)
    for i, words in enumerate(toxic):
        for m in marks(words):
            where[m].add(i)
    where = {m: d for m, d in where.items() if len(d) >= least}
    against: dict[str, int] = defaultdict(int)
    for words in clean:
        for m in marks(words):
            if m in where:
                against[m] += 1
    scale = len(toxic) / max(len(clean), 1)
    pure = {m: d for m, d in where.items() if len(d) >= purity * (len(d) + scale * against[m]) and len(d) >= 2 * against[m]}
    queue = [(-len(d), m) for m, d in pure.items()]
    heapq.heapify(queue)
    # What is in many toxic documents and in no other is telling even where other words explain them all.
    open_, found = set(range(len(toxic))), {m for m, d in pure.items() if len(d) >= 7 * least and not against[m]}
    for m in found:
        open_ -= pure[m]
    while queue:
        size, m = heapq.heappop(queue)
        now = len(pure[m] & open_)
        if now < least:
            continue
        if -size != now:
            heapq.heappush(queue, (-now, m))
            continue
        found.add(m)
        open_ -= pure[m]
    return found


class Field:
    """Potentials: emissions of label 1 from a word's features and its neighbours' (hashed), and 2x2 transitions."""

    def __init__(self) -> None:
        self.w = np.zeros((3, BUCKETS))  # own, previous word's, next word's
        self.trans = np.zeros((2, 2))
        self.start = np.zeros(2)

    def emissions(self, f: np.ndarray) -> np.ndarray:
        """f: segments x tokens x WIDTH."""
        own, left, right = (self.w[k][f].sum(-1) for k in range(3))
        own[:, 1:] += left[:, :-1]
        own[:, :-1] += right[:, 1:]
        return own

    def gradient(self, f: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean log likelihood of labels y; tokens beyond the end of a segment (on = 0) come last."""
        n, length = y.shape
        e = self.emissions(f)
        pot = np.stack([np.zeros_like(e), np.clip(e, -30, 30)], -1)
        fw, bw = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        fw[:, 0] = pot[:, 0] + self.start
        for t in range(1, length):
            step = np.logaddexp(fw[:, t - 1, :1] + self.trans[0], fw[:, t - 1, 1:] + self.trans[1]) + pot[:, t]
            fw[:, t] = np.where(on[:, t, None], step, fw[:, t - 1])
        for t in range(length - 2, -1, -1):
            a = bw[:, t + 1] + pot[:, t + 1]
            step = np.logaddexp(a[:, :1] + self.trans[:, 0], a[:, 1:] + self.trans[:, 1])
            bw[:, t] = np.where(on[:, t + 1, None], step, 0)
        z = np.logaddexp(fw[:, 0, 0] + bw[:, 0, 0], fw[:, 0, 1] + bw[:, 0, 1])
        p1 = np.exp(fw[:, :, 1] + bw[:, :, 1] - z[:, None])
        diff = np.where(on, y - p1, 0.0) / n
        g = np.zeros_like(self.w)
        for k, d in enumerate((diff, np.pad(diff[:, 1:], ((0, 0), (0, 1))), np.pad(diff[:, :-1], ((0, 0), (1, 0))))):
            g[k] = np.bincount(f.ravel(), np.repeat(d.ravel(), f.shape[2]), BUCKETS)
        gt = np.zeros((2, 2))
        for t in range(1, length):
            live = on[:, t]
            for a in (0, 1):
                for b in (0, 1):
                    p = np.exp(fw[:, t - 1, a] + self.trans[a, b] + pot[:, t, b] + bw[:, t, b] - z)
                    gt[a, b] += (((y[:, t - 1] == a) & (y[:, t] == b)) - p)[live].sum() / n
        gs = np.array([((y[:, 0] == a) - np.exp(fw[:, 0, a] + bw[:, 0, a] - z)).mean() for a in (0, 1)])
        return g, gt, gs

    def fit(self, f: np.ndarray, y: np.ndarray, on: np.ndarray, epochs: int = 2, batch: int = 512, rate: float = 0.1, decay: float = 1e-6) -> None:
        """AdaGrad over shuffled batches (fixed seed)."""
        # Few segments are gone through more often, in smaller batches.
        batch, epochs = min(batch, max(16, len(y) // 40)), max(epochs, 15_000 // max(len(y), 1))
        paces = np.array([[1.0], [0.1], [0.1]])  # neighbours learn slowly, lest rare ones explain the word beside them
        rng, sums = np.random.default_rng(7), [np.full_like(x, 1e-8) for x in (self.w, self.trans, self.start)]
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                k = order[i : i + batch]
                for x, g, s, pace in zip((self.w, self.trans, self.start), self.gradient(f[k], y[k], on[k]), sums, (paces, 1.0, 1.0), strict=True):
                    g -= decay * x
                    s += g * g
                    x += rate * pace * g / np.sqrt(s)


def chain_marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(label 1) of every token of a row of documents; ``first`` marks where documents begin, where messages start anew. Exact."""
    n = len(e)
    if not n:
        return np.zeros(0)
    length = max(16, int(np.sqrt(n)))
    c = -(-n // length)
    pad = c * length - n
    odds = np.concatenate((np.exp(np.clip(e, -30, 30)), np.ones(pad))).reshape(c, length)
    new = np.concatenate((first, np.ones(pad, bool))).reshape(c, length)
    t, s = np.exp(trans - trans.max()), np.exp(start - start.max())
    step = np.empty((c, length, 2, 2))
    for a in (0, 1):
        step[..., a, 0] = np.where(new, s[0], t[a, 0])
        step[..., a, 1] = np.where(new, s[1], t[a, 1]) * odds
    step /= step.max((2, 3), keepdims=True)
    prod = np.broadcast_to(np.eye(2), (c, 2, 2)).copy()
    for i in range(length):
        prod = prod @ step[:, i]
        prod /= prod.max((1, 2), keepdims=True)
    left, right = np.ones((c, 2)), np.ones((c, 2))
    for k in range(1, c):
        v = left[k - 1] @ prod[k - 1]
        left[k] = v / v.max()
        v = prod[c - k] @ right[c - k]
        right[c - 1 - k] = v / v.max()
    fw, v = np.empty((c, length, 2)), left
    for i in range(length):
        v = (v[:, :, None] * step[:, i]).sum(1)
        v /= v.max(1, keepdims=True)
        fw[:, i] = v
    bw, v = np.empty((c, length, 2)), right
    for i in range(length - 1, -1, -1):
        bw[:, i] = v
        v = (step[:, i] * v[:, None, :]).sum(2)
        v /= v.max(1, keepdims=True)
    both = fw * bw
    return (both[..., 1] / both.sum(-1)).ravel()[:n]


class _Words:
    """What each word adds, numbered as words come; one for each worker process, so that tasks leave nothing behind."""

    owner = ""
    number: dict[bytes, int] = {}
    adds = np.zeros((1024, 3), np.float32)

    @classmethod
    def of(cls, name: str) -> None:
        if cls.owner != name or len(cls.number) > CACHE:
            cls.owner, cls.number, cls.adds = name, {}, np.zeros((1024, 3), np.float32)


class Tagger:
    """What a worker needs of the field."""

    def __init__(self, field: Field):
        self.w, self.trans, self.start = field.w.astype(np.float32), field.trans, field.start
        self.name = uuid.uuid4().hex

    def _learn(self, words: set[bytes]) -> None:
        """Numbers words that the worker has not met, their potentials gathered at once."""
        known, n = _Words.number, len(_Words.number)
        while n + len(words) > len(_Words.adds):
            _Words.adds = np.concatenate((_Words.adds, np.zeros_like(_Words.adds)))
        order = list(words)
        for i in range(0, len(order), 4096):
            part = order[i : i + 4096]
            _Words.adds[n + i : n + i + len(part)] = self.w[:, np.array([features(w) for w in part])].sum(-1).T
        known.update(zip(order, range(n, n + len(order)), strict=True))

    def marginals(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        _Words.of(self.name)
        known = _Words.number
        if new := {w for words in docs for w in words if w not in known}:
            self._learn(new)
        ids = [known[w] for words in docs for w in words]
        add = _Words.adds[np.array(ids, np.int64)].astype(float)
        ends = np.cumsum([len(d) for d in docs])
        first = np.zeros(len(ids), bool)
        begins = np.concatenate(([0], ends[:-1])) if docs else np.zeros(0, int)
        first[begins[begins < ends]] = True
        e = add[:, 0].copy()
        if len(e) > 1:
            inner = ~first[1:]
            e[1:] += add[:-1, 1] * inner
            e[:-1] += add[1:, 2] * inner
        return np.split(chain_marginals(e, first, self.trans, self.start), ends[:-1]) if docs else []


def document_score(p: np.ndarray) -> float:
    """Chance that any tagged token is toxic: tokens at 0.5 or above count as independent; with none of them, the largest marginal. No tokens: 0."""
    if not len(p):
        return 0.0
    top = float(p.max())
    return top if top < 0.5 else float(1 - np.exp(np.log1p(-np.minimum(p[p >= 0.5], 1 - 1e-12)).sum()))


def segments(docs: list[list[bytes]], marked: list[list[int]], around: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training segments: around every labelled token, or the whole text, every word once, where a document has none."""
    length, fs, ys, ons = 2 * around + 1, [], [], []
    known: dict[bytes, list[int]] = {}
    for words, at in zip(docs, marked, strict=True):
        labels, last = set(at), -length
        starts = []
        for c in at:
            if c - last >= around:
                starts.append(max(0, c - around))
                last = c
        for a in starts if at else range(0, len(words), length):
            part = words[a : a + length]
            f = [known[w] if w in known else known.setdefault(w, features(w)) for w in part]
            fs.append(f + [[0] * WIDTH] * (length - len(part)))
            ys.append([int(a + i in labels) for i in range(len(part))] + [0] * (length - len(part)))
            ons.append([True] * len(part) + [False] * (length - len(part)))
    return np.array(fs, np.int32).reshape(-1, length, WIDTH), np.array(ys, float).reshape(-1, length), np.array(ons, bool).reshape(-1, length)


def train_field(toxic: list[bytes], clean: list[bytes]) -> Field:
    """Fits on texts of both classes. With no toxic text, or nothing that tells them apart, the field tags nothing."""
    field = Field()
    field.start[:] = 0.0, -6.0
    field.trans[:, 1] = -6.0
    tw, cw = [t.split() for t in toxic], [t.split() for t in clean]
    marks = telling([{normal(w) for w in d} for d in tw], [{normal(w) for w in d} for d in cw])
    if not marks:
        return field
    is_mark = lambda w: f"={w}" in marks or (len(w) > 4 and f"^{w[:4]}" in marks) or (len(w) > 5 and f"^{w[:5]}" in marks)
    at = [[i for i, w in enumerate(d) if is_mark(normal(w))] for d in tw]
    some = [(d, a) for d, a in zip(tw, at, strict=True) if a]
    docs, marked = [d for d, _ in some] + cw, [a for _, a in some] + [[] for _ in cw]
    f, y, on = segments(docs, marked)
    field.fit(f, y, on)
    # Tokens of clean documents that the first fit takes for toxic join the training set.
    hard = [[int(p.argmax())] if len(p) and p.max() > 0.1 else [] for p in Tagger(field).marginals(cw)]
    pick = [(d, h) for d, h in zip(cw, hard, strict=True) if h]
    if pick:
        f2, y2, on2 = segments([d for d, _ in pick], [h for _, h in pick])
        f, y, on = np.concatenate((f, f2)), np.concatenate((y, np.zeros_like(y2))), np.concatenate((on, on2))
        field.fit(f, y, on, epochs=1)
    return field


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE, sample_bytes: float = SAMPLE_BYTES) -> Tagger:
    """Fits on whole texts of at most ``sample`` labelled documents and ``sample_bytes`` of each class (first by hash of the id), never on ids with crc32 modulo ``folds`` equal to ``held``.

    The ids of the sample are broadcast: 2 * ``sample`` numbers at most. Null ids, labels and texts are left out; identical texts count once. Toxic texts of the sample
    in which no word tells them from clean ones give no labelled token and are left out of the training.
    """
    keep = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held)
    slim = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    texts: dict[int, list[bytes]] = {}
    for y in (0, 1):
        ids = labels.where(keep & (F.col("toxic") == y)).select(F.col("doc_id").cast("long")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        sized = slim.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
        some, total = [], 0
        for r in sized:
            if total + r["n"] <= sample_bytes:
                some.append((r["doc_id"],))
                total += r["n"]
        chosen = docs.sparkSession.createDataFrame(some, "doc_id long")
        texts[y] = sorted({bytes(t) for _, t in slim.join(F.broadcast(chosen), "doc_id", "left_semi").collect()})
    return Tagger(train_field(texts[1], texts[0]))


_WORDS = regex.compile(r"[^\x20\x09-\x0D]+")


def score_toxicity(docs: DataFrame, model: Tagger, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted, spans) of every row, map only, over whole texts. A score of exactly ``cut`` is predicted toxic.

    ``spans`` has (start, end, probability) of each run of tokens with a marginal of at least 0.5, as character offsets. Null and empty texts score 0;
    repeated rows stay; other columns are left out.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])))])

    def spans(text: bytes, p: np.ndarray) -> list[dict]:
        out: list[dict] = []
        where = [m.span() for m in _WORDS.finditer(text.decode("utf-8", "replace"))]
        for i in np.flatnonzero(p >= 0.5):
            if out and i == last + 1:  # noqa: F821
                out[-1] |= {"end": where[i][1], "probability": max(out[-1]["probability"], float(p[i]))}
            else:
                out.append({"start": where[i][0], "end": where[i][1], "probability": float(p[i])})
            last = i  # noqa: F841
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t or b"" for t in part.column(1).to_pylist()]
            ps = model.marginals([t.split() for t in texts])
            scores = [document_score(p) for p in ps]
            found = [spans(t, p) if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, ps, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32()), pa.array(found, arrow.field("spans").type)], schema=arrow)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
