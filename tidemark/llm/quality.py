"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from moments that are summed over every training row; the covariances are shrunk towards the pooled one and
its diagonal, factored once (Cholesky), and a score is the logistic of the difference of the two log densities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, hashed_bits, mix, slices

#: Rows with a score of at least this are predicted to be good.
CUT = 0.7
DIM = 15
#: Bits of hashed ids that have a label.
BITS = 1 << 23
_LOWER = bytes(range(0x61, 0x7B))
_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_SPACE = b" \t\n\r\x0b\x0c"
_SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,")


def document_stats(text: bytes | None) -> list[float]:
    """Statistics of a whole text, on scales that are close to normal. An empty or null text gives those of no letters."""
    text = text or b""
    n = len(text)
    words = text.split()
    k = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    no_space = n - len(text.translate(None, b"")) + len(text.translate(None, _SPACE))
    body = max(no_space, 1)
    upper, lower = n - len(text.translate(None, _UPPER)), n - len(text.translate(None, _LOWER))
    digit, signs = n - len(text.translate(None, _DIGIT)), n - len(text.translate(None, _SIGNS))
    lengths = np.fromiter(map(len, words), float, k) if k else np.zeros(1)
    pairs = len(set(zip(words, words[1:], strict=False))) if k > 1 else 0
    ratio = lambda a, b: np.log((a + 0.5) / (b - a + 0.5 if b >= a else 0.5))
    return [
        np.log1p(k),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        ratio(upper, upper + lower),
        ratio(digit, body),
        ratio(signs, body),
        ratio(text.count(b"|"), body),
        ratio(text.count(b"!") + text.count(b"?"), body),
        ratio(text.count(b".") + text.count(b","), body),
        ratio(len(set(words)), k + 1),
        ratio(pairs, k + 1),
        ratio(sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,"), k + 1),
        ratio(len(lines) - len(set(lines)), len(lines) + 1),
        ratio(n - len(text.decode("utf-8", "replace")), n + 1),
        np.log1p(k / max(len(lines), 1)),
    ]


def _matrix(values: list[bytes | None]) -> np.ndarray:
    return np.array([document_stats(t) for t in values], float).reshape(-1, DIM)


class Discriminant:
    """Two Gaussians with cached Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.05, ridge: float = 0.02):
        self.prior = 0.0
        self.parts: list[tuple[np.ndarray, np.ndarray, float]] = []
        if not moments:
            return
        total = sum(m[0] for m in moments.values())
        if len(moments) < 2:  # one class only: its share, smoothed, for every text
            (label, (n, _, _)), = moments.items()
            self.prior = np.log(n + 1) * (1 if label else -1)
            return
        covs = {c: s2 / n - np.outer(s / n, s / n) for c, (n, s, s2) in moments.items()}
        pooled = sum(moments[c][0] * covs[c] for c in covs) / total
        for c in (0, 1):
            n, s, _ = moments[c]
            near = shrink + (1 - shrink) * DIM / (n + DIM)  # few rows lean on the pooled covariance
            cov = (1 - near) * covs[c] + near * pooled
            cov = (1 - ridge) * cov + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(DIM)
            low = np.linalg.cholesky(cov)
            self.parts.append((s / n, np.linalg.inv(low), float(np.log(np.diag(low)).sum())))
        self.prior = float(np.log(moments[1][0] / moments[0][0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        odds = np.full(len(x), self.prior)
        for sign, (mean, inverse, logdet) in zip((-1, 1), self.parts, strict=False):
            z = (x - mean) @ inverse.T
            odds += sign * (-0.5 * (z * z).sum(1) - logdet)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Discriminant:
    """Fits on every labelled row whose crc32(doc_id) modulo ``folds`` is not ``held``.

    Statistics are taken where the texts lie, of rows whose id may have a label (by BITS hashed bits, which leave out none that has); only (doc_id, numbers) meet
    the labels, and two sums a class reach the driver. A row counts once for each of its labels. Null labels and ids are left out; without labels of either class
    the score is a constant.
    """
    bounded_batches(docs.sparkSession)
    keep = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held)
    named = labels.where(keep & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y"))
    hashed = lambda part: mix(part.column(0).to_numpy().astype(np.uint64))
    marked = hashed_bits(named.select("doc_id"), BITS, hashed)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            part = part.filter(pa.array(marked[hashed(part) % np.uint64(BITS)]))
            x = _matrix(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    taken = docs.where(keep).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(stats, "doc_id long, x array<double>").join(named, "doc_id").select("y", "x")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + DIM + DIM * DIM))
        for part in slices(batches, 4096):
            all_, y = part.column(1).flatten().to_numpy().reshape(-1, DIM), part.column(0).to_numpy()
            for c in (0, 1):
                x = all_[y == c]
                sums[c] += np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
        for c in (0, 1):
            if sums[c, 0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sums.shape[1], c, np.int32)), pa.array(np.arange(sums.shape[1], dtype=np.int32)), pa.array(sums[c])], ["y", "i", "s"])

    rows = taken.mapInArrow(moments, "y int, i int, s double").groupBy("y", "i").agg(F.sum("s").alias("s")).collect()
    out: dict[int, np.ndarray] = {}
    for y, i, s in rows:
        out.setdefault(y, np.zeros(1 + DIM + DIM * DIM))[i] = s
    return Discriminant({y: (v[0], v[1 : 1 + DIM], v[1 + DIM :].reshape(DIM, DIM)) for y, v in out.items()})


def score_quality(docs: DataFrame, model: Discriminant, column: str = "quality_score") -> DataFrame:
    """``docs`` with a DOUBLE column of scores, map only; a column of that name is replaced. Null and empty texts are scored as texts without words."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == column.lower()])
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = model.score(_matrix([None if t is None else t.encode() for t in part.column(at).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], schema=pa.schema([*part.schema, pa.field(column, pa.float64())]))

    return docs.mapInArrow(run, schema)


def held_out_id(doc_id: int | None, folds: int, held: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == held
