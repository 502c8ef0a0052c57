"""What the operators of this subpackage share: scratch tables, word hashes, blob exchanges."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every operator that counts words.
WORD = r"[^\x20\x09-\x0D]+"
#: Odd multipliers for mixing hashes.
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Base of the polynomial fingerprints over word hashes, and its inverse modulo 2**64.
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder set by ``setCheckpointDir``; on one machine, a temporary one. On a cluster without any: an error, as executors share no local folder."""
    if (folder := spark.sparkContext.getCheckpointDir()) is not None:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps the batches that go to Python workers small: texts may be long, and every batch exists several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


class Scratch:
    """Tables in the shared folder that ``spark.checkpoint.dir`` names; they cut lineage and survive lost executors.

    A folder is set only where the session names none (tests on one machine).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded_batches(spark)
        root = spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark)
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        del df
        return out

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, which a returned frame still reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(path):
            self.drop(*[s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName() not in names])

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, and lets Spark drop unreachable shuffle files."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
        # Python lets go of frames, the JVM hears of it a moment later; what both have forgotten goes with the second collection.
        for _ in range(2):
            gc.collect()
            jvm.System.gc()
            time.sleep(0.2)


def n_words(text: Column) -> Column:
    """Number of words of a text as LONG; null counts 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id's decimal text modulo ``m``; null ids count as -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % m, F.lit(-1))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _M1 + mix(b + np.uint64(salt * 0x632BE59BD9B4E019 & (2**64 - 1))))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["p"][:n], _POWERS["i"][:n]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of some texts by their places in one buffer, without an object for each: start, end, number of the text, hash."""

    def __init__(self, texts: list[bytes | None]):
        self.raw = b"\n".join(t or b"" for t in texts) + b"\n"
        self.bytes = np.frombuffer(self.raw, np.uint8)
        blank = _BLANK[self.bytes]
        turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        turn = np.append(0, turn) if not blank[0] else turn
        self.start, self.end = turn[::2], turn[1::2]
        closes = np.cumsum([len(t or b"") + 1 for t in texts])
        self.doc = np.searchsorted(closes, self.start, "right")
        self.lengths = np.bincount(self.doc, minlength=len(texts))
        self.hash = np.empty(len(self.start), np.uint64)
        for i in range(0, len(self.start), 65_536):  # some words at a time: eight bytes and more stand for each of theirs
            start, end = self.start[i : i + 65_536], self.end[i : i + 65_536]
            part = self.bytes[start[0] : end[-1]]
            power, inverse = powers(len(part) + 1)
            prefix = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
            self.hash[i : i + 65_536] = mix((prefix[end - start[0]] - prefix[start - start[0]]) * inverse[start - start[0]] + (end - start).astype(np.uint64) * _M1)

    def __len__(self) -> int:
        return len(self.start)

    def some(self, which: np.ndarray) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


class Fingerprints:
    """Fingerprints of any span of a sequence of hashes, each in constant time."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power, self.inverse = powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the items start..end-1."""
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _M1)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of each batch, so that Python objects of few rows exist at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def runs_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end of the last."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))


def parts_for(spark: SparkSession, total: float, each: float) -> int:
    """Number of groups of about ``each`` units; at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / each) + 1)


def hashed_bits(keys: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """``bits`` bits (a multiple of 8), set where a row of ``keys`` hashes to: of one size, whatever the number of rows. What is not set, no row has."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in slices(batches, 1024):
            held = np.zeros(bits, bool) if held is None else held
            held[hashes(part) % np.uint64(bits)] = True
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], ["v"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for part in slices(batches, 4):
            for v in part.column(0).to_pylist():
                held |= np.frombuffer(v, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["v"])

    few = max(1, int(keys.sparkSession.sparkContext.defaultParallelism))
    out = keys.mapInArrow(mark, "v binary").repartition(few).mapInArrow(either, "v binary").repartition(1).mapInArrow(either, "v binary").first()
    return np.unpackbits(np.frombuffer(bytes(out[0]), np.uint8)).astype(bool) if out else np.zeros(bits, bool)


def tasks_for(groups: int) -> int:
    """Partitions for ``groups`` groups that a task takes one after another: one each, up to what a driver can schedule."""
    return max(1, min(groups, 50_000))


def dealt(df: DataFrame, column: str, groups: int) -> DataFrame:
    """Groups by their number (0 to ``groups`` - 1), evenly: the number of tasks grows with the groups, none gets two of them before all have one."""
    n = tasks_for(groups)
    return df.repartitionById(n, F.pmod(F.col(column), F.lit(n)).cast("int"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by its first ``keys`` (integer) columns, one table each, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in cols)
        cuts = np.flatnonzero(new)
        start = 0
        for cut in cuts:
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
