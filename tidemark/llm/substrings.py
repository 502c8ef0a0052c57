"""Substring dedup by recompression: words of repeated windows go.

Rounds name runs of words and then pairs of symbols (left letters with right letters, by a bit of their global fingerprint), so the inside of equal
passages gets equal symbols wherever they stand. Each symbol carries the words that decide it. A window is represented by the highest-level symbol that its
own words decide, so equal windows have equal representatives; only windows whose representative several documents share are compared, word by
word sequence, by fingerprints of the whole window. Windows that decide no symbol represent themselves.

Exchange: documents keep to hashed shards. Keys travel in packed blobs to buckets, answers travel back to the shards that asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Fingerprints, Scratch, combine, dealt, mix, slices, sorted_groups, word_hashes

#: Consecutive words of a window.
WINDOW = 13
#: Rounds of pairs: symbols of up to 2**ROUNDS words.
ROUNDS = 3
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FAR = np.int64(1) << np.int64(40)
#: Text bytes of a bucket's keys and of a shard, about.
BUCKET_BYTES, SHARD_BYTES = 8e6, 8e6
BLOB = "bucket long, n int, a binary, b binary, c binary, d binary"


def symbol_levels(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, ...]]:
    """(name, start, end, first word that decides it, end of those words) of the symbols after each round.

    ``doc`` numbers each word's document; symbols never cross documents, and one that a document's end decides is decided by no window.
    """
    n = len(words)
    if not n:
        return [tuple(np.zeros(0, t) for t in (np.uint64, int, int, int, int))] * rounds
    # Runs of one word. The words beside a run decide it.
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    name = np.where(end - start > 1, combine(words[start], (end - start).astype(np.uint64), 1), words[start])
    d = doc[start]
    opens, closes = np.ones(len(d), bool), np.ones(len(d), bool)
    opens[1:] = closes[:-1] = d[1:] != d[:-1]
    low, high = np.where(opens, -_FAR, start - 1), np.where(closes, _FAR, end + 1)
    out = []
    for k in range(rounds):
        m = len(name)
        left = (mix(name + np.uint64((k + 1) * 0xA24BAED4963EE407 % 2**64)) >> np.uint64(63)).astype(bool)
        same = np.zeros(m, bool)
        same[:-1] = d[1:] == d[:-1]
        pair = np.zeros(m, bool)
        pair[:-1] = left[:-1] & ~left[1:] & same[:-1]
        tail = np.zeros(m, bool)
        tail[1:] = pair[:-1]
        # A lone left letter is decided by its right neighbour, a lone right letter by its left one.
        nlow, nhigh = low.copy(), high.copy()
        alone_l, alone_r = left & ~pair, ~left & ~tail
        after_low, after_high = np.append(low[1:], -_FAR), np.append(high[1:], _FAR)
        before_low, before_high = np.append(-_FAR, low[:-1]), np.append(_FAR, high[:-1])
        at_end, at_start = ~same, np.append(True, ~same[:-1])
        for mask, l2, h2, edge in ((alone_l, after_low, after_high, at_end), (alone_r, before_low, before_high, at_start)):
            nlow[mask] = np.where(edge[mask], -_FAR, np.minimum(low[mask], l2[mask]))
            nhigh[mask] = np.where(edge[mask], _FAR, np.maximum(high[mask], h2[mask]))
        p = np.flatnonzero(pair)
        nlow[p], nhigh[p] = np.minimum(low[p], low[p + 1]), np.maximum(high[p], high[p + 1])
        name = name.copy()
        name[p] = combine(name[p], name[p + 1], k + 2)
        end = end.copy()
        end[p] = end[p + 1]
        keep = ~tail
        name, start, end, low, high, d = name[keep], start[keep], end[keep], nlow[keep], nhigh[keep], d[keep]
        out.append((name, start, end, low, high))
    return out


def window_keys(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows, their representatives, their fingerprints)."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(doc[window - 1 :] == doc[: n - window + 1])
    prints = Fingerprints(words)
    whole = prints.spans(starts, starts + window)
    best = np.full(n, _NONE)
    for level, (_, _, _, low, high) in reversed(list(enumerate(symbol_levels(words, doc, rounds)))):
        ok = (low >= 0) & (high <= n) & (high - low <= window)
        low, high = low[ok], high[ok]
        open_ = np.concatenate(([0], np.cumsum(best == _NONE)))
        wanted = open_[low + 1] > open_[np.maximum(high - window, 0)]
        low, high = low[wanted], high[wanted]
        key = combine(prints.spans(low, high), np.full(len(low), level, np.uint64), 9)
        here = np.full(n, _NONE)
        for t in range(window):
            s = high - window + t
            at = (s <= low) & (s >= 0)
            np.minimum.at(here, s[at], key[at])
        best = np.where(best == _NONE, here, best)
    rep = best[starts]
    return starts, np.where(rep == _NONE, combine(whole, whole, 11), rep), whole


def _texts(part: pa.RecordBatch, id_at: int, text_at: int, step: int = 200_000) -> Iterator[tuple[np.ndarray, list[list[bytes]], np.ndarray, np.ndarray]]:
    """(row numbers, words of each row, hashes of all words, row of each word), some documents at a time."""
    rows, held, size = [], [], 0
    for i, t in enumerate(part.column(text_at).to_pylist()):
        words = t.split() if t else []
        rows.append(i)
        held.append(words)
        size += len(words)
        if size >= step:
            yield _flat(rows, held)
            rows, held, size = [], [], 0
    if rows:
        yield _flat(rows, held)


def _flat(rows: list[int], held: list[list[bytes]]) -> tuple[np.ndarray, list[list[bytes]], np.ndarray, np.ndarray]:
    return np.array(rows), held, word_hashes([w for d in held for w in d]), np.repeat(np.arange(len(held)), [len(d) for d in held])


def _blobs(bucket: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket, with its entries' columns packed."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cols = [c[order] for c in cols]
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, int)
    ends = np.append(cut[1:], len(b)) if len(b) else cut
    packed = [pa.array([c[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()) for c in cols]
    packed += [pa.array([b""] * len(cut), pa.binary())] * (4 - len(cols))
    return pa.RecordBatch.from_arrays([pa.array(b[cut], pa.int64()), pa.array(ends - cut, pa.int32()), *packed], ["bucket", "n", "a", "b", "c", "d"])


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _groups(df: DataFrame, buckets: int) -> DataFrame:
    return dealt(df, "bucket", buckets).sortWithinPartitions("bucket")


def find_repeats(docs: DataFrame, window: int, rounds: int, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(answers: a row (bucket = shard, fingerprints a, smallest doc_id b) for windows that a smaller doc_id has too, number of shards, of buckets)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards, buckets = int(size / SHARD_BYTES) + 1, int(size / BUCKET_BYTES) + 1
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), shard).where("doc_id IS NOT NULL")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Representatives, each with its document and shard. What two documents of this task share is known at once: the shards are told (bucket -1 - shard)."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            key, doc, sh = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, key))
            key, doc, sh = key[order], doc[order], sh[order]
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(cut, len(key)))
            known = doc[cut] != doc[cut + n - 1]
            told = np.repeat(known, n)
            if told.any():
                yield _blobs(-1 - sh[told], [key[told]])
            back = np.argsort(doc[cut], kind="stable")  # equal ids lie together and pack well
            cut, known = cut[back], known[back]
            yield _blobs((key[cut] % np.uint64(buckets)).astype(np.int64), [key[cut], doc[cut], sh[cut].astype(np.int32), known.astype(np.int8)])

        size = 0
        for part in slices(batches, 1024):
            ids, sh = part.column(0).to_numpy(), part.column(2).to_numpy()
            for rows_, _, words, doc in _texts(part, 0, 1):
                starts, rep, _ = window_keys(words, doc, window, rounds)
                if not len(starts):
                    continue
                at = doc[starts]
                change = np.append(True, (rep[1:] != rep[:-1]) | (at[1:] != at[:-1]))
                held.append((rep[change], ids[rows_][at[change]], sh[rows_][at[change]]))
                size += int(change.sum())
            if size > 1_500_000:
                yield from out()
                size = 0
        if held:
            yield from out()

    asked = scratch.save(rows.mapInArrow(keys, BLOB), "keys")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 1):
            key, doc, sh, known = _column(g, "a", np.uint64), _column(g, "b", np.int64), _column(g, "c", np.int32), _column(g, "d", np.int8)
            order = np.argsort(key, kind="stable")
            key, doc, sh, known = key[order], doc[order], sh[order], known[order]
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(cut, len(key)))
            several = (np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)) | (np.maximum.reduceat(known, cut) > 0)
            tell = np.repeat(several, n) & (known == 0)
            if tell.any():
                yield _blobs(sh[tell].astype(np.int64), [key[tell]])

    answers = _groups(asked.where("bucket >= 0"), buckets).mapInArrow(shared, BLOB).union(asked.where("bucket < 0").withColumn("bucket", -1 - F.col("bucket")))
    answers = scratch.save(answers.select("bucket", "a", "b"), "shared")
    scratch.drop("keys")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fingerprints of the windows whose representative is shared, with the smallest and largest document of the shard that has them."""
        for number, _, told, parts in _shards(batches):
            known = np.unique(told)
            fp, doc = [], []
            for part in parts:
                ids = part.column(2).to_numpy()
                for rows_, _, words, at in _texts(part, 2, 3):
                    starts, rep, whole = window_keys(words, at, window, rounds)
                    if len(starts) and len(known):
                        hit = known[np.minimum(np.searchsorted(known, rep), len(known) - 1)] == rep
                        fp.append(whole[hit])
                        doc.append(ids[rows_][at[starts[hit]]])
            if fp and sum(map(len, fp)):
                f, d = np.concatenate(fp), np.concatenate(doc)
                order = np.argsort(f, kind="stable")
                f, d = f[order], d[order]
                cut = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
                low, high = np.minimum.reduceat(d, cut), np.maximum.reduceat(d, cut)
                back = np.argsort(low, kind="stable")
                f, low, high = f[cut][back], low[back], high[back]
                yield _blobs((f % np.uint64(buckets)).astype(np.int64), [f, low, high, np.full(len(f), number, np.int32)])

    asked = scratch.save(_with_docs(rows, answers, shards).mapInArrow(candidates, BLOB), "windows")
    scratch.drop("shared")

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 1):
            f, low, high, sh = _column(g, "a", np.uint64), _column(g, "b", np.int64), _column(g, "c", np.int64), _column(g, "d", np.int32)
            order = np.argsort(f, kind="stable")
            f, low, high, sh = f[order], low[order], high[order], sh[order]
            cut = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
            least = np.repeat(np.minimum.reduceat(low, cut), np.diff(np.append(cut, len(f))))
            tell = least < high
            if tell.any():
                back = np.argsort(least[tell], kind="stable")
                yield _blobs(sh[tell][back].astype(np.int64), [f[tell][back], least[tell][back]])

    answers = scratch.save(_groups(asked, buckets).mapInArrow(smallest, BLOB).select("bucket", "a", "b"), "repeats")
    scratch.drop("windows")
    return answers, shards, buckets


def _with_docs(rows: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """(shard, 0, -, -, a, b) for answers, then (shard, 1, doc_id, text, -, -): shards together, answers first."""
    none = F.lit(None).cast("binary")
    told = answers.select(F.col("bucket").alias("shard"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("doc_id"), none.alias("text"), "a", "b")
    return dealt(told.union(rows.select("shard", F.lit(1), "doc_id", "text", none, none)), "shard", shards).sortWithinPartitions("shard", "kind")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """(shard, smallest ids, keys, batches of documents) of each shard."""
    blobs: tuple[int, pa.Table] | None = None
    for g in sorted_groups(batches, 2):
        number, kind = g.column(0)[0].as_py(), g.column(1)[0].as_py()
        if kind == 0:
            blobs = number, g
            continue
        own = blobs[1] if blobs and blobs[0] == number else None
        key = _column(own, "a", np.uint64) if own else np.zeros(0, np.uint64)
        low = np.frombuffer(b"".join(x or b"" for x in own.column("b").to_pylist()), np.int64) if own else np.zeros(0, np.int64)
        yield number, low, key, g.to_batches()
        blobs = None


def dedup_substrings(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept) of every row.

    A word goes when a window of ``window`` words that covers it also starts in a document with a smaller doc_id; windows are judged on the input. Kept words
    are joined by one blank. Null and empty texts have no words. Rows with a null doc_id are compared with nothing and keep all. Repeated rows and rows of
    one doc_id are judged alike, never against one another. Extra columns are not read; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "substr")
    answers, shards, _ = find_repeats(docs, window, rounds, scratch)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()), strict=False)])

    def finish(ids: list, kept: list[list[bytes]], total: list[int]) -> pa.RecordBatch:
        joined = [b" ".join(k) for k in kept]
        cols = [pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array([n - len(k) for n, k in zip(total, kept, strict=True)], pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined])]
        return pa.RecordBatch.from_arrays(cols + ([pa.array([j.decode("utf-8", "replace") for j in joined])] if texts else []), names)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, low, key, parts in _shards(batches):
            order = np.lexsort((low, key))
            key, low = key[order], low[order]
            for part in parts:
                ids = part.column(2).to_numpy()
                for rows_, words, hashes, at in _texts(part, 2, 3):
                    gone = np.zeros(len(hashes) + 1, np.int64)
                    starts, whole = np.zeros(0, np.int64), np.zeros(0, np.uint64)
                    if len(key) and len(hashes) >= window:
                        starts = np.flatnonzero(at[window - 1 :] == at[: len(at) - window + 1])
                        whole = Fingerprints(hashes).spans(starts, starts + window)
                        k = np.minimum(np.searchsorted(key, whole), len(key) - 1)
                        hit = starts[(key[k] == whole) & (low[k] < ids[rows_][at[starts]])]
                        np.add.at(gone, hit, 1)
                        np.add.at(gone, hit + window, -1)
                    covered = np.cumsum(gone[:-1]) > 0
                    ends = np.cumsum([len(w) for w in words])
                    kept = [w if not len(w) or not covered[e - len(w) : e].any() else [x for x, c in zip(w, covered[e - len(w) : e], strict=True) if not c] for w, e in zip(words, ends, strict=True)]
                    yield finish(list(ids[rows_]), kept, [len(w) for w in words])

    def as_is(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = [t.split() if t else [] for t in part.column(1).to_pylist()]
            yield finish(part.column(0).to_pylist(), words, [len(w) for w in words])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    judged = _with_docs(rows.where("doc_id IS NOT NULL"), answers, shards).mapInArrow(remove, schema)
    return judged.union(rows.where("doc_id IS NULL").select("doc_id", "text").mapInArrow(as_is, schema))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM w WHERE len(ws) >= 13)),
low AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
hit AS (SELECT win.doc_id, win.s FROM win JOIN low USING (g) WHERE low.d < win.doc_id),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM hit, range(13) AS r(k)),
kept AS (
  SELECT t.doc_id, count(*) FILTER (WHERE g.i IS NULL) AS n, string_agg(t.x, ' ' ORDER BY t.i) FILTER (WHERE g.i IS NULL) AS txt
  FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w) t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.i = g.i GROUP BY t.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.txt, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
