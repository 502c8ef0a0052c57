"""Line dedup: a segment-partition edit join.

Distinct lines are split into THRESHOLD + 1 segments; a line within the threshold of another holds one of its segments unchanged, at
nearly the same place. Segments are indexed by (length of the line, number of the segment, fingerprint), the substrings of each line that can match a segment
of a line of the same or a smaller length are probed, and candidates are verified with a banded bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Fingerprints, Scratch, combine, dealt, hashed_bits, mix, slices, sorted_groups
from tidemark.llm.substrings import _column

#: Edits (insert, delete, replace one code point) up to which two lines are near.
THRESHOLD = 2
#: Lines of fewer code points are near only when they are equal.
SHORT = 12
#: Bytes of text, or lines, for each bucket of segments.
BUCKET_BYTES, BUCKET_LINES = 12e6, 60_000
#: Entries of a bucket that a task holds; products of a key that it forms in place; products formed at a time.
HOLD, HOT, PRODUCT = 4_000_000, 50_000_000, 1_000_000
#: Candidates of a line and bucket in the first round; bits of hashed keys by which further rounds leave out what open lines cannot meet.
ROOM, BITS = 64, 1 << 23


def banded_distance(a: str, b: str, most: int) -> int:
    """Edit distance of a and b, or most + 1 when it is larger: bit-parallel (one machine word of 2 * most + 1 diagonals a step)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # Equal ends never matter.
    i, j = 0, min(len(a), len(b))
    while i < j:  # longest common prefix by halves
        m = (i + j + 1) // 2
        if a[i:m] == b[i:m]:
            i = m
        else:
            j = m - 1
    a, b = a[i:], b[i:]
    i, j = 0, min(len(a), len(b))
    while i < j:
        m = (i + j + 1) // 2
        if a[len(a) - m : len(a) - i] == b[len(b) - m : len(b) - i]:
            i = m
        else:
            j = m - 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    # State t holds, for t edits, a bit for each diagonal d = -most..most: whether it reaches that row. Rows advance through a.
    width = 2 * most + 1
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << j
    # reach[t] bit d: prefix a[:i] can be turned into b[:i + d - most] with t edits.
    reach = [0] * (most + 1)
    for t in range(most + 1):
        for d in range(width):
            if 0 <= d - most <= t:
                reach[t] |= 1 << d
    n, m = len(a), len(b)
    for i, c in enumerate(a):
        hit = where.get(c, 0)
        shift = i - most  # b index of diagonal 0 at this row
        eq = (hit >> shift if shift >= 0 else hit << -shift) & full
        valid = full
        if shift + 1 < 0:  # b prefixes of negative length do not exist
            valid &= full << -(shift + 1)
        if m - shift - 1 < width - 1:
            valid &= (1 << max(0, m - shift)) - 1
        new = []
        for t in range(most + 1):
            r = reach[t] & eq  # match: the same diagonal
            if t:
                r |= reach[t - 1]  # replace
                r |= reach[t - 1] >> 1  # delete from a
                r |= new[t - 1] << 1  # insert into a
                r |= new[t - 1]
            new.append(r & full & valid)
        reach = new
        if not reach[most]:
            return most + 1
    d = m - n + most
    for t in range(most + 1):
        if reach[t] >> d & 1:
            return t
    return most + 1


def segment_starts(length: np.ndarray, parts: int) -> np.ndarray:
    """Starts of the ``parts`` even segments, and the end: the last segments are the longer ones."""
    short = length // parts
    longer = length - short * parts
    k = np.arange(parts + 1)
    return short[:, None] * k + np.maximum(0, k - (parts - longer[:, None]))


def segment_keys(lines: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, kind) entries: kind 0 for indexed segments, 1 for probes. Lines with the same key may be near.

    A probe of segment k of lines of length l takes the substrings whose place can match: shifts within the edits that are left on either side
    (multi-match-aware selection).
    """
    size = np.array([len(x) for x in lines], np.int64)
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    prints = Fingerprints(mix(text + np.uint64(0x51ED270B)))
    base = np.cumsum(size) - size
    ok = np.flatnonzero(size >= SHORT)
    size, base = size[ok], base[ok]
    parts = most + 1
    out_key, out_line, out_kind = [], [], []

    def put(start: np.ndarray, end: np.ndarray, length: np.ndarray, k: int, which: np.ndarray, kind: int) -> None:
        key = combine(prints.spans(start, end), length.astype(np.uint64) * np.uint64(parts + 1) + np.uint64(k), 21)
        out_key.append(key)
        out_line.append(ok[which])
        out_kind.append(np.full(len(key), kind, np.int8))

    everyone = np.arange(len(ok))
    own = segment_starts(size, parts)
    for k in range(parts):
        put(base + own[:, k], base + own[:, k + 1], size, k, everyone, 0)
    for less in range(most + 1):  # a line of length size - less is the indexed one
        length = size - less
        cut = segment_starts(length, parts)
        for k in range(parts):
            seg = cut[:, k + 1] - cut[:, k]
            # Left of the segment at most k edits happened in the first k segments, right of it at most most - k; the shift follows from both.
            for shift in range(-most, most + 1):
                if not (-k <= shift <= k and -(most - k) <= less - shift <= most - k):
                    continue
                start = cut[:, k] + shift
                fit = np.flatnonzero((start >= 0) & (start + seg <= size) & (length >= SHORT))
                if len(fit):
                    put(base[fit] + start[fit], base[fit] + (start + seg)[fit], length[fit], k, fit, 1)
    return np.concatenate(out_key), np.concatenate(out_line), np.concatenate(out_kind)


def pair_marks(lines: list[str]) -> np.ndarray:
    """Twice 64 bits for each line: the parity of the number of its pairs of neighbouring code points in each of 64 hash cells, by two hashes.

    An edit changes four pairs at most, so lines within ``most`` edits differ in 4 * most bits of either at most.
    """
    size = np.array([len(x) for x in lines], np.int64)
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    line = np.repeat(np.arange(len(lines)), size)
    pair = np.flatnonzero(line[1:] == line[:-1]) if len(line) else np.zeros(0, np.int64)
    hashed, out = combine(text[pair], text[pair + 1], 23), []
    for bits in (58, 52):
        cell = ((hashed >> np.uint64(bits)) & np.uint64(63)).astype(np.int64)
        odd = (np.bincount(line[pair] * 64 + cell, minlength=64 * len(lines)) & 1).astype(np.uint8)
        out.append(np.packbits(odd.reshape(-1, 64), axis=1).view(np.int64).ravel())
    return np.stack(out, 1)


def _printed() -> Column:
    """Whether a line holds more than white space."""
    return F.col("line").rlike(r"[^\x20\x09-\x0D]")


def distinct_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(lid: md5, line, first_doc, n_docs) of the distinct lines that hold more than white space."""
    lines = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where(_printed())
    table = lines.groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))
    return scratch.save(table.select(F.unhex(F.md5("line")).alias("lid"), "line", "first_doc", "n_docs"), "lines")


def keyed_lines(lines: DataFrame, buckets: int, most: int, wanted: np.ndarray | None) -> DataFrame:
    """Segments and probes in packed blobs, by bucket of their key: key, line, its first document, kind, pair marks. Kinds 2 and 3 are those of an open line.

    ``wanted``: bits of hashed keys (none: all keys) that open lines have; what has no such key cannot be their partner.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            texts = part.column(1).to_pylist()
            key, line, kind = segment_keys(texts, most)
            if wanted is not None:
                met = np.flatnonzero(wanted[key % np.uint64(BITS)])
                key, line, kind = key[met], line[met], kind[met]
            ids, marks = np.frombuffer(b"".join(x[:8] for x in part.column(0).to_pylist()), np.int64), pair_marks(texts)
            doc = part.column(2).fill_null(_LAST).to_numpy()
            kind = kind + 2 * part.column(3).to_numpy(zero_copy_only=False).astype(np.int8)[line]
            if len(key):
                yield _entries((key % np.uint64(buckets)).astype(np.int64), key, ids[line], doc[line], kind, marks[line])

    flag = F.lit(True) if wanted is None else F.col("open")
    return lines.select("lid", "line", F.col("first_doc").cast("long"), flag.alias("open")).mapInArrow(keys, MET)


def open_keys(lines: DataFrame, most: int) -> np.ndarray:
    """BITS bits of hashed keys that open lines have."""
    return hashed_bits(lines.where("open").select("line"), BITS, lambda part: segment_keys(part.column(0).to_pylist(), most)[0])


def _entries(bucket: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket with its entries packed; the columns of candidates stay null."""
    order = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[order], [c[order] for c in cols]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    ends = np.append(cut[1:], len(bucket)) if len(bucket) else cut
    packed = [pa.array([c[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()) for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), *packed, *[pa.nulls(len(cut), t) for t in (pa.int64(), pa.int64(), pa.bool_())]], schema=_MET)


_LAST = (1 << 63) - 1
MET = "bucket long, key binary, who binary, doc binary, kind binary, marks binary, a long, b long, more boolean"
_MET = pa.schema([("bucket", pa.int64()), *[(n, pa.binary()) for n in ("key", "who", "doc", "kind", "marks")], ("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])


def _earliest(b: np.ndarray, a: np.ndarray, doc: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``room`` + 1 candidates a of each line b with the smallest first documents (ties by a), each once; and how many are kept before each in its line."""
    order = np.lexsort((a, doc, b))
    b, a, doc = b[order], a[order], doc[order]
    new = np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1])) if len(b) else np.zeros(0, bool)
    b, a, doc = b[new], a[new], doc[new]
    place = np.arange(len(b)) - np.searchsorted(b, b)
    keep = place <= room
    return b[keep], a[keep], doc[keep], place[keep]


def _compare(key: np.ndarray, who: np.ndarray, doc: np.ndarray, kind: np.ndarray, marks: np.ndarray, most: int, skip: int, room: int, product: int) -> pa.RecordBatch | None:
    """Candidates (a, b): a is not later than the open line b, shares a key, and their marks allow ``most`` edits; the earliest ones after ``skip``, ``room`` at most.

    Products are formed some at a time, so memory is bounded by the entries and the candidates kept.
    """
    order = np.lexsort((kind & 1, key))
    key, who, doc, kind, marks = key[order], who[order], doc[order], kind[order], marks[order]
    index, probe = np.flatnonzero(kind & 1 == 0), np.flatnonzero(kind & 1 == 1)
    low, high = np.searchsorted(key[index], key[probe], "left"), np.searchsorted(key[index], key[probe], "right")
    some = high > low
    low, high, probe = low[some], high[some], probe[some]
    # Probes with very many partners are taken in pieces.
    pieces = -(-(high - low) // product)
    at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low, high, probe = (np.repeat(x, pieces) for x in (low, high, probe))
    low = low + at * product
    high = np.minimum(high, low + product)
    total, i, held, size = np.concatenate(([0], np.cumsum(high - low))), 0, [], 0

    def settled() -> list[np.ndarray]:
        return list(_earliest(*(np.concatenate(x) for x in zip(*held, strict=True)), skip + room))

    while i < len(probe):
        j = max(i + 1, int(np.searchsorted(total, total[i] + product, "right")) - 1)
        n = high[i:j] - low[i:j]
        left = np.repeat(probe[i:j], n)
        right = index[np.repeat(low[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        for k in (0, 1):
            may = np.bitwise_count((marks[left, k] ^ marks[right, k]).view(np.uint64)) <= 4 * most
            left, right = left[may], right[may]
        other = who[left] != who[right]
        left, right = left[other], right[other]
        # Either end can be the later one; in one first document both may be, until their texts are compared.
        for b, a in ((left, right), (right, left)):
            ok = (doc[a] <= doc[b]) & (kind[b] >= 2)
            if ok.any():
                held.append((who[b[ok]], who[a[ok]], doc[a[ok]]))
                size += int(ok.sum())
        if size > 2 * product:
            held = [tuple(settled()[:3])]
            size = len(held[0][0])
        i = j
    if not held:
        return None
    b, a, _, place = settled()
    over = place == skip + room
    more = np.isin(b, b[over])
    keep = (place >= skip) & ~over
    n = int(keep.sum())
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.binary())] * 5, pa.array(a[keep]), pa.array(b[keep]), pa.array(more[keep])], schema=_MET)


def _candidates(lines: DataFrame, scratch: Scratch, name: str, most: int, skip: int, room: int, buckets: int, wanted: np.ndarray | None) -> DataFrame:
    """(a, b, more) by the first eight bytes of line ids: earlier candidates of each (open) line, and whether a key has more of them.

    Buckets are compared in place. Keys with very many lines, and all of a bucket beyond HOLD entries, are dealt anew by stretches of their pair marks: marks that differ in
    4 * most bits at most agree in one of 4 * most + 1 stretches, so no candidate is lost, and a template's lines spread over many tasks.
    """
    bands = 4 * most + 1
    edges = [64 * k // bands for k in range(bands + 1)]

    def anew(key: np.ndarray, who: np.ndarray, doc: np.ndarray, kind: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            part = (marks[:, 0].copy().view(np.uint64) >> np.uint64(lo)) & np.uint64((1 << hi - lo) - 1)
            new = combine(key, part, 40 + k)
            yield _entries((new % np.uint64(64 * buckets)).astype(np.int64), new, who, doc, kind, marks)

    def unpacked(g: pa.Table) -> tuple[np.ndarray, ...]:
        return *(_column(g, n, t) for n, t in (("key", np.uint64), ("who", np.int64), ("doc", np.int64), ("kind", np.int8))), _column(g, "marks", np.int64).reshape(-1, 2)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _in_pieces(batches, HOLD):
            whole = next(pieces)
            following = next(pieces, None)
            if following is not None:  # the bucket is too large to hold: all of it is dealt anew, a piece at a time
                for g in chain((whole, following), pieces):
                    yield from anew(*unpacked(g))
                continue
            cols = unpacked(whole)
            keys, at, n = np.unique(cols[0], return_inverse=True, return_counts=True)
            index = np.bincount(at, cols[3] & 1 == 0, len(keys))
            hot = index * (n - index) > HOT
            if hot.any():
                yield from anew(*(c[hot[at]] for c in cols))
                cols = tuple(c[~hot[at]] for c in cols)
            out = _compare(*cols, most, skip, room, PRODUCT)
            if out is not None:
                yield out

    def meet_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 1):
            out = _compare(*unpacked(g), most, skip, room, PRODUCT)
            if out is not None:
                yield out

    entries = keyed_lines(lines, buckets, most, wanted)
    met = scratch.save(dealt(entries, "bucket", buckets).sortWithinPartitions("bucket").mapInArrow(meet, MET), f"{name}-met")
    pairs, hot = met.where("a IS NOT NULL").select("a", "b", "more"), met.where("key IS NOT NULL")
    if not hot.isEmpty():
        again = dealt(hot, "bucket", 64 * buckets).sortWithinPartitions("bucket").mapInArrow(meet_again, MET)
        pairs = pairs.union(scratch.save(again.select("a", "b", "more"), f"{name}-hot"))
    return pairs.groupBy("b", "a").agg(F.max("more").alias("more"))


def _in_pieces(batches: Iterator[pa.RecordBatch], hold: int) -> Iterator[Iterator[pa.Table]]:
    """The buckets of a partition that is sorted by bucket, each as an iterator over tables of ``hold`` entries or so."""
    rows = ((b.column(0)[i].as_py(), b.slice(i, 1)) for batch in batches for b in (batch,) for i in range(batch.num_rows))

    def pieces(group: Iterator[tuple[int, pa.RecordBatch]]) -> Iterator[pa.Table]:
        held, size = [], 0
        for _, row in group:
            held.append(row)
            size += len(row.column(1)[0].as_py()) // 8
            if size > hold:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    for _, group in groupby(rows, lambda r: r[0]):
        yield pieces(group)


def _with_k(lines: DataFrame) -> DataFrame:
    """(k: the first eight bytes of lid as a number, lid, line, first_doc)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.frombuffer(b"".join(x[:8] for x in batch.column(0).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), *batch.columns], ["k", "lid", "line", "first_doc"])

    return lines.select("lid", "line", F.col("first_doc").cast("long")).mapInArrow(run, "k long, lid binary, line string, first_doc long")


def _verified(lines: DataFrame, pairs: DataFrame, scratch: Scratch, name: str, most: int) -> DataFrame:
    """(lid) of the lines b that a candidate a shadows: it is earlier and within ``most`` edits."""
    wanted = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    named = scratch.save(_with_k(lines).hint("merge").join(wanted, "k"), f"{name}-named")
    side = lambda x: named.select(F.col("k").alias(x), F.col("lid").alias(f"{x}_lid"), F.col("line").alias(f"{x}_line"), F.coalesce("first_doc", F.lit(_LAST)).alias(f"{x}_doc"))
    earlier = (F.col("a_doc") < F.col("b_doc")) | ((F.col("a_doc") == F.col("b_doc")) & (F.col("a_line") < F.col("b_line")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(earlier & (F.abs(F.length("a_line") - F.length("b_line")) <= most))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            near = pa.array([banded_distance(x, y, most) <= most for x, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)], pa.bool_())
            yield part.select(["b_lid"]).rename_columns(["lid"]).filter(near)

    return both.select("b_lid", "a_line", "b_line").mapInArrow(verify, "lid binary").distinct()


def shadowed_lines(lines: DataFrame, scratch: Scratch, most: int = THRESHOLD, room: int = ROOM) -> DataFrame:
    """(lid) of the lines that an earlier line is near to: one of a smaller first document, in one document the smaller by code points. Null documents come last.

    ``lines``: lid, line, first_doc. Of each line and key the ``room`` earliest candidates are verified first. Lines for which none held and which have more then try
    the following ones, eight times as many, until none is left: every line needs one earlier partner only, so pairs are not listed, and none is missed.
    """
    size, n_lines = lines.agg(F.coalesce(F.sum(F.octet_length("line")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = int(max(size / BUCKET_BYTES, n_lines / BUCKET_LINES)) + 1
    found, tried, rounds, wanted = None, 0, 0, None
    while True:
        pairs = scratch.save(_candidates(lines, scratch, f"r{rounds}", most, tried, room, buckets, wanted), f"r{rounds}-pairs")
        new = scratch.save(_verified(lines, pairs, scratch, f"r{rounds}", most), f"r{rounds}-shadowed")
        found = new if found is None else found.union(new)
        open_ = pairs.groupBy(F.col("b").alias("k")).agg(F.max("more").alias("open")).where("open")
        if open_.isEmpty():
            break
        still = scratch.save(_with_k(lines).join(open_, "k", "left").join(found.withColumn("done", F.lit(True)), "lid", "left").select("lid", "line", "first_doc", (F.coalesce("open", F.lit(False)) & F.col("done").isNull()).alias("open")), f"r{rounds}-lines")
        scratch.drop(f"r{rounds}-met", f"r{rounds}-hot", f"r{rounds}-named", f"r{rounds}-pairs")
        if still.where("open").isEmpty():
            break
        lines, tried, room, rounds, wanted = still, tried + room, 8 * room, rounds + 1, open_keys(still, most)
    return found.distinct()


def dedup_lines(docs: DataFrame, most: int = THRESHOLD) -> DataFrame:
    """``docs`` with repeated and nearly repeated lines taken out of ``text``; n_lines and n_removed are added (before any column of those names).

    A line (between line feeds) goes when an earlier document (smaller doc_id) has it, when it came before in its own document, or when an earlier distinct
    line is within ``most`` edits. White-space lines stay. Earlier means a smaller first document, in one document the smaller line. Lines of fewer than SHORT code
    points go only as exact repeats. Null texts stay null with 0 lines; rows of one doc_id are judged alike; rows with a null doc_id come last. Other columns pass through.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    # Rows without an id are known by the hash of their text, so they do not meet in one group.
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), own.alias("own"))
    lines = distinct_lines(slim, scratch)
    shadowed = shadowed_lines(lines, scratch, most).withColumn("shadowed", F.lit(True))
    fates = scratch.save(lines.select("lid", "first_doc", "n_docs").join(shadowed, "lid", "left").where("n_docs > 1 OR shadowed").select("lid", "first_doc", F.coalesce("shadowed", F.lit(False)).alias("shadowed")), "fates")
    at = slim.select("doc_id", "own", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where(_printed()).select("doc_id", "own", F.unhex(F.md5("line")).alias("lid"))
    later = F.coalesce(F.col("first_doc") < F.col("doc_id"), F.col("doc_id").isNull() & F.col("first_doc").isNotNull())
    gone = scratch.save(at.join(fates, "lid").where(F.col("shadowed") | later).groupBy("doc_id", "own").agg(F.collect_set("lid").alias("gone")), "gone")
    scratch.keep("gone")
    names = docs.columns
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t"), own.alias("o"))
    joined = renamed.hint("merge").join(gone, renamed["id"].eqNullSafe(gone["doc_id"]) & renamed["o"].eqNullSafe(gone["own"]), "left").select("row", "t", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, lines_, removed = [], [], []
            for t, g in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if t is None:
                    texts.append(None)
                    lines_.append(0)
                    removed.append(0)
                    continue
                all_, kept, seen, bad = t.split("\n"), [], set(), set(g or ())
                for x in all_:
                    if x.strip(" \t\n\x0b\x0c\r"):
                        if x in seen or (bad and hashlib.md5(x.encode()).digest() in bad):
                            continue
                        seen.add(x)
                    kept.append(x)
                texts.append("\n".join(kept))
                lines_.append(len(all_))
                removed.append(len(all_) - len(kept))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(lines_, pa.int64()), pa.array(removed, pa.int64())], ["row", "new_text", "n_lines", "n_removed"])

    schema = T.StructType([joined.schema["row"], T.StructField("new_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = joined.mapInArrow(cut, schema)
    keep = [c for c in names if c not in ("n_lines", "n_removed")]
    return out.select(*[F.col("new_text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in keep], "n_lines", "n_removed")


ORACLE = r"""
WITH l AS (
  SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, min(doc_id) AS first_doc, length(line) AS n FROM l GROUP BY line),
shadowed AS (
  SELECT DISTINCT b.line FROM d a JOIN d b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.line <> b.line
  WHERE a.n >= 12 AND b.n >= 12 AND (a.first_doc < b.first_doc OR (a.first_doc = b.first_doc AND a.line < b.line))
    AND levenshtein(a.line, b.line) <= 2),
r AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
k AS (
  SELECT r.*, NOT regexp_matches(r.line, '[^\x20\x09-\x0D]') OR (nth = 1 AND d.first_doc = r.doc_id AND s.line IS NULL) AS keep
  FROM r LEFT JOIN d ON r.line = d.line LEFT JOIN shadowed s ON r.line = s.line),
t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN t USING (doc_id)
"""
