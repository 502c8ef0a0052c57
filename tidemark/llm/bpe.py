"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols.

Distinct stretches between white space are merged once and then looked up in a bounded two-generation cache; very long ones are merged each time.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, slices

#: Stretches of each cache generation, and the length up to which a stretch is kept: so its memory is bounded. Pieces (of which stretches with other signs or capitals share many) likewise.
CACHE, KEPT = 200_000, 64
#: Signs that may stand behind a word.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return [chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A tokenizer file of kind BPE with word ends: NFC, white space to blanks, lower case, split by pattern, bytes, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.strings = {i: s for s, i in self.vocab.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"])
        # Ids of each byte inside a word and at its end.
        self.inner, self.final = ([self.vocab.get(x + end) for x in byte_symbols()] for end in ("", self.end))
        self.young: dict[str, tuple[int, bytes, bytes]] = {}
        self.old: dict[str, tuple[int, bytes, bytes]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        #: Whether the pattern takes a run of letters, and a run of signs behind it, as one piece each.
        self.plain = all(self.pieces.findall(f"ab{a}{b}{c}") == ["ab", a + b + c] for a in SIGNS for b in SIGNS for c in ("", "-", "."))
        size = max(self.strings, default=-1) + 1
        self.numbers = [str(i).encode() for i in range(size)]
        self.texts = [self.strings.get(i, "").encode() for i in range(size)]

    def merge(self, word: str) -> list[int]:
        """Ids of one piece. An entry of the queue is a number: the rank, then the position; it is stale when the symbols there no longer merge at that rank."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        if None in ids:  # no id, no unknown token: the library leaves such symbols out
            ids = [i for i in ids if i is not None]
        n, get = len(ids), self.ranks.get
        shift = n.bit_length()
        queue = [hit[0] << shift | i for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (hit := get(pair))]
        if not queue:
            return ids
        heapq.heapify(queue)
        pop, push, mask = heapq.heappop, heapq.heappush, (1 << shift) - 1
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            i = entry & mask
            j = nxt[i]
            if j >= n or not (hit := get((ids[i], ids[j]))) or hit[0] != entry >> shift:
                continue
            ids[i] = new = hit[1]
            ids[j] = -1  # no pair holds -1, so entries of this place are stale
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if hit := get((new, ids[k])):
                    push(queue, hit[0] << shift | i)
            h = prv[i]
            if h >= 0 and (hit := get((ids[h], new))):
                push(queue, hit[0] << shift | h)
        return [i for i in ids if i >= 0]

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        """As ``merge``, with a cache that starts anew when it is full."""
        ids = self.known.get(piece)
        if ids is None:
            ids = tuple(self.merge(piece))  # of numbers alone, so the collector does not follow it
            if len(piece) <= KEPT:
                if len(self.known) >= CACHE:
                    self.known = {}
                self.known[piece] = ids
        return ids

    def stretch_ids(self, stretch: str) -> Sequence[int]:
        """Ids of a stretch of text without special tokens."""
        s = stretch if stretch.isascii() else unicodedata.normalize("NFC", stretch).replace("Σ", "σ")  # lower case letter by letter: no final sigma
        s = s.lower()
        if s.isascii() or "Cn" not in map(unicodedata.category, s):
            if self.plain and s.isascii() and (word := s.rstrip(SIGNS)).isalpha():  # a word and the signs behind it
                return self.piece_ids(word) if len(word) == len(s) else self.piece_ids(word) + self.piece_ids(s[len(word) :])
            return [i for piece in self.pieces.findall(s) for i in self.piece_ids(piece)]
        # The pattern library may know letters of a later Unicode than the tokenizer's: unassigned code points count as signs.
        as_signs = "".join("\u00a7" if unicodedata.category(c) == "Cn" else c for c in s)
        return [i for m in self.pieces.finditer(as_signs) for i in self.merge(s[m.start() : m.end()])]

    def _miss(self, stretch: str) -> tuple[int, bytes, bytes]:
        found = self.old.get(stretch)
        if found is None:
            ids = self.stretch_ids(stretch)
            found = (len(ids), b" ".join([self.numbers[i] for i in ids]), b" ".join([self.texts[i] for i in ids]))
        if len(stretch) > KEPT:
            return found
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[stretch] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens in it are matched as such."""
        out: list[int] = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            out += [self.special[part]] if part in self.special else self.stretch_ids(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, one blank between; the file names no decoder."""
        return " ".join(self.strings[i] for i in ids)

    def digest(self, text: str) -> tuple[int, bytes, bytes]:
        """(number of ids, ids joined by blanks, decoded text), by the cache."""
        if self.at_special and "<|" in text and self.at_special.search(text):
            ids = self.encode(text)
            return len(ids), " ".join(map(str, ids)).encode(), self.decode(ids).encode()
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.young.get, words))
        if None in found:
            found = [f or self._miss(w) for f, w in zip(found, words, strict=True) if w]
        if not found:
            return 0, b"", b""
        n, ids_, strings = zip(*found, strict=True)
        if 0 in n:
            ids_, strings = [x for x in ids_ if x], [x for k, x in zip(n, strings, strict=True) if k]
        return sum(n), b" ".join(ids_), b" ".join(strings)


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One tokenizer, with its cache, for each path and worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
        gc.set_threshold(200_000, 50, 50)  # the caches hold no cycles: looking through them for some is a sixth of the time
    return _LOADED[path]


def bpe_encode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) to (doc_id, text); other columns are left out.

    ``path`` is the tokenizer file as each executor sees it, parsed once for each worker. Map only: nothing is
    shuffled. A null or empty text has no tokens and the digests of the empty string; repeated rows stay; order is not kept.
    """
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if keep_ids else []
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for part in slices(batches):
            rows = [bpe.digest(t or "") for t in part.column(1).to_pylist()]
            cols = [
                part.column(0),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows]),
                pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows]),
            ]
            if keep_ids:
                cols += [pa.array([[int(i) for i in r[1].split()] for r in rows], pa.list_(pa.int32())), pa.array([r[2].decode() for r in rows])]
            yield pa.RecordBatch.from_arrays(cols, names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, T.StructType(fields))
