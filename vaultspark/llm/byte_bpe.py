"""Byte-level BPE in two tiers.

1. A minimal perfect hash (hash and displace) over the vocabulary resolves the pre-tokens that are tokens themselves: two array
   reads and one comparison each, in tables of one slot a token.
2. The others are merged: a heap of (rank, place) over bytes in a doubly linked list, always the lowest rank and then the leftmost.
A batch's pre-tokens are dictionary-encoded first, so each different one is looked up once; a bounded cache keeps them over batches.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .latin import SAFE, splitter

#: Pieces that are remembered, none longer than KEPT_CHARS, which bounds the memory too.
CACHE, KEPT_CHARS, CHUNK = 400_000, 48, 4_000_000


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        found = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    return [found[k] for k in range(len(found))]


class PerfectHash:
    """A minimal perfect hash of distinct keys: slot(key) lies in [0, n), each slot once for the keys themselves."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = [xxhash.xxh3_128_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, x in enumerate(h):
            groups[(x & 0xFFFFFFFF) % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.ids = np.full(n, -1, np.int64)
        taken = bytearray(n)
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            own = groups[b]
            if not own:
                break
            if len(own) == 1:  # any free slot, named outright
                slots = [taken.index(0)]
                d = -1 - slots[0]
            else:
                d = 0
                while True:
                    slots = [self._place(h[i], d) for i in own]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
            self.shift[b] = d
            for i, s in zip(own, slots, strict=True):
                taken[s] = 1
                self.ids[s] = i

    def _place(self, x: int, d: int) -> int:
        return ((x >> 32) * (2 * d + 1) + d * 0x9E3779B97F4A7C15 >> 24 & 0xFFFFFFFFFFFF) % self.n

    def slot(self, key: bytes) -> int:
        x = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(x & 0xFFFFFFFF) % self.buckets]
        return -1 - d if d < 0 else self._place(x, d)


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.hash = PerfectHash(tokens)
        self.ids = self.hash.ids.tolist()
        self.rank = {t: r for r, t in enumerate(tokens)}
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.split_latin = splitter(pattern)
        self.cache: dict[str, np.ndarray] = {}

    def lookup(self, piece: bytes) -> int:
        """The id of a whole piece, or -1."""
        i = self.ids[self.hash.slot(piece)]
        return i if self.tokens[i] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no token: repeatedly joins the neighbours whose union has the lowest rank, leftmost first."""
        n, rank = len(piece), self.rank.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := rank(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, to = heapq.heappop(heap)
            right = after[left]
            if right >= n or end[left] == 0 or end[right] != to:
                continue  # one side has changed since
            end[left], end[right] = to, 0  # 0: no longer a part of its own
            far = after[left] = after[right]
            if far < n:
                before[far] = left
                if (r := rank(piece[left : end[far]])) is not None:
                    heapq.heappush(heap, (r, left, end[far]))
            near = before[left]
            if near >= 0 and (r := rank(piece[near:to])) is not None:
                heapq.heappush(heap, (r, near, to))
        out, k = [], 0
        while k < n:
            out.append(rank(piece[k : end[k]]))
            k = after[k]
        return out

    def encode_piece(self, piece: str) -> np.ndarray:
        found = self.cache.get(piece)
        if found is None:
            raw = piece.encode()
            whole = self.lookup(raw)
            found = np.array([whole] if whole >= 0 else self.merge(raw), np.uint32)
            if len(piece) <= KEPT_CHARS:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        pieces, ends = [], []
        for t in texts:
            pieces += self.split_latin(t) if SAFE.fullmatch(t) else self.split(t)
            ends.append(len(pieces))
        if not pieces:
            return [np.zeros(0, np.uint32) for _ in texts]
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        del pieces
        known = [self.encode_piece(p) for p in coded.dictionary.to_pylist()]
        size = np.array([len(x) for x in known])
        flat, start = np.concatenate(known), np.cumsum(size) - size
        index = coded.indices.to_numpy()
        out, at = [], 0
        for to in ends:
            own = index[at:to]
            n = size[own]
            total = int(n.sum())
            place = np.arange(total) + np.repeat(start[own] - (np.cumsum(n) - n), n)
            out.append(flat[place])
            at = to
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file; built once in a worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(doc_id, ids array<long> if with_ids, n_tokens, ids_sha256, decoded_sha256) for each row of docs.

    The digests are those of the ids as little-endian unsigned 32-bit integers and of the bytes that decoding them gives.
    A null text is empty; an empty text has no ids. A null id stays null; repeated rows come back as often as they occur.
    path: a rank file that every executor can read. A text is encoded whole; a batch of texts in ranges of about 4 MB.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                coded = c.encode_batch([t or "" for t in texts[lo:hi]])
                cols = [batch.column(0).slice(lo, hi - lo)]
                if with_ids:
                    at = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(coded).astype(np.int64))))
                cols += [
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in coded]),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = {"doc_id": "long", "ids": "array<long>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))
