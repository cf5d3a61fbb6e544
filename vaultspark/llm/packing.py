"""Packing by vector bin packing.

An example is a vector: its tokens, one segment, its loss-bearing tokens. A sequence has a limit on each. The open sequence takes, of
the waiting examples that fit, the one whose demand has the largest dot product with what the sequence has left, both as shares of
the limits; so scarce capacity draws the examples that use it. When none fits, the one with the largest product is cut to fill it.
Each task packs its own rows with a bounded pool, so nothing is shuffled. A sequence that ends early, by the other limits or at a task's
end, is split into sequences whose lengths are powers of two; these need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .word_tokens import chunks, word_tokenizer

TOKENS, SEGMENTS, POOL, END = 4096, 512, 512, 2


class Packer:
    """Takes examples one by one and yields pieces (tag, start, length, sequence, offset), where start counts the example's tokens before it."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL):
        self.limit = np.array([tokens, segments, loss or tokens], float)
        self.need = np.zeros((pool, 3))  # rows of waiting examples; a free row has no tokens
        self.start = np.zeros(pool, np.int64)
        self.mask: list[np.ndarray | None] = [None] * pool
        self.tag: list = [None] * pool
        self.free = list(range(pool))
        self.sequence, self.used, self.left = 0, 0, self.limit.copy()
        self.open: list[tuple] = []  # pieces (tag, start, length, offset) of the open sequence

    def _put(self, tag, mask: np.ndarray) -> None:
        k = self.free.pop()
        self.tag[k], self.start[k], self.mask[k] = tag, 0, mask
        self.need[k] = len(mask), 1, np.count_nonzero(mask)

    def _fitting(self, mask: np.ndarray) -> int:
        """How many of the first tokens fit into what is left."""
        if self.left[1] < 1:
            return 0
        bearing = np.cumsum(mask[: int(self.left[0])])
        return int(np.searchsorted(bearing, self.left[2], side="right"))

    def _take(self, k: int, n: int) -> None:
        mask = self.mask[k]
        self.open.append((self.tag[k], int(self.start[k]), n, self.used))
        self.used += n
        self.left -= (n, 1, np.count_nonzero(mask[:n]))
        if n < len(mask):
            self.start[k] += n
            self.mask[k] = mask[n:]
            self.need[k] = len(mask) - n, 1, np.count_nonzero(mask[n:])
        else:
            self.need[k] = 0
            self.tag[k] = self.mask[k] = None
            self.free.append(k)

    def _close(self) -> Iterator[tuple]:
        """The open sequence's pieces; one that isn't full becomes sequences whose lengths are powers of two, largest first."""
        lo = 0
        while lo < self.used:
            rest = self.used - lo
            size = rest if rest == self.limit[0] else 1 << (rest.bit_length() - 1)
            for tag, start, n, offset in self.open:
                a, b = max(offset, lo), min(offset + n, lo + size)
                if a < b:
                    yield tag, start + a - offset, b - a, self.sequence, a - lo
            self.sequence += 1
            lo += size
        self.used, self.left, self.open = 0, self.limit.copy(), []

    def _place(self) -> Iterator[tuple]:
        """Place one example, or fill the open sequence with a part of one; yields what that completes."""
        waiting = self.need[:, 0] > 0
        score = (self.need / self.limit) @ (self.left / self.limit)
        fits = waiting & (self.need <= self.left).all(axis=1)
        if fits.any():
            k = int(np.argmax(np.where(fits, score, -1)))
            self._take(k, len(self.mask[k]))
            full = self.left[0] < 1
        else:
            k = int(np.argmax(np.where(waiting, score, -1)))
            n = self._fitting(self.mask[k])
            if n:
                self._take(k, n)
            elif not self.used:
                raise ValueError("a token does not fit an empty sequence")
            full = True
        if full:
            yield from self._close()

    def add(self, tag, mask: np.ndarray) -> Iterator[tuple]:
        """mask: for each token whether it bears loss. Tags without tokens are placed nowhere."""
        if len(mask):
            while not self.free:
                yield from self._place()
            self._put(tag, mask)

    def finish(self) -> Iterator[tuple]:
        """Place what waits and close the last sequence."""
        while (self.need[:, 0] > 0).any():
            yield from self._place()
        yield from self._close()


class _Rows:
    """Packed pieces as batches; keeps an example's ids until its last piece is out."""

    NAMES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"

    def __init__(self, part: int):
        self.base, self.rows = part << 40, []

    def add(self, pieces: Iterator[tuple]) -> None:
        for (doc_id, ids, mask), start, n, sequence, offset in pieces:
            own = ids[start : start + n]
            self.rows.append((doc_id, start, n, zlib.crc32(own.astype("<u4").tobytes()), len(ids), self.base + sequence, offset, int(np.count_nonzero(mask[start : start + n]))))

    def batch(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in self.NAMES.split(", ")]
        cols = list(zip(*self.rows, strict=True)) or [[] for _ in names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack_documents(
    docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", *, prompt_col: str | None = None, end: int = END, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document's ids are its text's by the tokenizer file at path, without special tokens, then `end`. Each id lies in one piece. For
    instruction data, prompt_col names the column of the prompt, whose ids come before the text's and bear no loss. Of plain
    documents all ids but the first bear loss. A sequence holds at most `tokens` ids, `segments` pieces and `loss` loss-bearing ids; one that is
    shorter than `tokens`, where the other limits or a task's rows end it, has a power of two as its length.
    A null or empty text has the end id only. A null id stays null; repeated rows are packed as often as they occur. Sequence ids
    depend on how the table is split into tasks, not on the run: a task that is run again gives the same rows. An empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer, rows = word_tokenizer(path), Packer(tokens, segments, loss, pool), _Rows(TaskContext.get().partitionId())
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            prompts = batch.column(2).to_pylist()
            for lo, hi in chunks(texts):
                before = tokenizer.encode_batch(prompts[lo:hi]) if prompt_col else [np.zeros(0, np.uint32)] * (hi - lo)
                for doc_id, first, own in zip(ids[lo:hi], before, tokenizer.encode_batch(texts[lo:hi]), strict=True):
                    own = np.concatenate((first, own, np.array([end], np.uint32)))
                    mask = np.ones(len(own), bool)
                    mask[: max(1, len(first))] = False
                    rows.add(packer.add((doc_id, own, mask), mask))
                yield rows.batch()
        rows.add(packer.finish())
        yield rows.batch()
        tokenizer.forget()
        pa.default_memory_pool().release_unused()

    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c else F.lit("")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), filled(text_col).alias("text"), filled(prompt_col).alias("prompt")).mapInArrow(run, _Rows.NAMES)
