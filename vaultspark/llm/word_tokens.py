"""Ids of whole texts by a word-level BPE tokenizer file, with each different word encoded once a batch.

The tokenizer lower-cases, splits into words and encodes each word on its own, its last token marked as a word's end. So a text's
ids are those of its words in a row. Words are split here by the file's own pattern, dictionary-encoded, and the new ones given to the
tokenizer, split at spaces then, as one text, whose ids fall into words at the end marks. Other than SAFE texts, where the normaliser or the pattern might
follow other Unicode tables than Python's, go through the tokenizer whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .latin import SAFE, splitter

#: Words that are remembered, and their characters, which bounds the memory too.
CACHE, CACHE_CHARS, CHUNK = 300_000, 16_000_000, 4_000_000
_END = "</w>"


class _Index(dict):
    """Word -> its number; a word not seen before gets the next one and waits in `new`."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k


class WordTokenizer:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path) as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith(_END)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.split = splitter(split["pattern"]["Regex"])
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and spec["model"]["end_of_word_suffix"] == _END and split["invert"] and split["behavior"] == "Removed"
        self.by_word = self.by_word and [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]] == ["Split", "ByteLevel"]
        # Words come normalised and apart already, so this one has only the merges to do.
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self) -> None:
        """Drop the known words; at a task's end, so that an idle worker holds little."""
        self.known, self.chars = _Index(), 0  # word -> its place in start and size; characters of them all
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.size, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self) -> None:
        """Ids of the words that wait, which are the last in the index."""
        words, k = self.known.new, len(self.known) - len(self.known.new)
        self.chars += sum(map(len, words))
        while len(self.known) > len(self.start):
            self.start, self.size = np.append(self.start, self.start), np.append(self.size, self.size)
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.merger.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(some):
                raise ValueError("the tokenizer doesn't mark the ends of words as the pattern finds them")
            n = len(some)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.append(self.flat, self.flat)
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[k : k + n] = self.used + np.append(0, end[:-1])
            self.size[k : k + n] = np.diff(end, prepend=0)
            self.used += len(ids)
            k += n
        self.known.new = []

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        words, ends, who = [], [], []
        for k, t in enumerate(texts):
            if not self.by_word or not SAFE.fullmatch(t):
                out[k] = self._whole(t)
                continue
            words += self.split(unicodedata.normalize("NFC", t).lower())
            ends.append(len(words))
            who.append(k)
        if not who:
            return out
        if len(self.known) > CACHE or self.chars > CACHE_CHARS:
            self.forget()
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        del words
        distinct = coded.dictionary.to_pylist()
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        self._learn()
        size = self.size[place]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[place] - (upto - size), size)]
        upto = np.append(0, upto)
        lo = 0
        for k, to in zip(who, ends, strict=True):
            hi = int(upto[to])
            out[k] = ids[lo:hi]
            lo = hi
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
