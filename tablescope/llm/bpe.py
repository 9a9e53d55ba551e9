"""Byte-level BPE ids of many texts with the tokenizers library, each distinct word of a task encoded once.

The library's splitting pattern starts a token at a lone space between two other characters, at an ASCII sign after an
ASCII letter, and on both sides of a lone line break, so texts fall apart there without changing a single id. Only
cuts next to characters that are surely no white space are used.
"""

from __future__ import annotations

import hashlib
import os
import sys
from itertools import chain
from types import ModuleType

import numpy as np

from tablescope.llm.arrays import SPACE, ranges, span_hashes

_MOST_WORDS = 1_000_000  # kept at most, in about 40 bytes each
_WORDS_AT_ONCE = 4_000  # encoded at once: the library's objects take about a kilobyte a word
_BYTES_AT_ONCE = 4 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def encoder_of(tokenizer_json: str) -> WordEncoder:
    """The encoder of a tokenizer, kept by a worker process from task to task with the words it knows.

    It is kept under a module name of its own, as this module travels with each task anew.
    """
    kept = sys.modules.setdefault("_tablescope_encoder", ModuleType("_tablescope_encoder")).__dict__
    name = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if kept.get("name") != name:
        kept["name"], kept["encoder"] = name, WordEncoder(tokenizer_json)
    return kept["encoder"]


class WordEncoder:
    """Encodes pieces of text; keeps the ids of the words seen so far, a bounded number of them."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.firsts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if not new.any():
            return
        if len(self.hashes) + int(new.sum()) > _MOST_WORDS:
            self._reset()
            new = np.ones(len(hashes), bool)
        raw = memoryview(data)
        starts, ends = starts[new], ends[new]
        ids, counts = [self.ids], []
        for k in range(0, len(starts), _WORDS_AT_ONCE):
            texts = [str(raw[a:b], "utf-8") for a, b in zip(starts[k : k + _WORDS_AT_ONCE].tolist(), ends[k : k + _WORDS_AT_ONCE].tolist())]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
        counts = np.concatenate(counts)
        firsts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate(ids)
        at = np.searchsorted(self.hashes, hashes[new])  # both are sorted
        self.hashes, self.firsts, self.counts = (np.insert(old, at, more) for old, more in ((self.hashes, hashes[new]), (self.firsts, firsts), (self.counts, counts)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the bounds of the rows among them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data), bool)
        plain = (data < 0x80) & ~SPACE[data] & (data >= 0x20)
        before = plain.copy()
        before[1:] |= data[:-1] == 0xC3
        after = plain | (data == 0xC3)
        lone = before[:-2] & after[2:]
        cut[1:-1] = (data[1:-1] == 0x20) & lone
        line = np.flatnonzero((data[1:-1] == 0x0A) & lone) + 1
        cut[line] = True
        cut[line + 1] = True
        cut[1:] |= _SIGN[data[1:]] & _LETTER[data[:-1]]
        raw = data.tobytes()
        for token in self.added:  # stay whole
            at = raw.find(token)
            while at >= 0:
                cut[at + 1 : at + len(token)] = False
                at = raw.find(token, at + 1)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        parts, sizes = [], []
        bounds = np.searchsorted(starts, np.arange(0, len(data) + _BYTES_AT_ONCE, _BYTES_AT_ONCE)).tolist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            hashes, first, which = np.unique(span_hashes(data, starts[a:b], ends[a:b]), return_index=True, return_inverse=True)
            self._learn(data, hashes, starts[a:b][first], ends[a:b][first])
            at = np.searchsorted(self.hashes, hashes)
            sizes.append(self.counts[at][which])
            parts.append(self.ids[ranges(self.firsts[at][which], sizes[-1])])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[np.searchsorted(starts, offsets)]
