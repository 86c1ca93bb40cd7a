"""Subword ids of whole texts from the ids of their distinct words.

For vocabularies whose pre-tokenizer never joins what white space parts: then
a text's ids are its words' ids in a row.  Words are hashed in arrays, each
distinct one is encoded once and kept in a worker's memo of flat arrays.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from . import kernels as K

#: Places of a worker's memo (14 bytes each, and the ids); words that find no place are encoded again each time.
SLOTS = 1 << 21
_CLOSERS = np.zeros(256, bool)
_CLOSERS[list(b".,:;!?")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


class Memo:
    """Ids by the 64-bit hash of a word: two places for each hash, looked up for all words of a block at once."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self.key, self.at, self.n = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.order: list[np.ndarray] = []  # places in the order in which they were taken

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes new words; (at, n) of each in the pool."""
        ids = self.encode(words)
        n = np.array([len(x) for x in ids], np.int32)
        flat = np.array([y for x in ids for y in x], np.int32)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.int32)))
        self.pool[self.used : self.used + len(flat)] = flat
        at = (self.used + np.cumsum(n) - n).astype(np.int32)
        kept, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for shift in (0, 21):
            place = (keys[left] >> np.uint64(shift)).astype(np.int64) & (SLOTS - 1)
            free = np.flatnonzero(self.key[place] == 0)
            _, one = np.unique(place[free], return_index=True)
            mine = free[one]
            self.key[place[mine]], self.at[place[mine]], self.n[place[mine]] = keys[left[mine]], at[left[mine]], n[left[mine]]
            self.order.append(place[mine])
            kept[left[mine]] = True
            left = np.delete(left, mine)
        if kept.any():  # what is behind the last one that stays is overwritten next time
            last = int(np.flatnonzero(kept)[-1])
            self.used = int(at[last]) + int(n[last])
        return at, n

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place or -1, first id in the pool, number of ids) of each span; hashes aren't 0."""
        place = hashes.astype(np.int64) & (SLOTS - 1)
        at, n = self.at.take(place), self.n.take(place)
        miss = np.flatnonzero(self.key.take(place) != hashes)
        if len(miss):
            h = hashes[miss]
            other = (h >> np.uint64(21)).astype(np.int64) & (SLOTS - 1)
            ok = self.key[other] == h
            place[miss], at[miss], n[miss] = np.where(ok, other, -1), self.at[other], self.n[other]
            miss = miss[~ok]
        if len(miss):
            keys, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            first = miss[first]
            got_at, got_n = self._learn(keys, [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            at[miss], n[miss] = got_at[back], got_n[back]
        return place, at, n

    def gather(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of spans in a row; before the next `find`."""
        total = np.cumsum(n, dtype=np.int64)
        if not len(total):
            return np.zeros(0, np.int32)
        return self.pool.take(np.arange(total[-1]) + np.repeat(at - total + n, n))

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, their number for each span)."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        _, at, n = self.find(K.span_hashes(data, starts, ends) | np.uint64(1), data, starts, ends)
        return self.gather(at, n), n


_memos: dict[tuple[str, str], Memo] = {}


def lower_word_memo(path: str) -> Memo:
    """Of a tokenizers file with a lower-casing normalizer."""

    def load() -> Memo:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

        def encode(words: list[bytes]) -> list[list[int]]:
            return [e.ids for a in range(0, len(words), 20_000) for e in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[a : a + 20_000]], add_special_tokens=False)]

        return Memo(encode)

    return _memos.get(("lower", path)) or _memos.setdefault(("lower", path), load())


def lower_word_ids(memo: Memo, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all ids in a row, first id of each document and at last their number).

    The vocabulary ignores case, and a letter or digit never shares a piece with a mark
    behind it; so ASCII is lower-cased and a closing mark is a word of its own, which leaves fewer distinct words.
    """
    data = K.LOWER[data]
    starts, ends, _ = K.words(data, offsets)
    parted = _CLOSERS[data[ends - 1]] & (ends - starts > 1) if len(ends) else np.zeros(0, bool)
    parted &= _PLAIN[data[np.maximum(ends - 2, 0)]]
    cut = ends[parted] - 1
    starts, ends = np.sort(np.concatenate((starts, cut)), kind="stable"), np.sort(np.concatenate((ends, cut)), kind="stable")
    ids, n = memo.ids(data, starts, ends)
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)))
    return ids, total[np.searchsorted(starts, offsets)]
