"""Byte-pair merges of many short words at once, in numpy: what a BPE tokenizer does to each run of letters, step by step over all of them."""

from __future__ import annotations

import numpy as np

_NONE = 512  # of a byte's places: 0 to 255 within a run, 256 to 511 at its end, none
_NEVER = np.iinfo(np.int32).max
_LETTER, _DIGIT, _MARK, _LEAD, _REST, _OUT = range(1, 7)
#: Letters (also à to ÿ, of two bytes, and their capitals), digits and marks; other words, and what may begin 's or a special token, are left to the tokenizer.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127], _KIND[48:58], _KIND[97:123], _KIND[65:91], _KIND[0xC3], _KIND[0x80:0xC0] = _MARK, _DIGIT, _LETTER, 0, _LEAD, _REST
_KIND[[0x97, 0xB7, ord("'"), ord("<")]] = 0  # the first two: signs of multiplication and division


def _shown() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class Merges:
    """The merges of a byte-level tokenizer (its JSON) in which runs of letters, of marks and each digit are merged apart and end in a suffix."""

    def __init__(self, made: dict, longest: int = 32):
        model, self.longest = made["model"], longest
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.none = max(vocab.values()) + 1
        self.ids = np.array([*(vocab[c] for c in _shown()), *(vocab[c + suffix] for c in _shown()), self.none], np.int64)
        keys = np.array([vocab[a] * (self.none + 1) + vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        n = len(self.ids)
        self.rank = self._ranks(np.repeat(self.ids, n), np.tile(self.ids, n))  # of pairs of bytes

    @staticmethod
    def fit(made: dict) -> bool:
        """Whether the model merges by rank alone, with every pair once."""
        model = made["model"]
        odd = any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback", "unk_token"))
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or odd or len({str(x) for x in model["merges"]}) < len(model["merges"]):
            return False
        return all(c in model["vocab"] and c + model["end_of_word_suffix"] in model["vocab"] for c in _shown())

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.none + 1) + b
        at = np.searchsorted(self.keys, key)
        out = np.full(len(key), _NEVER, np.int32)
        hit = np.flatnonzero(self.keys[at] == key)
        out[hit] = self.order[at[hit]]
        return out

    def merged(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words these are for, their ids end to end, how many each has) of words (n, width) of bytes, at least one each; what stands behind sizes is ignored."""
        kind = _KIND[words]
        kind[np.arange(words.shape[1]) >= sizes[:, None]] = _OUT
        lead, rest = kind == _LEAD, kind == _REST
        some = np.flatnonzero((kind != 0).all(1) & ~rest[:, 0] & ~lead[:, -1] & (rest[:, 1:] == lead[:, :-1]).all(1))
        kind, rest, words = kind[some], rest[some], words[some]
        kind[lead[some] | rest] = _LETTER
        ends = kind == _DIGIT
        ends[:, :-1] |= kind[:, :-1] != kind[:, 1:]
        ends[:, -1] = True
        rows, width = np.arange(len(some)), words.shape[1] + 2
        small = np.full((len(some), width), _NONE, np.int32)
        capital = rest & (words < 0x9F)
        small[:, 1:-1] = np.where(kind == _OUT, _NONE, words + np.int32(32) * capital + np.int32(256) * ends)
        rank = np.full((len(some), width), _NEVER, np.int32)
        rank[:, :-1] = self.rank[small[:, :-1] * np.int32(len(self.ids)) + small[:, 1:]]
        ids = self.ids[small]
        after, before = (np.arange(ids.size) + x for x in (1, -1))
        flat, ranks, live = ids.reshape(-1), rank.reshape(-1), rows
        while len(live):  # of each word the pair of the least rank, the first of equals
            at = live * width + rank[live].argmin(1)
            best = ranks[at]
            some_left = best < _NEVER
            live, at, best = live[some_left], at[some_left], best[some_left]
            gone = after[at]
            nxt, prev = after[gone], before[at]
            flat[at] = self.made[best]
            flat[gone], ranks[gone] = self.none, _NEVER
            after[at], before[nxt] = nxt, at
            ranks[at] = self._ranks(flat[at], flat[nxt])
            ranks[prev] = self._ranks(flat[prev], flat[at])
        kept = ids != self.none
        return some, ids[kept].astype(np.uint16), kept.sum(1)
