"""Subword ids of a whole Arrow text column at once, each distinct word being encoded once per worker."""

from __future__ import annotations

import json
import os
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept
from .merges import Merges
from .words import Eights, grouped, hashed_words, same_words

if TYPE_CHECKING:
    from tokenizers import Tokenizer

_encoders: dict[str, WordEncoder] = kept("encoders")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Growing:
    """An array that is added to, in room that doubles."""

    def __init__(self, kind: type | str):
        self.whole, self.n = np.zeros(1024, kind), 0

    def __len__(self) -> int:
        return self.n

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n + 2 > len(self.whole):
            self.whole = np.concatenate([self.whole[: self.n], np.zeros(max(self.n // 2, n + 2 - self.n + 1024), self.whole.dtype)])
        self.whole[self.n : n] = values
        self.n = n

    def of(self, places: np.ndarray) -> np.ndarray:
        return self.whole[places]

    def part(self) -> np.ndarray:
        return self.whole[: self.n]


class WordEncoder:
    """Encodes by a tokenizer that splits at white space and folds ASCII case, as word_bpe_49k.json does.

    The ids of a text are then those of its words in a row. Words are known by their 64-bit hash, and their bytes are
    compared before their ids are used, in sorted arrays of some 40 bytes a word; beyond most words a worker
    begins anew. Texts in which a special token could be spelled ("<|") are encoded in one piece.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.size = self.tokenizer.get_vocab_size()
        assert self.size <= 1 << 16
        # words of lower-case ASCII letters need neither its normalizers nor its pattern, which cuts at white space and around runs of letters
        made = json.loads(self.tokenizer.to_str())
        whole = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and "[\\p{L}]+|" in json.dumps(made["pre_tokenizer"]).replace("\\\\", "\\")
        self.merges = Merges(made) if whole and Merges.fit(made) else None
        made["normalizer"], made["pre_tokenizer"] = None, {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.lean = Tokenizer.from_str(json.dumps(made)) if whole else self.tokenizer
        self.ends = np.zeros(self.size, bool)  # tokens that end a run of letters, a digit or a run of marks
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.uint32)  # of each known hash: its place in what follows
        self.begin, self.count, self.pool = Growing(np.uint32), Growing(np.uint32), Growing(np.uint16)
        self.letters_at, self.letters_n, self.letters = Growing(np.uint32), Growing(np.uint32), Growing("<u8")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _joined(self, tokenizer: Tokenizer, words: list[str], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids end to end, how many each word has) of words of one run of letters, or two with a mark at the end."""
        text = " ".join([w if n == 1 else f"{w[:-1]} {w[-1]}" for w, n in zip(words, runs.tolist(), strict=True)])
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
        stops = np.flatnonzero(self.ends[ids])
        if len(stops) != runs.sum():  # it cuts the lower case of some letters; it never cuts less
            return None
        return ids, np.diff(stops[np.cumsum(runs) - 1] + 1, prepend=0) if len(runs) else runs

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many each word has)."""
        runs = np.array([1 if w.isalpha() else 2 if w[-1:] in ".,;:!?" and w[:-1].isalpha() else 0 for w in words], np.int64)
        if not self.ends.any():
            runs[:] = 0
        plain = np.array([w.isascii() for w in words], bool)
        count, parts = np.zeros(len(words), np.int64), []
        rest = runs == 0
        for tokenizer, some in ((self.lean, (runs > 0) & plain), (self.tokenizer, (runs > 0) & ~plain)):
            at = np.flatnonzero(some)
            if len(at):
                if got := self._joined(tokenizer, [words[k] for k in at.tolist()], runs[at]):
                    parts.append((some, got[0]))
                    count[at] = got[1]
                else:
                    rest |= some
        if rest.any():
            at = np.flatnonzero(rest)
            got = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in at.tolist()], add_special_tokens=False)]
            count[at] = list(map(len, got))
            parts.append((rest, np.fromiter((x for ids in got for x in ids), np.uint16, int(count[at].sum()))))
        ids = np.empty(int(count.sum()), np.uint16)
        for some, own in parts:
            ids[np.repeat(some, count)] = own
        return ids, count

    def look_up(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, count) in pool of each of some distinct words, given sorted by hash, in lower-case bytes; unknown ones are encoded first."""
        at = np.searchsorted(self.known, hashes)
        found = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        found[inside] = self.known[at[inside]] == hashes[inside]
        eights, sizes = Eights(data), ends - starts
        some = np.flatnonzero(found)
        entry = self.entry[at[some]]
        same = self.letters_n.of(entry) == sizes[some]
        some, entry = some[same], entry[same]
        stored = Eights.over(self.letters.whole)
        right = np.zeros(len(hashes), bool)
        right[some] = same_words(eights, starts[some], stored, self.letters_at.of(entry).astype(np.int64) << 3, sizes[some])
        if not right.all():
            new = np.flatnonzero(~right)
            if len(self.begin) + len(new) > self.most and len(self.begin):
                self._forget()
                return self.look_up(hashes, starts, ends, data)
            raw = memoryview(data)
            first = len(self.begin)
            begin, count = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)

            def put(places: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
                begin[places], count[places] = len(self.pool) + np.cumsum(own) - own, own
                self.pool.add(ids)

            rest = np.ones(len(new), bool)
            if self.merges and self.ends.any():
                order = np.argsort(sizes[new], kind="stable")
                order = order[np.searchsorted(sizes[new][order], 1) : np.searchsorted(sizes[new][order], self.merges.longest, "right")]
                for lo in range(0, len(order), 8_000):
                    block = order[lo : lo + 8_000]
                    size = sizes[new[block]]
                    letters = data[np.minimum(starts[new[block]][:, None] + np.arange(size[-1]), len(data) - 1)]
                    some, ids, own = self.merges.merged(letters, size)
                    put(block[some], ids, own)
                    rest[block[some]] = False
            rest = np.flatnonzero(rest)
            for lo in range(0, len(rest), 5_000):
                some = new[rest[lo : lo + 5_000]]
                put(rest[lo : lo + 5_000], *self._ids_of([str(raw[a:b], "utf-8") for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]))
            self.begin.add(begin)
            self.count.add(count)
            size = sizes[new]
            eight = (size + 7) >> 3
            self.letters_at.add(len(self.letters) + np.cumsum(eight) - eight)
            self.letters_n.add(size)
            step = 8 * (np.arange(int(eight.sum())) - np.repeat(np.cumsum(eight) - eight, eight))
            self.letters.add(eights.at(np.repeat(starts[new], eight) + step, np.repeat(size, eight) - step))
            entries = np.arange(first, first + len(new), dtype=np.uint32)
            clash = found[new]  # another word has the hash: this one takes its place
            self.entry[at[new[clash]]] = entries[clash]
            self.known = np.insert(self.known, at[new[~clash]], hashes[new[~clash]])
            self.entry = np.insert(self.entry, at[new[~clash]], entries[~clash])
            at = np.searchsorted(self.known, hashes)
        entry = self.entry[at]
        return self.begin.of(entry).astype(np.int64), self.count.of(entry).astype(np.int64)

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the column's ids end to end, end_id after each row's, and len(column) + 1 bounds in them."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.fill_null("")
        special = pc.match_substring(column, "<|")
        apart = special.to_numpy(zero_copy_only=False).copy()
        plain = pc.if_else(special, "", column) if apart.any() else column
        hashes, starts, ends, first, data = hashed_words(plain)
        distinct, index, place = grouped(hashes)
        begin, count = self.look_up(distinct, starts[index], ends[index], data)
        eights, sizes = Eights(data), ends - starts
        same = sizes == sizes[index][place]
        same[same] = same_words(eights, starts[same], eights, starts[index][place][same], sizes[same])
        if not same.all():  # two words of this column share a hash
            apart[np.searchsorted(first, np.flatnonzero(~same), "right") - 1] = True
        ids, bounds = ragged(self.pool.part(), begin[place], count[place], first)
        odd = np.flatnonzero(apart)
        if len(odd):
            rows = np.split(ids, bounds[1:-1])
            for k in odd:
                rows[k] = self.whole(column[int(k)].as_py())
            ids = np.concatenate(rows).astype(np.uint16)
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], np.uint16(end_id))
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


def ragged(pool: np.ndarray, begin: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[begin:begin + count] for each word in a row, and the bounds of rows whose words are first[k] to first[k + 1]."""
    total = np.concatenate([[0], np.cumsum(count)])
    take = np.repeat(begin - total[:-1], count) + np.arange(total[-1])
    return pool[take], total[first]


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder of the tokenizer in the file at path."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
