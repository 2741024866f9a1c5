"""Token ids by the tokenizers library, with the ids of repeated parts of texts remembered."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Parts whose ids a process remembers, about 150 bytes each; then it forgets all and starts again.
MOST_PARTS = 400_000
#: Bytes of text that are cut into parts at once.
PORTION = 1 << 21
_MISS = -1
#: A word that separates new parts as they are encoded together; parts that have it are encoded alone.
_BETWEEN = "\0"
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_MARK = np.isin(np.arange(256), list(b".,;:!?*%$#&"))
#: First bytes of characters that are white space in no library's eyes: all that can be seen of ASCII, and of UTF-8 the
#: blocks without spaces.
_SOLID = np.array([32 < b < 127 or 0xC3 <= b <= 0xDF or 0xE4 <= b <= 0xED for b in range(256)])


def cuts(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a part: a space before a solid character, a mark after a letter or digit of ASCII, and a line's end
    between a word or mark and a word, with what follows it. Pre-tokenizers that take words, digits, marks and white
    space apart break there whatever stands around, and no normal form joins what stands on both sides."""
    after, before = np.append(data[1:], np.uint8(0)), np.append(np.uint8(0), data[:-1])
    line = (data == 10) & (_ALNUM | _MARK)[before] & _ALNUM[after]
    out = (data == 32) & _SOLID[after] | _MARK[data] & _ALNUM[before] | line
    out[1:] |= line[:-1]
    return out


class WordTokenizer:
    """Ids of whole texts, equal to encode(text, add_special_tokens=False) for byte-level tokenizers with the usual pattern and
    those that drop white space (see cuts). Each distinct part of the texts is encoded by the library once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab()
        mark = lambda test: np.array([test(t) for t, _ in sorted(vocabulary.items(), key=lambda x: x[1])])
        self.begins = mark(lambda t: t.startswith("Ġ")) if "Ġ" in vocabulary and "a</w>" not in vocabulary else None
        self.ends = mark(lambda t: t.endswith("</w>")) if "a</w>" in vocabulary else None
        self.between = self.library.encode(" " + _BETWEEN, add_special_tokens=False).ids
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.letters = self._letters_only(vocabulary)
        self.forget()

    def _letters_only(self, vocabulary):
        """The same model behind a split at white space, for words of ASCII letters, which are one piece each and at most change
        case before the model sees them; none if probes of the vocabulary's own words come out otherwise."""
        from tokenizers import Tokenizer, pre_tokenizers

        if self.begins is None and self.ends is None:
            return None
        fast = Tokenizer(self.library.model)
        fast.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        own = [t for t in (t.removesuffix("</w>") for t in sorted(vocabulary)) if t.isascii() and t.isalpha()][::20]
        probes = [*own, *(t.title() for t in own), *(a + b for a, b in zip(own, own[7:], strict=False))]
        want = [self.library.encode(" " + p, add_special_tokens=False).ids for p in probes]
        got = [fast.encode(self._for_letters([p]), add_special_tokens=False).ids for p in probes]
        return fast if want == got else None

    def _for_letters(self, words: list[str]) -> str:
        return " ".join(words).lower() if self.begins is None else "Ġ" + " Ġ".join(words)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, "<u4")
        self.starts = np.zeros(1 << 16, np.int64)
        self.n = 0

    def _append(self, ids: np.ndarray, ends: np.ndarray) -> int:
        """Adds parts whose ids end at `ends` of ids; returns the number of the first."""
        first, at = self.n, int(self.starts[self.n])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(ends) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[at : at + len(ids)] = ids
        self.n += len(ends)
        self.starts[first + 1 : self.n + 1] = at + ends
        return first

    def _learn(self, parts: list[str]) -> None:
        """Encodes new parts, a thousand alike in one text."""
        spaced: tuple[list, list, list] = ([], [], [])  # words after a space: of ASCII letters, of letters, others
        bare, alone = [], []  # words after nothing; what is encoded by itself
        for p in parts:
            if p[0] == " " and _BETWEEN not in p:
                w = p[1:]
                spaced[2 if not w.isalpha() else 0 if w.isascii() else 1].append(w)
            else:
                (bare if p.isalpha() else alone).append(p)
        for kind, words in enumerate(spaced):
            for i in range(0, len(words), 1000):
                some = words[i : i + 1000]
                self._keep([" " + w for w in some], *self._spaced(some, kind))
        for i in range(0, len(bare), 1000):
            some = bare[i : i + 1000]
            self._keep(some, *self._bare(some))
        if alone:
            ids = [self._ids(p) for p in alone]
            self._keep(alone, np.concatenate(ids), np.cumsum([len(x) for x in ids]))

    def _keep(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        first = self._append(ids, ends)
        self.known.update(zip(parts, range(first, first + len(parts)), strict=True))

    def _spaced(self, words: list[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each after a space, in one array, and where each ends.

        A part begins with the only token that begins with a space; or it is all letters, so one word, and ends with the only token
        that ends a word. If the counts say otherwise, the parts are encoded with a word between them that none of them has."""
        if kind == 0 and self.letters is not None:
            ids = self._ids(self._for_letters(words), self.letters)
        elif self.begins is not None or kind < 2 and self.ends is not None:
            ids = self._ids(" " + " ".join(words))
        else:
            ids = np.zeros(0, np.uint32)
        if len(ids):
            at = np.flatnonzero(self.begins[ids] if self.begins is not None else self.ends[ids])
            if len(at) == len(words) and (at[0] == 0 if self.begins is not None else at[-1] == len(ids) - 1):
                return ids, np.append(at[1:], len(ids)) if self.begins is not None else at + 1
        ids = self._ids("".join(f" {w} {_BETWEEN}" for w in words))
        m = len(self.between)
        at = np.flatnonzero(ids == self.between[-1]) + 1 - m
        keep = np.ones(len(ids), bool)
        for j in range(m):
            keep[at + j] = False
        assert len(at) == len(words)
        return ids[keep], at - m * np.arange(len(words))

    def _bare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters with nothing before them, and where each ends: a line each in one text."""
        if self.ends is not None and not self.line:  # white space is dropped, so a space before a word is nothing
            return self._spaced(words, 0 if all(map(str.isascii, words)) else 1)
        ids = self._ids("\n".join(words))
        at = np.flatnonzero(ids == self.line[0]) if len(self.line) == 1 else np.zeros(0, np.int64)
        if len(at) == len(words) - 1:
            return np.delete(ids, at), np.append(at, len(ids)) - np.arange(len(words))
        each = [self._ids(w) for w in words]
        return np.concatenate(each), np.cumsum([len(x) for x in each])

    def _ids(self, text: str, by=None) -> np.ndarray:
        return np.array((by or self.library).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _numbers(self, parts: list[str]) -> np.ndarray:
        got = np.fromiter(map(self.known.get, parts, repeat(_MISS)), np.int64, len(parts))
        missing = np.flatnonzero(got == _MISS).tolist()
        if missing:
            new = [parts[i] for i in missing]
            self._learn(new)
            got[missing] = [self.known[p] for p in new]
        return got

    def _gather(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.starts[parts]
        n = self.starts[parts + 1] - a
        ends = np.cumsum(n)
        return self.flat[np.repeat(a - ends + n, n) + np.arange(int(ends[-1]))], ends

    def encoded(self, texts: Iterable[str | None], end: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text (null: empty) as little-endian uint32, followed by the id `end` if given."""
        part, size = [], 0
        for t in texts:
            b = t.encode() if t else b""
            if part and size + len(b) > PORTION:
                yield from self._portion(part, end)
                part, size = [], 0
            part.append(b)
            size += len(b) + 1
        if part:
            yield from self._portion(part, end)

    def encode(self, texts: Iterable[str | None], end: int | None = None) -> list[np.ndarray]:
        return list(self.encoded(texts, end))

    def _portion(self, texts: list[bytes], end: int | None) -> list[np.ndarray]:
        if self.n > MOST_PARTS:
            self.forget()
        joined = b"\0".join(texts) + b"\0"
        data = np.frombuffer(joined, np.uint8)
        stop = np.cumsum([len(t) + 1 for t in texts]) - 1
        begin = cuts(data)
        begin[stop] = True
        begin[stop[:-1] + 1] = True
        begin[0] = True
        starts = np.flatnonzero(begin)
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(joined)).dictionary_encode()
        found = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        last = np.searchsorted(starts, stop)
        found[last] = self._append(np.array([] if end is None else [end], np.uint32), np.array([end is not None], np.int64))
        ids, ends = self._gather(found)
        return np.split(ids, ends[last[:-1]])


@lru_cache(4)
def tokenizer(path: str) -> WordTokenizer:
    """One for each process and file; tasks are the parallel unit, so the library's own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)
