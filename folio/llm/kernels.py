"""Array kernels over the bytes of many texts at once: words, shingles and their hashes. No Spark here."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Bytes of text that one call of the kernels handles; a longer text is handled alone, whole.
CHUNK = 1 << 19
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(1)
def byte_values() -> np.ndarray:
    """A random-looking odd number for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * ODD) | np.uint64(1)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base, and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        base = 0xC2B2AE3D27D4EB4F
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            out = np.ones(max(n, CHUNK + 4096), np.uint64)
            filled = 1
            while filled < len(out):  # doubles what is known
                take = min(filled, len(out) - filled)
                out[filled : filled + take] = out[:take] * np.uint64(pow(b, filled, 1 << 64))
                filled += take
            _powers[name] = out
    return _powers["up"][:n], _powers["down"][:n]


def lower_table() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


LOWER = lower_table()
#: Words of the joins: anything but ASCII white space. Words of decontamination: letters, digits, all of non-ASCII.
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)], np.uint8)
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)], np.uint8)


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, the texts first to end as UTF-8) with about CHUNK bytes each; null is empty."""
    at, size, part = 0, 0, []
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if part and size + len(b) > CHUNK:
            yield at, i, part
            at, size, part = i, 0, []
        part.append(b)
        size += len(b) + 1
    if part:
        yield at, at + len(part), part


class Words:
    """The words of some texts: hash, place and text of each. Lower-cases A-Z first."""

    def __init__(self, texts: Sequence[bytes], is_word: np.ndarray):
        joined = b"\n".join(texts).translate(LOWER) + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        self.raw = joined
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        inside = is_word[self.data]
        step = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        #: Words first[i] to first[i + 1] are those of text i.
        self.first = np.searchsorted(self.start, begins)
        up, down = powers(len(joined) + 1)
        total = np.empty(len(joined) + 1, np.uint64)
        total[0] = 0
        np.cumsum(byte_values()[self.data] * up[:-1], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; only those that end in the same text mean anything."""
        n = len(self.hash)
        out = np.zeros(n, np.uint64)
        m = max(0, n - k + 1)
        for j in range(k):
            out[:m] = mix(out[:m] * ODD + self.hash[j : j + m])
        return out

    def whole(self, i: int) -> np.uint64:
        """Hash of all words of text i as one shingle."""
        out = np.zeros(1, np.uint64)
        for h in self.hash[self.first[i] : self.first[i + 1]]:
            out = mix(out * ODD + h)
        return out[0]

    def shingle_sets(self, k: int) -> list[np.ndarray]:
        """Of each text: its distinct k-word shingles, sorted; with fewer words, the whole sequence as one."""
        all_ = self.shingles(k)
        sets = []
        for i in range(len(self.first) - 1):
            a, b = self.first[i], self.first[i + 1]
            if b - a >= k:
                s = np.sort(all_[a : b - k + 1])
                sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                sets.append(np.array([self.whole(i)], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
        return sets

    def text(self, a: int, b: int) -> list[bytes]:
        """Words a to b."""
        return [self.raw[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(mark.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
