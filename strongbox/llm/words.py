"""Words of texts and their hashes, on bytes: white space is the blank and tab to carriage return."""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """What lies between white space, as UTF-8. Only A-Z are turned into lower case."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


class Memo(dict):
    """Remembers a function's values, up to a number of keys; it forgets all of them there. Long keys
    are not kept."""

    def __init__(self, of, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.of, self.most, self.longest = of, most, longest

    def __missing__(self, key):
        value = self.of(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Known(dict):
    """The places of what was met; asking for a new key gives it a place. Values met before the
    last ``turn`` are taken over when they are asked for again."""

    def __init__(self, fixed: dict[str, bytes]):
        super().__init__(zip(fixed, range(len(fixed)), strict=True))
        self.fixed, self.values, self.new = fixed, list(fixed.values()), []
        self.older: tuple[dict[str, int], list[bytes | None]] = {}, []

    def turn(self) -> None:
        self.older = dict(self), self.values
        self.clear()
        self.update(zip(self.fixed, range(len(self.fixed)), strict=True))
        self.values = list(self.fixed.values())

    def __missing__(self, key: str) -> int:
        at = self[key] = len(self.values)
        places, values = self.older
        if (place := places.get(key)) is not None:
            self.values.append(values[place])
        else:
            self.values.append(None)
            self.new.append(key)
        return at


def word_hashes(seed: int = 0, most: int = 400_000) -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w, seed), most)


def hashed(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX
    return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n neighbouring word hashes, in their order; none if there are fewer."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = mixed(h[:size])
    for k in range(1, n):
        out = mixed(out * MIX + h[k : k + size])
    return out


def shingles(words: list[bytes], n: int, memo: Memo) -> np.ndarray:
    """The set of n-word shingles as sorted 64-bit hashes. Fewer words are one shingle; none are none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashed(words, memo)
    return np.unique(ngram_hashes(h, min(n, len(words))))
