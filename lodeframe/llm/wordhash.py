"""Hashes of words and word windows over a whole block of text at once, with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Words at most that are hashed in one block; longer texts go in overlapping segments.
SEGMENT = 100_000
#: Bytes of text at least that are gathered into a block.
BLOCK = 1_000_000

#: Bytes of a word that the table covers; the hash of a longer word is that of its blake2b digest.
SPAN = 64
_random = np.random.default_rng(20_240_611)
#: For both hashes: an independent random value for every byte at every place (tabulation hashing), so
#: that two different words of at most SPAN bytes agree with probability 2 ** -64, whatever their form.
_TABLE = [_random.integers(0, 2**64, (SPAN, 256), np.uint64).ravel() for _ in range(2)]
#: Independent odd factors of a window's words.
_FACTORS = [_random.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """Words of a text that are joined by single spaces or line feeds. Other control characters are
    part of a word, as for ``bytes.split``, but for those that it splits at: no word holds these."""

    def __init__(self, body: bytes) -> None:
        self.body = body
        self.bytes = np.frombuffer(body, np.uint8)
        gaps = np.flatnonzero((self.bytes == 32) | (self.bytes == 10))
        self.starts = np.concatenate([[0], gaps + 1]).astype(np.int64)
        self.ends = np.concatenate([gaps, [len(body)]]).astype(np.int64)

    def words(self, which: int = 0) -> np.ndarray:
        """A hash of every word; ``which`` is 0 or 1, for two independent ones."""
        sizes = self.ends - self.starts
        place = np.arange(len(self.bytes), dtype=np.int64)
        place -= np.repeat(self.starts, np.append(np.diff(self.starts), len(self.bytes) - self.starts[-1]))
        value = _TABLE[which][((place & (SPAN - 1)) << 8) + self.bytes]
        sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        out = mixed(sums[self.ends] - sums[self.starts] + sizes.astype(np.uint64))
        for i in np.flatnonzero(sizes > SPAN).tolist():
            digest = hashlib.blake2b(self.body[self.starts[i] : self.ends[i]], digest_size=16).digest()
            out[i] = np.frombuffer(digest, np.uint64)[which]
        return out


def windows(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every run of ``size`` words, in order; windows may cross texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = _FACTORS[which] if size <= len(_FACTORS[which]) else np.random.default_rng(which).integers(0, 2**63, size, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : k + n] * factors[k]
    return mixed(out)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (size - have)], out[size - have :]) if size > have else out


def blocks(texts: list[tuple[int, list[bytes]]], overlap: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Groups of (owner, first word, words): texts cut into segments that share ``overlap`` words,
    so that each window of ``overlap + 1`` words lies in exactly one."""
    group, size = [], 0
    for owner, words in texts:
        for at in range(0, max(1, len(words) - overlap), SEGMENT):
            part = words[at : at + SEGMENT + overlap]
            if not part:
                continue
            group.append((owner, at, part))
            size += sum(map(len, part)) + len(part)
            if size >= BLOCK:
                yield group
                group, size = [], 0
    if group:
        yield group
