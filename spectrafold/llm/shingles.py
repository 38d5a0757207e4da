"""Word and shingle fingerprints of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are fingerprinted together; a longer text goes alone.
GROUP_BYTES = 250_000
_STEP, _MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: One number for each shingle length.
_SALT = np.random.default_rng(20240502).integers(1, 2**62, 64, dtype=np.uint64)
_BYTES = np.random.default_rng(20240501).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd number and of its inverse, both modulo 2**64, as far as asked for."""

    base = 0xD1342543DE82EF95

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, GROUP_BYTES)
            self.up, self.down = _powers(self.base, size), _powers(pow(self.base, -1, 2**64), size)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts with at most so many bytes, or of one text."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, text numbers) of the words of each text, A-Z in lower case, in order."""
    n = len(data)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not n:
        return none
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])))
    ends = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    if not len(starts):
        return none
    up, down = POWERS.to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[lower] * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct fingerprints of its shingles of so many words.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    for _, data, offsets in groups(texts):
        marks, text = words(data, offsets)
        bounds = np.searchsorted(text, np.arange(len(offsets)))
        if len(marks) >= size:
            many = len(marks) - size + 1
            total = np.zeros(many, np.uint64)
            for i in range(size):
                total = mixed(total + marks[i : i + many] + np.uint64(_SALT[min(size, 63)]))
        for i in range(len(offsets) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= size:
                own = total[a : b - size + 1].copy()
                own.sort()
                yield own if len(own) < 2 else own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                one = np.zeros(1, np.uint64)
                for m in marks[a:b]:
                    one = mixed(one + m + np.uint64(_SALT[min(b - a, 63)]))
                yield one
            else:
                yield np.zeros(0, np.uint64)
