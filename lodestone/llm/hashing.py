"""Hashes of many stretches of one byte or code-point array, with NumPy.

The hash of a stretch is a pair of polynomials over mixed symbols, modulo the prime
2**31 - 1, each at a base of its own and of the seed's. Two different stretches of n symbols
agree in both with a chance of about (n / 2**31)**2, whatever they hold; a power of two
as modulus would give equal hashes to some made words at every base. The polynomials come
from prefix sums, so that any number of stretches of any length cost a few operations
each, and equal stretches have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

PRIME = (1 << 31) - 1
_P, _31 = np.uint64(PRIME), np.uint64(31)
#: symbols or stretches that are worked on at a time
PIECE = 1 << 15
#: symbols that ``hashes`` sums up together, a longer stretch being alone
HASHED_BYTES = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer: all bits of the result depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _folded(x: np.ndarray) -> np.ndarray:
    """Equal to ``x`` modulo the prime, and below 2**34; ``x`` is overwritten."""
    high = x >> _31
    x &= _P
    x += high
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """The residue of ``x`` modulo the prime; ``x`` is overwritten."""
    x = _folded(_folded(x))
    x[x >= _P] -= _P
    return x


def _number(*parts: int) -> int:
    """A number from 2 to the prime less 2 that the parts determine."""
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = mixed(x + np.uint64(p * 1_000_003 + 12345))
    return 2 + int(x[0]) % (PRIME - 3)


_POWERS: dict[int, np.ndarray] = {}  # of a worker process


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**n`` modulo the prime, kept up to the longest asked for."""
    held = _POWERS.get(base, np.ones(1, np.uint32))
    while len(held) <= n:
        more = held[:n + 1 - len(held)].astype(np.uint64)
        more *= np.uint64(pow(base, len(held), PRIME))
        held = np.concatenate([held, _reduced(more).astype(np.uint32)])
    _POWERS[base] = held
    return held[:n + 1]


class Stretches:
    """Hashes of stretches ``[start, end)`` of one array of symbols.

    All of it goes by pieces that stay in a core's cache: arrays as long as the data cost several times as much.
    """

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.n = n = len(data)
        self.limbs = []
        for limb in (1, 2):
            base, extra = _number(seed, limb), np.uint64(_number(seed, limb, 3))
            steps = powers(base, n)
            bytewise = mixed(np.arange(256, dtype=np.uint64) + extra) % _P if data.dtype == np.uint8 else None
            sums = np.zeros(n + 1, np.uint64)
            for low in range(0, n, PIECE):
                piece = data[low:low + PIECE]
                values = mixed(piece.astype(np.uint64) + extra) % _P if bytewise is None else bytewise[piece]
                values *= steps[low:low + len(piece)]
                values = _folded(values)
                values[0] += sums[low]
                np.cumsum(values, out=sums[low + 1:low + len(piece) + 1])
            self.limbs.append((base, sums))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        for low in range(0, len(starts), PIECE):
            out[low:low + PIECE] = self._of(starts[low:low + PIECE], ends[low:low + PIECE])
        return out

    def _of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        parts = []
        for base, sums in self.limbs:
            # all stretches are brought to one place, the end of the array, and from there to 0
            x = _reduced(sums[ends] - sums[starts])
            x *= powers(base, self.n)[self.n - starts]
            x = _reduced(x)
            x *= np.uint64(pow(base, -self.n, PRIME))
            parts.append(_reduced(x))
        return mixed((parts[0] << _31) | parts[1])


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of stretches that follow each other, as of ``Stretches``, from some of the data at a time.

    Sums over all of the data would take many times its room.
    """
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        to = np.searchsorted(starts, low + HASHED_BYTES)
        out[at:to] = Stretches(data[low:ends[to - 1]], seed).of(starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def distinct(hi: np.ndarray, lo: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys: an index of the first of each, and each row's place among them."""
    order = np.argsort(hi)
    key = hi[order]
    same = key[1:] == key[:-1]
    if lo is not None:
        rest = lo[order]
        # mostly the first part tells keys apart, and its sort alone is much faster
        if (same & (rest[1:] != rest[:-1])).any():
            order = np.lexsort((lo, hi))
            key, rest = hi[order], lo[order]
            same = (key[1:] == key[:-1]) & (rest[1:] == rest[:-1])
    new = np.concatenate([np.ones(min(1, len(hi)), bool), ~same])
    place = np.empty(len(hi), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return np.minimum.reduceat(order, first) if len(first) else order, place


def planes(values: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes before all second ones: like bytes compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without blanks, tabs and line ends, inside stretches that fill ``data``."""
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    some = ends > starts
    before[starts[some]] = False
    after[ends[some] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
