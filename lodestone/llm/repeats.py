"""Repeated passages: every byte inside a string of ``length`` bytes that starts twice.

Suffixes are told apart to a depth of ``length`` bytes, block by block of the sorted
order, as only equality to that depth matters. A difference cover of modulus ``v`` makes
this affordable: any two positions have a common shift below ``v`` that takes both into
the cover. Cover positions are named by their next ``length - v + 1`` bytes. A suffix
all of whose cover positions have unique names ties with no other, and isn't sorted at
all. Of the rest

1. repeated cover positions are ranked to the full depth, which settles the inside of
   long repeats,
2. names whose surroundings are still open, in any of their documents, are marked, and
3. only the suffixes around marked names go to their bucket, a key range that one task
   sorts at a time; equal neighbours are repeats.

Which positions repeat, and which ranked windows do, is found once and kept with the
block, so that later passes hash the bytes of the windows they look at, and no others.
Keys have 94 bits, so that a chance tie is less likely than a disk error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import BLOCK_BYTES, Block, bits_of, per_block, round_of, sent, split, stage, to_bits, with_kept
from .hashing import Stretches, distinct, from_planes, planes

# Perfect difference sets; every residue is a difference of two members.
COVERS = {
    1: (0,),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover whose modulus leaves names of at least a third of the length."""
    v = max(v for v in COVERS if v <= max(1, length * 2 // 3))
    return v, COVERS[v]


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that stretches ``[low, high)`` fill, both ascending: their starts and ends, and the run of each stretch."""
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(new)
    return low[first], high[np.append(first[1:], len(low))[:len(first)] - 1], np.cumsum(new) - 1


def _filled(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places runs that don't touch cover."""
    step = np.zeros(n + 1, np.int8)
    step[starts], step[ends] = 1, -1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


class _View:
    """What the passes over a block share: cover positions and the windows around them."""

    def __init__(self, block: Block, length: int):
        v, cover = cover_for(length)
        self.b, self.length, self.v = block, length, v
        self.name = name = length - v + 1
        # whole periods of the cover from each text's start, then those with room for a name
        periods = (block.ends - block.starts - name) // v + 1
        periods[block.ends - block.starts < name] = 0
        owner = np.repeat(np.arange(len(periods)), periods)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(periods) - periods, periods)
        at = (block.starts[owner] + nth * v)[:, None] + np.array(cover)
        fits = at + name <= block.ends[owner][:, None]
        self.cover, owner = at[fits], np.broadcast_to(owner[:, None], at.shape)[fits]
        # starts of the windows that a cover position answers for: from low to high
        self.low = np.maximum(self.cover - v + 1, block.starts[owner])
        self.high = np.minimum(self.cover, block.ends[owner] - length)

    def hashes(self, starts: np.ndarray, size: int, *seeds: int) -> list[np.ndarray]:
        """Hashes of the ``size`` bytes at ascending ``starts``, for each seed; no other bytes are read."""
        low, high, run = _merged(starts, starts + size)
        sizes = high - low
        moved = starts - (low - np.cumsum(sizes) + sizes)[run]
        inside = self.b.data[_filled(len(self.b.data), low, high)]
        return [Stretches(inside, seed).of(moved, moved + size) for seed in seeds]

    def names(self, at: np.ndarray) -> np.ndarray:
        # 32 bits beside the range are enough: a chance tie only adds candidates
        return self.hashes(at, self.name, 1)[0] & ~np.uint64(0xFFF)

    def twice(self, place: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(place, minlength=n) > 1

    def repeated(self, got: dict) -> np.ndarray:
        """Which cover positions have a repeated name."""
        if "ranks kept" in got:
            return bits_of(got["ranks kept"], len(self.cover))
        heads, place = distinct(self.names(self.cover))
        flags = bits_of(got.get("names", []), len(heads)) | self.twice(place, len(heads))
        return flags[place]

    def keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = self.hashes(starts, self.length, 1, 2)
        return first, (second >> np.uint64(32)).astype(np.uint32)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Bytes inside the windows at ascending ``starts``."""
        low, high, _ = _merged(starts, starts + self.length)
        return _filled(len(self.b.data), low, high)

    def ranked(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that the first ranking looks at."""
        at = self.cover[repeated]
        return at[self.high[repeated] >= at]

    def known(self, kind: str, starts: np.ndarray, got: dict) -> np.ndarray:
        """Which of ``starts`` have a window that starts elsewhere too."""
        hi, lo = self.keys(starts)
        heads, place = distinct(hi, lo)
        flags = bits_of(got.get(kind, []), len(heads)) | self.twice(place, len(heads))
        return flags[place]

    def open_names(self, repeated: np.ndarray, settled: np.ndarray) -> np.ndarray:
        """Of the repeated cover positions: whether a window around isn't inside the ``settled`` ones."""
        start, end, _ = _merged(settled, settled + self.length)
        low, high = self.low[repeated], self.high[repeated]
        run = np.searchsorted(start, low, side="right") - 1
        inside = np.append(end, 0)[run] >= high + self.length
        return (high >= low) & ~(inside & (run >= 0))

    def around(self, repeated: np.ndarray, got: dict) -> np.ndarray:
        """Starts of all windows around marked names."""
        heads, place = distinct(self.names(self.cover[repeated]))
        marked = bits_of(got.get("marks", []), len(heads))[place]
        low, high = self.low[repeated][marked], self.high[repeated][marked]
        some = high >= low
        start, end, _ = _merged(low[some], high[some] + 1)
        return np.flatnonzero(_filled(len(self.b.data), start, end))


def _name_bytes(names: np.ndarray) -> np.ndarray:
    return ((names >> np.uint64(12)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _ties(payloads: list[bytes]) -> list[bytes]:
    """Names that two blocks have."""
    each = [from_planes(p, np.uint32) for p in payloads]
    everything = np.concatenate(each)
    heads, place = distinct(everything)
    found = (np.bincount(place, minlength=len(heads)) > 1)[place]
    return [to_bits(x) for x in split(found, [len(e) for e in each])]


def _window_ties(payloads: list[bytes]) -> list[bytes]:
    """One bucket, sorted: windows that two blocks have."""
    each = [(from_planes(p[:len(p) * 2 // 3], np.uint64), from_planes(p[len(p) * 2 // 3:], np.uint32)) for p in payloads]
    heads, place = distinct(np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each]))
    found = (np.bincount(place, minlength=len(heads)) > 1)[place]
    return [to_bits(x) for x in split(found, [len(e[0]) for e in each])]


def _any_mark(payloads: list[bytes]) -> list[bytes]:
    """Names that any block has marked."""
    each = [(from_planes(p[:len(p) * 4 // 5], np.uint32), np.frombuffer(p[len(p) * 4 // 5:], bool)) for p in payloads]
    heads, place = distinct(np.concatenate([e[0] for e in each]))
    marked = np.bincount(place, np.concatenate([e[1] for e in each]), len(heads)) > 0
    return [to_bits(x) for x in split(marked[place], [len(e[0]) for e in each])]


def find_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 200,
                 keep_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes; a byte is removed if it lies in any ``length`` bytes of its
    text that also start anywhere else, in the same text (overlaps count) or another.
    ``n_spans`` counts maximal removed runs; ``keep_text`` adds ``kept``, the remaining
    bytes. Null counts as empty; texts shorter than ``length`` lose nothing; repeated rows
    are copies of each other, also if they repeat the id; an empty table gives no rows;
    extra columns are not read. Whatever repeats how often, a block sends a key once.
    """
    if length < 1:
        raise ValueError("length must be positive")
    staged = stage(docs, id, text, block_bytes=block_bytes)
    ranges = staged.ranges

    def send_names(block: int, b: Block, got: dict) -> pa.Table:
        view = _View(b, length)
        names = view.names(view.cover)
        names = names[distinct(names)[0]]
        return sent(block, names, ranges, lambda s: planes(_name_bytes(names[s])))

    def send_windows(block: int, view: _View, starts: np.ndarray) -> pa.Table:
        hi, lo = view.keys(starts)
        heads, _ = distinct(hi, lo)
        hi, lo = hi[heads], lo[heads]
        return sent(block, hi, ranges, lambda s: planes(hi[s]) + planes(lo[s]))

    def send_ranks(block: int, b: Block, got: dict) -> pa.Table:
        view = _View(b, length)
        repeated = view.repeated(got)
        return with_kept(send_windows(block, view, view.ranked(repeated)), block, to_bits(repeated))

    def send_marks(block: int, b: Block, got: dict) -> pa.Table:
        view = _View(b, length)
        repeated = view.repeated(got)
        names = view.names(view.cover[repeated])
        heads, place = distinct(names)
        names, starts = names[heads], view.ranked(repeated)
        known = view.known("ranks", starts, got)
        is_open = np.bincount(place, view.open_names(repeated, starts[known]), len(heads)) > 0
        return with_kept(sent(block, names, ranges, lambda s: planes(_name_bytes(names[s])) + is_open[s].tobytes()),
                         block, to_bits(known))

    def send_suffixes(block: int, b: Block, got: dict) -> pa.Table:
        view = _View(b, length)
        return send_windows(block, view, view.around(view.repeated(got), got))

    answers = round_of(staged, send_names, _ties, None, "names")
    answers = round_of(staged, send_ranks, _window_ties, answers, "ranks")
    answers = round_of(staged, send_marks, _any_mark, answers, "marks")
    answers = round_of(staged, send_suffixes, _window_ties, answers, "suffixes")

    kind = docs.schema[id].dataType
    id_type = to_arrow_type(kind)

    def remove(block: int, b: Block, got: dict) -> pa.Table:
        view = _View(b, length)
        repeated = view.repeated(got)
        ranked, rest = view.ranked(repeated), view.around(repeated, got)
        gone = view.covered(np.sort(np.concatenate([ranked[bits_of(got["marks kept"], len(ranked))],
                                                    rest[view.known("suffixes", rest, got)]])))
        size, removed, spans, kept = [], [], [], []
        for start, end in zip(b.starts, b.ends):
            own = gone[start:end]
            size.append(end - start)
            removed.append(int(own.sum()))
            spans.append(int((np.diff(own.astype(np.int8), prepend=0) == 1).sum()))
            kept.append(b.data[start:end][~own].tobytes())
        out = {"doc_id": pa.array(b.ids, id_type), "n_bytes": pa.array(size, pa.int64()),
               "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
               "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if keep_text:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    return per_block(staged, answers, remove, f"doc_id {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, "
                        "kept_sha256 string" + ", kept binary" * keep_text)


