"""Hashes of stretches: equal ones wherever they stand, unequal ones for made words too."""

import numpy as np
import pytest
from lodestone.llm import hashing, near
from lodestone.llm.hashing import PRIME, Stretches, powers
from lodestone.llm.lm import score_texts


def made_words(n: int) -> tuple[str, str]:
    """A Thue-Morse word over a and b, and its complement: equal modulo 2**64 at every odd base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_powers():
    assert powers(12345, 5000).tolist() == [pow(12345, k, PRIME) for k in range(5001)]


@pytest.mark.parametrize("kind", [np.uint8, np.int64])
def test_equal_exactly_where_stretches_are(kind):
    data = np.random.default_rng(1).integers(0, 3, 3000).astype(kind)
    starts, ends = (x.ravel() for x in np.meshgrid(np.arange(0, 2900, 7), np.arange(9)))
    ends = starts + ends
    seen: dict = {}
    for h, s, e in zip(Stretches(data, 1).of(starts, ends).tolist(), starts, ends):
        assert seen.setdefault(h, data[s:e].tolist()) == data[s:e].tolist()
    assert len(seen) == len({tuple(data[s:e].tolist()) for s, e in zip(starts, ends)})
    moved = Stretches(np.concatenate([data[:17], data]), 1)
    assert (moved.of(starts + 17, ends + 17) == Stretches(data, 1).of(starts, ends)).all()
    assert (Stretches(data, 2).of(starts[-9:], ends[-9:]) != moved.of(starts[-9:] + 17, ends[-9:] + 17)).all()


@pytest.mark.parametrize("n", [1024, 4096])
def test_made_words(n):
    one, other = (np.frombuffer(w.encode(), np.uint8) for w in made_words(n))
    for seed in range(6):
        a, b = Stretches(np.concatenate([one, other]), seed).of(np.array([0, n]), np.array([n, 2 * n]))
        assert a != b


def test_made_word_is_unknown(spark):
    one, other = made_words(1024)
    # id 1 teaches, id 5 is held out: crc32 modulo 10
    import zlib
    held = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = {r.doc_id: r for r in score_texts(spark.createDataFrame([(1, one), (held, other)], "doc_id long, text string")).collect()}
    assert zlib.crc32(b"1") % 10 and rows[held].held_out
    assert (rows[1].n_known, rows[held].n_known, rows[1].train_tokens) == (2, 1, 2)


def test_slices_hold_little_text_at_once():
    texts = ["a" * 300_000, "b" * 300_000, "c" * 2_000_000, "", "é", "d" * 500_000]
    parts = list(near._slices(texts))
    assert [t for _, bodies in parts for t in bodies] == [t.encode() for t in texts]
    assert [i for part, _ in parts for i in range(part.start, part.stop)] == list(range(len(texts)))
    assert all(len(bodies) == 1 or sum(map(len, bodies)) <= near.SLICE_BYTES <= 1 << 19 for _, bodies in parts)


def test_following_stretches_are_summed_up_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 5, 5000).astype(np.uint8)
    cuts = np.sort(rng.choice(5000, 301, replace=False))
    starts, ends = cuts[:-1], np.maximum(cuts[:-1], cuts[1:] - 1)
    want, sizes, plain = Stretches(data, 3).of(starts, ends), [], Stretches.__init__

    def seen(self, data, seed=0):
        sizes.append(len(data))
        plain(self, data, seed)

    monkeypatch.setattr(Stretches, "__init__", seen)
    monkeypatch.setattr(hashing, "HASHED_BYTES", 500)
    assert (hashing.hashes(data, starts, ends, 3) == want).all()
    assert len(sizes) > 5 and max(sizes) < 500 + (ends - starts).max()
    assert len(hashing.hashes(data, starts[:0], ends[:0], 3)) == 0
