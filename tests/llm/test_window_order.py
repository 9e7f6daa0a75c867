"""The suffix sort of repeated windows, and how much of a batch the suffix stage holds at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.llm import base, suffixes


def runs(texts, length, gram):
    """All runs of windows of all texts, as the pieces of one task."""
    pieces, doc, first, count, place = [], [], [], [], []
    for i, text in enumerate(texts):
        _, _, _, start, windows, at = suffixes._runs_of(np.frombuffer(text, np.uint8), np.array([len(text)]), length, gram)
        pieces += [text[a : a + n - 1 + length] for a, n in zip(start.tolist(), windows.tolist())]
        for col, x in ((doc, np.full(len(start), i)), (first, start), (count, windows), (place, at)):
            col.append(x)
    return pieces, *(np.concatenate(c) for c in (doc, first, count, place))


@pytest.mark.parametrize("length, gram", [(100, 36), (16, 8), (9, 4)])
def test_repeated_windows_equal_a_plain_scan(length, gram):
    rng = random.Random(length)
    parts = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randrange(1, 3 * length))) for _ in range(12)] + [b"a" * 2 * length, b"\0" * 2 * length]
    texts = [b"".join(rng.choices(parts, k=5)) for _ in range(25)]
    pieces, doc, first, count, place = runs(texts, length, gram)
    piece, start, end = suffixes.repeated_windows(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), doc, first, count, place, length)
    got = {(int(doc[p]), i) for p, a, b in zip(piece, start.tolist(), end.tolist()) for i in range(a, b - length + 1)}
    seen, want = set(), set()
    for i, text in enumerate(texts):
        for a in range(len(text) - length + 1):
            if text[a : a + length] in seen:
                want.add((i, a))
            seen.add(text[a : a + length])
    assert got == want and want


def test_only_covered_places_are_ranked(monkeypatch):
    """Three of seven places are named and ranked, and no deeper than a window is long."""
    ranked, plain = [], suffixes.suffix_ranks

    def spy(s, *need):
        ranked.append(len(s))
        return plain(s, *need)

    monkeypatch.setattr(suffixes, "suffix_ranks", spy)
    rng = random.Random(1)
    passage = bytes(rng.choice(b"abcd") for _ in range(3000))
    pieces, doc, first, count, place = runs([passage + bytes([i]) * 50 for i in range(40)], 100, 36)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    suffixes.repeated_windows(text, np.array([len(p) for p in pieces]), doc, first, count, place, 100)
    assert ranked[0] < 0.5 * len(text) and sum(ranked) < len(text)


def test_suffix_ranks_up_to_a_depth():
    rng = np.random.default_rng(4)
    for _ in range(300):
        s = rng.integers(1, int(rng.choice([2, 3, 300])) + 1, int(rng.integers(0, 120)))
        s = np.tile(s, int(rng.integers(1, 4)))
        need = int(rng.integers(1, 20))
        heads = [s[i : i + need].tolist() for i in np.argsort(suffixes.suffix_ranks(s, need)).tolist()]
        assert heads == sorted(heads)


def test_joined_texts_have_the_runs_of_each():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab c") for _ in range(rng.choice([0, 1, 99, 100, 101, 400]))) for _ in range(60)]
    which, *joined = suffixes._runs_of(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), 100, 36)
    alone = [suffixes.anchors(np.frombuffer(t, np.uint8), 100, 36) for t in texts]
    assert which.tolist() == [i for i, a in enumerate(alone) for _ in a[0]]
    assert all(np.array_equal(x, np.concatenate([a[k] for a in alone])) for k, x in enumerate(joined[:4]))


def test_large_batches_are_worked_on_in_slices():
    """No step of the suffix stage gets a whole batch of long texts; all rows are kept, in order."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["x" * 20_000] * 300)], ["doc_id", "text"])
    sizes = []

    def step(part):
        sizes.append(part.nbytes)
        return part

    out = list(base.per_batch(lambda: step, suffixes._SLICE)([batch, batch.slice(0, 0)]))
    assert pa.Table.from_batches(out).column("doc_id").to_pylist() == list(range(300))
    assert max(sizes) <= 2 * suffixes._SLICE and len(list(base.per_batch(lambda: step)([batch]))) == 1
