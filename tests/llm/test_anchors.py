"""Least grams of windows, and what the suffix stage keeps on disk."""

import os
import random
from collections import defaultdict

import numpy as np

from sessionloom.llm import suffixes


def test_anchors_are_the_least_grams_of_all_windows():
    """Each window in exactly one run; windows of equal bytes under the same gram, also where grams repeat inside them."""
    rng = random.Random(3)
    for text in [b"a" * 400, bytes(rng.choice(b"ab") for _ in range(3000)), b"xyz" * 200 + bytes(rng.choice(b"abc") for _ in range(500)) + b"xyz" * 200]:
        gram, _, start, count = suffixes.anchors(np.frombuffer(text, np.uint8), 100, 36)
        assert start.tolist() == (np.cumsum(count) - count).tolist() and count.sum() == len(text) - 99
        of = defaultdict(set)
        for g, a, n in zip(gram.tolist(), start.tolist(), count.tolist()):
            for i in range(a, a + n):
                of[text[i : i + 100]].add(g)
        assert all(len(x) == 1 for x in of.values())


def test_runs_are_removed_before_pieces_are_cut(spark, monkeypatch):
    """Of the stored tables, those of all anchors and runs are gone when the sort begins."""
    kept = []

    def stash(df):
        kept.append(plain(df))
        return kept[-1]

    plain = suffixes.stash
    monkeypatch.setattr(suffixes, "stash", stash)
    rows = [(i, 0, f"{'shared passage ' * 12}{i}{'other words ' * 10}") for i in range(20)]
    assert suffixes.repeated_spans(spark.createDataFrame(rows, "doc_id long, version long, text string")).count() > 0
    there = [t.columns for t in kept if os.path.exists(t._stash_path.removeprefix("file://"))]
    assert ["gram"] not in there and not [c for c in there if "content" in c and "doc_id" in c] and len(there) == 3
