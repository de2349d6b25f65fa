"""Ranges of many distinct keys: sorted as often as they double."""

import numpy as np

from millrace.llm import collocations as C
from millrace.llm import lexicon


def test_distinct_keys_are_sorted_as_often_as_they_double(monkeypatch):
    sorts, plain = [], C.radix_runs
    monkeypatch.setattr(C, "radix_runs", lambda d, c: sorts.append(len(c)) or plain(d, c))
    keys = C._Keys(2)
    for i in range(200):
        at = np.arange(i * 10, i * 10 + 10)
        keys.add(np.stack([at // 1000, at % 1000]).astype(np.uint16), np.full(10, i + 1))
        keys.bounded(50)
    digits, counts = keys.combined()
    assert digits.shape == (2, 2000) and counts.sum() == 10 * sum(range(1, 201))
    assert len(sorts) < 10 and sum(sorts) < 4 * 2000


def test_distinct_words_are_merged_as_often_as_they_double(monkeypatch):
    merges, plain = [], lexicon.Tally.merge
    monkeypatch.setattr(lexicon.Tally, "merge", lambda self: merges.append(self.rows) or plain(self))
    tally = lexicon.Tally()
    tally.group("en", "")
    for i in range(200):
        key = np.arange(i * 10 + 1, i * 10 + 11).astype(np.uint64)
        one = np.ones(10, np.int64)
        tally.add((key, 0 * one, one, one), (key, one, np.full(10, 97, np.uint8)))
        tally.bounded(50)
    tally.merge()
    assert tally.rows == 2000 and len(merges) < 10
