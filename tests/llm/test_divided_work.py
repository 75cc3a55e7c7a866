"""Crowded keys, tallies and fills past the usual sizes."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa

from lapidary.llm import mixing, near_dup


def test_crowded_keys_above_the_sign_bit_are_divided():
    t, counts = Fraction("0.7"), np.zeros(near_dup.COUNTS, np.int64)
    for x in (5, (1 << 31) + 5, (1 << 32) - 5000):  # the first byte of the crowded key
        y, rows, seen = x + 1, [], []
        for r in range(20):
            words = [x, y, *(x + 100 * r + i for i in range(20, 30))]  # x and y stand in the prefix
            rows.append(np.sort(np.array(words, np.uint64) << np.uint64(32)).view(np.int64))
        key = np.array([x], np.uint64).view(np.int64)[0] << 32 | y
        off = pa.array(np.arange(21, dtype=np.int32) * 12)
        b = pa.RecordBatch.from_arrays([pa.array([key] * 20), pa.array(range(20)), pa.array([12] * 20, pa.int32()), pa.array([[x, y]] * 20), pa.ListArray.from_arrays(off, pa.array(np.concatenate(rows)))], names=["key", "rep", "n", "used", "words"])
        for out in near_dup._extended(iter([b]), counts, t, 3):
            seen += zip(out["key"].to_pylist(), out["rep"].to_pylist())
        most = Counter(k for k, _ in seen).most_common(1)[0][1]
        assert most == 1 and len({k for k, _ in seen}) == len(seen) > 20, (x, most)  # the rows share no third byte


def test_candidates_are_tallied_before_the_words(spark):
    w = lambda bytes_, low=0: [(b << 32) + low for b in bytes_]
    a = w(range(10))
    rows = [
        ("same", a, a), ("short", a, w(range(7)) + w(range(20, 23))), ("enough", a, w(range(9)) + w([20])), ("bytes only", a, w(range(10), 1)),
        ("fell together", w([1] * 5) + [6, 7, 8] + w(range(2, 9)), w([1] * 5) + [6, 7, 8] + w(range(2, 9))), ("sign", w(range(-5, 5)), w(range(-5, 5))),
    ]
    df = spark.createDataFrame(rows, "name string, wa array<long>, wb array<long>")
    assert {r[0] for r in df.where(near_dup._reaches(Fraction("0.7"))).collect()} == {"same", "enough", "bytes only", "fell together", "sign"}


def test_a_miss_past_the_range_is_filled_again():
    counts = {1000: 1000, 70: 100}
    for b in range(1, 100, 7):  # only b documents of 70 fit exactly, the proportional start holds some 59
        budget = 600_000 + 70 * b
        got = mixing.fill(counts, budget)
        assert all(0 < k <= counts[n] for n, k in got.items())
        assert sum(n * k for n, k in got.items()) == budget, b
