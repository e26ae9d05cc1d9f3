"""The configuration program on histograms of several shapes, against best fit alone and the bound."""

from collections import Counter

import numpy as np
import pytest

from talus.llm import packing

RNG = np.random.default_rng(1)
SHAPES = {
    "uniform": RNG.integers(1, 2048, 60_000),
    "narrow": RNG.integers(600, 1100, 30_000),
    "lognormal": np.clip(np.exp(RNG.normal(5, 1, 60_000)).astype(int) + 1, 1, 2048),
    "halves": np.repeat([1025, 1023, 500, 523], [5000, 4000, 3000, 5000]),
    "one of each": np.arange(1, 2049),
    "few pieces": np.array([2048, 1, 1, 2047, 700]),
    "one size": np.repeat(300, 1000),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_program_is_near_the_bound_or_better_than_best_fit(shape):
    histogram = Counter(SHAPES[shape].tolist())
    found = packing.solve(histogram)
    held = Counter()
    for items, often in found.plan:
        assert sum(length * n for length, n in items.items()) <= packing.LENGTH and often > 0
        for length, n in items.items():
            held[length] += n * often
    assert held == histogram
    left = np.zeros(packing.LENGTH + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plain = sum(often for _, often in packing.best_fit([], left, packing.LENGTH))
    got = sum(often for _, often in found.plan)
    assert found.bound <= got <= plain * 1.0005 + 2
    if shape in ("uniform", "lognormal"):
        assert got <= found.bound * 1.005
    if shape in ("narrow", "halves"):
        assert got < plain * 0.99
    if len(SHAPES[shape]) > 10_000:  # nearly all ids are placed by configurations; the rest are the shortest pieces
        assert found.placed > (0.75 if shape == "lognormal" else 0.9) * found.pieces
