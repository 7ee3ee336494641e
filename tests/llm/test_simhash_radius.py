"""Links at exactly the radius, for odd radii as for even ones."""

import numpy as np
import pytest

from revmine.llm import simhash


def rows_of(forest):
    return sorted(map(tuple, forest.tolist()))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
@pytest.mark.parametrize("most", [1 << 22, 3000])
def test_meeting_links_what_is_within_the_radius(monkeypatch, radius, most):
    monkeypatch.setattr(simhash, "TASK_VARIANTS", most)
    rng = np.random.default_rng(radius)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    for _ in range(9):
        flips = rng.choice(64, radius + int(rng.integers(0, 2)), replace=False)
        fps.append(fps[int(rng.integers(0, len(fps)))] ^ sum(1 << int(b) for b in flips))
    fps = np.unique(np.array(fps, np.uint64))
    want = [(a, b) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= radius]
    got = list(simhash.meet(fps, np.full(len(fps), simhash.ball(radius)), 64, radius))
    pairs = np.concatenate(got) if got else np.zeros((0, 2), np.uint64)
    assert rows_of(simhash.forest(pairs)) == rows_of(simhash.forest(np.array(want, np.uint64).reshape(-1, 2)))


def test_links_over_prefixes_at_an_odd_radius(spark):
    fps = [0, 0b111, 0b1111 << 20, (0b1111 << 20) | (0b111 << 50), 1 << 60]
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r["u"], r["v"]) for r in simhash.links(distinct, 1 << 20, 3).collect()}
    nodes = {frozenset((u, v)) for u, v in got}
    pairs = np.array([(u, v) for u, v in got], np.uint64)
    want = np.array([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], np.uint64)
    assert nodes and rows_of(simhash.forest(pairs)) == rows_of(simhash.forest(want))
