"""Round breaks against what R's pretty() gives for the same ranges."""

import math

import pytest

from geoframe.operators.classify import _pretty, round_step


@pytest.mark.parametrize("lo, hi, classes, want", [
    (0, 1, 5, [0, 0.2, 0.4, 0.6, 0.8, 1]), (0, 97, 5, [0, 20, 40, 60, 80, 100]), (1, 10, 5, [0, 2, 4, 6, 8, 10]), (-1, 1, 5, [-1, -0.5, 0, 0.5, 1]),
    (0, 3, 5, [0, 0.5, 1, 1.5, 2, 2.5, 3]), (1.234, 5.678, 5, [1, 2, 3, 4, 5, 6]), (0, 10, 10, list(range(11))), (-999.99, 9999.99, 5, [-2000, 0, 2000, 4000, 6000, 8000, 10000]),
])
def test_as_published(lo, hi, classes, want):
    assert _pretty(lo, hi, classes) == pytest.approx(want)


def test_steps_and_single_values():
    assert [round_step(w) for w in (1, 1.4, 1.5, 2.8, 3, 7, 7.1, 0.03)] == pytest.approx([1, 1, 2, 2, 5, 5, 10, 0.05])
    for v in (0.0, 5.0, -3.0, 1e9, 1e-9, 123.456):
        out = _pretty(v, v, 5)
        assert out[0] <= v + 1e-6 and out[-1] >= v - 1e-6 and len(out) >= 2 and all(math.isfinite(x) for x in out)
