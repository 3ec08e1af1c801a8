import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from batchplan.functions.sizes import candidate_grid, even_floor, friendly_floor, growth_step, round_sizes, size_cap, smooth
from batchplan.operators.dynamic import PlanConfig, budget_sizes, stages, walk


def test_grid():
    assert (candidate_grid(3, 2.5), size_cap(3, 2.5)) == ([3, 4, 5, 6, 7, 8], 7)
    assert (candidate_grid(100, 1.15), size_cap(100, 1.15)) == ([100, 115], 114)
    assert candidate_grid(32, 1.05) == [32]
    assert candidate_grid(7, 0.5) == [7]


def test_floors():
    allowed = sorted({2**k for k in range(10)} | {3 * 2**k for k in range(9)})
    for n in range(1, 513):
        assert friendly_floor(n) == max(a for a in allowed if a <= n)
        assert even_floor(n) == (n if n == 1 else n // 2 * 2)
    for f in (friendly_floor, even_floor):
        with pytest.raises(ValueError):
            f(0)


@pytest.mark.parametrize(
    ("sizes", "b", "cap", "want"),
    [
        ([4, 8, 8, 8, 8, 4], 4, 8, [4, 5, 6, 7, 8, 8, 2]),
        ([4, 5, 4, 8, 7, 2], 4, 8, [4, 5, 4, 5, 6, 6]),
        ([32, 64, 64, 64, 26], 32, 64, [32, 38, 44, 50, 56, 30]),
        ([10, 50, 50, 50, 3], 10, 50, [10, 12, 14, 16, 18, 20, 22, 24, 26, 1]),
        ([3, 15, 15, 15], 3, 15, [3] * 16),
        ([], 3, 15, []),
    ],
)
def test_smooth(sizes, b, cap, want):
    assert smooth(sizes, b, cap, 0.2) == want


@pytest.mark.parametrize(
    ("sizes", "floor", "want"),
    [
        ([4, 5, 6, 7, 8, 8, 2], even_floor, [4, 4, 6, 6, 8, 8, 4]),
        ([3], even_floor, [2, 1]),
        ([5], even_floor, [4, 1]),
        ([3, 4, 5, 5, 3], even_floor, [2, 4, 4, 4, 4, 2]),
        ([32, 38, 44, 50, 56, 30], friendly_floor, [32, 32, 32, 48, 48, 48, 10]),
        ([10, 12, 14, 9], friendly_floor, [8, 12, 12, 12, 1]),
        ([], even_floor, []),
    ],
)
def test_round(sizes, floor, want):
    assert round_sizes(sizes, floor) == want


@given(st.lists(st.integers(1, 40), max_size=30), st.integers(1, 20), st.sampled_from([1.0, 1.5, 2.0, 5.0]))
def test_folds_keep_rows(sizes, b, wide):
    cap = size_cap(b, wide)
    out = smooth(sizes, b, cap, 0.2)
    assert sum(out) == sum(sizes) and all(x <= cap for x in out)
    step = growth_step(b, cap, 0.2)
    assert all(y - x <= max(step, 0) for x, y in zip(out, out[1:], strict=False))
    for f in (even_floor, friendly_floor):
        assert sum(round_sizes(sizes, f)) == sum(sizes) and all(0 < x <= max(sizes) for x in round_sizes(sizes, f))


@given(st.lists(st.integers(0, 60), max_size=120), st.integers(1, 9), st.sampled_from([1.0, 2.0, 3.0]), st.sampled_from(["token_sum", "padded_area", "constant:0", "constant:2"]))
def test_walk(token, b, wide, pressure):
    t = np.sort(np.array(token, np.int64))[::-1]
    config = PlanConfig(batch_size=b, max_range=wide, pressure=pressure)
    sizes = walk(t, t, 5 * t, config)
    assert sum(sizes) == len(t) and (not sizes or sizes[0] == min(b, len(t)))
    naive, at, grid = ([min(b, len(t))] if len(t) else []), min(b, len(t)), candidate_grid(b, wide)
    while at < len(t):
        base = {"token_sum": t[:b].sum(), "padded_area": b * t[0]}.get(pressure, 1)
        found = [{"token_sum": t[at : at + c].sum(), "padded_area": c * t[at]}.get(pressure, float(pressure.split(":")[-1]) if ":" in pressure else 0) / base if base else 0 for c in grid]
        naive.append(int(min(max((c for c, f in zip(grid, found, strict=True) if f <= 0.9), default=b), len(t) - at)))
        at += naive[-1]
    assert sizes == naive
    final = stages(t, t, t, config)["final"]
    assert sum(final) == len(t)


def test_range_one_is_fixed_size():
    t = np.arange(50, 0, -1)
    dynamic = stages(t, t, t, PlanConfig(batch_size=8, max_range=1.0, even=False))["final"]
    assert dynamic == stages(t, t, t, PlanConfig(batch_size=8, dynamic=False))["final"] == [8] * 6 + [2]


def test_growth_with_the_stub_and_a_model():
    t = np.arange(100, 0, -1)
    assert max(walk(t, t, t, PlanConfig(batch_size=4, pressure="constant:0"))) == 8
    assert walk(t, t, t, PlanConfig(batch_size=4, pressure=lambda f, base: f.token_sum_y / base["token_sum"])) == walk(t, t, t, PlanConfig(batch_size=4))


def test_budget_sizes():
    token = sorted(range(5, 60), reverse=True)
    plain = budget_sizes(token, 4)
    assert sum(s for s, bad in plain if not bad) == len(token) and not any(bad for _, bad in plain)
    assert budget_sizes(token, 4, 0.5, 3) == budget_sizes(token, 4, 0.5, 3)
    hard = budget_sizes(token, 4, fails=lambda size, longest: size * longest > 120)
    assert sum(s for s, bad in hard if not bad) == len(token) and any(bad for _, bad in hard)
    assert budget_sizes([9, 9], 1, fails=lambda size, longest: True) == [(1, True), (1, True)]
