"""Sketches against exact percentiles: error, merging, deletion, odd input."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import percentiles as p


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**62), min_size=1, max_size=50))
def test_codes_keep_order_and_value(values):
    v = np.sort(np.array(values, np.int64))
    codes = p.encode(v)
    assert (np.diff(codes) >= 0).all() and codes.max() < 1 << p.CODE_BITS
    back = p.decode(codes)
    assert (np.abs(back - v) <= np.maximum(0.5, v * 2.0 ** -(p.BITS + 1) * 1.001)).all()


def frame(spark, rows):
    return spark.createDataFrame(rows, "model string, day int, latency long, ttft long, weight long").selectExpr("*", "'x' as metric", "1 as cells")


KEYS = ["model"]


def state(sketch):
    """All that a sketch holds, at the resolution that is exact."""
    return sketch.level, dict(zip(sketch.nodes.tolist(), sketch.weights.tolist(), strict=True)), dict(zip(sketch.atoms.tolist(), sketch.atom_weights.tolist(), strict=True)), [c.tolist() for c in sketch.cells]


def exact_rank(values, v):
    a = np.sort(np.array(values))
    return np.searchsorted(a, v * (1 - 1e-3) - 1) / len(a), np.searchsorted(a, v * (1 + 1e-3) + 1, side="right") / len(a)


def test_percentiles_within_the_stated_bound(spark):
    rng = np.random.default_rng(3)
    rows = [(m, int(d), int(v), None if i % 5 == 0 else 0, 1) for m, scale in (("a", 9), ("b", 5)) for i, (d, v) in enumerate(zip(rng.integers(1, 4, 3000), rng.lognormal(scale, 1, 3000), strict=True))]
    rows += [("a", 1, -1, 0, 1), ("a", 1, None, None, 1), (None, 2, 7, 7, 1)]
    parts = p.sketches(frame(spark, rows), [*KEYS, "day"], {"latency": 0, "ttft": 1})
    out = p.percentiles(parts, KEYS, over="day").collect()
    assert {(r["model"], r["metric"], r["scope"]) for r in out} == {(m, "latency", s) for m in ("a", "b") for s in ("day", "all")} | {(None, x, s) for x in ("latency", "ttft") for s in ("day", "all")}
    for r in out:
        values = [v for m, d, v, _, _ in rows if m == r["model"] and v is not None and v >= 0 and (r["scope"] == "all" or d == r["day"])] if r["metric"] == "latency" else [7]
        assert r["n"] == len(values)
        for q, name in zip(p.QUANTILES, ("p50", "p90", "p95", "p99"), strict=True):
            low, high = exact_rank(values, r[name])
            assert low - r["rank_error"] - 1 / len(values) <= q <= high + r["rank_error"] + 1 / len(values)


def test_merging_equals_sketching_at_once_and_deletion_undoes(spark):
    rows = [("a", i % 3, i * 13 % 997, 1, 1) for i in range(500)]
    metrics = {"latency": 0}
    whole = p.sketches(frame(spark, rows), KEYS, metrics, "weight")
    days = p.sketches(frame(spark, rows), [*KEYS, "day"], metrics, "weight")
    cells = lambda df: state(p.Sketch.unpack(df.first()["cells"]))
    assert cells(whole) == cells(p.merged(days, KEYS))
    more = [("a", 9, 10**9, 1, 1)] * 40
    undone = p.sketches(frame(spark, rows + more + [(m, d, v, t, -1) for m, d, v, t, _ in more]), KEYS, metrics, "weight")
    assert cells(whole) == cells(undone)
    gone = p.sketches(frame(spark, more + [(m, d, v, t, -1) for m, d, v, t, _ in more]), KEYS, metrics, "weight")
    assert p.percentiles(gone, KEYS).count() == 0


def test_constant_single_and_empty(spark):
    out = {r["model"]: r for r in p.percentiles(p.sketches(frame(spark, [("c", 1, 150, 1, 1)] * 100 + [("s", 1, 2**40, 1, 1)]), KEYS, {"latency": 0}), KEYS).collect()}
    assert out["c"]["p50"] == out["c"]["p99"] == 150 and abs(out["s"]["p50"] / 2**40 - 1) < 2.0**-12
    assert p.sketches(frame(spark, [("a", 1, None, None, 1)]), KEYS, {"latency": 0}).count() == 0
    assert p.percentiles(p.sketches(frame(spark, []), KEYS, {"latency": 0}), KEYS).count() == 0


@pytest.mark.parametrize("rows", [3, 100])
def test_chunks_of_a_task_add_up(spark, monkeypatch, rows):
    monkeypatch.setattr(p, "CHUNK_ROWS", rows)
    df = frame(spark, [("a", 1, i % 10, 1, 1) for i in range(200)]).coalesce(1)
    assert p.percentiles(p.sketches(df, KEYS, {"latency": 0}), KEYS).first()["n"] == 200


SHAPES = {
    "ties": lambda g, n: g.integers(0, 40, n) * 100,
    "constant": lambda g, n: np.full(n, 777),
    "tail": lambda g, n: np.floor(g.lognormal(7, 2, n)),
    "capped": lambda g, n: np.minimum(np.floor(g.lognormal(8, 1, n)), 6000),
    "wide": lambda g, n: g.integers(0, 2**40, n),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("n", [900, 5000, 60000])
def test_bound_holds_and_is_narrow(shape, n):
    """Ten parts are sketched apart and added up; the bound is nought where all is exact and below 2 % elsewhere."""
    rng = np.random.default_rng(n)
    values = SHAPES[shape](rng, n).astype(np.int64)
    total = None
    for part in np.array_split(values, 10):
        own = p.Sketch.unpack(p.Sketch(p.encode(part), np.ones(len(part), np.int64)).pack())
        total = own if total is None else total.add(own)
    count, found, bound = total.quantiles(p.QUANTILES)
    assert count == n and bound < 0.02 and (bound == 0 or total.level > 0)
    codes = np.sort(p.encode(values))
    for q, v in zip(p.QUANTILES, found, strict=True):
        code = int(p.encode(np.array([round(v)]))[0])
        low, high = np.searchsorted(codes, code) / n, np.searchsorted(codes, code, side="right") / n
        assert low - bound - 1 / n <= q <= high + bound + 1 / n


def test_sums_do_not_depend_on_the_order_of_parts():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 14, 700) for _ in range(8)]
    make = lambda: [p.Sketch(x, np.ones(len(x), np.int64)) for x in parts]
    forth, back = make(), make()[::-1]
    for many in (forth, back):
        for other in many[1:]:
            many[0].add(other)
    a, b = forth[0], back[0]
    assert a.quantiles((0.5,))[0] == b.quantiles((0.5,))[0] == 5600 and abs(a.level - b.level) <= 1
