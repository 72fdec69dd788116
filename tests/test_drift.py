"""States of runs, added up, against counting all rows."""

import numpy as np
import pytest

from tributary.operators import drift as d
from tributary.operators.aggregates import population_stability


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(5, 2, 30_000), rng.exponential(9, 20_000)])
    rng.shuffle(x)
    return x


def frame(spark, x, start=0):
    rows = [(start + i, None if (start + i) % 17 == 0 else float(v), float("nan") if i % 5 == 0 else 1e9 + i % 3) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x double, big double").repartition(6)


def test_added_states_equal_a_recount(spark, values, tmp_path):
    root = str(tmp_path / "state")
    parts = [values[:1_000], values[1_000:30_000], values[30_000:]]
    for i, part in enumerate(parts):
        d.write_state(frame(spark, part, 100_000 * i), root, f"day-{i}", ["x", "big"])
    d.write_state(frame(spark, parts[1], 100_000), root, "day-1", ["x", "big"])  # again, and counted once
    found = {r["column"]: r for r in d.state_statistics(d.read_state(spark, root)).collect()}
    whole = {"x": [], "big": []}
    for i, part in enumerate(parts):
        for r in frame(spark, part, 100_000 * i).collect():
            whole["x"].append(np.nan if r["x"] is None else r["x"])
            whole["big"].append(r["big"])
    for c, v in whole.items():
        v = np.array(v)
        known = v[~np.isnan(v)]
        r = found[c]
        assert (r["n"], r["n_null"], r["minimum"], r["maximum"]) == (len(known), len(v) - len(known), known.min(), known.max())
        assert r["mean"] == pytest.approx(known.mean()) and r["std"] == pytest.approx(known.std(ddof=1))
        for q in (25, 50, 75):
            low, high = (known < r[f"q{q}"]).mean(), (known <= r[f"q{q}"]).mean()
            assert low - d.RANK_ERROR <= q / 100 <= high + d.RANK_ERROR
    one = {r["column"]: r["n"] for r in d.read_state(spark, root, ["day-0"]).collect()}
    assert one["x"] == 1_000 - len([i for i in range(1_000) if i % 17 == 0])
    with pytest.raises(ValueError):
        d.read_state(spark, root, ["day-9"])
    with pytest.raises(ValueError):
        d.write_state(frame(spark, parts[0]), root, "a/b")


def test_stability_of_states_is_near_that_of_rows(spark, values, tmp_path):
    a, b = frame(spark, values[:25_000]), frame(spark, values[25_000:] * 1.3 + 1)
    exact = population_stability(a, b, ["x"]).first()["psi"]
    found = d.state_stability(d.column_state(a, ["x"]), d.column_state(b, ["x"])).first()["psi"]
    assert exact > 0.05 and found == pytest.approx(exact, rel=0.05)
    same = d.state_stability(d.column_state(a, ["x"]), d.column_state(a.repartition(3), ["x"])).first()["psi"]
    assert same < 1e-3


def test_columns_without_values(spark):
    empty = spark.createDataFrame([(1, None), (2, None)], "id long, x double")
    state = d.column_state(empty, ["x"])
    row = d.state_statistics(state).first()
    assert (row["n"], row["n_null"], row["mean"], row["q50"]) == (0, 2, None, None)
    assert d.state_stability(state, state).first()["psi"] == 0.0
    assert d.column_state(empty.limit(0), ["x"]).count() == 0
