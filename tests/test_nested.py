"""Validation from sums of groups against fits on copied rows."""
import random

import numpy as np
import pytest

from telltale.operators import nested

CANDIDATES = {"mean": ([], 0.0), "a": (["a"], 1.0), "ab": (["a", "b"], 5.0), "abc": (["c", "a", "b"], 0.0), "flat": (["flat"], 1.0)}


def slow_error(rows, out, held, used, penalty):
    """Ridge on standardised features of the rows outside `out`, scored on the rows of `held`."""
    train = [r for r in rows if r["g"] not in out]
    y = np.array([r["y"] for r in train])
    x = np.array([[r[f] for f in used] for r in train]).reshape(len(train), len(used))
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-12] = np.inf
    z = (x - mean) / sd
    w = np.linalg.lstsq(np.vstack([z, np.sqrt(penalty) * np.eye(len(used))]), np.concatenate([y - y.mean(), np.zeros(len(used))]), rcond=None)[0]
    return np.mean([(r["y"] - y.mean() - ((np.array([r[f] for f in used]) - mean) / sd) @ w) ** 2 for r in rows if r["g"] == held])


def rows_of(groups, seed):
    draw = random.Random(seed)
    out = []
    for g in range(groups):
        slope = draw.uniform(-1, 3)
        for _ in range(draw.randrange(1, 9)):
            a, b = draw.gauss(5, 2), draw.gauss(-1, 1)
            out.append({"g": f"g{g}", "a": a, "b": b, "c": draw.random(), "flat": 7.0, "y": 1000 + slope * a - b + draw.gauss(0, 1)})
    return out


@pytest.mark.parametrize("block", [2, 256])
def test_nested_choice_equals_repeated_fits(spark, block):
    rows = rows_of(9, 3)
    df = spark.createDataFrame(rows + [rows[0] | {"a": None}, rows[0] | {"y": float("nan")}, rows[0] | {"g": None}])
    groups = sorted({r["g"] for r in rows})
    got = {r["g"]: r for r in nested.nested_choice(df, "g", "y", CANDIDATES, block).collect()}
    assert sorted(got) == groups
    for g in groups:
        inner = {name: np.mean([slow_error(rows, {g, h}, h, *c) for h in groups if h != g]) for name, c in CANDIDATES.items()}
        best = min(inner, key=lambda n: (round(inner[n], 9), list(CANDIDATES).index(n)))
        assert got[g]["selected"] == best and abs(got[g]["inner_error"] - inner[best]) < 1e-6
        assert abs(got[g]["error"] - slow_error(rows, {g}, g, *CANDIDATES[best])) < 1e-6


def test_left_out_errors_equal_repeated_fits(spark):
    rows = rows_of(6, 8)
    got = nested.left_out_errors(spark.createDataFrame(rows), "g", "y", CANDIDATES).collect()
    assert len(got) == 6 * len(CANDIDATES)
    for r in got:
        assert abs(r["error"] - slow_error(rows, {r["g"]}, r["g"], *CANDIDATES[r["name"]])) < 1e-6
        assert r["rows"] == sum(x["g"] == r["g"] for x in rows)


def test_thousands_of_groups_in_one_job(spark):
    df = spark.range(12000).selectExpr("id % 3000 AS g", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS b", "CAST(2 * (id % 7) + id % 5 AS DOUBLE) AS y")
    rows = nested.nested_choice(df, "g", "y", {"mean": ([], 0.0), "a": (["a"], 1.0), "b": (["b"], 1.0)}).collect()
    assert len(rows) == 3000 and {r["selected"] for r in rows} == {"a"}


def test_few_groups_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0)], "g int, a double, y double")
    with pytest.raises(ValueError):
        nested.nested_choice(df, "g", "y", {"a": (["a"], 1.0)})
    one = df.where("g = 1")
    assert nested.left_out_errors(one, "g", "y", {"a": (["a"], 1.0)}).count() == 0
    assert nested.left_out_errors(one.where("false"), "g", "y", {"a": (["a"], 1.0)}).count() == 0


def test_pairs_on_tiles_equal_single_fits():
    rows = rows_of(7, 5)
    features = ["a", "flat"]
    names = sorted({r["g"] for r in rows})
    v = {g: np.array([[r[f] for f in (*features, "y")] for r in rows if r["g"] == g]) - [5, 7, 1000] for g in names}
    s = np.array([[len(x), *x.sum(axis=0), *(x.T @ x)[np.triu_indices(3)]] for x in v.values()])
    for used, penalty in (([], 0.0), ([0], 1.0), ([1], 1.0), ([0, 1], 2.0)):
        right, left = nested._pair_errors(s[:4], s[4:], s.sum(axis=0), 3, used, penalty, None)
        for i in range(4):
            for j in range(3):
                want = [slow_error(rows, {names[i], names[4 + j]}, g, [features[k] for k in used], penalty) for g in (names[4 + j], names[i])]
                assert np.allclose([right[i, j], left[i, j]], want)
