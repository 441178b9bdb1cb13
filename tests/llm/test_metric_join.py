"""The metric range join of vectors against a brute-force version."""
import math

import numpy as np
import pytest

from barlake.llm import metric_join

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)), None)
    good = list(good)
    unit = [np.array(v) / np.abs(v).max() for _, v in good]
    unit = [u / np.sqrt(u @ u) for u in unit]
    links = {k: set() for k in range(len(good))}
    for a in links:
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[a].add(b)
                links[b].add(a)
    lowest = {}
    for k in sorted(links, key=lambda k: good[k][0]):
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in lowest:
                lowest[x] = good[k][0]
                todo += links[x]
    at = {g: k for k, g in enumerate(good)}
    out = []
    for i, v in rows:
        k = at.get((i, tuple(v))) if v else None
        if k is None:
            out.append((i, 0, i, i is not None))
        else:
            out.append((i, len(links[k]), lowest[k], lowest[k] == i))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "'x' AS id", "1 AS cls", "2 AS w", "3 AS home", "4 AS key")
    return metric_join.near_vectors(df, **options).collect()


def fixture(dim=16):
    rng = np.random.default_rng(3)
    vectors = [*rng.normal(size=(150, dim))]
    for spread, n in ((0.05, 60), (0.12, 60), (0.2, 60)):  # groups inside, across and beyond a ball
        vectors += [*(rng.normal(size=dim) + spread * rng.normal(size=(n, dim)))]
    steps = np.linspace(0, 3, 25)  # a chain along a circle
    vectors += [np.r_[math.cos(t), math.sin(t), np.zeros(dim - 2)] * 10.0 ** (k % 7 - 3) for k, t in enumerate(steps)]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(vectors)) * 3, vectors)]
    copy = rows[170][1]
    rows += [(5000 + k, copy) for k in range(40)] + [(6000 + k, [2 * x for x in copy]) for k in range(5)]
    rows += [rows[0], rows[180], rows[180], (7000, None), (7001, []), (7002, [0.0] * dim), (7003, [1.0, None] * (dim // 2)),
             (7004, [float("nan")] * dim), (7005, [float("inf")] * dim), (7006, [1.0, 2.0]), (7007, [1.0, 2.1]), (None, copy), (None, None),
             (7008, [1e-300] * dim), (7009, [1e300] * dim), (7010, [-0.0] + copy[1:]), (7011, [0.0] + copy[1:])]
    return rows


@pytest.mark.parametrize("options", [{}, {"cell_rows": 20, "block_bytes": 1600, "visit_rows": 40}])
def test_links_match_brute_force(spark, options):
    rows = fixture()
    assert order(found(spark, rows, **options)) == order(brute(rows))


def test_no_dense_sample(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "SAMPLE", 8)  # cells from few vectors, no balls, lengths without a pivot
    rows = fixture()
    assert order(found(spark, rows, cell_rows=50)) == order(brute(rows))


def test_empty_and_unlinkable_tables(spark):
    assert found(spark, []) == []
    rows = [(1, None), (2, [0.0]), (None, None)]
    assert order(found(spark, rows)) == order(brute(rows))


def test_a_ball_is_counted_not_compared(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=64) + 0.15 * rng.normal(size=(300, 64))
    df = spark.createDataFrame([(k, [float(x) for x in v], 0) for k, v in enumerate(vectors)], SCHEMA)
    _, classes = metric_join.classes(df)
    homed, parts, balls = metric_join.metric_links(classes)
    inside = homed.join(balls, homed["home"] == balls["ball"]).count()
    assert inside > 280 and parts.where("b is not null").count() <= 2 * (300 - inside)
