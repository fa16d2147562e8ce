"""Mapping between uneven axes against plain Python, with the axes broadcast and joined."""

import bisect
import itertools
import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import regrid

START = datetime(2024, 1, 1)


def plain(point, nodes, axes):
    """Multilinear value of a point, None outside or beside a missing node."""
    low, shares = [], []
    for x, axis in zip(point, axes, strict=True):
        if x is None or not axis[0] <= x <= axis[-1]:
            return None
        if len(axis) == 1:
            low.append((axis[0], axis[0]))
            shares.append(0.0)
            continue
        i = min(bisect.bisect_right(axis, x), len(axis) - 1) - 1
        low.append((axis[i], axis[i + 1]))
        shares.append((x - axis[i]) / (axis[i + 1] - axis[i]))
    total = 0.0
    for corner in itertools.product((0, 1), repeat=len(axes)):
        value = nodes.get(tuple(pair[c] for pair, c in zip(low, corner, strict=True)))
        if value is None:
            return None
        weight = 1.0
        for c, f in zip(corner, shares, strict=True):
            weight *= f if c else 1 - f
        total += weight * value
    return total


AXES = {"a": ([0.0, 3600.0, 90000.0], [0.5, 5.0, 30.0, 200.0], [4.0, 4.1, 5.7, 6.0, 9.0], [-164.0, -163.5, -160.0]), "b": ([0.0, 86400.0], [10.0], [3.0, 8.0], [-165.0, -161.0, -160.5, -160.4])}


def made(seed, empty):
    rng = random.Random(seed)
    nodes = {p: {c: rng.uniform(-1, 1) for c in itertools.product(*axes)} for p, axes in AXES.items()}
    for p in nodes:
        for c in rng.sample(sorted(nodes[p]), empty):
            nodes[p][c] = None if rng.random() < 0.5 else nodes[p].pop(c)
            if rng.random() < 0.5:
                nodes[p].pop(c, None)
    return nodes


@pytest.mark.parametrize("most", [regrid.MOST_VALUES, 0])
def test_two_grids_of_four_uneven_axes(spark, most, monkeypatch):
    monkeypatch.setattr(regrid, "COARSE", 2)
    nodes = made(1, 4)
    rows = [(p, START + timedelta(seconds=c[0]), *c[1:], v) for p in nodes for c, v in nodes[p].items()]
    field = spark.createDataFrame(rows, "product string, time timestamp, depth double, lat double, lon double, w double").repartition(5)
    rng = random.Random(2)
    points = []
    for i in range(400):
        p = rng.choice("ab")
        at = [rng.choice(axis) if rng.random() < 0.3 else rng.uniform(axis[0] - 0.1 * (axis[-1] - axis[0]), axis[-1] * 1.02) for axis in AXES[p]]
        at[0] = round(at[0])
        points.append((i, p, *at))
    points += [(400, "a", None, 5.0, 5.0, -161.0), (401, "a", 0, None, 5.0, -161.0), (402, "c", 0, 5.0, 5.0, -161.0), (403, "b", 86400, 10.0, 8.0, -160.4), (404, None, 0, 5.0, 5.0, -161.0)]
    df = spark.createDataFrame([(i, p, None if t is None else START + timedelta(seconds=t), z, y, x, 7) for i, p, t, z, y, x in points], "id long, product string, ts timestamp, z double, y double, x double, _keep int")
    got = regrid.at_points(df, field, {"time": "ts", "depth": "z", "lat": "y", "lon": "x"}, ["product"], ["w"], most_values=most)
    assert got.columns == [*df.columns, "mapped_w"]
    values = {r.id: r.mapped_w for r in got.collect()}
    assert len(values) == len(points)
    found = 0
    for i, p, *at in points:
        axes = [sorted({c[k] for c in nodes[p]}) for k in range(4)] if p in nodes else [[0]] * 4
        want = plain(at, nodes.get(p, {}), axes)
        assert (values[i] is None) == (want is None), (i, p, at)
        if want is not None:
            assert abs(values[i] - want) < 1e-9
            found += 1
    assert found > 50


@pytest.mark.parametrize("most", [regrid.MOST_VALUES, 0])
def test_one_long_axis_and_no_field(spark, most):
    axis = [i**1.7 for i in range(3000)]
    field = spark.createDataFrame([(x, (i * 37 % 101) / 8.0) for i, x in enumerate(axis)], "x double, w double")
    points = spark.range(2000).selectExpr("id", "cast(id * id / 5.0 - 3 as double) as x")
    got = {r.id: r for r in regrid.at_points(points, field, {"x": "x"}, values=["w"], most_values=most).collect()}
    nodes = {(x,): (i * 37 % 101) / 8.0 for i, x in enumerate(axis)}
    for r in got.values():
        want = plain([r.x], nodes, [axis])
        assert r.mapped_w is None if want is None else abs(r.mapped_w - want) < 1e-9
    assert regrid.at_points(points, field.limit(0), {"x": "x"}, values=["w"], most_values=most).where("mapped_w is not null").count() == 0
