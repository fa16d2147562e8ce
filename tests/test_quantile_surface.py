"""The fitted quantile surface, and the reports on it, against brute force: SQL has no quantile regression."""

import itertools

import numpy as np
import pytest

from tidemark.operators import quantreg
from tidemark.plans import reports, views

SF = "/root/testdata/sf0.001"


def test_pinball_loss_is_that_of_the_best_plane_through_three_rows(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random(30), 4 + 3 * rng.random(30)
    y = 2 + 3 * a + 0.5 * b + rng.exponential(2, 30)
    rows = [(2.0, *map(float, x)) for x in zip(y, a, b, strict=True)]
    df = spark.createDataFrame([*rows, (9.0, 1.0, 1.0, 1.0), (2.0, None, 1.0, 1.0)], "lead_h double, error_km double, diff_init double, lat_init double")
    got = {(r.lead_h, r.q): (r.b0, r.b_speed, r.b_lat) for r in quantreg.surface(df, bins=3, quantiles=(0.3, 0.9)).collect()}
    x = np.stack([np.ones(30), a, b], axis=1)

    def loss(c, q):
        left = y - x @ np.asarray(c)
        return np.maximum(q * left, (q - 1) * left).sum()

    for q in (0.3, 0.9):
        # some best plane goes through three of the rows
        best = min(loss(np.linalg.solve(x[list(k)], y[list(k)]), q) for k in itertools.combinations(range(30), 3))
        assert loss(got[4.0, q], q) <= best * 1.001
        assert got[8.0, q] == got[12.0, q] == (None, None, None)  # no row; one row


def test_reports_on_the_fitted_surface(spark):
    fixes = views.fixes(spark, SF)
    table = quantreg.surface(reports.errors(fixes), passes=10).toPandas()
    made = spark.createDataFrame(table)
    known = table.dropna().sort_values("lead_h")
    assert len(known) >= 9
    runs = {(r.buoy_id, str(r.day), r.fix_id): r for r in reports.errors(fixes).collect()}
    cones = reports._cones(fixes, lambda _: made).dropna().collect()
    assert len(cones) == 9 * len(runs)
    planes = {q: g for q, g in known.groupby("q")}
    for c in cones:
        r, g = runs[c.buoy_id, c.start_day, c.fix_id], planes[c.q]
        x = g["lead_h"].to_numpy()
        k = int(np.clip(np.searchsorted(x, r.lead_h, side="right") - 1, 0, len(x) - 2))
        t = (r.lead_h - x[k]) / (x[k + 1] - x[k])
        b0, b1, b2 = ((1 - t) * g[n].to_numpy()[k] + t * g[n].to_numpy()[k + 1] for n in ("b0", "b_speed", "b_lat"))
        assert c.radius_km == pytest.approx(max(b0 + b1 * r.diff_init + b2 * r.lat_init, 0.01), rel=1e-6, abs=1e-6)
    plane = known[(known["lead_h"] == 72) & (known["q"] == 0.7)].iloc[0]
    for r in reports._surface_check(fixes, lambda _: made).dropna(subset=["x", "y"]).collect():
        assert r.predicted == pytest.approx(plane["b0"] + plane["b_speed"] * r.x + plane["b_lat"] * r.y)
