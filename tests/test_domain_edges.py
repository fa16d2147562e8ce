"""A polygon's boundary is outside the domain, as a box's is."""

from datetime import datetime, timedelta

from tidemark.operators import tracks


def runs(spark, points, **domain):
    start = datetime(2024, 1, 1)
    rows = [(1, i, start + timedelta(hours=i), x, y) for i, (x, y) in enumerate(points)]
    fixes = spark.createDataFrame(rows, "buoy_id long, fix_id long, ts timestamp, lon double, lat double")
    return sorted((r.fix_id, r.run, r.run_len) for r in tracks.domain_runs(fixes, **domain).collect())


def test_fixes_on_every_side_and_vertex_of_a_box(spark):
    edge = [(-163.75, 6.0), (-160.6667, 6.0), (-162.0, 4.5), (-162.0, 7.75), (-163.75, 4.5), (-160.6667, 4.5), (-160.6667, 7.75), (-163.75, 7.75)]
    points = [p for e in edge for p in ((-162.0, 6.0), (-162.0, 6.1), e)] + [(-162.0, None)]
    box = (-163.75, -160.6667, 4.5, 7.75)
    ring = [(box[0], box[2]), (box[1], box[2]), (box[1], box[3]), (box[0], box[3])]
    want = [(3 * i + k, i + 1, 2) for i in range(len(edge)) for k in (0, 1)]
    assert runs(spark, points, box=box) == want
    assert runs(spark, points, polygon=ring) == want
    assert runs(spark, points, polygon=ring[::-1]) == want


def test_fixes_on_slanted_sides(spark):
    diamond = [(0.0, -1.0), (1.0, 0.0), (0.0, 1.0), (-1.0, 0.0)]
    points = [(0.0, 0.0), (0.25, 0.25), (-0.5, -0.5), (0.0, 0.0), (0.1, 0.0), (0.5, 0.5), (0.0, 0.0), (-0.25, 0.5), (-0.5, 0.5)]
    assert runs(spark, points, polygon=diamond) == [(0, 1, 2), (1, 1, 2), (3, 2, 2), (4, 2, 2), (6, 3, 2), (7, 3, 2)]
