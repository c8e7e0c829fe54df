import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import position
from wakeline.operators import zones
from wakeline.sources import dimensions

SHAPES = "name string, rings array<array<array<double>>>"


def strictly_inside(x, y, rings):
    odd = False
    for ring in rings:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        for (x1, y1), (x2, y2) in zip(closed, closed[1:]):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [1.0, 3.0], [3.0, 3.0], [3.0, 1.0], [1.0, 1.0]]
STAR = [[10.0, 0.5], [11.0, 3.0], [13.5, 3.25], [11.5, 5.0], [12.0, 8.0], [10.0, 6.0], [8.0, 8.125], [8.5, 5.0], [6.5, 3.5], [9.0, 3.0]]  # open
ALL = [("square", [SQUARE, HOLE]), ("star", [STAR]), ("strip", [[[-1.0, 2.0], [9.0, 2.0], [9.0, 2.5], [-1.0, 2.5], [-1.0, 2.0]]]),
       ("flat", [[[5.0, 5.0], [6.0, 6.0], [5.0, 5.0]]]), ("nothing", []), ("none", None), ("tiny", [[[2.0, 5.0], [2.0 + 2**-20, 5.0], [2.0, 5.0 + 2**-20]]])]


@pytest.mark.parametrize("per_side", [1, 7, 64])
def test_containment_equals_the_even_odd_rule(spark, per_side):
    r = random.Random(3)
    points = [(r.uniform(-2, 14), r.uniform(-1, 9)) for _ in range(1500)] + [(r.randint(-2, 28) / 2, r.randint(-2, 18) / 2) for _ in range(500)]
    points += [tuple(p) for _, rings in ALL for ring in rings or [] for p in ring] + [(2.0 + 2**-22, 5.0 + 2**-22)]
    rows = [{"id": i, "Longitude": x, "Latitude": y} for i, (x, y) in enumerate(points)]
    rows += [{"id": 90001, "Longitude": float("nan"), "Latitude": 2.25}, {"id": 90002, "Latitude": 2.25}, {"id": 90003, "Longitude": 2.0}]
    table = spark.createDataFrame(ALL, SHAPES)
    got = zones.in_zones(position(spark, rows).withColumn("zone", F.lit("old")), table, per_side=per_side)
    assert got.columns == [*position(spark, []).columns, "zone"]
    want = sorted((i, name) for i, (x, y) in enumerate(points) for name, rings in ALL if name != "flat" and rings and strictly_inside(x, y, rings))
    assert sorted((r.id, r.zone) for r in got.collect()) == want


def test_a_crowded_cell_and_quiet_ones(spark):
    rows = [{"id": i, "Longitude": 0.5 + i * 1e-6, "Latitude": 0.5} for i in range(900)]
    rows += [{"id": 1000 + i, "Longitude": 0.1 + (i % 20) / 5, "Latitude": 0.1 + i // 20 / 5} for i in range(400)]
    got = zones.in_zones(position(spark, rows), spark.createDataFrame(ALL[:1], SHAPES))
    want = sorted(r["id"] for r in rows if strictly_inside(r["Longitude"], r["Latitude"], ALL[0][1]))
    assert sorted(r.id for r in got.collect()) == want


def test_inner_cells_need_no_test_and_edge_cells_keep_few_edges(spark):
    cells = zones.cover(spark.createDataFrame(ALL[:1], SHAPES)).collect()
    inner = [c for c in cells if c.inner]
    assert len(inner) > 0.8 * len(cells) and all(c.edges is None for c in inner)
    assert len(cells) <= 66 * 66 and max(len(c.edges) for c in cells if not c.inner) <= 8


def test_no_zones_and_no_reports(spark):
    some = position(spark, [{"id": 1, "Longitude": 1.0, "Latitude": 1.0}])
    assert zones.in_zones(some, spark.createDataFrame([], SHAPES)).count() == 0
    assert zones.in_zones(some.limit(0), spark.createDataFrame(ALL, SHAPES)).count() == 0


def test_the_ports_hold_their_own_middle(spark):
    ports = dimensions.port_zones(spark)
    assert ports.count() == 3
    rows = [{"id": 1, "Longitude": 13.5060, "Latitude": 43.6165}, {"id": 2, "Longitude": 13.0, "Latitude": 43.0}]
    rings = {r.name: r.rings for r in ports.collect()}
    want = {(r["id"], name) for r in rows for name, shape in rings.items() if strictly_inside(r["Longitude"], r["Latitude"], shape)}
    assert {(r.id, r.zone) for r in zones.in_zones(position(spark, rows), ports).collect()} == want
