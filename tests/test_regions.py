"""Least rectangles, label anchors and coarse registration against closed forms and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomflux.operators import regions

RING = "id long, ring array<struct<x:double,y:double>>"


def bent(w, h):
    return [(0.0, 0.0), (w, 0.0), (w, h / 2), (w / 2, h / 2), (w / 2, h), (0.0, h)]


def turned(ring, angle):
    c, s = math.cos(angle), math.sin(angle)
    return [(x * c - y * s, x * s + y * c) for x, y in ring]


def test_label_anchors_reach_the_widest_circle(spark):
    sizes = [(5.0, 4.0), (9.0, 3.0), (3.0, 9.0), (20.0, 7.0), (6.0, 6.0)]
    rows = [(k, turned(bent(*s), 0.3)) for k, s in enumerate(sizes)] + [(100, None), (101, []), (102, [(1.0, 1.0), (1.0, 1.0)])]
    got = {r["id"]: r["room"] for r in regions.label_anchors(spark.createDataFrame(rows, RING), 0.02).collect()}
    assert set(got) == set(range(len(sizes)))
    for k, (w, h) in enumerate(sizes):
        best = min(w / 2, h / 2, (w + h - math.sqrt(2 * w * h)) / 2)
        assert best - 0.0201 <= got[k] <= best + 1e-9


def test_least_rectangles_are_no_larger_than_any_turn(spark):
    rng = np.random.default_rng(1)
    rings = [[tuple(map(float, p)) for p in rng.uniform(-5, 5, (int(rng.integers(3, 9)), 2))] for _ in range(20)]
    rows = list(enumerate(rings)) + [(100, None), (101, []), (102, [(1.0, 1.0), (1.0, 1.0)])]
    got = {r["id"]: r for r in regions.least_rectangles(spark.createDataFrame(rows, RING)).collect()}
    assert set(got) == set(range(20))
    for k, ring in enumerate(rings):
        p = np.array(ring)
        areas = []
        for a in np.radians(np.arange(0, 90, 0.05)):
            areas.append(np.ptp(p @ [math.cos(a), math.sin(a)]) * np.ptp(p @ [-math.sin(a), math.cos(a)]))
        area = got[k]["longer"] * got[k]["shorter"]
        assert min(areas) * 0.98 - 0.1 <= area <= min(areas) * 1.001 + 0.1
        assert -90 < got[k]["angle"] <= 90


@pytest.mark.parametrize(("flip", "angle"), [(1, 0.0), (1, 75.0), (-1, 200.0)])
def test_coarse_registration_finds_the_turn(spark, flip, angle):
    rng = np.random.default_rng(2)
    walls = np.concatenate([np.column_stack([np.linspace(a, b, 200), np.full(200, c)])[:, :: 1 if k % 2 else -1] for k, (a, b, c) in enumerate([(0, 40, 0), (0, 25, 40), (3, 40, 12), (5, 17, 22), (0, 9, 31)])])
    walls += rng.normal(0, 0.02, walls.shape)
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    home = walls @ np.array([[c, -s], [s, c]]) * [1, flip]  # the inverse turn, then the flip
    moving = spark.createDataFrame([tuple(map(float, p)) for p in home + [0.0, 0.0]] + [(None, 1.0)], "x double, y double")
    fixed = spark.createDataFrame([tuple(map(float, p)) for p in walls + [7.0, -3.0]], "x double, y double")
    got = regions.coarse_registration(moving, fixed, 5.0, 128).collect()
    assert [(r["flip"], r["angle"]) for r in got] == [(flip, angle)]
    assert abs(got[0]["tx"] - 7) < 2 and abs(got[0]["ty"] + 3) < 2
    assert regions.coarse_registration(moving.where(F.lit(False)), fixed, 5.0, 64).count() == 0
