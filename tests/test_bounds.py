"""Queries whose SQL ends at a bound, over a building longer than that bound."""

import duckdb
import pandas as pd
import pytest

from roomflux import registry
from roomflux.operators import graph as G
from tests.test_oracle import rows

#: Cells along a level: more than the bound of the SQL, and more than its bitmap's rows are wide.
LONG = 205


@pytest.fixture(scope="module")
def long_building(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    users = [15 * j + i for j in range(LONG) for i in (0, 1, 2, 5) if i < 2 or j % 3] * 11
    events = pd.DataFrame({"user_id": users, "event_type": "click"})
    events = pd.concat([events, events.assign(event_type="error")], ignore_index=True)
    events.insert(0, "event_id", range(len(events)))
    events.to_parquet(f"{path}/events.parquet")
    return path


def same(spark, path, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/events.parquet'")
    assert rows(registry.queries()[name](spark, path).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", ["shortest_path", "route_alternatives", "unreachable", "walk_minutes", "bfs_parent", "via_parent", "route_points", "route_steps"])
def test_search_ends_where_its_sql_does(spark, long_building, name):
    same(spark, long_building, name)


def test_searches_go_on_to_the_last_cell(spark, long_building):
    found = {name: registry.queries()[name](spark, long_building).toPandas() for name in ("shortest_path", "route_alternatives", "unreachable", "walk_minutes", "bfs_parent", "via_parent", "route_points", "route_steps")}
    reached = {level * 1_000_000 + i * 10_000 + j for level in (1, 2) for i in (0, 1, 2) for j in range(LONG) if i < 2 or j % 3}
    for name in ("shortest_path", "route_alternatives", "walk_minutes", "bfs_parent"):
        assert set(found[name]["node"]) == reached
    assert set(found["unreachable"]["node"]) == {level * 1_000_000 + 50_000 + j for level in (1, 2) for j in range(LONG) if j % 3}
    # The farthest cell of the other level is 204 along, 1 across and a portal away.
    assert found["shortest_path"]["dist"].max() == found["route_points"]["dist"].max() == 208
    assert (found["route_alternatives"]["by_first"].max(), found["route_alternatives"]["by_second"].max()) == (208, 206)
    assert found["bfs_parent"]["depth"].max() == 205 and found["via_parent"]["depth"].max() > 200
    assert found["route_steps"]["points"].sum() == len(found["route_points"])


def test_bitmap_holds_every_cell(spark, long_building):
    same(spark, long_building, "bitmap_roundtrip")


def test_intervals_without_a_value_come_last(spark, tmp_path):
    events = pd.DataFrame({"event_id": [1, 2, 3, 4], "user_id": [7, 7, 7, 7], "value": [5.0, None, 500.0, 6.0], "ts": pd.to_datetime("2024-01-01")})
    events.to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    same(spark, tmp_path, "coalesce_gaps")


@pytest.mark.parametrize("small", [0, 1000])
def test_bounds_of_searches(spark, small):
    edges = spark.createDataFrame([(k, k + 1, 2.0) for k in range(6)], "a long, b long, w double")
    assert {r["node"]: r["dist"] for r in G.shortest_paths(edges, 0, small, below=6).collect()} == {0: 0.0, 1: 2.0, 2: 4.0}
    source = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["depth"] for r in G.bfs_parents(edges, source, small, deepest=3).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def random_boxes(n, seed):
    import random

    random.seed(seed)
    out = []
    for k in range(n):
        x, y = random.randrange(60), random.randrange(60)
        out.append((k, random.randrange(2), x, y, x + random.randrange(1, 9), y + random.randrange(1, 5)))
    return [(*r, (r[4] - r[2]) * (r[5] - r[3])) for r in out] + [(n + k, *r[1:], (r[4] - r[2]) * (r[5] - r[3])) for k, r in enumerate(out[: n // 3])]


BOX = "id long, level int, x0 int, y0 int, x1 int, y1 int, area int"


def test_full_buckets_are_sliced(spark, monkeypatch):
    from roomflux.operators import spatial as P

    monkeypatch.setattr(P, "SLICE", 20)
    boxes = random_boxes(150, 1)
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] == b[1] and a[2] + 0.5 < b[4] and b[2] + 0.5 < a[4] and a[3] + 0.5 < b[5] and b[3] + 0.5 < a[5]}
    got = [(r["a"], r["b"]) for r in P.overlap_pairs(spark.createDataFrame(boxes, BOX), 16).collect()]
    assert len(got) == len(want) and set(got) == want


def test_copies_of_boxes_make_no_pairs(spark, monkeypatch):
    from roomflux.operators import spatial as P

    boxes, seen = random_boxes(120, 2), []
    made = P.settle

    def watched(rivals):
        seen.append(rivals.count())
        return made(rivals)

    monkeypatch.setattr(P, "settle", watched)
    copies = [(1000 * c + b[0], *b[1:]) for c in range(20) for b in boxes]
    copies.append((99_999, 0, 0, 0, 50, 50, None))
    kept = []
    for b in sorted(copies[:-1], key=lambda b: (-b[6], b[0])):
        if not any(a[1] == b[1] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5] for a in kept):
            kept.append(b)
    assert {r["id"] for r in P.greedy_nms(spark.createDataFrame(copies, BOX), 16).collect()} == {b[0] for b in kept} | {99_999}
    assert seen[0] < len(boxes) ** 2 / 2


@pytest.mark.parametrize("ahead", [False, True])
def test_nearest_points_by_tiles(spark, ahead):
    import random

    from roomflux.operators import spatial as P

    random.seed(3)
    pts = [(k, random.choice([random.gauss(0, 1), random.uniform(-30, 30)]), round(random.uniform(-9, 9), 1)) for k in range(250)]
    pts += [(1000 + p[0], *p[1:]) for p in pts[:100]] + [(5000, None, 1.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    want = {}
    for p in pts[:-1]:
        near = [((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2, q[0]) for q in pts[:-1] if not ahead or q[1] > p[1] and abs(q[2] - p[2]) <= q[1] - p[1]]
        near = [n for n in near if n[0] <= 9]
        if near:
            want[p[0]] = min(near)[1]
    assert {r["id"]: r["near"] for r in P.nearest_points(df, df, 3.0, ahead).collect()} == want


@pytest.mark.parametrize("asked", [7, 1 << 20])
def test_neighbours_ahead_are_found_however_far(spark, monkeypatch, asked):
    import random

    from roomflux.operators import rank as R
    from roomflux.operators import spatial as P

    monkeypatch.setattr(P, "BLOCK", 8)
    monkeypatch.setattr(P, "ASKED", asked)
    random.seed(5)
    pts = [(k, round(random.choice([random.gauss(0, 2), random.uniform(-900, 900)]), 1), round(random.choice([random.gauss(0, 2), random.uniform(-300, 300)]), 1)) for k in range(200)]
    pts += [(1000 + p[0], *p[1:]) for p in pts[:60]] + [(2000 - k, 5000.0 + 100 * (k // 5), 100.0 * (k % 5)) for k in range(25)]
    want = {}
    for p in pts:
        near = [((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2, q[0]) for q in pts if q[1] > p[1] and abs(q[2] - p[2]) <= q[1] - p[1]]
        if near:
            want[p[0]] = min(near)[1]
    odd = [(9000, None, 1.0), (9001, float("nan"), 1.0), (9002, 1.0, float("inf"))]
    got = R.directional_neighbour(spark.createDataFrame(pts + odd, "id long, x double, y double"), 6.0).collect()
    assert {r["id"]: r["neighbour"] for r in got} == want and len(got) == len(want)


def test_copies_of_doors_and_walls_meet_once(spark):
    from roomflux.operators import shapes as SH

    doors = [(k, 1, 0.0, 0.0, 4.0, 0.0) for k in range(50)]
    walls = [(1, 1.0, -1.0, 2.0, 1.0)] * 40 + [(1, 3.0, -1.0, 3.5, 1.0)]
    found = SH.blocked_doors(spark.createDataFrame(doors, "id long, level int, ax double, ay double, bx double, by double"), spark.createDataFrame(walls, "level int, x0 double, y0 double, x1 double, y1 double"), 4.0)
    assert {r["id"]: r["covered"] for r in found.collect()} == {k: 40.5 for k in range(50)}
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert len(joins) >= 4  # lines and walls are put together before they meet


def test_first_below_takes_the_nearest_row_then_the_least_id(spark):
    from roomflux.operators import spatial as P

    codes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 500.0, 0.0)], "id long, x double, y double")
    others = spark.createDataFrame([(10, 5.0, 3.0, 1), (9, -39.0, 3.0, 1), (8, 40.0, 3.0, 1), (7, 0.0, 4.0, 1), (6, 0.0, -1.0, 2), (5, 0.0, -2.0, 2)], "id long, x double, y double, kind int")
    assert {r["id"]: r["first"] for r in P.first_below(codes, others, 39, -1, 44).collect()} == {1: {1: 9, 2: 6}, 2: {1: 9, 2: 6}}


def test_components_broadcast_nothing(spark, monkeypatch):
    from roomflux.plans import components as C

    plans, kept = [], C.materialize

    def watched(df, label="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, label)

    monkeypatch.setattr(C, "materialize", watched)
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")
    assert {r["label"] for r in C.connected_components(edges).collect()} == {0}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_anchors_by_task_and_by_rounds_are_the_same(spark, monkeypatch):
    from roomflux.operators import regions as R

    rings = [(k, [(0.0, 0.0), (2.0 + k / 7, 0.3), (2.1, 0.7 + k / 9), (0.9, 0.6), (0.8, 1.9), (0.1, 1.7)]) for k in range(12)] + [(90, [(0.0, 0.0), (40.0, 0.0), (40.0, 1.0), (0.0, 1.0)]), (91, [(0.0, 0.0), (1.0, 0.0)]), (92, None)]
    rings += [(100 + k, r) for k, r in rings[:5]]
    df = spark.createDataFrame(rings, "id long, ring array<struct<x:double,y:double>>")
    want = {tuple(r) for r in R._anchors_in_rounds(df, 0.02).collect()}
    solved, rounds = [], R._anchors_in_rounds

    def watched(rest, precision):
        solved.append(rest.count())
        return rounds(rest, precision)

    monkeypatch.setattr(R, "_anchors_in_rounds", watched)
    assert {tuple(r) for r in R.label_anchors(df, 0.02).collect()} == want and not solved
    monkeypatch.setattr(R, "SQUARES", 500)
    assert {tuple(r) for r in R.label_anchors(df, 0.02).collect()} == want and solved == [1]
