"""Cases worked out by hand or by brute force."""

import itertools
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from roomflux.functions import normalize as N
from roomflux.operators import graph as G
from roomflux.operators import lookup as L
from roomflux.operators import schedule as S
from roomflux.operators import sequence as Q
from roomflux.operators import shapes as SH
from roomflux.operators import spatial as P
from roomflux.plans.blocks import with_last_known, with_numbers, with_previous, with_running_sum
from roomflux.plans.components import connected_components
from roomflux.sources import documents as D


@pytest.fixture(scope="module")
def rooms(spark):
    return spark.createDataFrame([(1, False), (2, True), (3, False)], "room int, shared boolean")


@pytest.fixture(scope="module")
def slots(spark):
    rows = [(1, 3, 480, 570, 2, "lab"), (1, 3, 480, 570, 1, "lab"), (1, 3, 480, 570, 2, "lab"), (2, 3, 600, 700, 2, "ea"), (3, 3, 480, 700, 4, "gy"), (3, 3, 480, 700, 9, "gy"), (3, 3, 480, 700, 0, "gy")]
    return S.weekly_slots(spark.createDataFrame(rows, "room int, day int, t_from int, t_to int, week int, kind string"), 4)


def state(rooms, slots, week, minute, **options):
    return {r["room"]: (r["state"], r["until"], r["next_from"]) for r in S.occupancy(rooms, slots, 3, week, minute, 4, **options).collect()}


def test_masks(slots):
    assert {r["room"]: r["mask"] for r in slots.collect()} == {1: 3, 2: 2, 3: 8}


def test_never_free_outside_the_term_or_on_no_class_days(rooms, slots):
    for week, options in ((0, {}), (5, {}), (2, {"holiday": True})):
        assert {s for s, *_ in state(rooms, slots, week, 500, **options).values()} == {"none"}


def test_occupancy_is_half_open_and_by_week(rooms, slots):
    assert state(rooms, slots, 2, 569)[1] == ("busy", 570, 1440)
    assert state(rooms, slots, 2, 570)[1] == ("free", None, 1440)
    assert state(rooms, slots, 3, 500)[1][0] == "free" and state(rooms, slots, 4, 500)[3][0] == "busy"
    assert state(rooms, slots, 2, 570)[2] == ("maybe", None, 600)


def test_week_before_the_term(spark):
    from roomflux.tables import week_number

    days = spark.createDataFrame([("2023-12-31",), ("2024-01-01",), ("2024-01-08",), ("2023-12-24",)], "d string").select(week_number(F.to_date("d")).alias("w"))
    assert [r["w"] for r in days.collect()] == [0, 1, 2, -1]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [(" F08 ", "F08"), ("f08", None), ("110", "1.10"), ("2.10", "2.10"), ("216 A", "2.16a"), ("audmax 1.32", "Audmax"), ("kazan", None), ("", None), (None, None)])
def test_door_number(spark, raw, want):
    assert one(spark, N.door_number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("09:05", 545), ("9:05:59", 545), ("noon", None), ("", None), ("99999999999:00", None)])
def test_minutes(spark, raw, want):
    assert one(spark, N.minutes_of_day(F.lit(raw))) == want


def test_lists(spark):
    assert one(spark, N.week_list(F.lit("3, 1,1.0,x,,2 ,3"))) == [1, 2, 3]
    assert one(spark, N.list_cell(F.lit("BA.1, ;BA.2\nX"), "BA.")) == ["BA.1", "BA.2"]
    assert one(spark, N.segment(F.lit("a-b-c"), 1)) == "b" and one(spark, N.segment(F.lit("a-b"), 1)) is None


def test_lookup_with_divisible_names(spark):
    reg = spark.createDataFrame([("F03 - F04 - F07", 1, 0), ("F04", 2, 1)], "name string, value int, pos int")
    got = L.left_lookup(spark.createDataFrame([("f03",), ("F04",), ("F09",)], "k string"), reg, "k").select("k", "r.value").collect()
    assert {r["k"]: r["value"] for r in got} == {"f03": 1, "F04": 2, "F09": None}


def test_header_missing(spark):
    with pytest.raises(ValueError, match="b"):
        L.project_by_header(spark.createDataFrame([(1,)], "a int"), ["a", "b"])


def test_ambiguous_numbers_lose_all_rows(spark):
    df = spark.createDataFrame([("1.10", "A"), ("1.10", "B"), ("1.11", "C"), ("1.11", "C")], "n string, room string")
    assert {r["n"] for r in L.unambiguous(df, "n", "room").collect()} == {"1.11"}


def test_line_pack(spark):
    df = spark.createDataFrame([("a",), ("bb",), ("ccc",), ("d" * 9,), ("e",)], "x string")
    assert [r["line"] for r in L.line_pack(df, F.lit(1), F.col("x"), 8).orderBy("line_no").collect()] == ["a, bb", "ccc", "d" * 9, "e"]


def test_hysteresis_ignores_jitter(spark):
    values = [0.0, 7.6, 5.5, 7.4, 5.1, 4.9, 6.0, 7.5]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "g int, k int, v double")
    for width in (1, 3, 100):
        rows = Q.hysteresis(df.withColumn("b", F.floor(F.col("k") / width)), "g", ["k"], "v", 5.0, 7.5, "b").orderBy("k").collect()
        assert [r["state"] for r in rows] == [0, 1, 1, 1, 1, 0, 0, 1]


def test_blocks_do_not_show(spark):
    rng = random.Random(8)
    values = [rng.choice([None, 1, 2]) for _ in range(60)]
    df = spark.createDataFrame([(k % 2, k, v) for k, v in enumerate(values)], "g int, k int, v int")
    seen = []
    for width in (1, 7, 1000):
        rows = df.withColumn("b", F.floor(F.col("k") / width))
        a = with_previous(rows, ["g"], ["k"], F.col("v"), "b", "x")
        a = with_previous(a, ["g"], ["k"], F.col("v"), "b", "y", backward=True)
        a = with_running_sum(a, ["g"], ["k"], F.lit(1), "b", "n")
        a = with_last_known(a, ["g"], ["k"], F.col("v"), "b", "l")
        seen.append([(r["x"], r["y"], r["n"], r["l"]) for r in a.orderBy("k").collect()])
    assert seen[0] == seen[1] == seen[2]
    own = [values[k] for k in range(0, 60, 2)]
    for i, (x, y, n, last) in enumerate(seen[0][::2]):
        assert x == (own[i - 1] if i else None) and y == (own[i + 1] if i + 1 < len(own) else None) and n == i + 1
        assert last == next((v for v in reversed(own[: i + 1]) if v is not None), None)


def test_numbers(spark):
    df = spark.createDataFrame([(k,) for k in (5, 100, 7, 250, 101)], "k int")
    assert [r["n"] for r in with_numbers(df, "k", 100, [], "n").orderBy("k").collect()] == [1, 2, 3, 4, 5]


def test_sessions_merge_at_exactly_the_gap(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:02:01")], "u int, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in Q.sessions(df, "u", "t", "60 seconds").collect()) == [1, 2]


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(4)
    edges = {(a, b): rng.randint(1, 9) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(110)) if a != b}
    rows = [(a, b, w) for (a, b), w in edges.items()] + [(b, a, w) for (a, b), w in edges.items() if (b, a) not in edges]
    return rows, spark.createDataFrame(rows, "a long, b long, w int"), spark.range(60).withColumnRenamed("id", "node")


@pytest.mark.parametrize("small", [0, 1000])
def test_shortest_paths(net, small):
    rows, edges, _ = net
    best = {rows[0][0]: 0}
    for _ in range(60):
        for a, b, w in rows:
            if a in best and best[a] + w < best.get(b, 1e9):
                best[b] = best[a] + w
    assert {r["node"]: r["dist"] for r in G.shortest_paths(edges, rows[0][0], small).collect()} == best


@pytest.mark.parametrize("small", [0, 1000])
def test_bfs_parents(spark, net, small):
    rows, edges, _ = net
    near = {}
    for a, b, _ in sorted(rows):
        near.setdefault(a, []).append(b)
    want = {3: (None, 0), 7: (None, 0)}
    queue = deque([3, 7])
    while queue:
        at = queue.popleft()
        for b in near.get(at, []):
            if b not in want:
                want[b] = (at, want[at][1] + 1)
                queue.append(b)
    sources = spark.createDataFrame([(7,), (3,), (3,)], "node long")
    got = {r["node"]: (r["parent"], r["depth"]) for r in G.bfs_parents(edges, sources, small).collect()}
    assert got == want


@pytest.mark.parametrize("small", [0, 1000])
def test_components(net, small):
    rows, edges, nodes = net
    label = {n: n for n in range(60)}
    for _ in range(60):
        for a, b, _ in rows:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["node"]: r["label"] for r in G.components(nodes, edges, small).collect()} == label


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id a", "id + 1 b")
    assert {r["label"] for r in G.components(spark.range(301).withColumnRenamed("id", "node"), edges, 0).collect()} == {0}


def test_overlaps_and_suppression(spark):
    rng = random.Random(2)
    rows = []
    for k in range(150):
        x, y, w, h = rng.randrange(200), rng.randrange(200), rng.randrange(3, 40), rng.randrange(3, 30)
        rows.append((k, k % 2, x, y, x + w, y + h, w * h))
    boxes = spark.createDataFrame(rows, "id long, level int, x0 int, y0 int, x1 int, y1 int, area int")

    def over(a, b, t):
        return a[1] == b[1] and a[2] + t < b[4] and b[2] + t < a[4] and a[3] + t < b[5] and b[3] + t < a[5]

    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if over(a, b, 0.5)}
    got = [(r["a"], r["b"]) for r in P.overlap_pairs(boxes, 16).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[0])):
        if not any(over(r, k, 0) for k in kept):
            kept.append(r)
    assert {r["id"] for r in P.greedy_nms(boxes, 16).collect()} == {k[0] for k in kept}


def test_nearest_vectors_in_blocks(spark):
    rng = random.Random(1)
    rows = [(k, [rng.random() for _ in range(4)]) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    want = {}
    for q, v in rows[::10]:
        want[q] = [i for _, i in sorted((sum((a - b) ** 2 for a, b in zip(v, u, strict=True)), i) for i, u in rows if i != q)[:3]]
    for block in (4096, 7):
        got = {}
        for r in P.nearest_vectors(df, df.where("id % 10 = 0"), 3, block).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        assert got == want


def test_bits(spark):
    cells = spark.createDataFrame([(1, 0), (1, 2), (1, 8), (2, 17)], "g int, p int")
    packed = P.pack_bits(cells, "g", F.col("p"))
    assert {r["g"]: r["bits"] for r in packed.collect()}[1] == "BQE="
    assert sorted((r["g"], r["place"]) for r in P.unpack_bits(packed, "g").collect()) == [(1, 0), (1, 2), (1, 8), (2, 17)]


def test_spacing(spark):
    df = spark.createDataFrame([(1, k, float(x), 0.0) for k, x in enumerate([0, 0.5, 1.2, 2.0, 2.3])], "g int, id long, x double, y double")
    assert [r["id"] for r in P.spacing_dedup(df, "g", F.col("id"), 1.0).orderBy("nth").collect()] == [0, 2, 4]


def test_greedy_merge(spark):
    cells = spark.createDataFrame([(1, k, a) for k, a in enumerate([1.0, 2.0, 5.0, 1.0])], "grp int, cell long, area double")
    edges = spark.createDataFrame([(1, a, b) for a, b in [(0, 1), (1, 0), (1, 2), (2, 1), (1, 3), (3, 1)]], "grp int, a long, b long")
    assert [r["cell"] for r in G.greedy_merge(cells, edges, 4.0).orderBy("step").collect()] == [0, 1, 3]


def test_components_of_a_path_of_random_ids(spark):
    """Labels that only creep along such a path need hundreds of rounds."""
    ids = list(range(1000))
    random.Random(0).shuffle(ids)
    links = [(f"{a:04}", f"{b:04}") for a, b in zip(ids, ids[1:])] + [("x", "x"), ("y", "z"), ("z", "y"), (None, "0001")]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a string, b string"), 20).collect()}
    assert got == {f"{a:04}": "0000" for a in ids} | {"y": "y", "z": "y"}


def test_components_raise_at_the_bound(spark):
    edges = spark.createDataFrame([(a, a + 1) for a in range(50)], "a int, b int")
    with pytest.raises(RuntimeError):
        connected_components(edges, 1)


def test_door_number_overrides(spark):
    assert one(spark, N.door_number(F.lit("117 A"), {"1.17a": "1.17"})) == "1.17"
    assert one(spark, N.door_number(F.lit("118"), {"1.17a": "1.17"})) == "1.18"


def test_white_space_of_all_kinds(spark):
    assert one(spark, N.squash(F.lit("\u00a0a\u2003 \tb\u00a0"))) == "a b"


@pytest.mark.parametrize("raw, want", [("&aacute;&#225;&#xE1;", "ááá"), ("&amp;lt; &bogus; &", "&lt; &bogus; &"), ("&#128512;&apos;&quot;", "😀'\""), ("plain", "plain"), ("", ""), (None, None), ("&#0;&#xD800;", "\ufffd\ufffd")])
def test_unescape(spark, raw, want):
    assert one(spark, N.unescape(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("url, want", [("x#A1", ("A1", None, None, None)), ("x#from=A&to=B&via=lift?utm=1", (None, "A", "B", "lift")), ("x", (None,) * 4), ("x?q=1#", (None,) * 4), (None, (None,) * 4), ("x#to=B&x=1", (None, None, "B", None))])
def test_url_state(spark, url, want):
    assert tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(N.url_state(F.lit(url).cast("string"))))).first()) == want


def test_blocks_keep_null_groups_and_blocks(spark):
    """Null keys are a group, null orders come first, and a late event lies in the block of its own order."""
    rows = [(g, o, v) for g in (None, 1) for o, v in ((None, "a"), (1, "a"), (5, "b"), (9, "b"), (12, "a"))]
    df = spark.createDataFrame(rows, "g int, o int, v string").withColumn("block", F.floor(F.col("o") / 4))
    back = {(r["g"], r["o"]): r["back"] for r in Q.history_back(df, "g", ["o"], "v", "block").collect()}
    assert back == {(g, o): b for g in (None, 1) for o, b in ((None, None), (1, "a"), (5, "a"), (9, "b"), (12, "b"))}
    assert {r["g"]: r["changes"] for r in Q.transitions(df, "g", ["o"], "v", "block").collect()} == {None: 2, 1: 2}
    assert Counter(r["g"] for r in Q.runs(df, ["g"], ["o"], "v", "block").collect()) == {None: 3, 1: 3}
    assert Q.hysteresis(df.withColumn("x", F.col("o")), "g", ["o"], "x", 2, 8, "block").count() == len(rows)
    numbered = with_numbers(df, "o", 4, ["g"], "n").collect()
    assert sorted(r["n"] for r in numbered) == list(range(1, 11)) and {r["n"] for r in numbered if r["o"] is None} == {9, 10}


@pytest.mark.parametrize("small", [0, 1000])
def test_null_edges_and_isolated_nodes(spark, small):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (None, 2, 1.0), (2, None, 1.0), (3, 4, None), (2, 7, 2.0)], "a long, b long, w double")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 7, 8)], "node long")
    assert {r["node"]: r["label"] for r in G.components(nodes, edges, small).collect()} == {1: 1, 2: 1, 7: 1, 8: 8}
    assert {r["node"]: r["dist"] for r in G.shortest_paths(edges, 1, small).collect()} == {1: 0.0, 2: 1.0, 7: 3.0}
    sources = spark.createDataFrame([(1,), (None,)], "node long")
    assert {r["node"]: r["parent"] for r in G.bfs_parents(edges, sources, small).collect()} == {1: None, 2: 1, 7: 2}
    closed = spark.createDataFrame([(2,)], "node long")
    assert {r["node"] for r in G.bfs_parents(edges, sources, small, closed).collect()} == {1, 2}
    assert {r["node"] for r in G.route(edges, 1, 7, small).collect()} == {1, 2, 7}
    assert G.route(edges, 1, 8, small).count() == 0


def test_cycles_of_any_length(spark):
    rows = [(k, (k + 1) % 70) for k in range(70)] + [(100, 5), (101, 100), (200, 200), (300, None), (301, 300), (None, 1)]
    got = {r["k"]: (r["cyclic"], r["cycle"]) for r in G.cycles(spark.createDataFrame(rows, "k long, via long")).collect()}
    assert got == {k: (1, 70) for k in range(70)} | {100: (0, None), 101: (0, None), 200: (1, 1), 300: (0, None), 301: (0, None), None: (0, None)}


def test_documents_of_an_old_format_are_read_elsewhere(spark, tmp_path):
    D.write_documents(spark.createDataFrame([(1, "x")], "old int, name string"), str(tmp_path / "old"))
    D.write_documents(spark.createDataFrame([(2, None)], "rooms int, name string"), str(tmp_path / "new"))
    paths = [str(tmp_path / "old"), str(tmp_path / "new")]
    assert [tuple(r) for r in D.read_current(spark, paths, "rooms int, name string", ["rooms"]).collect()] == [(2, None)]
    with pytest.raises(ValueError):
        D.read_current(spark, paths[:1], "rooms int", ["rooms"])
    (tmp_path / "list.json").write_text('[{"a": 1},\n {"b": 2}]')
    assert [tuple(r) for r in D.read_documents(spark, str(tmp_path / "list.json"), "a int, b int", whole=True).collect()] == [(1, None), (None, 2)]
    assert [r["name"] for r in D.listing(spark, str(tmp_path), "list").collect()] == ["list.json"]


def test_cluster_needs_a_shared_folder():
    from roomflux.plans import lineage

    class Held:
        master = "spark://host:7077"
        sparkContext = conf = property(lambda self: self)

        def get(self, key, default=None):
            return default

        def getConf(self):
            return self

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Held())


DOORS = "id long, level int, ax double, ay double, bx double, by double"
WALLS = "level int, x0 double, y0 double, x1 double, y1 double"


def test_doors_against_walls(spark):
    doors = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 0.0), (2, 0, 0.0, 5.0, 2.0, 5.0), (3, 1, 0.0, 0.0, 2.0, 0.0), (4, 0, 1.0, -9.0, 1.0, 9.0), (5, 0, None, 0.0, 1.0, 1.0), (6, 0, 0.5, 0.5, 1.5, 1.5)], DOORS)
    walls = spark.createDataFrame([(0, 1.0, -1.0, 1.5, 1.0), (0, 1.5, -1.0, 1.75, 1.0), (1, 1.98, -1.0, 9.0, 1.0), (None, 0.0, 0.0, 9.0, 9.0)], WALLS)
    got = {r["id"]: r["covered"] for r in SH.blocked_doors(doors, walls, 0.7).collect()}
    assert got == {1: 0.75, 4: 2.0}
    assert sorted(r["id"] for r in SH.open_doors(doors, walls, 0.7).collect()) == [2, 3, 5, 6]
    assert SH.blocked_doors(doors, walls.limit(0), 0.7).count() == 0
    assert SH.open_doors(doors.limit(0), walls, 0.7).count() == 0


def test_styles_and_obstacles(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0, None, 0.5), (2, 0.0, 0.0, 0.01, 0.0, None, 0.5), (3, 0.0, 0.0, 0.0, 1.0, 0.2501, 0.0), (4, 0.0, 0.0, 0.0, 1.0, 0.3, 0.0), (5, 0.0, 0.0, 0.0, 1.0, 0.25, None)], "id int, x0 double, y0 double, x1 double, y1 double, width double, grey double")
    styles = spark.createDataFrame([(0.0, 0.5), (0.25, 0.0)], "width double, grey double")
    got = {tuple(r) for r in SH.styled_cuts(lines, styles, (1.0, 0.0, 0.0, 0.0)).collect()}
    assert got == {(1, -0.02, 0.0, 1.02, 0.0), (3, 0.0, -0.02, 0.0, 1.02)}
    rows = [(1, "w", "f", "l", 0.9), (2, "w", "f", "l", 0.5), (3, "w", "s", "l", 0.9), (4, "c", "fs", "c", None), (5, "c", "s", "c", None), (6, "c", "s", "re", None), (7, None, "f", "l", 0.9)]
    e = spark.createDataFrame([(*r, 0.0, 0.0, 1.0, 1.0) for r in rows], "id int, layer string, kind string, item string, fill double, x0 double, y0 double, x1 double, y1 double")
    assert {r["id"]: r["x1"] for r in SH.obstacles(e, ["w"], "c").collect()} == {1: 1.0, 4: 1.0, 6: 2.2}


def test_first_seen_takes_null_keys_as_one(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 4), (3, "a", 1), (4, "a", 2)], "id int, k string, t int")
    assert {(r["k"], r["id"]) for r in SH.first_seen(df, ["k"], ["t", "id"]).collect()} == {(None, 2), ("a", 3)}


def test_spacing_by_rounds_equals_turns(spark):
    pts = [(k, k % 2 if k % 5 else None, float(k * 7 % 23), float(k * 11 % 19)) for k in range(80)]
    df = spark.createDataFrame(pts, "id int, g int, x double, y double")
    kept = {}
    for k, g, x, y in pts:
        if all((x - a) ** 2 + (y - b) ** 2 > 9 for _, a, b in kept.setdefault(g, [])):
            kept[g].append((k, x, y))
    got = {}
    for r in P.spacing_dedup(df, "g", F.col("id"), 3.0).orderBy("nth").collect():
        got.setdefault(r["g"], []).append(r["id"])
    assert got == {g: [k for k, _, _ in v] for g, v in kept.items()}
    assert P.spacing_dedup(df.limit(0), "g", F.col("id"), 3.0).count() == 0
