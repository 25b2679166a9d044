"""Regions as rings of corners: least rectangles and label anchors; and coarse registration of two point sets.

A ring is an array of structs with x and y, without the first corner repeated at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomflux.operators.spatial import fold_angle, inside
from roomflux.plans.groups import dealt
from roomflux.plans.lineage import materialize, release


def least_rectangles(rings: DataFrame) -> DataFrame:
    """id, angle, longer, shorter: the rectangle of least area around each ring (id, ring), any direction allowed.

    One of its sides lies along a side of the convex hull, so the corners of a ring are taken two by two and kept where all
    others are on one side. ``angle`` is the longer side's, in degrees above -90 and up to 90; of equal areas the least angle's.
    Rings that are null, empty or all on one point give no row.
    """

    def cross(p, q, r):
        return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    sides = rings.select("id", "ring", F.explode("ring").alias("p")).select("id", "ring", "p", F.explode("ring").alias("q")).where("p <> q")
    sides = sides.where(F.forall("ring", lambda r: cross(F.col("p"), F.col("q"), r) >= -1e-9))
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    sides = sides.select("id", "ring", (dx / F.hypot(dx, dy)).alias("u"), (dy / F.hypot(dx, dy)).alias("v"))

    def extent(a: Column, b: Column) -> Column:
        places = F.transform("ring", lambda r: r["x"] * a + r["y"] * b)
        return F.array_max(places) - F.array_min(places)

    u, v = F.col("u"), F.col("v")
    boxed = sides.select("id", u, v, extent(u, v).alias("along"), extent(-v, u).alias("across"))
    turned = F.degrees(F.atan2("v", "u")) + F.when(F.round("along", 6) >= F.round("across", 6), 0.0).otherwise(90.0)
    angle = fold_angle(F.round(turned, 1))
    picked = boxed.select("id", F.round(F.col("along") * F.col("across"), 6).alias("area"), F.struct(angle.alias("angle"), F.round(F.greatest("along", "across"), 2).alias("longer"), F.round(F.least("along", "across"), 2).alias("shorter")).alias("box"))
    return picked.groupBy("id").agg(F.min_by("box", F.struct("area", "box")).alias("box")).select("id", "box.*")


def room_around(x: Column, y: Column, ring: Column) -> Column:
    """Distance from a point to the ring's line, negative outside."""

    def to_side(k: Column) -> Column:
        a, b = F.get(ring, k), F.get(ring, (k + 1) % F.size(ring))
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        square = dx * dx + dy * dy
        along = F.when(square > 0, ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(square, F.lit(0.0))).otherwise(F.lit(0.0))
        along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - a["x"] - along * dx, y - a["y"] - along * dy)

    far = F.array_min(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), to_side))
    return F.when(inside(x, y, ring), far).otherwise(-far)


def _anchors_in_rounds(rings: DataFrame, precision: float) -> DataFrame:
    """Anchors by one round of jobs for each size of squares, all rings in each; a ring's squares are spread over tasks."""

    def span(axis: str, of):
        return of(F.transform("ring", lambda r: r[axis]))

    boxed = rings.select("id", "ring", *(span(a, of).alias(n) for a, of, n in (("x", F.array_min, "x0"), ("x", F.array_max, "x1"), ("y", F.array_min, "y0"), ("y", F.array_max, "y1"))))
    boxed = boxed.withColumn("size", F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).where("size > 0")

    def centres(low: str, high: str) -> Column:
        many = F.ceil((F.col(high) - F.col(low)) / F.col("size")).cast("int")
        return F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.col(low) + (k + 0.5) * F.col("size"))

    cells = boxed.withColumn("x", F.explode(centres("x0", "x1"))).withColumn("y", F.explode(centres("y0", "y1"))).select("id", "ring", "x", "y", (F.col("size") / 2).alias("half"))
    middle = boxed.select("id", "ring", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.lit(0.0).alias("half"))
    cells, best = cells.unionByName(middle), None
    while True:
        # A ring's squares are spread too: a large region is not one task's.
        measured = materialize(cells.repartition("id", "x", "y").withColumn("room", room_around(F.col("x"), F.col("y"), F.col("ring"))), "squares")
        rivals = measured.select("id", "x", "y", "room")
        rivals = rivals if best is None else rivals.unionByName(best)
        chosen = materialize(rivals.groupBy("id").agg(F.max_by(F.struct("x", "y", "room"), F.struct("room", -F.col("x"), -F.col("y"))).alias("b")).select("id", "b.*"), "anchors")
        release(best)
        best = chosen
        left = measured.join(best.select("id", F.col("room").alias("top")), "id").where((F.col("half") > 0) & (F.col("room") + F.col("half") * math.sqrt(2) > F.col("top") + precision))
        corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-0.5, 0.5) for b in (-0.5, 0.5)))
        split = left.select("id", "ring", "x", "y", "half", F.inline(corners))
        cells = materialize(split.select("id", "ring", (F.col("x") + F.col("a") * F.col("half")).alias("x"), (F.col("y") + F.col("b") * F.col("half")).alias("y"), (F.col("half") / 2).alias("half")), "squares")
        release(measured)
        if not cells.limit(1).count():
            return best


#: Squares of one ring up to which the task that reads it also finds its anchor, and of one batch.
SQUARES = 1 << 15
BATCH = 256


def _hypot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As Java's hypot, to the last bit, so that equal widths are equal on either way."""
    x, y = np.abs(x), np.abs(y)
    a, b = np.maximum(x, y), np.minimum(x, y)

    def high(v: np.ndarray) -> np.ndarray:
        return (v.view(np.int64) & np.int64(-(1 << 32))).view(np.float64)

    w = a - b
    t = high(a)
    wide = np.sqrt(t * t - (b * -b - (a - t) * (a + t)))
    twice = a + a
    y1, t1 = high(b), high(twice)
    near = np.sqrt(t1 * y1 - (w * -w - (t1 * (b - y1) + (twice - t1) * b)))
    far = (a.view(np.int64) >> 32) - (b.view(np.int64) >> 32) > 0x3C00000
    return np.where(far, a + b, np.where(w > b, wide, near))


def _room(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """``room_around`` of points in rings of equally many corners (point, corner, axis)."""
    n = ring.shape[1]
    far, crossed = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for k in range(n):
        ax, ay, bx, by = *ring[:, k].T, *ring[:, (k + 1) % n].T
        ax, ay, bx, by = (np.ascontiguousarray(v) for v in (ax, ay, bx, by))
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            along = np.where(square > 0, ((x - ax) * dx + (y - ay) * dy) / square, 0.0)
            along = np.minimum(np.maximum(along, 0.0), 1.0)
            across = (ay > y) != (by > y)
            crossed += across & (x < dx * (y - ay) / dy + ax)
        far = np.minimum(far, _hypot(x - ax - along * dx, y - ay - along * dy))
    return np.where(crossed % 2 == 1, far, -far)


def _anchors(rings: np.ndarray, precision: float) -> np.ndarray:
    """x, y, room of each ring of equally many corners; not a number where more than ``SQUARES`` squares would be needed."""
    low, high = rings.min(1), rings.max(1)
    size = (high - low).min(1)
    many = np.ceil((high - low) / size[:, None])
    out = np.full((len(rings), 3), np.nan)
    live = many.prod(1) <= SQUARES
    own, x, y, half = [], [], [], []
    for r in np.flatnonzero(live):
        nx, ny = many[r].astype(int)
        gx, gy = np.meshgrid(low[r, 0] + (np.arange(nx) + 0.5) * size[r], low[r, 1] + (np.arange(ny) + 0.5) * size[r], indexing="ij")
        own.append(np.full(gx.size + 1, r))
        x.append(np.r_[gx.ravel(), (low[r, 0] + high[r, 0]) / 2])
        y.append(np.r_[gy.ravel(), (low[r, 1] + high[r, 1]) / 2])
        half.append(np.r_[np.full(gx.size, size[r] / 2), 0.0])
    if not own:
        return out
    own, x, y, half = (np.concatenate(v) for v in (own, x, y, half))
    while len(own):
        room = np.concatenate([_room(x[k : k + 65536], y[k : k + 65536], rings[own[k : k + 65536]]) for k in range(0, len(own), 65536)])
        best = np.full(len(rings), -np.inf)
        np.maximum.at(best, own, room)
        top = np.flatnonzero(room == best[own])
        top = top[np.lexsort((y[top], x[top], own[top]))]
        top = top[np.r_[True, own[top][1:] != own[top][:-1]]]
        for k in top:
            if np.isnan(out[own[k], 2]) or (room[k], -x[k], -y[k]) > (out[own[k], 2], -out[own[k], 0], -out[own[k], 1]):
                out[own[k]] = x[k], y[k], room[k]
        keep = (half > 0) & (room + half * math.sqrt(2) > out[own, 2] + precision)
        own, x, y, half = own[keep], x[keep], y[keep], half[keep]
        over = np.bincount(own, minlength=len(rings)) * 4 > SQUARES
        live &= ~over
        own, x, y, half = (v[~over[own]] for v in (own, x, y, half))
        own = np.repeat(own, 4)
        h = np.repeat(half, 4)
        x = np.repeat(x, 4) + np.tile([-0.5, -0.5, 0.5, 0.5], len(x)) * h
        y = np.repeat(y, 4) + np.tile([-0.5, 0.5, -0.5, 0.5], len(y)) * h
        half = h / 2
    out[~live] = np.nan
    return out


def label_anchors(rings: DataFrame, precision: float = 0.02) -> DataFrame:
    """id, x, y, room: a point in each ring (id, ring) that is as far from its line as any, to within ``precision``.

    Squares over a ring's box are split into four while they may hold a better point than the best centre so far. The task
    that reads a ring finds its anchor; rings that need more than ``SQUARES`` squares at a time (where the widest place is a
    strip, squares grow with its length over ``precision``) are left to rounds of jobs over which their squares are spread,
    with the same result. Equal rings are solved once. Null rings, and those without extent in x or y, give no row.
    """
    plain = F.forall("ring", lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    given = materialize(rings.select("id", "ring").where("size(ring) > 0"), "given")
    one = materialize(given.groupBy("ring").agg(F.min("id").alias("one")), "shapes")
    # Shapes are dealt over all tasks: few bytes of rings are much work.
    own = materialize(dealt(one.select(F.col("one").alias("id"), "ring").withColumn("plain", plain), "id"), "rings")
    flat = own.where("plain").select("id", F.transform("ring", lambda p: p["x"].cast("double")).alias("x"), F.transform("ring", lambda p: p["y"].cast("double")).alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby(batch["x"].map(len)):
                for k in range(0, len(same), BATCH):
                    part = same.iloc[k : k + BATCH]
                    ring = np.stack([np.stack(part["x"].tolist()), np.stack(part["y"].tolist())], 2)
                    wide = (np.ptp(ring, axis=1) > 0).all(1)
                    found = _anchors(ring[wide], precision) if wide.any() else np.empty((0, 3))
                    yield pd.DataFrame({"id": part["id"].to_numpy()[wide], "x": found[:, 0], "y": found[:, 1], "room": found[:, 2]})

    found = materialize(flat.mapInPandas(run, f"id {rings.schema['id'].dataType.simpleString()}, x double, y double, room double"), "anchors")
    done = found.where("room is not null").groupBy("id").agg(F.max_by(F.struct("x", "y", "room"), F.struct("room", -F.col("x"), -F.col("y"))).alias("b")).select("id", "b.*")
    rest = own.where("not plain").select("id", "ring").unionByName(own.where("plain").join(found.where("room is null").select("id"), "id", "left_semi").select("id", "ring"))
    rest = materialize(rest, "rest")
    every = done.unionByName(_anchors_in_rounds(rest, precision)) if rest.limit(1).count() else done
    same = given.join(one, "ring").select("id", "one")
    return same.join(every.withColumnRenamed("id", "one"), "one").groupBy("id").agg(F.max_by(F.struct("x", "y", "room"), F.struct("room", -F.col("x"), -F.col("y"))).alias("b")).select("id", "b.*")


def _occupied(points: DataFrame, low: tuple[float, float], res: float) -> np.ndarray:
    """Centres of the squares of side ``res`` that hold a point; their number is bounded by the caller's grid."""
    at = points.select(*(F.floor((F.col(c) - v) / res).alias(c) for c, v in zip("xy", low, strict=True))).distinct().toPandas()
    return np.array(low) + (at[["x", "y"]].to_numpy(dtype=float) + 0.5) * res


def coarse_registration(moving: DataFrame, fixed: DataFrame, step: float = 0.5, grid: int = 256, blur: float = 1.0) -> DataFrame:
    """flip, angle, tx, ty, score: the turn, mirroring and shift under which ``moving`` (x, y) covers most of ``fixed``.

    Each angle (in degrees, every ``step``) and either flip of y is a row; a raster of ``grid`` squares a side is correlated
    with the fixed one by Fourier transform for all shifts at once. Only occupied squares reach the driver: at most
    ``grid`` ** 2 of ``fixed`` and four times as many of ``moving``, however many points there are. x' = R(angle)(x, flip y) +
    (tx, ty), true to a square; points with nulls are left out; no points on either side: no rows.
    """
    moving, fixed = (df.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL") for df in (moving, fixed))
    ends = [df.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first() for df in (moving, fixed)]
    schema = "flip int, angle double, tx double, ty double, score double"
    if any(e[0] is None for e in ends):
        return moving.sparkSession.createDataFrame([], schema)
    widest = max(math.hypot(e[2] - e[0], e[3] - e[1]) for e in ends)
    res = max(widest, 1e-9) / (grid // 2 - 4)
    own = _occupied(moving, tuple(ends[0][:2]), res / 2)
    other = _occupied(fixed, tuple(ends[1][:2]), res)
    waves = np.fft.fftfreq(grid)
    smooth = np.exp(-2 * (math.pi * blur) ** 2 * (waves[:, None] ** 2 + waves[None, :] ** 2)) ** 2

    def raster(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = points.min(0)
        at = np.floor((points - low) / res).astype(int) + 1
        image = np.zeros((grid, grid))
        image[at[:, 0], at[:, 1]] = 1
        return np.fft.fft2(image), low

    target, origin = raster(other)

    def correlate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["id"]:
                flip, angle = (1, -1)[k % 2], float(k // 2) * step
                c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
                turned = (own * [1, flip]) @ np.array([[c, s], [-s, c]])
                image, low = raster(turned)
                met = np.fft.ifft2(target * np.conj(image) * smooth).real
                best = int(np.argmax(met))
                shift = [v - grid if v > grid // 2 else v for v in divmod(best, grid)]
                out.append((flip, angle, *(np.array(shift) * res + origin - low), met.flat[best]))
            yield pd.DataFrame(out, columns=["flip", "angle", "tx", "ty", "score"])

    turns = moving.sparkSession.range(0, 2 * round(360 / step), 1, 32)
    tried = turns.mapInPandas(correlate, schema)
    picked = tried.agg(F.max_by(F.struct(*tried.columns), F.struct(F.round("score", 6), "flip", -F.col("angle"))).alias("b"))
    return picked.select("b.*")
