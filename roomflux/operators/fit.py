"""Registration of point sets by sums: rotation, scale and shift in closed form, and the iterated form."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflux.operators.spatial import nearest_within


def similarity(pairs: DataFrame, by: list[str] | None = None, scaled: bool = True) -> DataFrame:
    """Least-squares similarity from (x, y) to (u, v): n, angle, scale, tx, ty; ``scaled`` false keeps the scale at 1.

    With p and q centred, the angle is atan2 of the sums of cross and dot products, and the scale their length over the sum of
    squares, so plain aggregates do; without reflection.
    """
    s = pairs.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{c}") for c in "xyuv"), F.sum(F.col("x") * F.col("u") + F.col("y") * F.col("v")).alias("dot"), F.sum(F.col("x") * F.col("v") - F.col("y") * F.col("u")).alias("cross"), F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("sq"))
    s = s.where("n > 0")
    dot = F.col("dot") - (F.col("sx") * F.col("su") + F.col("sy") * F.col("sv")) / F.col("n")
    cross = F.col("cross") - (F.col("sx") * F.col("sv") - F.col("sy") * F.col("su")) / F.col("n")
    sq = F.col("sq") - (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) / F.col("n")
    scale = F.when(sq > 0, F.hypot(dot, cross) / sq).otherwise(F.lit(1.0)) if scaled else F.lit(1.0)
    out = s.withColumn("angle", F.atan2(cross, dot)).withColumn("scale", scale)
    tx = F.col("su") / F.col("n") - F.col("scale") * (F.cos("angle") * F.col("sx") - F.sin("angle") * F.col("sy")) / F.col("n")
    ty = F.col("sv") / F.col("n") - F.col("scale") * (F.sin("angle") * F.col("sx") + F.cos("angle") * F.col("sy")) / F.col("n")
    return out.select(*(by or []), "n", "angle", "scale", tx.alias("tx"), ty.alias("ty"))


def icp(moving: DataFrame, fixed: DataFrame, gates: tuple[float, ...] = (2.0, 1.0, 0.5, 0.25)) -> list[dict]:
    """Iterated rigid registration of ``moving`` (id, x, y) onto ``fixed``: nearest within a gate, refit, narrower gate.

    One row of sums reaches the driver per round. Returns the transform after each round and the share of points within the gate.
    """
    angle, tx, ty, rounds = 0.0, 0.0, 0.0, []
    total = moving.count()
    for gate in gates:
        c, s = math.cos(angle), math.sin(angle)
        here = moving.select("id", (F.col("x") * c - F.col("y") * s + tx).alias("x"), (F.col("x") * s + F.col("y") * c + ty).alias("y"))
        near = nearest_within(here, fixed.select("id", "x", "y"), gate)
        pairs = near.join(moving, "id").join(fixed.select(F.col("id").alias("near"), F.col("x").alias("u"), F.col("y").alias("v")), "near")
        fit = similarity(pairs, scaled=False).collect()
        if fit:
            angle, tx, ty = fit[0]["angle"], fit[0]["tx"], fit[0]["ty"]
        rounds.append({"gate": gate, "pairs": fit[0]["n"] if fit else 0, "share": (fit[0]["n"] if fit else 0) / max(1, total), "angle": angle, "tx": tx, "ty": ty})
    return rounds
