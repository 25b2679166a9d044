"""Drawing elements and door lines: filters by style and layer, segments lengthened, segments against walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomflux.plans.groups import dealt


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each key (null keys are one key): what a set of seen keys lets through."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def _span(at: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Parameters between which ``at + t * step`` lies within low and high; from above to if it never does."""
    flat, held = step == 0, (at >= low) & (at <= high)
    one, other = (low - at) / F.nullif(step, F.lit(0.0)), (high - at) / F.nullif(step, F.lit(0.0))
    return (
        F.when(flat, F.when(held, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(one, other)),
        F.when(flat, F.when(held, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(one, other)),
    )


def blocked_doors(doors: DataFrame, walls: DataFrame, size: float, allowed: float = 0.05) -> DataFrame:
    """Doors (id, level, ax, ay, bx, by) with more than ``allowed`` of their line within walls (level, x0, y0, x1, y1): id, covered.

    ``covered`` is summed over walls. Equal lines and equal walls are taken once, the walls with their number. Both stand in each
    bucket that their box touches; a pair counts in the bucket where the common part of the boxes begins, and buckets are dealt
    over all tasks. Rows with nulls meet nothing.
    """
    ends, sides = ["ax", "ay", "bx", "by"], ["x0", "y0", "x1", "y1"]

    def spread(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
        wide = df.withColumn("__bx", F.explode(F.sequence(F.floor(x0 / size), F.floor(x1 / size))))
        return dealt(wide.withColumn("__by", F.explode(F.sequence(F.floor(y0 / size), F.floor(y1 / size)))), "level", "__bx", "__by")

    left, low = F.least("ax", "bx"), F.least("ay", "by")
    own = spread(doors.select("level", *ends).distinct(), left, low, F.greatest("ax", "bx"), F.greatest("ay", "by"))
    counted = walls.groupBy("level", *sides).agg(F.count(F.lit(1)).alias("__n")).select("level", "__n", *(F.col(c).alias(f"__{c}") for c in sides))
    other = spread(counted, *(F.col(f"__{c}") for c in sides))
    once = (F.col("__bx") == F.floor(F.greatest(left, "__x0") / size)) & (F.col("__by") == F.floor(F.greatest(low, "__y0") / size))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    (fx, tx), (fy, ty) = _span(F.col("ax"), dx, F.col("__x0"), F.col("__x1")), _span(F.col("ay"), dy, F.col("__y0"), F.col("__y1"))
    share = F.greatest(F.lit(0.0), F.least(tx, ty, F.lit(1.0)) - F.greatest(fx, fy, F.lit(0.0)))
    met = own.join(other.hint("merge"), ["level", "__bx", "__by"]).where(once)
    lines = met.groupBy("level", *ends).agg(F.sum(share * F.sqrt(dx * dx + dy * dy) * F.col("__n")).alias("__covered"))
    covered = doors.select("id", "level", *ends).join(lines, ["level", *ends]).groupBy("id").agg(F.round(F.sum("__covered"), 6).alias("covered"))
    return covered.where(F.col("covered") > allowed)


def open_doors(doors: DataFrame, walls: DataFrame, size: float, allowed: float = 0.05) -> DataFrame:
    """Doors whose line lies in walls for ``allowed`` at most."""
    return doors.join(blocked_doors(doors, walls, size, allowed), "id", "left_anti")


def styled_cuts(lines: DataFrame, styles: DataFrame, turn: tuple[float, float, float, float], least: float = 0.03, more: float = 0.02) -> DataFrame:
    """Lines (id, x0, y0, x1, y1, width, grey) of a listed style, moved by ``turn`` and lengthened by ``more`` at either end.

    ``styles``: width (3 decimals), grey (2 decimals). ``turn``: c, s, tx, ty of x' = cx - sy + tx, y' = sx + cy + ty. Lines
    shorter than ``least`` once moved go; a width that is null counts as 0.
    """
    c, s, tx, ty = turn
    styled = lines.withColumn("__w", F.round(F.coalesce("width", F.lit(0.0)), 3)).withColumn("__g", F.round("grey", 2))
    styled = styled.join(styles.select(F.col("width").alias("__w"), F.col("grey").alias("__g")), ["__w", "__g"], "left_semi")
    for k in ("0", "1"):
        x, y = F.col(f"x{k}"), F.col(f"y{k}")
        styled = styled.withColumn(f"__u{k}", x * c - y * s + tx).withColumn(f"__v{k}", x * s + y * c + ty)
    dx, dy = F.col("__u1") - F.col("__u0"), F.col("__v1") - F.col("__v0")
    styled = styled.withColumn("__n", F.sqrt(dx * dx + dy * dy)).where(F.col("__n") >= least)
    ends = {"ax": F.col("__u0") - dx / F.col("__n") * more, "ay": F.col("__v0") - dy / F.col("__n") * more, "bx": F.col("__u1") + dx / F.col("__n") * more, "by": F.col("__v1") + dy / F.col("__n") * more}
    return styled.select("id", *(F.round(v, 4).alias(k) for k, v in ends.items()))


def obstacles(elements: DataFrame, walls: list[str], curtain: str, thick: float = 1.2, pale: float = 0.7) -> DataFrame:
    """Boxes of what blocks: pale filled walls, filled curtain walls, and the curtain wall's straight strokes thickened.

    ``elements``: id, layer, kind (f, s, fs), item (l, re, qu, c), fill (0 to 1, null if none), x0, y0, x1, y1. Curves of the
    curtain wall are door swings and do not block.
    """
    filled = F.col("kind").isin("f", "fs")
    solid = filled & ((F.col("layer").isin(walls) & (F.col("fill") > pale)) | (F.col("layer") == curtain))
    stroke = ~filled & (F.col("layer") == curtain) & F.col("item").isin("l", "re", "qu")
    grow = F.when(stroke, F.lit(thick)).otherwise(F.lit(0.0))
    return elements.where(solid | stroke).select("id", *((F.col(c) - grow).alias(c) for c in ("x0", "y0")), *((F.col(c) + grow).alias(c) for c in ("x1", "y1")))
