"""Graph search as checkpointed DataFrame loops.

A search keeps one row per reached node and expands only the nodes improved in the last round; each round is written to the
shared folder, so lineage stays short. Graphs of at most ``SEARCHED`` edges (counted first) are searched in one grouped task:
the answer is the same, without a job per round.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomflux.plans.blocks import with_numbers
from roomflux.plans.components import connected_components
from roomflux.plans.lineage import materialize, release

SMALL = 200_000
#: Edges that one task searches. Rounds are as many as the longest way has steps, so a long building needs this rather than rounds.
SEARCHED = 3_000_000
#: Places (or nodes) of a queue that one task puts in order.
RANGE = 4096


def _by_start(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order of edges (a, b: places below ``n``) by a and b, and where the edges of each place begin in it."""
    order = np.lexsort((b, a))
    return order, np.searchsorted(a[order], np.arange(n + 1)).tolist()


def shortest_paths(edges: DataFrame, source: int, small: int = SEARCHED, below: float | None = None) -> DataFrame:
    """node, dist from ``source`` over directed edges (a, b, w > 0; those with a null are left out); unreachable nodes are left out.

    ``below``: only nodes less far than that are wanted, and the search goes no further; by default all.
    """
    within = float("inf") if below is None else float(below)
    own = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w")).where("a is not null and b is not null and w is not null"), "edges")
    if own.count() <= small:

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes, ends = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
            a, b = ends[: len(pdf)], ends[len(pdf) :]
            order, first = _by_start(len(nodes), a, b)
            near, far = b[order].tolist(), pdf["w"].to_numpy()[order].tolist()
            best, queue = [float("inf")] * len(nodes), []
            at = int(np.searchsorted(nodes, source))
            if at < len(nodes) and nodes[at] == source:
                best[at] = 0.0
                queue.append((0.0, at))
            while queue:
                d, at = heapq.heappop(queue)
                if d > best[at]:
                    continue
                for k in range(first[at], first[at + 1]):
                    far_off = d + far[k]
                    if far_off < within and far_off < best[near[k]]:
                        best[near[k]] = far_off
                        heapq.heappush(queue, (far_off, near[k]))
            dist = np.array(best)
            return pd.DataFrame({"node": nodes[np.isfinite(dist)], "dist": dist[np.isfinite(dist)]})

        return own.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(solve, "node long, dist double")
    spark = edges.sparkSession
    best = materialize(spark.createDataFrame([(source, 0.0, True)], "node long, dist double, fresh boolean").join(own.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), "best")
    while best.where("fresh").limit(1).count():
        step = best.where("fresh").join(own, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new")).where(F.col("new") < within)
        both = best.select("node", "dist").join(step, "node", "full")
        better = F.col("dist").isNull() | (F.col("new") < F.col("dist"))
        new = materialize(both.select("node", F.least("dist", "new").alias("dist"), F.coalesce(better, F.lit(False)).alias("fresh")), "best")
        release(best)
        best = new
    return best.select("node", "dist")


def routes(edges: DataFrame, other: DataFrame, source: int, below: float | None = None) -> DataFrame:
    """node, by_first, by_second: distances (``below`` a bound, if given) over two sets of edges (stairs and lifts); null where there is no way."""
    a = shortest_paths(edges, source, below=below).withColumnRenamed("dist", "by_first")
    return a.join(shortest_paths(other, source, below=below).withColumnRenamed("dist", "by_second"), "node", "full")


def unreachable(nodes: DataFrame, edges: DataFrame, source: int, below: float | None = None) -> DataFrame:
    """Nodes that no path from ``source`` (shorter than ``below``, if given) reaches."""
    return nodes.select("node").join(shortest_paths(edges, source, below=below), "node", "left_anti")


def components(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node, label (least node of its component), isolated nodes included; edges with a null are left out."""
    own = materialize(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    if own.limit(small + 1).count() <= small:

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            up = {n: n for n in pd.unique(pdf[["a", "b"]].to_numpy().ravel())}

            def root(n):
                while up[n] != n:
                    up[n] = up[up[n]]
                    n = up[n]
                return n

            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
            return pd.DataFrame({"node": list(up), "label": [root(n) for n in up]})

        linked = own.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(solve, "node long, label long")
    else:
        linked = connected_components(own)
    return nodes.select("node").join(linked.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the largest component; of equals that with the least label."""
    own = materialize(components(nodes, edges), "components")
    top = own.groupBy("label").count().agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("label"))
    return own.join(F.broadcast(top), "label", "left_semi")  # one row


def bfs_parents(edges: DataFrame, sources: DataFrame, small: int = SEARCHED, closed: DataFrame | None = None, deepest: int | None = None) -> DataFrame:
    """node, parent, depth of a first-in first-out search: sources queue by node, neighbours by node; sources have no parent.

    Nodes in ``closed`` (such as codes that stand for several rooms) are reached but nothing is reached through them. Edges and
    sources with a null are left out. ``deepest``: the search ends with the nodes of that depth; by default with the last node.
    """
    own = edges.select("a", "b").where("a is not null and b is not null").distinct()
    if closed is not None:
        own = own.join(closed.select(F.col("node").alias("a")).distinct(), "a", "left_anti")
    own, sources = materialize(own, "edges"), sources.where("node is not null")
    if own.count() <= small and sources.limit(small + 1).count() <= small:
        tagged = own.withColumn("s", F.lit(False)).unionByName(sources.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(True).alias("s")))

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes, ends = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
            link = ~pdf["s"].to_numpy(dtype=bool)
            a, b = ends[: len(pdf)], ends[len(pdf) :]
            order, first = _by_start(len(nodes), a[link], b[link])
            near = b[link][order].tolist()
            queue = np.unique(a[~link]).tolist()
            parent, depth = [-1] * len(nodes), [-1] * len(nodes)
            for at in queue:
                depth[at] = 0
            for at in queue:  # grows as it is read
                if deepest is not None and depth[at] >= deepest:
                    break
                for to in near[first[at] : first[at + 1]]:
                    if depth[to] < 0:
                        parent[to], depth[to] = at, depth[at] + 1
                        queue.append(to)
            via = np.array(parent)[queue]
            return pd.DataFrame({"node": nodes[queue], "parent": pd.Series(nodes[via]).astype("Int64").mask(via < 0), "depth": np.array(depth)[queue]})

        return tagged.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(solve, "node long, parent long, depth int")
    queue = with_numbers(sources.select("node").distinct(), "node", RANGE, [], "place")
    front = materialize(queue.select("node", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), F.col("place").cast("long").alias("place")), "front")
    parts = [front]
    seen = front.select("node")
    depth = 0
    while (deepest is None or depth < deepest) and front.limit(1).count():
        depth += 1
        step = front.select(F.col("node").alias("a"), "place").join(own, "a").join(seen.withColumnRenamed("node", "b"), "b", "left_anti")
        found = step.groupBy(F.col("b").alias("node")).agg(F.min_by("a", "place").alias("parent"), F.min("place").alias("__p"))
        queue = with_numbers(found, "__p", RANGE, ["node"], "place")
        front = materialize(queue.select("node", "parent", F.lit(depth).alias("depth"), F.col("place").cast("long").alias("place")), "front")
        parts.append(front)
        seen = seen.unionByName(front.select("node"))
        if depth % 10 == 0:
            seen = materialize(seen, "seen")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("node", "parent", "depth")


def route(edges: DataFrame, source: int, target: int, small: int = SEARCHED, below: float | None = None) -> DataFrame:
    """node, dist of the nodes on a shortest path from ``source`` to ``target``; of equal ways each node's least predecessor. No way (shorter than ``below``, if given): no rows.

    Predecessors are followed by doubling the steps, so rounds grow with the logarithm of the path's length.
    """
    own = edges.where("a is not null and b is not null and w is not null")
    dist = materialize(shortest_paths(own, source, small, below), "dist")
    near, far = dist.toDF("a", "da"), dist.toDF("b", "db")
    jump = materialize(own.join(near, "a").join(far, "b").where(F.col("da") + F.col("w") == F.col("db")).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "jump")
    on = materialize(dist.where(F.col("node") == target).select("node"), "on")
    n, was = on.count(), 0
    while n > was:
        was = n
        on = materialize(on.unionByName(on.join(jump, "node").select(F.col("up").alias("node"))).distinct(), "on")
        n = on.count()
        jump = materialize(jump.join(jump.toDF("up", "further"), "up").select("node", F.col("further").alias("up")), "jump")
    return dist.join(on, "node", "left_semi")


def cycles(chain: DataFrame) -> DataFrame:
    """k, cyclic (0 or 1), cycle: whether following ``via`` from ``k`` comes back to it, and after how many steps (null if never).

    Doubling the steps until they are as many as the nodes leaves the nodes of cycles as the only ends; a cycle is as long as
    its component of those has nodes. A null ``via`` ends a chain.
    """
    steps = jump = materialize(chain.where("k is not null and via is not null").select("k", "via"), "steps")
    n, made = steps.count(), 1
    while made < n:
        jump = materialize(jump.select("k", F.col("via").alias("__v")).join(jump.toDF("__v", "__w"), "__v").select("k", F.col("__w").alias("via")), "jump")
        made *= 2
    ends = jump.select(F.col("via").alias("k")).distinct()
    ring = materialize(steps.join(ends, "k", "left_semi"), "ring")
    labels = connected_components(ring.toDF("a", "b")).toDF("k", "label")
    of = materialize(ring.select("k").join(labels, "k", "left").select("k", F.coalesce("label", "k").alias("label")), "labels")
    long = of.join(of.groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("cycle")), "label").select("k", "cycle")
    return chain.select("k").join(long, "k", "left").select("k", F.col("cycle").isNotNull().cast("int").alias("cyclic"), "cycle")


def route_segments(path: DataFrame, group: str, order: str) -> DataFrame:
    """A path's runs on one level: level, points, length in the plane, and the levels climbed to reach it."""
    w = Window.partitionBy(group).orderBy(order)
    rows = path.withColumn("__was", F.lag("level").over(w)).withColumn("__dx", F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0))).withColumn("__dy", F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0)))
    rows = rows.withColumn("segment", F.sum(F.when(F.col("__was").eqNullSafe(F.col("level")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.sum(F.when(F.col("__was") == F.col("level"), F.hypot("__dx", "__dy")).otherwise(0.0))
    climb = F.sum(F.when(F.col("__was") != F.col("level"), F.abs(F.col("level") - F.col("__was"))).otherwise(0))
    return rows.groupBy(group, "segment").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("points"), F.round(length, 4).alias("length"), climb.alias("climb"))


def walk_minutes(distance, climb, speed: float = 1.25, per_level: float = 18.0):
    """Whole minutes, at least one: metres by speed and seconds per level."""
    return F.greatest(F.lit(1), F.ceil((distance / speed + climb * per_level) / 60)).cast("int")


def greedy_merge(cells: DataFrame, edges: DataFrame, target: float, slack: float = 0.03) -> DataFrame:
    """Regions grown one cell at a time from the least cell of each group towards a target area.

    ``cells``: grp, cell, area; ``edges``: grp, a, b. Each step takes the neighbour that brings the area nearest to the target
    (the least cell among equals) and stops when none does or the area is over by more than ``slack``. A group is one region's
    surroundings: bounded, and solved in one task.
    """
    both = cells.select("grp", F.col("cell").alias("a"), F.lit(None).cast("long").alias("b"), "area").unionByName(edges.select("grp", "a", "b", F.lit(0.0).alias("area")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["b"].isna()]
        area = dict(zip(own["a"], own["area"], strict=True))
        near = defaultdict(set)
        for a, b in pdf[~pdf["b"].isna()][["a", "b"]].astype("int64").itertuples(index=False):
            near[a].add(b)
        if not area:
            return pd.DataFrame({"grp": [], "cell": [], "step": []})
        took, total = [min(area)], area[min(area)]
        edge = set(near[took[0]]) & set(area)
        while edge:
            best = min(edge, key=lambda c: (abs(total + area[c] - target), c))
            if abs(total + area[best] - target) >= abs(total - target) or total + area[best] > target * (1 + slack):
                break
            took.append(best)
            total += area[best]
            edge = (edge | near[best]) & set(area) - set(took)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "cell": took, "step": range(len(took))})

    return both.groupBy("grp").applyInPandas(grow, "grp int, cell long, step int")
