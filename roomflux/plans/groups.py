"""Groups solved one after another in Arrow batches, dealt over as many tasks as the session's shuffles have."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` shuffled by ``keys``; the number of tasks is given, so that few bytes with much work are not gathered in few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def solved(df: DataFrame, keys: list[str], solve: Callable[[dict[str, np.ndarray]], Iterator[dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """What ``solve`` gives for the rows of each group (arrays by column), piece by piece; a group's rows are held, its results are not."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                group = {c: np.concatenate([h[c] for h in held]) for c in names}
                held.clear()
                for out in solve(group):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], names=list(out))

        for b in batches:
            rows = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            new = np.zeros(max(0, b.num_rows - 1), bool)
            for c in keys:
                new |= rows[c][1:] != rows[c][:-1]
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    key = tuple(rows[c][lo] for c in keys)
                    if key != last:
                        yield from close()
                        last = key
                    held.append({c: v[lo:hi].copy() for c, v in rows.items()})
        yield from close()

    return dealt(df, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def ranges(low: np.ndarray, high: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (k, place) with low[k] <= place < high[k], about ``most`` at a time."""
    n = np.maximum(high - low, 0)
    upto = np.cumsum(n)
    at, done = 0, 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(upto, done + most, "right")))
        own = n[at:end]
        k = np.repeat(np.arange(at, end), own)
        first = np.repeat(upto[at:end] - own - done, own)
        if len(k):
            yield k, low[k] + np.arange(len(k)) - first
        at, done = end, int(upto[end - 1])
