"""Batches that Python workers take at a time, bounded in rows and in bytes, so that memory does not follow the longest texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows and bytes of text that a worker takes at a time; one longer text is taken alone.
ROWS = 256
BYTES = 4 << 20
#: Bytes of an Arrow batch, in sessions that leave it at Spark's default.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, BATCH_DEFAULT = "8m", "67108864b"


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, whose session sends it to Python in batches of ``BATCH_BYTES`` from now on."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH, BATCH_BYTES)
    return docs


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Each batch in parts of ``ROWS`` rows and ``BYTES`` bytes of ``column`` at most."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(upto, upto[at] + BYTES, side="right")) - 1
            end = min(max(end, at + 1), at + ROWS, b.num_rows)
            yield b.slice(at, end - at)
            at = end
