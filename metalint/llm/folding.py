"""Partial states of map tasks, added up in rounds of bounded groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalint.llm.common import cut

FAN_IN = 32


def folded(pieces: DataFrame, key: str, add: Callable[[bytes | None, bytes], bytes]) -> DataFrame:
    """(key, piece, state): one row per key, the sum of all states of pieces (key long, piece long, state binary).

    add gives the sum of a running state (None at first) and one more. A round adds up to FAN_IN states of a key in a
    task, one after another, so no task holds more than two states; the rounds are the logarithm of the number of
    pieces, which are numbered from 0. No pieces give no row.
    """

    def run(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for state in batch.column("state"):
                total = add(total, state.as_py())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k.as_py()], pa.int64()) for k in keys] + [pa.array([total], pa.binary())], names=[key, "piece", "state"])

    pieces = cut(pieces)
    last = pieces.agg(F.max("piece")).first()[0]
    while last:
        last //= FAN_IN
        pieces = cut(pieces.withColumn("piece", F.expr(f"piece div {FAN_IN}")).groupBy(key, "piece").applyInArrow(
            run, f"{key} long, piece long, state binary"))
    return pieces
