"""What several operators share: cut lineage, connected components, Arrow helpers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from quarrylens.operators.graph import connected as components
from quarrylens.operators.lineage import cut, shared_dir

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "components", "cut", "map_batches", "share", "shared_dir", "slices"]

#: Rows, and bytes of text, that Python functions handle at once; a text that is longer is handled alone.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in order, in slices of BATCH_ROWS rows and BATCH_BYTES bytes of texts, binaries and lists at most, or of one row."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            size += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at = done = 0
    while at < batch.num_rows:
        stop = max(at + 1, min(at + BATCH_ROWS, int(np.searchsorted(total, done + BATCH_BYTES, side="right"))))
        yield batch.slice(at, min(stop, batch.num_rows) - at)
        at = min(stop, batch.num_rows)
        done = total[at - 1]


def share(spark: SparkSession, thing: object) -> Callable[[], object]:
    """Broadcasts an object of bounded size with its class; each task unpacks it once."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    made: list = []

    def get() -> object:
        if not made:
            made.append(pickle.loads(sent.value))
        return made[0]

    return get


def map_batches(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list | pa.Array]], schema: str) -> DataFrame:
    """Apply a function of Python column lists to slices of bounded size; ``schema`` is a DDL string."""
    spark = df.sparkSession
    want = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(want)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
