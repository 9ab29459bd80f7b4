"""Row-to-rows Python kernels over Arrow batches, for what no built-in expression can say."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


SMALL = 128 << 20  # bytes for each core below which a table may lie in too few row groups to keep all cores busy


def spread(df: DataFrame) -> DataFrame:
    """A small table spread over all cores before a kernel that takes long for each row; a large one stays where it is.

    What is moved is bounded by SMALL bytes a core; which rows come out doesn't change.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(4 * cores, F.xxhash64(*df.columns)) if size < SMALL * cores else df


def flat_map(df: DataFrame, kernel: Callable[..., Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """Each row of *df*, given to *kernel* as positional values, becomes the tuples it yields.

    Works batch by batch on Arrow columns, so no row is pickled and a partition
    is never held as a whole.
    """
    spec = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.extend(kernel(*row))
                if len(out) >= 4096:
                    yield _batch(out, target)
                    out = []
            if out:
                yield _batch(out, target)

    return df.mapInArrow(run, spec)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
