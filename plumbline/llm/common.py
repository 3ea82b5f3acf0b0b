"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.runtime import discard, materialize, ship, spread

__all__ = ["arrow_map", "discard", "let", "materialize", "picked", "release_memory", "ship", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; also makes the package importable on the executors, and keeps Arrow batches of texts small.

    A small table in one file is dealt over all cores, as its scan would be one task.
    """
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default, meant for narrow rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can never clash with working names."""
    return df.select(*names)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    A lambda variable binds the value; a plain reference inside a
    higher-order function would be evaluated again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, Iterable] | None]], schema: str, keep_caches: bool = False) -> DataFrame:
    """``mapInArrow`` with dicts of column lists; ``make`` is called once in each task and gives the batch function."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_caches:
            release_memory(caches=True)
        call = make()
        for batch in batches:
            for part in _small(batch):
                out = call({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)
        release_memory()

    return df.mapInArrow(run, struct)


#: Caches that an operator keeps in a Python worker between its own tasks. Tasks of other operators empty them.
WORKER_CACHES: list[dict] = []


def release_memory(caches: bool = False) -> None:
    """Gives freed memory back to the system: Python workers live on, and share the executor's memory with what runs next."""
    if caches:
        for cache in WORKER_CACHES:
            cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: Bytes of Arrow data that are turned into Python objects at a time.
SLICE_BYTES = 4 << 20


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch, so that a batch of long texts is not held as Python objects all at once."""
    n = batch.num_rows
    step = max(1, n * SLICE_BYTES // max(batch.nbytes, 1))
    for at in range(0, n, step):
        yield batch.slice(at, step)
