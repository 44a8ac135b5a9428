"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one Arrow batch. A batch is the unit held in a Python worker, so with long
#: texts the default of 10,000 rows would not bound its memory.
BATCH_ROWS = 512

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A-Z to a-z and nothing else: str.lower would also touch other letters.
ASCII_LOWER = {ord(c): ord(c) + 32 for c in UPPER}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def own_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first of wanted_1, wanted_2 … that no column of ``df`` has."""
    taken, name, i = {c.lower() for c in df.columns}, wanted, 0
    while name.lower() in taken:
        i += 1
        name = f"{wanted}_{i}"
    return name


_SIMPLE = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(),
           "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}


def columns(spec: str) -> T.StructType:
    """A schema from "name type, name type[]"; unlike DDL it can be read without a session, in a worker."""
    fields = []
    for part in filter(None, spec.split(",")):
        name, kind = part.split()
        kept = _SIMPLE[kind.removesuffix("[]")]
        fields.append(T.StructField(name, T.ArrayType(kept) if kind.endswith("[]") else kept))
    return T.StructType(fields)


def batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """A batch of the given Spark schema from Python lists or arrays."""
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)],
        schema=arrow)


def extend_rows(df: DataFrame, added: str, reads: list[str],
                work: Callable[[list[list]], tuple[list | None, list[list]]]) -> DataFrame:
    """All columns of ``df`` and the ``added`` ones, made batch by batch.

    ``work`` gets the values of the columns ``reads`` and returns (the row numbers to
    keep, or None for all; the new columns, for the kept rows).
    """
    extra = columns(added)
    schema = T.StructType(df.schema.fields + extra.fields)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for b in batches:
            keep, new = work([b.column(b.schema.get_field_index(c)).to_pylist() for c in reads])
            kept = b if keep is None else b.take(pa.array(keep, pa.int64()))
            old = [kept.column(i).cast(arrow.field(i).type) for i in range(kept.num_columns)]
            yield pa.RecordBatch.from_arrays(
                old + [pa.array(v, type=arrow.field(len(old) + i).type) for i, v in enumerate(new)],
                schema=arrow)

    return df.mapInArrow(run, schema)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def sorted_groups(batches, keys: int, most_rows: int):
    """(key, slices) of rows that come sorted by their first ``keys`` columns; a longer run comes in several."""
    held, size, at = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        values = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changes = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        bounds = [0, *changes.tolist(), b.num_rows]
        for a, z in zip(bounds, bounds[1:]):
            key = tuple(v[a] for v in values)
            if held and (key != at or size >= most_rows):
                yield at, held
                held, size = [], 0
            at = key
            held.append(b.slice(a, z - a))
            size += z - a
    if held:
        yield at, held


def numbers(slices: list[pa.RecordBatch], column: int) -> np.ndarray:
    return np.concatenate([s.column(column).to_numpy(zero_copy_only=False) for s in slices])


def vectors(slices: list[pa.RecordBatch], column: int) -> np.ndarray:
    """A column of equally long lists as unit rows in double precision."""
    flat = np.concatenate([s.column(column).flatten().to_numpy(zero_copy_only=False) for s in slices]).astype(np.float64)
    rows = flat.reshape(sum(s.num_rows for s in slices), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
