"""Cutting of lineage through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session of one process (``local[...]``) may lack it, and gets a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="hitweave-")


def durable(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; partitions and their order stay."""
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


def dealt_in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows sorted over all tasks: each task holds a range of them, written once, so that passes over it shuffle nothing.

    Range borders are sampled by Spark, so outliers and bursts get no larger ranges; only rows equal in all of ``order`` stay together.
    """
    return durable(rows.repartitionByRange(*order).sortWithinPartitions(*order))


def streamed(rows: DataFrame, schema: T.StructType, fold: Callable[[Iterator[tuple]], Iterator[tuple]], at_once: int = 4096) -> DataFrame:
    """The rows that ``fold`` makes of the rows of each task, in their order; a batch of them is held at a time."""
    arrow = to_arrow_schema(schema)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for row in fold(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
            made.append(row)
            if len(made) >= at_once:
                yield batch(made)
                made = []
        if made:
            yield batch(made)

    return rows.mapInArrow(run, schema)
