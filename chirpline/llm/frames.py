"""Small helpers the operators share: Arrow maps over texts, written steps, free column names."""

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chirpline.session import run_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and lost executors cost no recomputation."""
    path = run_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back():
    """Memory that this process has freed but still holds goes back to the system; a worker lives on beside the JVM and others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, make, schema: T.StructType) -> DataFrame:
    """Rows of ``make()(batch)`` for every Arrow batch of the frame.

    ``make`` runs once in a task and returns a function from a record batch to
    an iterator of dictionaries of columns.
    """
    target = to_arrow_schema(schema)

    def run(batches):
        step = make()
        for batch in batches:
            for columns in step(batch):
                arrays = [pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type)
                          for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def doc_schema(*fields: tuple[str, str], id_type: T.DataType | None = None, id_name: str = "doc_id") -> T.StructType:
    own = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    return T.StructType([T.StructField(id_name, id_type or T.LongType()), *own.fields])


def lists(values, counts, kind):
    """An Arrow list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text under fixed names, whatever other columns there are; a text column of another type is cast."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
