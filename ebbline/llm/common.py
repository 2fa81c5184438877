"""Helpers that several operators share: reading, ordering by key, shared folders, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..scratch import shared_dir, written

__all__ = ["batches", "bounded_batches", "bucket_of", "crossed_out", "key_bounds", "put_file", "shared_dir", "shuffle_parts", "table", "trim_memory", "written"]


#: Bytes of a batch that goes to a Python worker, where the session has Spark's own bound.
BATCH_BYTES = 8 << 20
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches from Spark's 64 MB to BATCH_BYTES; another bound stays. Whole texts fill batches, of which an executor holds several."""
    if spark.conf.get(_BATCH) == _SPARKS_OWN:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(stream: Iterator[pa.RecordBatch], limit_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each piece holds about limit_bytes; one long row stays whole."""
    for batch in stream:
        n = batch.num_rows
        if n == 0:
            continue
        step = max(1, int(n * limit_bytes / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def trim_memory() -> None:
    """Hands memory that this process has freed back to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def bucket_of(bounds: list[int]):
    """Pandas UDF: the number of bounds at or below the key, less one; 0 for nulls and smaller keys."""
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        known = key.notna().to_numpy()
        out = np.zeros(len(key), dtype=np.int32)
        if known.any():
            values = key[known].astype("int64").to_numpy()
            out[known] = np.maximum(np.searchsorted(edges, values, side="right") - 1, 0)
        return pd.Series(out)

    return bucket


def key_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending distinct keys of df that start at most ``parts`` ranges of about equal size.

    The first is the smallest key. Each bound is a key that occurs, so range i begins
    with the rows of bounds[i]. One small row reaches the driver.
    """
    shares = [i / parts for i in range(1, parts)] or [0.5]
    row = df.select(F.col(key).cast(LongType()).alias("k")).agg(F.min("k"), F.percentile_approx("k", shares, 20000)).first()
    if row[0] is None:
        return []
    near = sorted(set(row[1] or [])) if parts > 1 else []
    # quantiles are doubles, so large keys are rounded: each becomes the first key from it on
    exact = df.select(F.col(key).cast(LongType()).alias("k")).agg(*[F.min(F.when(F.col("k") >= b, F.col("k"))) for b in near]).first() if near else []
    return sorted({row[0], *(b for b in exact if b is not None)})


def crossed_out(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of df, in order, whatever the case or number of the others."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def local_path(uri: str):
    """(pyarrow file system, path) for a URI or plain path of the shared folder."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Writes a file whole or not at all: a retried or doubled task leaves the same bytes."""
    filesystem, path = local_path(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    scratch = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(scratch) as out:
        out.write(data)
    filesystem.move(scratch, path)
