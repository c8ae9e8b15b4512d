"""Helpers shared by the training-data operators: shared folders, written tables, session settings."""

from __future__ import annotations

import gc
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.session import ship
from pagesieve.storage import shared_root

#: Rows in one Arrow batch. Texts can be long, so a batch must stay far below the default 10,000 rows.
ARROW_ROWS = 500
#: Bytes of text that a Python step handles at once; a longer single text is a step of its own.
STEP_BYTES = 8_000_000


def tune(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches so that a batch of long documents fits in a Python worker; send the package's sources."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and read it again: later steps neither recompute it nor lose it with an executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps now instead of at some later garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def crc_mod(col: str, mod: int):
    """crc32 of the id written as text, modulo ``mod`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % F.lit(mod)


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows (all of them if there are fewer), drawn by a hash of ``keys``."""
    n = df.count()
    if n <= rows:
        return df
    cut = int(rows / n * (1 << 30))
    return df.where((F.xxhash64(*[F.col(k) for k in keys]).bitwiseAND((1 << 30) - 1)) < cut)


# --- files that tasks write and read themselves -------------------------------------------------


def filesystem(path: str):
    """(file system, path in it) of a URI or a local path, for use inside tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def write_file(path: str, chunks) -> int:
    """Write a file whole or not at all: to a name of its own first, then move it. Returns its size."""
    fs, p = filesystem(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    part, size = f"{p}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(part, compression=None) as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    fs.move(part, p)
    return size


def read_file(path: str) -> bytes:
    fs, p = filesystem(path)
    with fs.open_input_stream(p, compression=None) as f:
        return f.read()


def small_steps(batches, columns: list[str]):
    """Slices of record batches with at most STEP_BYTES of text in ``columns`` (or one row), in the same order."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        n = b.num_rows
        size = np.zeros(n, dtype=np.int64)
        for c in columns:
            a = b.column(b.schema.get_field_index(c))
            if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) or pa.types.is_binary(a.type):
                size += pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < n:
            end = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), STEP_BYTES, side="right")))
            yield b.slice(at, end - at)
            at = end


def with_columns_from_arrow(df: DataFrame, fn, inputs: list[str], fields, keep: list[str] | None = None) -> DataFrame:
    """Append columns that ``fn(dict of pyarrow arrays) -> list of pyarrow arrays`` computes batch by batch.

    ``fields`` are the StructFields it appends. Columns of the input with the same name (in any case) are
    replaced. ``keep`` limits the columns that pass through Python.
    """
    from pyspark.sql import types as T

    new = {f.name.lower() for f in fields}
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in new]
    need = [c for c in inputs if c not in kept]
    n_keep = len(kept)
    src = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], *[F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(need)])
    where = {c: (f"k{kept.index(c)}" if c in kept else f"i{need.index(c)}") for c in inputs}
    schema = T.StructType([T.StructField(f"k{i}", src.schema[f"k{i}"].dataType) for i in range(n_keep)] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)])

    def run(batches):
        import pyarrow as pa

        for b in small_steps(batches, [where[c] for c in inputs]):
            cols = {c: b.column(b.schema.get_field_index(w)) for c, w in where.items()}
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], *fn(cols)], names=schema.names)

    got = src.mapInArrow(run, schema)
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"n{i}").alias(f.name) for i, f in enumerate(fields)])
