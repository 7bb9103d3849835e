"""Helpers shared by the operators of this subpackage.

Conventions that hold for every operator here:

* Operators read text whole. A null text counts as the empty text unless a docstring says otherwise.
* ``carry`` names the input columns that an operator hands on. A column that the operator adds replaces
  a carried column of the same name, so inputs with clashing names give one defined result.
* Python code runs as Arrow batches (``mapInArrow``, ``applyInPandas``); nothing keeps a whole table in one task.
"""

from __future__ import annotations

import gc
import os
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that Python code gets at once, so that results do not pile up for a whole batch.
PART_BYTES = 4_000_000


def let_workers_import(spark: SparkSession) -> None:
    """Put this package's folder on the path of the session's Python workers.

    It serves sessions whose working directory is elsewhere; on a cluster without that folder the package is shipped
    or installed like any other.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def fold_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; null for a null id, which is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def is_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for ids in that fold; a null id is in no fold and gives false."""
    return F.coalesce(fold_id(doc_id, modulus) == remainder, F.lit(False))


def not_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for ids outside that fold; a null id gives false, so it is neither held out nor learned from."""
    return F.coalesce(fold_id(doc_id, modulus) != remainder, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without one, as in a test, gets a folder of its own, which goes when Python ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import atexit
            import shutil
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The data survive lost executors, unlike a local checkpoint or a cache.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder, and its path, for :func:`drop_table` when it has served."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Keys that may be broadcast for their many rows: those with over 1 / HOT_KEYS of all rows, so fewer than HOT_KEYS.
HOT_KEYS = 500
HOT_ROWS = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each ``key`` once and in ``n`` how many of the ``total`` rows of ``left`` have it.

    A key with more than its share of rows would be one task's work. There are fewer than ``HOT_KEYS`` of these, as their
    rows add up to no more than all; their rows of ``right`` are broadcast, and the others are joined by a shuffle. Tables
    too small to have such keys are joined plainly. A key that is null has no match, and the result is without ``n``.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if total <= 20 * HOT_ROWS:
        return left.join(right.drop(n), key)
    hot = right.where(F.col(n) > limit).drop(n)
    few = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(right.where(F.col(n) <= limit).drop(n), key)
    return few.unionByName(rest)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column in one array, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    bounds = bounds[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes together (one row at least), to bound working memory."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, end
        start = end


def in_parts(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about ``most`` bytes together, one row at least."""
    step = max(1, batch.num_rows * most // max(most, batch.nbytes))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def give_back() -> None:
    """Return memory that a task has freed to the system; workers serve later tasks and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        import ctypes

        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim is not None:
            trim(0)


def add_columns(
    df: DataFrame,
    carry: Iterable[str],
    inputs: Iterable[str],
    added: T.StructType,
    compute: Callable[[], Callable[[list[pa.Array]], list[Any]]],
) -> DataFrame:
    """``carry`` columns of ``df`` and the columns ``added``, which Python computes batch by batch.

    ``compute()`` runs once in each task and gives the function from the arrays of ``inputs`` to the new
    columns' values. Columns of ``carry`` that ``added`` names are replaced.
    """
    let_workers_import(df.sparkSession)
    names = {f.name.lower() for f in added}
    kept = [c for c in dict.fromkeys(carry) if c.lower() not in names]
    inputs = list(inputs)
    wanted = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)]
    wanted += [F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)]
    kept_fields = [T.StructField(c, df.schema[c].dataType, True) for c in kept]
    schema = T.StructType(kept_fields + list(added))
    n_kept = len(kept)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    out_types = [target.field(n_kept + i).type for i in range(len(added))]
    out_names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute()
        for batch in batches:
            for part in in_parts(batch):
                columns = part.columns
                results = function(columns[n_kept:])
                arrays = list(columns[:n_kept])
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(results, out_types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=out_names)
        give_back()

    return df.select(*wanted).mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
