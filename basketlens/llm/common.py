"""Helpers shared by the operators: table access, stored intermediate tables, text constants."""

from __future__ import annotations

import ctypes
import os
import sys
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.sources.loaders import run_dir

#: White space of the word rule ``[^\x20\x09-\x0D]+`` (space, tab, line feed, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the cluster's shared folder and read it back.

    Cuts the lineage: after the loss of an executor the files are read again
    instead of computing the steps before them once more.  The folder is the one
    that ``spark.checkpoint.dir`` names; every call takes a new one in this run's part of
    it, which ``loaders.drop_materialized_tables`` removes.
    """
    spark = df.sparkSession
    target = f"{run_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


#: Bytes of a worker's memo table; a full one is emptied.
MEMO_BYTES = 16 << 20
#: What an entry of a dict costs besides its key and value.
_ENTRY = 100


class Memo(dict):
    """A memo table of bounded bytes.  Python workers are used again and again: every map
    task empties all tables and gives its memory back when it ends (:func:`release`)."""

    tables: weakref.WeakSet = weakref.WeakSet()
    __hash__ = object.__hash__

    def __init__(self, limit: int = MEMO_BYTES):
        super().__init__()
        self.limit, self.used = limit, 0
        self.tables.add(self)

    def __reduce__(self):
        return Memo, (self.limit,)

    def put(self, key, value):
        self.used += sys.getsizeof(key) + sys.getsizeof(value) + _ENTRY
        if self.used > self.limit:
            self.clear()
        self[key] = value
        return value

    def clear(self):
        super().clear()
        self.used = 0


def release() -> None:
    """Empty the memo tables, give free Arrow and heap memory back to the machine."""
    for memo in list(Memo.tables):
        memo.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):            # another C library
        pass


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column in ``taken`` is called so."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(*columns: str) -> Column:
    """128 bits that tell rows apart by some columns; equal rows have equal keys."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema) -> DataFrame:
    """``df.mapInArrow``, with this package on the Python workers' path.

    Workers import the operators by name.  They inherit the driver's working folder
    only by chance; where the package lies at the same place on all machines this
    names it, elsewhere it is shipped with ``--py-files``.
    """
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in known:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, known), here])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)
