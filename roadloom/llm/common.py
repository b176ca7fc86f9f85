"""Helpers that the corpus operators share: shared storage, column hygiene, Arrow text access."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest run of text bytes, and of rows, that one vectorised step handles; temporaries take about 30 bytes a byte.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 1024


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the one that the cluster shares (spark.checkpoint.dir); gone when the application ends.

    Where the setting is missing, a single-machine session uses its temporary folder and any other raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"file://{tempfile.gettempdir()}/roadloom-shared"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there and survives lost executors."""
    return stored_at(df, shared_dir(df.sparkSession, label))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def with_fact(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int | None = None) -> DataFrame:
    """rows joined with the one fact of their key; `count` says how many rows a fact has. facts are stored.

    Keys with more than a 1024th of all rows are at most 1023, whatever the table: their facts are broadcast, so that their
    rows stay where they are. The others are joined by a shuffle. total: of all rows, or more, where that is known.
    """
    total = (facts.agg(F.sum(count)).first()[0] or 0) if total is None else total
    often = F.col(count) * 1024 > total
    hot = F.broadcast(facts.where(often))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(~often), key)
    return rest.unionByName(rows.join(hot, key))


def trim() -> None:
    """Hands what this Python worker has freed back to the system: an idle worker keeps none of its last task's memory."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc
    if free:
        free(0)


def trimmed(f: Callable) -> Callable:
    """A function for mapInArrow that trims when its partition ends."""

    def run(batches):
        yield from f(batches)
        trim()

    return run


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_crc(name: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def append(docs: DataFrame, *columns: Column, names: list[str]) -> DataFrame:
    """docs plus named result columns; an input column of a result's name (in any case) gives way to it."""
    taken = {n.lower() for n in names}
    keep = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken]
    return docs.select(*keep, *(c.alias(n) for c, n in zip(columns, names, strict=True)))


def append_struct(docs: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    """docs plus the named fields of a struct column, evaluated once."""
    held = docs.withColumn("__result", struct)
    taken = {n.lower() for n in names} | {"__result"}
    keep = [held[f"`{c}`"] for c in held.columns if c.lower() not in taken]
    return held.select(*keep, *(held["__result"][n].alias(n) for n in names))


def chunks(text: pa.Array, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of whole rows of about `limit` bytes and `rows` rows at most; null reads as empty."""
    arr = pc.fill_null(text.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return
    buffers = arr.buffers()
    offs = np.frombuffer(buffers[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
