"""Helpers shared by the corpus operators: tables, shared files, row keys."""

from __future__ import annotations

import gc
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, shared_dir, table  # noqa: F401  the operators take them from here

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans whose results are already written.

    The cleaner acts on what the driver's collector finds unreachable; a large driver heap may
    not be collected for half an hour, in which the files of every earlier step stay on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Columns of ``row_keys``.
KEYS = ("k1", "k2")


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two longs (128 bits) that name a row by its id and text; equal rows have equal results, so they may share them."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias(KEYS[0]), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias(KEYS[1])]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Both as one struct, which joins, groups and sorts like a single column."""
    return F.struct(*row_keys(id_col, text_col))


KEY_TYPE = "struct<k1: long, k2: long>"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(doc_id: str | int | None, mod: int = 3) -> int:
    """crc32 of the id as text modulo ``mod``; a missing id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(batches, rows: int = 512):
    """Smaller record batches, so that what Python holds at once stays bounded."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
