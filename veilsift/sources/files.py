"""Files in and results out."""

from __future__ import annotations

import os
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import upload_reason

Target = bytes | str | os.PathLike | IO


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``doc_id, filename, content`` of the files under ``path``; the id is the path's hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def target_documents(spark: SparkSession, *targets: Target, default: str = "document.pdf") -> DataFrame:
    """``doc_id, filename, content`` of a few targets at hand: bytes, paths or open files.

    The id is the target's place.  What an open file gives as text counts as UTF-8.  Folders and
    large collections go through ``binary_documents``.
    """

    def one(target: Target) -> tuple[str, bytes]:
        if isinstance(target, (bytes, bytearray, memoryview)):
            return default, bytes(target)
        if isinstance(target, (str, os.PathLike)):
            path = Path(target)
            return path.name, path.read_bytes()
        if hasattr(target, "read"):
            held = target.read()
            name = os.path.basename(str(getattr(target, "name", "") or "")) or default
            return name, held.encode() if isinstance(held, str) else bytes(held)
        raise TypeError(f"neither bytes nor a path nor a file: {type(target).__name__}")

    return spark.createDataFrame([(i, *one(t)) for i, t in enumerate(targets)], "doc_id long, filename string, content binary")


def encoded(files: DataFrame, column: str = "content") -> DataFrame:
    """``files`` with ``content_base64``, one line, for senders of text."""
    return files.withColumn("content_base64", F.replace(F.base64(column), F.lit("\r\n"), F.lit("")))


def validated(files: DataFrame, most: int | None = 15 << 20) -> DataFrame:
    """``files`` with the ``reason`` for which each is refused, null if it is not."""
    return files.withColumn("reason", upload_reason(F.col("filename"), F.col("content"), most))


def write_results(results: DataFrame, path: str, kind: str = "parquet") -> None:
    results.write.mode("overwrite").format(kind).save(path)
