"""SHA-256 of files of any size: a task streams a file through in chunks, many files run side by side.

No file is ever held whole, in a cell or in memory, so files beyond 2 GiB are hashed like small ones.
Files are opened by pyarrow, in the task; a store pyarrow can't open is an error, not a wrong hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

CHUNK = 8 << 20


def _opened(path: str):
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:") :]
    fs, place = pafs.FileSystem.from_uri(path)
    return fs.open_input_stream(place)


def digest(path: str, chunk: int = CHUNK) -> tuple[int, str]:
    """Size and hash of one file."""
    size, state = 0, hashlib.sha256()
    with _opened(path) as stream:
        while data := stream.read(chunk):
            size += len(data)
            state.update(data)
    return size, state.hexdigest()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files of a folder or pattern, empty ones too; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()
    return spark.createDataFrame([(unquote(f),) for f in found], "path string")


def file_hashes(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, bytes, sha256) of each (path) row; the largest files are dealt first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                size, sha = digest(path, chunk)
                yield pd.DataFrame({"path": [path], "bytes": [size], "sha256": [sha]})

    # one file a partition where there are few, so that large ones do not queue behind each other
    count = files.count()
    dealt = files.select("path").repartition(max(1, min(count, 10_000)), "path")
    return dealt.mapInPandas(run, "path string, bytes bigint, sha256 string")
