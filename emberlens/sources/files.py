"""Bytes of files that tasks read and write, in any store that the local file system or pyarrow opens."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.session import ship_package

#: Bytes of a file that a task holds while it goes over it.
WINDOW = 4 << 20


def opened(path: str) -> Callable[[int, int], bytes] | None:
    """A reader (offset, length) of a file, or None if its store can't be opened from here."""
    try:
        if (urlparse(path).scheme or "file") == "file":
            f = open(unquote(urlparse(path).path), "rb")  # noqa: SIM115
        else:
            store, at = pyarrow.fs.FileSystem.from_uri(path)
            f = store.open_input_file(at)
    except (OSError, ValueError, pa.ArrowException):
        return None

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        out = f.read(n)
        if len(out) < n:
            raise ValueError("a record ends behind the file")
        return out

    return read


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths, sizes = b.column("path").to_pylist(), b.column("length").to_pylist()
        out = []
        for path, size in zip(paths, sizes, strict=True):
            read = opened(path)
            if read is None:
                out.append(None)
                continue
            digest = hashlib.sha256()
            for at in range(0, size, WINDOW):
                digest.update(read(at, min(WINDOW, size - at)))
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(out, pa.string())], ["path", "length", "sha256"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 (lowercase hex) of the bytes of all files below a path.

    A task goes over each file in windows, whatever its size. Files in stores that only Spark opens are read as one
    binary value, up to what such a value holds. Files without bytes have no row, as Spark doesn't list them.
    """
    ship_package(spark)
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = d.select("path", "length")
    n = min(max(1, files.count()), 8 * spark.sparkContext.defaultParallelism)
    read = files.repartition(n, "path").mapInArrow(_digests, "path string, length long, sha256 string")
    rest = read.where("sha256 is null").select("path")
    return read.where("sha256 is not null").unionByName(d.join(rest, "path", "left_semi").select("path", "length", F.sha2("content", 256).alias("sha256")))


def _writing(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = (urlparse(folder).scheme or "file") == "file"
        root = unquote(urlparse(folder).path)
        store = None
        if not local:
            store, root = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("data").to_pylist(), strict=True):
                path = f"{root}/{name}"
                # written under a name of its own and renamed, so that a repeated task leaves one whole file
                own = f"{path}.{os.urandom(8).hex()}.part"
                if local:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(own, "wb") as f:
                        f.write(data)
                    os.replace(own, path)
                else:
                    store.create_dir(os.path.dirname(path), recursive=True)
                    with store.open_output_stream(own) as f:
                        f.write(data)
                    store.move(own, path)
            yield pa.RecordBatch.from_arrays([b.column("name")], ["name"])

    return run


def write_files(files: DataFrame, folder: str) -> int:
    """Write files (name, data binary), a name may hold folders, below a folder, each by the task that has its row.

    Gives how many there were. Of rows that repeat a name the last one written stays; a null name is an error.
    """
    ship_package(files.sparkSession)
    return files.select(F.coalesce("name", F.raise_error(F.lit("a file without a name"))).alias("name"), F.coalesce("data", F.lit(b"")).alias("data")).mapInArrow(_writing(folder), "name string").count()
