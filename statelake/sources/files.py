"""File listings and byte streams."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

# what Spark's binaryFile source delivers; a stream needs it spelled out
FILES = "path string, modificationTime timestamp, length long, content binary"


def list_files(
    spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False, required: bool = False
) -> DataFrame:
    """(path, modificationTime, length, content) of files; contents are only read when `content` is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    if required and files.select("path").isEmpty():
        raise FileNotFoundError(f"no {glob or 'file'} in {path}")
    return files


def refuse_used(spark: SparkSession, path: str) -> None:
    """An error if `path` exists: what an earlier writer left there would be read with the new files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        raise FileExistsError(f"{path} exists: write into a folder of its own")


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that tasks open a path with, and the path in it."""
    local = re.sub("^file:/+", "/", path)
    if local.startswith("/"):
        return pafs.LocalFileSystem(), local
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def open_for_read(path: str):
    """Sequential byte stream, opened inside a task."""
    system, name = resolve(path)
    return system.open_input_stream(name, compression=None)


def open_random(path: str):
    """Random-access byte source, opened inside a task."""
    system, name = resolve(path)
    return system.open_input_file(name)


@contextmanager
def replacing(path: str):
    """Byte sink of a task attempt that becomes `path` when it is complete, so no reader or other attempt sees a part."""
    system, name = resolve(path)
    folder, base = name.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{base}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(part, compression=None) as sink:
        yield sink
    system.move(part, name)


def exists(path: str) -> bool:
    system, name = resolve(path)
    return system.get_file_info(name).type == pafs.FileType.File


def write_text(spark: SparkSession, path: str, pieces: Iterator[str]) -> None:
    """One UTF-8 text file by Spark's file system: written aside, then put in its place."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    stream, held, size = system.create(part, False), [], 0
    for piece in pieces:
        held.append(piece.encode())
        size += len(held[-1])
        if size > 1 << 20:
            stream.write(bytearray(b"".join(held)))
            held, size = [], 0
    stream.write(bytearray(b"".join(held)))
    stream.close()
    system.delete(place, False)
    if not system.rename(part, place):
        raise OSError(f"{path} was not written")


def _whole_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open_for_read(path) as stream:
                yield pa.record_batch([pa.array([stream.read().decode("utf-8")])], names=["value"])


def manifest_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of one manifest file. Spark's own readers hide names that start with an underscore."""
    return spark.createDataFrame([(path,)], "path string").mapInArrow(_whole_text, "value string")
