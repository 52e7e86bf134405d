"""Small texts (status, manifests, reports, configurations) in any file system that the session reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(path: str) -> bool:
    at, fs = _at(path)
    return fs.exists(at)


def read_text(path: str) -> str:
    at, fs = _at(path)
    stream = fs.open(at)
    try:
        return bytes(SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Writes beside the file and renames, so that a reader never sees half of it."""
    at, fs = _at(path)
    part, _ = _at(path + ".part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"{path} could not be written")
