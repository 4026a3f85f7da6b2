"""Small files through the file system the session writes to.

Whatever store holds the tables holds these files too; nothing here opens a local path.
Creating a file once and renaming over a file are single steps on HDFS.  A local file
system looks first and creates then, which is enough for tests on one machine.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from wayside.session import scratch_path


def _opened(spark: SparkSession, path: str):
    """The path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, system = _opened(spark, path)
    return system.exists(target)


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder was committed."""
    return path_exists(spark, f"{path}/_SUCCESS")


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none where it does not exist."""
    target, system = _opened(spark, folder)
    if not system.exists(target):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(target))


def data_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(subfolder, name) of the files of a partitioned write, one level deep."""
    target, system = _opened(spark, folder)
    found = []
    for status in system.listStatus(target) if system.exists(target) else []:
        if status.isDirectory():
            names = (s.getPath().getName() for s in system.listStatus(status.getPath()))
            found += [(status.getPath().getName(), n) for n in names if n[0] not in "._"]
    return sorted(found)


def modified(spark: SparkSession, path: str) -> float:
    """Seconds since 1970."""
    target, system = _opened(spark, path)
    return system.getFileStatus(target).getModificationTime() / 1000


def _write(system, target, text: str) -> None:
    out = system.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_new(spark: SparkSession, path: str, content: dict) -> bool:
    """Create a file; false where it exists."""
    target, system = _opened(spark, path)
    try:
        _write(system, target, json.dumps(content))
    except Py4JJavaError:
        if system.exists(target):
            return False
        raise
    return True


def write_over(spark: SparkSession, path: str, content: dict) -> None:
    """Replace a file in one step: readers find the old content or the new."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    source, system = _opened(spark, fresh)
    target, _ = _opened(spark, path)
    _write(system, source, json.dumps(content))
    options = spark._jvm.org.apache.hadoop.fs.Options
    chosen = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    chosen[0] = getattr(options, "Rename").OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        system.getUri(), spark._jsc.hadoopConfiguration()
    )
    context.rename(source, target, chosen)


def read_content(spark: SparkSession, path: str) -> dict | None:
    """None where the file does not exist, or is created but not written yet."""
    target, system = _opened(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file, making the folder it goes to."""
    old, system = _opened(spark, source)
    new, _ = _opened(spark, target)
    system.mkdirs(new.getParent())
    if not system.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    target, system = _opened(spark, path)
    system.delete(target, True)


# How Parquet files of passages are packed.
PACKED = ("compression", "zstd")


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """The finished rows, as Parquet in the shared folder until the end of the block.

    For rows that are read several times: they take a fraction of what they would as
    cached rows, outlive their executors, and a reader of few columns reads only these.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    try:
        df.write.option(*PACKED).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)
