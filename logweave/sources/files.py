"""Small files and whole folders of a shared file system, put in place in one step."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def _move(spark: SparkSession, source: str, target: str, replace: bool) -> bool:
    """Rename in one step; False where the target is there and is not to be replaced."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    _, a = _system(spark, source)
    system, b = _system(spark, target)
    context = hadoop.FileContext.getFileContext(system.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").valueOf("OVERWRITE" if replace else "NONE")
    try:
        context.rename(a, b, options)
    except Exception as error:
        if not replace and exists(spark, target):
            return False
        raise error
    return True


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _system(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    system, at = _system(spark, path)
    system.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where there is none."""
    if not exists(spark, path):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside ``path`` and let it take that place: readers see the old or the new one."""
    beside = f"{path}.{uuid.uuid4().hex}"
    system, at = _system(spark, beside)
    stream = system.create(at, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    _move(spark, beside, path, replace=True)


def publish(spark: SparkSession, folder: str, path: str) -> bool:
    """Let a whole folder take its place, unless one is there already: then ``folder`` is deleted, and the answer is False."""
    if _move(spark, folder, path, replace=False):
        return True
    delete(spark, folder)
    return False
