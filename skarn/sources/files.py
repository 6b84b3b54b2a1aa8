"""Small files beside the tables, on whatever file system the path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Move a folder to a place where nothing stands."""
    p, fs = _fs(spark, old)
    q, _ = _fs(spark, new)
    if fs.exists(q):
        raise FileExistsError(new)
    return fs.rename(p, q)


def list_names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p, fs = _fs(spark, path)
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it over what stands there, in one step: a reader sees the old text or the new."""
    write_bytes(spark, path + ".tmp", text.encode())
    jvm = spark._jvm
    p, q = (_fs(spark, x)[1].makeQualified(_fs(spark, x)[0]) for x in (path + ".tmp", path))
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(q.toUri(), spark._jsc.hadoopConfiguration()).rename(p, q, over)
