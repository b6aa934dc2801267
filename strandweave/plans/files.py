"""Single files in the session's file systems, written through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _path(spark, path)
    return store.exists(p)


def put_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file with a text that the driver has."""
    p, store = _path(spark, path)
    out = store.create(p, True)
    out.write(bytearray(content.encode()))
    out.close()


def single_file(lines: DataFrame, path: str, overwrite: bool = True) -> None:
    """One file with the lines of ``lines (value)`` in the order of the frame.

    Executors write part files; the driver appends one to the other as streams, so what it
    holds doesn't grow with the file.
    """
    spark = lines.sparkSession
    target, store = _path(spark, path)
    if store.exists(target):
        if not overwrite:
            raise FileExistsError(f"{path} exists already")
        store.delete(target, True)
    parts, _ = _path(spark, f"{path}.parts")
    lines.write.mode("overwrite").text(parts.toString())
    names = sorted(s.getPath().getName() for s in store.listStatus(parts) if s.getPath().getName().startswith("part-"))
    copy, out = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes, store.create(target, True)
    try:
        for name in names:
            source = store.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parts, name))
            copy(source, out, 1 << 16, False)
            source.close()
    finally:
        out.close()
    store.delete(parts, True)
