"""Readers, and which of them a path is for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from strandweave.model import PropertyGraph

_RDF = (".nt", ".ttl", ".turtle", ".rdf", ".owl")


def _names(spark: SparkSession, path: str) -> list[str]:
    """What lies at a path: the names in a folder, or the file's own."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(p):
        raise FileNotFoundError(f"no such path: {path}")
    return sorted(s.getPath().getName() + "/" * s.isDirectory() for s in store.listStatus(p))


def _is_jsonld(spark, path, names):
    return "ro-crate-metadata.json" in names


def _is_rdf(spark, path, names):
    return any(n.lower().endswith(_RDF) for n in names)


def _is_sql(spark, path, names):
    return any(n.lower().endswith(".sql") for n in names)


def _is_tables(spark, path, names):
    return any(n.lower().endswith(".csv") for n in names)


def _is_markdown(spark, path, names):
    from strandweave.sources import markdown

    return markdown.is_bundle(spark, path, names)


def _is_folder(spark, path, names):
    return names != [path.rstrip("/").rpartition("/")[2]]


def _reader(module: str, function: str = "read"):
    def read(spark: SparkSession, path: str, **options) -> PropertyGraph:
        from importlib import import_module

        return getattr(import_module(f"strandweave.sources.{module}"), function)(spark, path, **options)

    return read


#: In the order in which they are tried.
_READERS: list[tuple[str, Callable, Callable]] = [
    ("jsonld", _is_jsonld, _reader("jsonld")),
    ("rdf", _is_rdf, _reader("rdf")),
    ("sql", _is_sql, _reader("sqldump")),
    ("csv", _is_tables, _reader("tabular", "read_csv")),
    ("markdown", _is_markdown, _reader("markdown")),
    ("folder", _is_folder, _reader("folder")),
]


def register_reader(name: str, can_read: Callable, read: Callable) -> None:
    """A reader of one's own, tried before the others: ``can_read(spark, path, names)``, ``read(spark, path)``."""
    _READERS.insert(0, (name, can_read, read))


def reader_for(spark: SparkSession, path: str, readers: list[str] | None = None) -> str:
    names = _names(spark, path)
    for name, can_read, _ in _READERS:
        if (readers is None or name in readers) and can_read(spark, path, names):
            return name
    raise ValueError(f"no reader for {path}")


def read(spark: SparkSession, path: str, *, format: str | None = None, readers: list[str] | None = None, **options) -> PropertyGraph:
    """The graph at a path, by the first reader that can read it or the one named."""
    name = format or reader_for(spark, path, readers)
    return next(r for n, _, r in _READERS if n == name)(spark, path, **options)
