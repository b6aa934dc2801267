"""A chunk index with embeddings, kept in step with its sources, and exact nearest chunks.

The index is a folder of Parquet tables: ``units`` and ``chunks`` by ``source_id``, where
a chunk holds offsets into its unit's text, ``sources`` with a hash of each source, and a
manifest of the settings.  A build compares hashes and writes only what changed, into a
new version of the folder; the manifest is swapped last, so readers see one version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.model import PropertyGraph, note
from strandweave.operators import text as T

DEFAULTS = {"window": 300, "overlap": 50, "dim": 64, "embedder": "hashed-words"}


def hashed_words(dim: int) -> Callable[[pd.Series], pd.Series]:
    """An embedder without a model: signed hashed word counts, scaled to length 1."""
    import zlib

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim, np.float64)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out, dtype=object)

    embed.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return embed


def _embedder(settings: dict, embed) -> Callable:
    return embed or hashed_words(settings["dim"])


def _put(spark: SparkSession, path: str, content: str) -> None:
    """Writes a small file in one step: beside its place, then renamed over it."""
    jvm = spark.sparkContext._jvm
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(temp, True)
    out.write(bytearray(content.encode()))
    out.close()
    store.delete(target, False)
    if not store.rename(temp, target):
        raise OSError(f"the manifest {path} could not be replaced")


def manifest(spark: SparkSession, store_path: str) -> dict | None:
    """The index's settings and current version, or None where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store_path}/manifest.json")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(f"{store_path}/manifest.json", wholetext=True).collect()))


def source_hashes(records: DataFrame) -> DataFrame:
    """``(source_id, hash)``: SHA-256 over a source's records in order.

    Each record is hashed first, so that an ordered list has one short hash a record.
    """
    own = records.select("source_id", F.sha2(F.to_json(F.struct("entity_id", "source_kind", "entity_types", "text")).cast("binary"), 256).alias("h"), "entity_id", "source_kind")
    return own.groupBy("source_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "source_kind", "h"))), lambda x: x["h"]), "").cast("binary"), 256).alias("hash"))


def source_diff(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """``(source_id, state)``: new, changed, unchanged or removed."""
    if old is None:
        return new.select("source_id", F.lit("new").alias("state"))
    both = new.select("source_id", F.col("hash").alias("n")).join(old.select("source_id", F.col("hash").alias("o")), "source_id", "full")
    return both.select("source_id", F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").when(F.col("n") == F.col("o"), "unchanged").otherwise("changed").alias("state"))


def build_index(g: PropertyGraph, store_path: str, *, embed=None, source_kind: str = "all", files: DataFrame | None = None, text_properties=None, **settings) -> dict[str, int]:
    """Builds or updates the index of the graph's texts; how many sources were in which state."""
    records = T.text_records(g, source_kind=source_kind, files=files, text_properties=text_properties)
    return index_records(records, store_path, embed=embed, **settings)


def index_records(records: DataFrame, store_path: str, *, embed=None, partial: bool = False, **settings) -> dict[str, int]:
    """Builds or updates an index of text records; with ``partial`` sources not among them stay."""
    spark = records.sparkSession
    settings = DEFAULTS | settings
    old = manifest(spark, store_path)
    if old and old["settings"] != settings:
        raise ValueError(f"the index at {store_path} was built with other settings: {old['settings']}")
    read = lambda name: spark.read.parquet(f"{store_path}/{old['version']}/{name}")
    hashes = source_hashes(records)
    diff = source_diff(hashes, read("sources") if old else None)
    if partial:
        diff = diff.withColumn("state", F.when(F.col("state") == "removed", "unchanged").otherwise(F.col("state")))
    version = f"v-{uuid.uuid4().hex}"
    base = f"{store_path}/{version}"
    diff.write.parquet(f"{base}/diff")
    diff = spark.read.parquet(f"{base}/diff")
    counts = {r["state"]: r["count"] for r in diff.groupBy("state").count().collect()}
    fresh = diff.where("state IN ('new', 'changed')").select("source_id")
    same = diff.where("state = 'unchanged'").select("source_id")
    units = records.join(fresh, "source_id", "left_semi").select("source_id", "entity_id", "source_kind", "entity_types", "text")
    made = T.chunks(units, settings["window"], settings["overlap"])
    vector = F.pandas_udf(_embedder(settings, embed), "array<float>")
    made = made.withColumn("embedding", vector("chunk")).drop("chunk")
    tables = {"units": units, "chunks": made, "sources": hashes.join(fresh, "source_id", "left_semi")}
    for name, table in tables.items():
        if old:
            table = table.unionByName(read(name).join(same, "source_id", "left_semi"))
        table.write.parquet(f"{base}/{name}")
    _put(spark, f"{store_path}/manifest.json", json.dumps({"settings": settings, "version": version}))
    return {s: counts.get(s, 0) for s in ("new", "changed", "unchanged", "removed")}


class Store:
    """Reads one version of an index."""

    def __init__(self, spark: SparkSession, store_path: str):
        found = manifest(spark, store_path)
        if found is None:
            raise FileNotFoundError(f"no index at {store_path}")
        self.spark, self.settings, self.base = spark, found["settings"], f"{store_path}/{found['version']}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}")

    def known_source_ids(self) -> list[str]:
        return sorted(r[0] for r in self.table("sources").select("source_id").collect())

    def source_records(self) -> DataFrame:
        """``(source_id, hash)`` of each source, in order."""
        return self.table("sources").orderBy("source_id")

    def source_record(self, source_id: str):
        """A source's row, or None."""
        return self.table("sources").where(F.col("source_id") == source_id).first()

    def count_chunks(self) -> int:
        return self.table("chunks").count()

    def records(self, filters: dict | None = None) -> DataFrame:
        """Stored text records, in order."""
        return T.apply_filters(self.table("units"), filters).orderBy("source_id", "entity_id", "source_kind")

    def chunks(self, filters: dict | None = None) -> DataFrame:
        """Chunks with their text, unranked."""
        keys = ["source_id", "entity_id", "source_kind"]
        joined = self.table("chunks").join(self.table("units").select(*keys, "text"), keys)
        return T.apply_filters(joined, filters).withColumn("chunk", F.expr("substring(text, start + 1, `end` - start)")).drop("text")

    def nearest(self, vector: list[float], k: int, filters: dict | None = None, view: DataFrame | None = None) -> DataFrame:
        """The ``k`` nearest chunks with ``distance`` and ``score``; filters come before ranking.

        Ranking reads keys and vectors only; texts are joined for the winners.
        """
        rows = T.apply_filters(self.table("chunks"), filters)
        if view is not None:
            rows = rows.join(view.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        best = nearest(rows, vector, k, ["source_id", "entity_id", "source_kind", "chunk_index"])
        keys = ["source_id", "entity_id", "source_kind"]
        texts = self.table("units").select(*keys, "text").join(F.broadcast(best.select(*keys).distinct()), keys, "left_semi")
        return best.join(texts, keys).withColumn("chunk", F.expr("substring(text, start + 1, `end` - start)")).drop("text", "embedding").orderBy("distance", *keys, "chunk_index")


def distance(a: Column, vector: list[float]) -> Column:
    """Euclidean distance in double precision."""
    other = F.array(*[F.lit(float(x)) for x in vector])
    return F.sqrt(F.aggregate(F.zip_with(a, other, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def nearest(rows: DataFrame, vector: list[float], k: int, ties: list[str], column: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to a vector, exactly, with ``distance`` and ``score = 1 / (1 + distance)``."""
    d = rows.withColumn("distance", distance(F.col(column), vector)).withColumn("score", 1 / (1 + F.col("distance")))
    return d.orderBy("distance", *ties).limit(k)


def entity_scores(hits: DataFrame, k: int) -> DataFrame:
    """``(entity_id, score)``: the best chunk of each entity, the ``k`` best entities."""
    return hits.groupBy("entity_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "entity_id").limit(k)


def _vector(store: Store, query: str, embed) -> list[float]:
    return list(_embedder(store.settings, embed)(pd.Series([query]))[0])


def _warn_if_unrelated(g: PropertyGraph, store: Store) -> None:
    """A note where the graph's sources and the index's have none in common."""
    own = g.entities.where("source IS NOT NULL").select(T.base_name(F.col("source")).alias("source_id")).distinct()
    known = store.table("sources").select("source_id")
    if not own.isEmpty() and not known.isEmpty() and own.join(known, "source_id").isEmpty():
        note(f"the graph and the index at {store.base} have no source in common")


def chunk_records(g: PropertyGraph, query: str | None = None, *, k: int = 10, store_path=None, filters=None, restrict_to_view: bool = True, embed=None) -> DataFrame:
    """Chunks of the index: all, or the nearest to a query."""
    store = Store(g.entities.sparkSession, store_path or g.default_index_path)
    view = g.entities.select("id") if restrict_to_view and g.origin is not None else None
    if query is not None:
        _warn_if_unrelated(g, store)
        return store.nearest(_vector(store, query, embed), k, filters, view)
    rows = store.chunks(filters)
    if view is not None:
        rows = rows.join(view.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return rows.orderBy("source_id", "entity_id", "source_kind", "chunk_index")


def search_entities(g: PropertyGraph, query: str, *, k: int = 10, store_path=None, filters=None, restrict_to_view: bool = True, embed=None) -> PropertyGraph:
    """The graph of the entities with the nearest chunks: 5k chunks, then the k best entities."""
    hits = chunk_records(g, query, k=5 * k, store_path=store_path, filters=filters, restrict_to_view=restrict_to_view, embed=embed)
    base = g if restrict_to_view else g.root
    return base.induce(entity_scores(hits, k).select(F.col("entity_id").alias("id")))
