"""A plain folder: its files and subfolders as entities, ``hasPart`` from each to what is in it.

The listing is Spark's; empty folders and links to other places have no files in it and
are not seen, nor are names with a dot or an underscore in front.
"""

from __future__ import annotations

import mimetypes

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandweave.model import PropertyGraph, no_props, props

ROOT = "./"


def read(spark: SparkSession, path: str) -> PropertyGraph:
    base = path.rstrip("/")
    name = base.rpartition("/")[2]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length")
    # a file's path below the folder: what is behind its last occurrence of /name/ from the front
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    full = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath()
    below = F.try_url_decode(F.replace(F.substring(F.regexp_replace("path", r"^[a-z0-9]+:(?://[^/]*)?(?=/)", ""), len(full) + 2, 1 << 20), F.lit("+"), F.lit("%2B")))
    files = listed.select(below.alias("id"), "length")
    steps = F.split("id", "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.array_join(F.slice(steps, 1, i - 1), "/"), F.lit("/")))).alias("id")).where("id <> '/'").distinct()
    # Fixed values come from the platform's table of media types
    kinds = sorted({(e, t) for e, t in mimetypes.types_map.items()})
    table = spark.createDataFrame(kinds, "ext string, mime string")
    ext = F.concat(F.lit("."), F.lower(F.element_at(F.split("id", r"\."), -1)))
    last = lambda c: F.element_at(F.split(F.regexp_replace(c, "/$", ""), "/"), -1)
    typed = files.withColumn("ext", ext).join(F.broadcast(table), "ext", "left")
    f = typed.select("id", F.array(F.lit("File")).alias("types"), props(name=last(F.col("id")), contentSize=F.col("length"), encodingFormat=F.col("mime")).alias("props"))
    d = folders.select("id", F.array(F.lit("Dataset")).alias("types"), props(name=last(F.col("id"))).alias("props"))
    r = spark.range(1).select(F.lit(ROOT).alias("id"), F.array(F.lit("Dataset")).alias("types"), props(name=F.lit(name), _is_root=F.lit(True)).alias("props"))
    from strandweave.plans.numbering import numbered

    rows = numbered(r.unionByName(d).unionByName(f), F.col("id") != ROOT, "id", name="ord")
    entities = rows.select("id", "ord", "types", "props", F.lit(base).alias("source"))
    parent = F.regexp_extract("id", r"^(.*/)[^/]+/?$", 1)
    edges = entities.where(F.col("id") != ROOT).select("ord", F.when(parent == "", ROOT).otherwise(parent).alias("src"), F.col("id").alias("dst"), F.lit("hasPart").alias("type"), no_props().alias("props"), F.lit(None).cast("string").alias("rel_id"))
    return PropertyGraph(entities, edges, metadata={"_root_id": ROOT, "name": name}, source=base)
