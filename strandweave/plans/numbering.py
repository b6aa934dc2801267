"""Consecutive numbers over a global order without one task that reads all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.plans.workspace import Workspace


def numbered(df: DataFrame, *order, name: str = "number", work: Workspace | None = None) -> DataFrame:
    """``df`` with numbers from 0 in the given order.

    Rows are sorted by ranges; the ranges' sizes, one number each, give where each begins.
    """
    work = work or Workspace(df.sparkSession, "numbers")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit((1 << 33) - 1)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = work.save(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(low)}), "numbered")
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(total)]
        total += sizes[part]
    if not starts:
        return rows.drop("_part", "_at").withColumn(name, F.lit(0).cast("bigint"))
    return rows.withColumn(name, (F.element_at(F.create_map(*starts), F.col("_part")) + F.col("_at")).cast("bigint")).drop("_part", "_at")
