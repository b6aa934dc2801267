"""Exact top-k search by inner product as a Voronoi join.

Pivots, which are rows themselves, cut the space into cells; queries and data are grouped
by their nearest pivot (W. Lu et al., "Efficient Processing of k Nearest Neighbor Joins
using MapReduce", 2012).  A summary of each cell has its count, radius and largest norm, of
all rows and of its queries.  From the summaries alone follows, for each group of queries,
a score that the k-th best of none of them can fall under: with pivot p and radius R of the
group and N its largest norm, a row in a cell with pivot c and radius r scores at least
``p.c - R|c| - N r``.  A row x is copied to a group only if ``p.x + R|x|`` reaches the
group's bound.  Groups and the rows they need are cut into blocks of bounded size, each pair
of blocks is solved locally, and what is under the group's bound is dropped before the
winners are merged.  The number of pivots grows with the queries, so that a group has about
``QUERY_BLOCK`` of them; of equal vectors and crowded cells no more than a block meet in a task.

Scores are exact: integer vectors, multiplied in double precision while products stay
under 2**53 and in 64-bit integers beyond; bounds are widened by their rounding.

Defined cases: vectors that are null or hold a null or non-finite component take no part,
nor do rows without an id; empty vectors score 0, and of vectors of unequal length the
shorter counts as filled with zeros; rows of the query's own id are no candidates for it;
rows that repeat an id count once, with the best score; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.plans.workspace import Workspace
from strandweave.llm.words import mix
from strandweave.llm.workers import tidied

#: Rows of a block of data and of a block of queries, and the fewest pivots.
DATA_BLOCK, QUERY_BLOCK, PIVOTS = 16384, 4096, 64
_EXACT = float(1 << 53)


def quantised(rows: DataFrame, factor: int = 256) -> DataFrame:
    """``(vec_id, q)`` with ``q`` the floors of ``factor`` times each component."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return good.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * factor).cast("bigint")).alias("q"))


def _matrix(lists, width: int) -> np.ndarray:
    """Rows of integers, the shorter filled with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = lambda x: float(np.sqrt(np.square(x.astype(float)).sum(axis=1).max(initial=0)))
    if most(a) * most(b) < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` best scores, ties to smaller ids; a row's own id is left out."""
    order = np.argsort(ids, kind="stable")
    scores, ids = scores[:, order], ids[order]
    apart = ids[None, :] != own[:, None]
    rows, columns = [], []
    for i in range(len(scores)):
        free = np.flatnonzero(apart[i])
        mine = scores[i, free]
        if len(free) > k:
            least = np.partition(mine, len(mine) - k)[len(mine) - k]
            free, mine = free[mine >= least], mine[mine >= least]
        # the columns are in order of ids, and the sort is stable
        chosen = free[np.argsort(-mine, kind="stable")][:k]
        rows += [i] * len(chosen)
        columns += order[chosen].tolist()
    return np.array(rows, np.int64), np.array(columns, np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x.astype(float)).sum(axis=1))


def group_bounds(centres: np.ndarray, every: list, asked: list, rows: int) -> np.ndarray:
    """For each pivot a score that so many rows reach with every query of its group; every, asked: ``(cell, n, radius, norm)``."""
    bounds = np.full(len(centres), -np.inf)
    norms = _norms(centres)
    cells, n, radius = (np.array([r[i] for r in every]) for i in range(3))
    for cell, _, reach, largest in asked:
        at_pivot = centres[cells].astype(float) @ centres[cell].astype(float) - reach * norms[cells]
        # the pivot is a row of its cell; the others are within the radius of it
        least = np.concatenate([at_pivot, at_pivot - largest * radius])
        count = np.concatenate([np.ones(len(cells), np.int64), n - 1])
        order = np.argsort(-least, kind="stable")
        at = np.searchsorted(np.cumsum(count[order]), rows)
        if at < len(order):
            bound = least[order][at]
            bounds[cell] = bound - abs(bound) * 1e-9 - 1e-6
    return bounds


def top_k(rows: DataFrame, *, k: int = 5, every: int = 50, factor: int = 256, pivots: int = PIVOTS, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for each query of ``rows (vec_id, embedding)``.

    Queries are the rows whose id ``every`` divides; candidates are all rows of another id.
    """
    work = Workspace(rows.sparkSession, "topk")
    vectors = work.save(quantised(rows, factor).withColumn("size", F.size("q")), "vectors")
    sizes = vectors.agg(F.max("size").alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).first()
    width, pivots = sizes["width"] or 0, max(pivots, -(-sizes["asked"] // query_block))
    # distinct rows in the order of a hash
    found = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("q").collect()
    centres = np.zeros((max(1, len(found)), width), np.int64)
    for i, r in enumerate(found):
        centres[i, : len(r["q"])] = r["q"]
    centres = np.unique(centres, axis=0) if width else centres[:1]
    # so many rows have more than k ids, that of the query among them
    enough = (k + 1) * (vectors.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1)

    def assign(batches):
        for b in batches:
            x = _matrix(b.column(1), width)
            xf, cf = x.astype(float), centres.astype(float)
            cell = np.argmin(np.square(cf).sum(axis=1) - 2 * (xf @ cf.T), axis=1)
            radius = _norms(xf - cf[cell]) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(radius), pa.array(_norms(xf) * (1 + 1e-9))], names=["vec_id", "q", "cell", "radius", "norm"])

    placed = work.save(vectors.select("vec_id", "q").mapInArrow(tidied(assign), "vec_id bigint, q array<bigint>, cell int, radius double, norm double"), "cells")

    def summary(df: DataFrame) -> list[tuple]:
        return sorted(map(tuple, df.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).collect()))

    asked = placed.where(F.col("vec_id") % every == 0)
    own, groups = summary(placed), summary(asked)
    bounds = group_bounds(centres, own, groups, enough)
    cells = np.array([g[0] for g in groups], np.int64)
    reach, largest = (np.array([g[i] for g in groups], float) for i in (2, 3))
    # what a group can need at most, from the cells' summaries, says in how many blocks it comes
    n, radius, norm = (np.array([c[i] for c in own], float) for i in (1, 2, 3))
    between = centres[cells].astype(float) @ centres[np.array([c[0] for c in own], np.int64)].astype(float).T
    most = np.minimum(between + np.outer(reach, _norms(centres)[[c[0] for c in own]]) + np.outer(largest, radius), np.outer(largest, norm))
    needed = (np.where(most * (1 + np.sign(most) * 1e-9) + 1e-6 >= bounds[cells][:, None], n, 0)).sum(axis=1)
    parts = np.maximum(1, np.ceil(needed / data_block)).astype(np.int64)
    blocks = np.array([-(-g[1] // query_block) for g in groups], np.int64)

    def spread(ids: np.ndarray, count: np.ndarray, salt: int) -> np.ndarray:
        """Which of so many blocks each id is in."""
        return (mix(ids.view(np.uint64) + np.uint64(salt)) % count.astype(np.uint64)).astype(np.int64)

    def copies(b: pa.RecordBatch, row: np.ndarray, group: np.ndarray, part: np.ndarray, block: np.ndarray, ask: bool):
        for at in range(0, len(row), 10_000):
            piece = slice(at, at + 10_000)
            take = pa.array(row[piece])
            columns = [cells[group[piece]].astype(np.int32), part[piece].astype(np.int32), block[piece].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *map(pa.array, columns), pa.array(np.full(len(take), ask))], names=["vec_id", "q", "cell", "part", "block", "ask"])

    def repeated(row: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row as often as it is counted, with the number of the copy."""
        number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(row, count), number

    def deal_data(batches):
        """A copy of a row for each block of each group that needs it."""
        for b in batches:
            if not len(b) or not len(cells):
                continue
            x = _matrix(b.column(1), width)
            most = x.astype(float) @ centres[cells].astype(float).T + np.outer(_norms(x), reach)
            most = np.minimum(most, np.outer(_norms(x), largest))
            row, group = np.nonzero(most * (1 + np.sign(most) * 1e-9) + 1e-6 >= bounds[cells])
            part = spread(b.column(0).to_numpy(zero_copy_only=False)[row], parts[group], 1)
            at, block = repeated(np.arange(len(row)), blocks[group])
            yield from copies(b, row[at], group[at], part[at], block, False)

    def deal_queries(batches):
        """A copy of a query for each block of its group's data."""
        for b in batches:
            if not len(b):
                continue
            group = np.searchsorted(cells, b.column(2).to_numpy(zero_copy_only=False))
            block = spread(b.column(0).to_numpy(zero_copy_only=False), blocks[group], 2)
            at, part = repeated(np.arange(len(b)), parts[group])
            yield from copies(b, at, group[at], part, block[at], True)

    kind = "vec_id bigint, q array<bigint>, cell int, part int, block int, ask boolean"
    data = placed.select("vec_id", "q").mapInArrow(tidied(deal_data), kind)
    questions = asked.select("vec_id", "q", "cell").mapInArrow(tidied(deal_queries), kind)

    def solve(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids, own = (t.column("vec_id").to_numpy() for t in (candidates, queries))
        x, q = _matrix(candidates.column("q"), width), _matrix(queries.column("q"), width)
        least = bounds[queries.column("cell")[0].as_py()] if len(own) else 0.0
        out = []
        # all rows of an id are in one block, where the best one counts
        order = np.argsort(ids, kind="stable")
        ids, first = np.unique(ids[order], return_index=True)
        for at in range(0, len(own) if len(ids) else 0, 64):
            scores = np.maximum.reduceat(products(q[at : at + 64], x)[:, order], first, axis=1)
            row, column = best(scores, ids, own[at : at + 64], k)
            good = scores[row, column] >= least
            row, column = row[good], column[good]
            out.append((own[at + row], ids[column], scores[row, column]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    keys = ["cell", "part", "block"]
    local = data.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    merged = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
