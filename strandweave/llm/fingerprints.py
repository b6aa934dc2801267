"""Document fingerprints: SimHash over weighted terms, with permuted block tables.

Each distinct word of a text votes with its hash on 64 bits, plus or minus its weight,
which grows with the logarithm of its count.  Likeness of two fingerprints is the share
of equal bits.  To find all fingerprints within a radius, the bits are cut into blocks;
for each choice of blocks one table leads with the chosen blocks, and any two
fingerprints within the radius agree on the lead of some table (G. Manku, A. Jain and
A. Das Sarma, "Detecting near-duplicates for web crawling", WWW 2007).

Memory: of a text, its words and their counts and 64 bytes a distinct word; a task holds one
text and the next one.

Defined cases: a null text is an empty one, with fingerprint zero; a document's next one
follows it in descending order of ``doc_id``, null ids after all others, equal ids by a
hash of their texts, rows that repeat both in any order; after the last comes the first,
so that a single row follows itself; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.simhash import near_links
from strandweave.llm.workers import bounded_batches, tidied
from strandweave.operators.components import connected_components
from strandweave.plans.workspace import Workspace

BITS = 64


def fingerprint(text: str | None) -> int:
    """SimHash of a text's words; a bit is set if the votes for it outweigh those against."""
    tally = Counter(text.lower().split()) if text else None
    if not tally:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in tally), np.uint64, len(tally))
    counts = np.fromiter(tally.values(), np.int64, len(tally))
    # whole numbers, so that the order of the terms can't matter
    weights = np.round(1024 * (1 + np.log(counts)))
    votes = weights @ np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(votes * 2 > weights.sum(), bitorder="little").view(np.uint64)[0])


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def _ordered(docs: DataFrame) -> DataFrame:
    """``docs`` with the order key: null ids last, ids downwards, then a hash of the text."""
    return docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.struct(F.col("doc_id").isNull().cast("int").alias("z"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("bigint")), F.lit(0)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("k"),
    )


def with_next(docs: DataFrame, per_pair, schema: pa.Schema, fields: str) -> DataFrame:
    """``per_pair(doc_id, text, next_text)`` for each document and the one after it.

    A first pass over the keys alone finds where ranges of the order begin.  Then each
    document goes once to its range, and the first of a range also to the one before.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _ordered(docs).select("k.*")
    heads = keys.repartitionByRange(ranges, "z", "d", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("z", "d", "h")).alias("k")).select("k.*").collect()
    starts = sorted((r["z"], r["d"], r["h"]) for r in heads)
    before = {k: (i - 1) % len(starts) for i, k in enumerate(starts)}

    def deal(batches):
        for b in batches:
            z, d, h = (b.column(2).field(i).to_pylist() for i in range(3))
            keys = list(zip(z, d, h, strict=True))
            rows = [(bisect_right(starts, k) - 1, 0, i) for i, k in enumerate(keys)] + [(before[k], 1, i) for i, k in enumerate(keys) if k in before]
            take = pa.array([i for _, _, i in rows], pa.int64())
            bucket, ahead = pa.array([x for x, _, _ in rows], pa.int32()), pa.array([x for _, x, _ in rows], pa.int32())
            z, d, h = (pa.array(x) for x in (z, d, h))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), z.cast(pa.int32()).take(take), d.take(take), h.take(take), bucket, ahead], names=["doc_id", "text", "z", "d", "h", "bucket", "ahead"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = _ordered(docs).mapInArrow(tidied(deal), f"doc_id {kind}, text string, z int, d bigint, h bigint, bucket int, ahead int")
    placed = dealt.repartition("bucket").sortWithinPartitions("bucket", "ahead", "z", "d", "h").select("doc_id", "text", "bucket", "ahead")

    def pair(batches):
        last = None
        for b in batches:
            out = []
            for doc, text, bucket, ahead in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                now = (doc, text.as_py(), bucket)
                if last is not None and last[2] == bucket:
                    out.append(per_pair(last[0], last[1], now[1]))
                last = None if ahead else now
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return placed.mapInArrow(tidied(pair), fields)


def edit(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_edits(docs: DataFrame, *, radius: int | None = None, blocks: int = 5) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness to each other and to the next document's.

    With a ``radius`` also ``near_group``: documents have the same one if a chain of
    fingerprints within the radius leads from one to the other; the first of its fingerprints.
    """
    made = _edits(docs)
    if radius is None:
        return made
    work = Workspace(docs.sparkSession, "fingerprints")
    made = work.save(made, "made")
    group = near_groups(made.select(F.conv("fingerprint", 16, -10).cast("bigint").alias("print")), work, radius=radius, blocks=blocks)
    named = group.select(F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.lower(F.lpad(F.hex("group"), 16, "0")).alias("near_group"))
    joined = made.join(named, "fingerprint", "left")
    return joined.select(*made.columns, F.coalesce("near_group", "fingerprint").alias("near_group"))


def near_groups(prints: DataFrame, work: Workspace, *, radius: int, blocks: int) -> DataFrame:
    """``(print, group)`` for the fingerprints that have another within the radius, from the permuted block tables.

    A bucket's links are a spanning forest; one that is too long is parted by its free bits.
    """
    nodes = work.save(prints.distinct().select("print", F.lit(0).alias("sketch")), "prints")
    links = near_links(nodes, radius, work, masks=block_leads(radius, blocks))
    return connected_components(links, "a", "b").toDF("print", "group")


def _edits(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    memo: dict[str, int] = {}

    def known(text: str) -> int:
        """A next text comes up again as the following row's own."""
        if text not in memo:
            own = fingerprint(text)
            while len(memo) > 1:
                memo.pop(next(iter(memo)))
            memo[text] = own
        return memo[text]

    def per_pair(doc, text, following):
        edited = edit(text, following)
        own, other, after = known(text), fingerprint(edited), known(following)
        return {"doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": f"{own:016x}", "edited_fingerprint": f"{other:016x}", "near_edited": likeness(own, other), "near_next": likeness(own, after)}

    return with_next(docs, per_pair, schema, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def block_leads(radius: int, blocks: int) -> list[int]:
    """Masks of the leading blocks of each permuted table: all choices of ``blocks - radius`` blocks."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("the radius must be smaller than the number of blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << p for p in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def within_radius(queries: DataFrame, prints: DataFrame, *, radius: int = 3, blocks: int = 6) -> DataFrame:
    """``(query, print, distance)`` for all distinct fingerprints within the radius of a query.

    queries: ``(query bigint)``; prints: ``(print bigint)``.  Equal fingerprints count once.
    """
    leads = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("bigint") for m in block_leads(radius, blocks)])

    def tabled(df: DataFrame, name: str) -> DataFrame:
        own = df.select(name).where(F.col(name).isNotNull()).distinct()
        return own.select(name, F.posexplode(leads).alias("t", "mask")).select(name, "t", F.col(name).bitwiseAND(F.col("mask")).alias("lead"))

    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("print")))
    met = tabled(queries, "query").join(tabled(prints, "print"), ["t", "lead"]).select("query", "print", distance.cast("int").alias("distance"))
    return met.where(F.col("distance") <= radius).distinct()
