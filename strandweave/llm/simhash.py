"""SimHash near-duplicates by covering locality-sensitive hashing.

A SimHash of 64 bits is taken from each text's features.  Every bit position gets a
nonzero vector of ``radius + 1`` bits; each of the ``2 ** (radius + 1) - 1`` nonzero
vectors *v* gives a table whose mask keeps the positions with an odd inner product with
*v*.  The vectors of at most ``radius`` differing positions cannot span the whole space,
so some *v* is orthogonal to all of them and that table's mask hides every difference:
each pair within the radius collides in some table (R. Pagh, "Locality-sensitive Hashing
without False Negatives", SODA 2016).

Buckets are read as sorted runs, one table row at a time per task, so memory is bounded.
In a bucket, links are a spanning forest, never all pairs.  A bucket with more than
``run_limit`` members is covered again over the bits in which its members still differ,
which halves those bits each time and keeps the guarantee, until it is small.  Texts of
equal fingerprints are one member, so that each round parts a bucket.  Where links
are checked on the texts, the members that a sketch's links connect are a cluster, one for
each text and sketch, and the pairs in it that the checks left in different components are compared.

Memory: a text's shingles are hashed ``BLOCK`` at a time, so a very long text costs the list
of its words; of near copies, the hashes of its distinct shingles.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other;
fewer words than a shingle form one shingle; rows that repeat give the same result each;
a null ``doc_id`` never is the smallest of a component (a component of null ids only has
a null id); an empty table gives no rows; columns beside those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.components import connected_components
from strandweave.plans.workspace import Workspace
from strandweave.llm.words import Words, gram_hashes, mix, together
from strandweave.llm.workers import bounded_batches, packed_row, tidied

BITS = 64
RUN_LIMIT = 4096
#: SimHashes of a text and differing bits in which near copies are sought: a pair of similarity 0.8
#: is about 4.4 bits apart in one of them, so all six miss about one pair in a hundred.
SKETCHES, RADIUS = 6, 4
#: Texts a side that a task compares at a time; one of many shingles counts once for each ``WEIGHT`` of them.
UNIT, WEIGHT = 512, 1024
#: A cluster with more texts to compare with all others is read by its buckets, of which a text has
#: ``2 ** (radius + 1) - 1`` a sketch: from there on the cluster's own units would have more rows.
WIDE = UNIT << RADIUS + 1
#: Shingles hashed at a time.
BLOCK = 1 << 15


def covering_masks(radius: int, free: int = (1 << BITS) - 1) -> list[int]:
    """Masks over the bits of ``free``, one of which hides any ``radius`` of them."""
    top = (1 << (radius + 1)) - 1
    positions = [i for i in range(BITS) if free >> i & 1]
    vector = {p: 1 + k % top for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, top + 1)]


def text_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], width: int) -> Iterator[bytes]:
    """Each run of ``width`` words joined by a space; all words if there are fewer."""
    if len(words) <= width:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(islice(words, i, None) for i in range(width)), strict=False))


def _hashes(features, seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, features, repeat(seed)), np.uint64)


def _hash_blocks(features: Iterator[bytes], seed: int) -> Iterator[np.ndarray]:
    """The features' hashes, ``BLOCK`` at a time."""
    while len(block := _hashes(islice(features, BLOCK), seed)):
        yield block


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; hashes: a row each, in whole words."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    # sums of 255 rows fit in a byte
    parts = [np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8) for at in range(0, len(bits), 255)]
    return np.array(parts, np.uint8).reshape(-1, bits.shape[1]).sum(axis=0, dtype=np.int64)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that over half of the hashes have set."""
    ones, n = np.zeros(BITS, np.int64), 0
    for block in blocks:
        ones += _ones(block)
        n += len(block)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0


def shingle_print(text: str | None, width: int, seed: int = 42) -> int:
    """SimHash over word shingles, repeats included."""
    return majority(_hash_blocks(shingles(text_words(text), width), seed))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct hashes of each text's word shingles, sorted; all words are one shingle if there are fewer."""
    w = Words(texts, lower=True, ascii_only=True)
    grams = gram_hashes(w.hashes, width)
    out = []
    for a, b in zip(w.first, w.first[1:], strict=False):
        own = grams[a : b - width + 1] if b - a >= width else gram_hashes(w.hashes[a:b], b - a) if b > a else grams[:0]
        out.append(np.unique(own))
    return out


def word_prints(texts: list[str], count: int) -> list[int]:
    """``count`` independent SimHashes over the distinct longer words of each text.

    Words of five characters or more, as common short words would make all texts alike; all
    words where there is none that long.
    """
    w = Words(texts, lower=True, ascii_only=True)
    long_, salts = w.stop - w.start >= 5, np.array([(k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(count)], np.uint64)
    out = []
    for a, b in zip(w.first, w.first[1:], strict=False):
        own = w.hashes[a:b]
        chosen = np.unique(own[long_[a:b]] if long_[a:b].any() else own)
        ones = np.zeros(BITS * count, np.int64)
        for at in range(0, len(chosen), BLOCK):
            ones += _ones(mix(chosen[at : at + BLOCK, None] + salts))
        out += np.packbits(ones * 2 > len(chosen), bitorder="little").view(np.uint64).tolist()
    return out


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def with_prints(docs: DataFrame, keep: list[str], width: int | None, sketches: int) -> DataFrame:
    """``keep`` and ``prints``, an array of ``sketches`` fingerprints of ``text``."""

    def run(batches):
        for b in batches:
            texts = b.column(len(keep))
            if width is not None:
                flat = [shingle_print(t.as_py(), width) for t in texts]
            else:
                flat = [p for some in together(t or "" for t in texts.to_pylist()) for p in word_prints(some, sketches)]
            offsets = pa.array(np.arange(0, len(flat) + 1, sketches, dtype=np.int32))
            prints = pa.ListArray.from_arrays(offsets, pa.array(_signed(flat)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], prints], names=[*keep, "prints"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidied(run), f"{fields}, prints array<bigint>")


def node_ids(prints: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """What names a fingerprint of a sketch: itself for the first sketch, salted for the others."""
    return prints ^ np.where(sketch == 0, np.uint64(0), mix(np.asarray(sketch, np.uint64)))


def _entries(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """``(key, print, sketch)`` for each table and node; nodes: ``(print, sketch)``.

    A key hashes the sketch, the table's number and the masked bits.  Two buckets that share
    a key only give more candidates, as links are decided on the fingerprints themselves.
    """
    table = np.array(masks, np.uint64)

    def run(batches):
        for b in batches:
            prints, sketch = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
            for t, mask in enumerate(table):
                keys = table_keys(prints, sketch, t, mask, len(table))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *b.columns], names=["key", "print", "sketch"])

    return nodes.select("print", F.col("sketch").cast("tinyint")).mapInArrow(tidied(run), "key bigint, print bigint, sketch tinyint")


def forest(prints: np.ndarray, ids: np.ndarray, radius: int) -> tuple[list, list]:
    """A spanning forest of the links at ``radius`` or fewer bits among a bucket's members."""
    order = np.argsort(ids, kind="stable")
    prints, ids = prints[order], ids[order]
    left, a, b = np.arange(len(ids)), [], []
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= radius
            if near.any():
                found = left[near]
                a += [ids[at]] * len(found)
                b += ids[found].tolist()
                stack += found.tolist()
                left = left[~near]
    return a, b


def table_keys(prints: np.ndarray, sketch: np.ndarray, table, mask, tables: int) -> np.ndarray:
    """Keys of fingerprints in the tables of these numbers and masks, of ``tables`` in all."""
    return mix((prints & mask) ^ mix((sketch.astype(np.int64) * tables + table + 1).astype(np.uint64)))


def in_first_table(keys: np.ndarray, p: np.ndarray, q: np.ndarray, sketch: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether buckets of these keys are those of the first table that hides the difference of ``p`` and ``q``.

    The other buckets' links may go: the first one's connect both ends, in one step or by
    way of pairs that have an earlier table still.
    """
    first = ((p ^ q) & masks[:, None] == 0).argmax(axis=0)
    return table_keys(p, sketch, first, masks[first], len(masks)) == keys


def connected_members(prints: np.ndarray, ids: np.ndarray, radius: int) -> list[list[int]]:
    """The clusters of two or more members that the radius connects."""
    root: dict[int, int] = {}
    clusters: dict[int, list[int]] = {}
    for x, y in zip(*forest(prints, ids, radius), strict=True):  # a tree's edges lead away from its root
        root[y] = root.setdefault(x, x)
        clusters.setdefault(root[y], [root[y]]).append(y)
    return list(clusters.values())


def _run_linker(radius: int, run_limit: int, clusters: bool, masks: list[int] | None = None):
    """Reads rows sorted by key; gives the rows of runs that are too long and links, or ``clusters`` under a hash of their members.

    With the tables' ``masks``, links go that another table gives in steps.
    """

    #: With fewer bits that differ a mask can be empty and part nothing; they have at most ``1 << fewest - 1`` values.
    fewest = 1 << radius

    def out(a, b, key=None, cluster=None):
        fill = lambda x: pa.array(np.asarray(x, np.int64)) if x is not None else pa.nulls(len(b), pa.int64())
        return pa.RecordBatch.from_arrays([fill(a), fill(b), fill(key), fill(cluster)], names=["a", "b", "over", "cluster"])

    def run(batches):
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8)]
        long_key = None
        for batch in batches:
            cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(cols[0]):
                continue
            keys = cols[0]
            if long_key is not None and keys[0] == long_key:
                # the run that was found too long goes on
                stop = int(np.searchsorted(keys != long_key, True)) if (keys != long_key).any() else len(keys)
                yield out(cols[1][:stop], cols[2][:stop], keys[:stop])
                cols = [c[stop:] for c in cols]
                keys = cols[0]
                if not len(keys):
                    held = cols
                    continue
            long_key = None
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            last = int(cut[-1]) if len(cut) else 0
            yield from closed([c[:last] for c in cols])
            held = [c[last:] for c in cols]
            if len(held[0]) > max(run_limit, 1 << fewest - 1):
                long_key = held[0][0]
                yield out(held[1], held[2], held[0])
                held = [c[:0] for c in held]
        if len(held[0]):
            yield from closed(held)

    def closed(cols):
        keys, prints = cols[0], cols[1].view(np.uint64)
        if len(keys) < 2:
            return
        ids = node_ids(prints, cols[2]).view(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
        a, b = ids[two].tolist(), ids[two + 1].tolist()
        names, members = [], []
        if masks:
            two = two[in_first_table(keys[two].view(np.uint64), prints[two], prints[two + 1], cols[2][two], np.array(masks, np.uint64))]
            a, b = ids[two].tolist(), ids[two + 1].tolist()
        if clusters:
            names, members = (mix(ids[two].view(np.uint64)) + mix(ids[two + 1].view(np.uint64))).view(np.int64).tolist() * 2, a + b
            a, b = [], []
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            run = prints[at : at + size]
            if size > run_limit and int(np.bitwise_or.reduce(run) ^ np.bitwise_and.reduce(run)).bit_count() >= fewest:
                yield out(cols[1][at : at + size], cols[2][at : at + size], keys[at : at + size])
                continue
            own = ids[at : at + size]
            if clusters:
                for c in connected_members(run, own, radius):
                    names += [int(mix(np.array(c, np.int64).view(np.uint64)).sum(dtype=np.uint64).view(np.int64))] * len(c)
                    members += c
                continue
            if masks:
                # from the middle one: short links, the same in many buckets
                order = np.lexsort((mix(own.view(np.uint64)), np.bitwise_count(run ^ np.uint64(majority([run])))))
                x, y = (order[np.array(e, np.int64)] for e in forest(run[order], np.arange(size), radius))
                kept = in_first_table(np.full(len(x), keys[at]).view(np.uint64), run[x], run[y], cols[2][at : at + size][x], np.array(masks, np.uint64))
                x, y = own[x[kept]].tolist(), own[y[kept]].tolist()
            else:
                x, y = forest(run, own, radius)
            a += x
            b += y
        if a:
            yield out(a, b)
        if members:
            yield out(None, members, None, names)

    return run


def near_links(nodes: DataFrame, radius: int, work: Workspace, *, run_limit: int = RUN_LIMIT, masks: list[int] | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect all nodes whose fingerprints differ in ``radius`` bits or fewer.

    nodes: ``(print bigint, sketch)``, distinct, as equal ones cannot be parted; fingerprints
    of one sketch are compared.  ``node_ids`` names them in the links.  ``masks`` are those of
    the tables, one of which must hide any ``radius`` bits; covering masks by default.
    """
    return _buckets(nodes, radius, work, run_limit, masks)


def _buckets(nodes: DataFrame, radius: int, work: Workspace, run_limit: int, masks: list[int] | None = None, *, clusters: bool = False, sparse: bool = False) -> DataFrame:
    """Links ``(a, b)``, or ``clusters (cluster, id)`` of which one holds both ends of each pair within the radius.

    ``sparse`` links connect the same nodes, mostly without those that several tables' buckets repeat in other ways.
    """
    masks = masks or covering_masks(radius)
    entries = _entries(nodes, masks)
    found, linker = [], _run_linker(radius, run_limit, clusters, masks if sparse else None)
    while True:
        dealt = entries.repartition(F.col("key")).sortWithinPartitions("key")
        step = work.save(dealt.mapInArrow(tidied(linker), "a bigint, b bigint, over bigint, cluster bigint"), "links")
        found.append(step.where("over IS NULL"))
        over = step.where("over IS NOT NULL")
        if over.isEmpty():
            break
        linker = _run_linker(radius, run_limit, clusters)
        entries = _covered_again(over.select(F.col("over").alias("key"), F.col("a").alias("print"), F.col("b").cast("tinyint").alias("sketch")), radius, work, run_limit)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionAll(more)
    if clusters:
        return rows.select("cluster", F.col("b").alias("id")).distinct()
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _covered_again(rows: DataFrame, radius: int, work: Workspace, run_limit: int) -> DataFrame:
    """Entries of long buckets under masks over the bits in which their members differ."""
    free = work.save(rows.groupBy("key").agg((F.bit_or("print").bitwiseXOR(F.bit_and("print"))).alias("free")), "free")

    def run(batches):
        cache: dict[int, list[int]] = {}
        for b in batches:
            keys, prints, sketch, frees = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for free_bits in np.unique(frees):
                at = frees == free_bits
                masks = cache.setdefault(int(free_bits), covering_masks(radius, int(free_bits) & (1 << BITS) - 1))
                for t, mask in enumerate(masks):
                    sub = prints[at].view(np.uint64) & np.uint64(mask)
                    new = mix(mix(keys[at].view(np.uint64) + np.uint64(t + 1)) ^ sub)
                    yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(prints[at]), pa.array(sketch[at])], names=["key", "print", "sketch"])

    # rows of one bucket are many and join one row: both sides are plain tables, which AQE splits
    return rows.join(free, "key").select("key", "print", "sketch", "free").mapInArrow(tidied(run), "key bigint, print bigint, sketch tinyint")


def simhash_components(docs: DataFrame, *, width: int = 3, radius: int = 3, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``(doc_id, print, component_id)`` for each row of ``docs (doc_id, text)``.

    Fingerprints over ``width``-word shingles link at ``radius`` or fewer differing bits;
    ``component_id`` is the smallest ``doc_id`` reachable, the row's own included.
    """
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.save(with_prints(docs, ["doc_id"], width, 1).select("doc_id", F.col("prints")[0].alias("print")), "prints")
    classes = work.save(prints.groupBy("print").agg(F.min("doc_id").alias("doc")), "classes")
    links = near_links(classes.select("print", F.lit(0).alias("sketch")), radius, work, run_limit=run_limit)
    member = connected_components(links, "a", "b")
    # classes that have links: the smallest doc_id of the whole component
    linked = work.save(classes.join(member.toDF("print", "component"), "print"), "linked")
    least = work.save(linked.groupBy("component").agg(F.min("doc").alias("component_id")), "least")
    named = linked.join(least, "component").select("print", "component_id")
    ids = work.save(
        classes.join(named.withColumn("linked", F.lit(True)), "print", "left").select("print", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc")).alias("component_id")), "ids"
    )
    return prints.join(ids, "print").select("doc_id", "print", "component_id")


def _text_hash() -> list[Column]:
    """128 bits that name a text, in two columns."""
    body = F.coalesce("text", F.lit(""))
    return [F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2")]


def _node_id(print_: Column, sketch: Column, sketches: int) -> Column:
    """``node_ids`` of columns."""
    salts = node_ids(np.zeros(sketches, np.uint64), np.arange(sketches)).view(np.int64).tolist()
    return print_.bitwiseXOR(F.element_at(F.array(*[F.lit(x) for x in salts]), sketch + 1))


def near_duplicate_classes(docs: DataFrame, *, sketches: int = SKETCHES, radius: int = RADIUS, width: int = 5, similarity: float = 0.8, run_limit: int = RUN_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Distinct texts as ``(id, h1, h2, doc_id)`` and ``(class, component)``: their ids, grouped at a Jaccard similarity.

    ``h1`` and ``h2`` hash the text, ``doc_id`` is the smallest of those that have it.
    Candidates are texts of which one of ``sketches`` SimHashes over distinct words lies
    within the radius; a candidate pair is a link if the sets of ``width``-word shingles
    have a Jaccard similarity of ``similarity`` or more, computed on the whole texts.
    A first check of few pairs a bucket links most; then all candidates whose ends are
    still in different components are compared.
    Only texts with a link have a component.
    """
    work = Workspace(docs.sparkSession, "near")
    texts = docs.select("doc_id", *_text_hash(), "text")
    made = with_prints(texts, ["doc_id", "h1", "h2"], None, sketches).select("doc_id", "h1", "h2", *[F.col("prints")[k].alias(f"p{k}") for k in range(sketches)])
    distinct = made.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), *[F.first(f"p{k}").alias(f"p{k}") for k in range(sketches)])
    nodes = work.save(distinct.withColumn("id", F.monotonically_increasing_id()), "nodes")
    cells = nodes.select("id", F.posexplode(F.array(*[f"p{k}" for k in range(sketches)])).alias("sketch", "print"))
    cells = cells.withColumn("group", _node_id(F.col("print"), F.col("sketch"), sketches))
    groups = work.save(cells.groupBy("group", "sketch", "print").agg(F.min("id").alias("first"), F.count("*").alias("n")), "groups")
    near = work.save(_buckets(groups.select("print", "sketch"), radius, work, run_limit, sparse=True), "near")
    first = groups.select("group", "first")
    across = near.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    # equal fingerprints: each text with the first one, and all of them as a cluster
    equal = cells.join(groups.where("n > 1").select("group", "first"), "group").where("id != first").select(F.col("first").alias("x"), F.col("id").alias("y"))
    pairs = work.save(across.select("x", "y").unionAll(equal).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    ends = work.save(nodes.select("id", "h1", "h2").join(ends, "id"), "ends")

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for some in together(t or "" for t in b.column(1).to_pylist()) for x in shingle_sets(some, width)], pa.binary())], names=["id", "set"])

    # only texts that have a candidate are read again, and hashed once each
    bodies = texts.join(ends, ["h1", "h2"]).groupBy("id").agg(F.first("text").alias("text"))
    hashed_sets = bodies.mapInArrow(tidied(hashed), "id bigint, set binary")
    sets = work.save(hashed_sets.withColumn("weight", F.greatest(F.lit(1), F.ceil(F.octet_length("set") / (8 * WEIGHT)))), "sets")
    weights, sets = sets.select("id", "weight"), sets.select("id", "set")
    both = pairs.join(sets.toDF("a", "left_set"), "a").join(sets.toDF("b", "right_set"), "b")

    def run(batches):
        for b in batches:
            a, c, x, y = b.columns
            read = lambda v: np.frombuffer(v.as_py(), np.uint64)
            keep = pa.array(np.array([similar(read(p), read(q), similarity) for p, q in zip(x, y, strict=True)], bool))
            yield pa.RecordBatch.from_arrays([a.filter(keep), c.filter(keep)], names=["a", "b"])

    links = work.save(both.select("a", "b", "left_set", "right_set").mapInArrow(tidied(run), "a bigint, b bigint"), "checked")
    found = connected_components(links, "a", "b")
    # what a sketch's links connect is one cluster, whichever and however many buckets gave them
    linked = connected_components(near, "a", "b").toDF("group", "cluster")
    named = groups.join(linked, "group", "left").where("cluster IS NOT NULL OR n > 2")
    clusters = work.save(named.select("group", "sketch", "print", F.coalesce("cluster", "group").alias("cluster")), "clusters")
    inside = cells.join(weights, "id").select("group", "id", "print", "weight")
    members = work.save(clusters.select("cluster", "group").join(inside, "group").select("cluster", "id", "print", "weight"), "members")
    rest = _unsettled(members, found, work)
    wide = work.save(_open_texts(rest).where(F.col("open") > WIDE).select("cluster"), "wide")
    if not wide.isEmpty():
        parted = _buckets(clusters.join(wide, "cluster").select("print", "sketch"), radius, work, run_limit, clusters=True)
        equal = clusters.join(wide, "cluster").select("group").join(groups.where("n > 2").select("group"), "group")
        parted = parted.toDF("cluster", "group").unionAll(equal.select(F.col("group").alias("cluster"), "group"))
        parted = parted.join(inside, "group").select("cluster", "id", "print", "weight")
        members = work.save(members.join(wide, "cluster", "left_anti").unionAll(parted), "members")
        rest = _unsettled(members, found, work)
    if not rest.where(F.col("size") > UNIT).isEmpty():
        # each text in its largest cluster first, which settles most of large groups before their other clusters are read
        largest = rest.groupBy("id").agg(F.max(F.struct("size", "cluster")).alias("m")).select("id", F.col("m.cluster").alias("cluster"))
        links = links.unionAll(_compared(rest.join(largest, ["id", "cluster"]), sets, work, radius, similarity))
        found = connected_components(links, "a", "b")
        rest = _unsettled(members, found, work)
    if not rest.isEmpty():
        found = connected_components(links.unionAll(_compared(rest, sets, work, radius, similarity)), "a", "b")
    return nodes.select("id", "h1", "h2", "doc_id"), found.toDF("class", "component")


def _unsettled(members: DataFrame, components: DataFrame, work: Workspace) -> DataFrame:
    """``(cluster, id, print, weight, label, size)`` of the clusters of three or more texts that are not all in one component."""
    known = members.join(components.toDF("id", "component"), "id", "left").select("cluster", "id", "print", "weight", F.coalesce("component", "id").alias("label"))
    known = work.save(known, "labels")
    size = known.groupBy("cluster").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    return work.save(known.join(work.save(size.where("size > 2 AND low != high").select("cluster", "size"), "open"), "cluster"), "rest")


def _open_texts(rest: DataFrame) -> DataFrame:
    """``(cluster, main, n, open)``: a cluster's heaviest label, the weight of its texts and of those with another label."""
    labels = rest.groupBy("cluster", "label").agg(F.sum("weight").alias("weight"))
    top = labels.groupBy("cluster").agg(F.max(F.struct("weight", "label")).alias("m"), F.sum("weight").alias("n"))
    return top.select("cluster", F.col("m.label").alias("main"), "n", (F.col("n") - F.col("m.weight")).alias("open"))


def _compared(rest: DataFrame, sets: DataFrame, work: Workspace, radius: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that join all similar texts within the radius in a cluster that have different labels.

    A cluster's texts outside its heaviest label are compared with all of the cluster,
    in units of about ``UNIT`` by ``UNIT`` texts, so no task grows with a cluster.
    """
    plan = work.save(_open_texts(rest).where("open > 0").select("cluster", "main", F.ceil(F.col("n") / UNIT).alias("across"), F.ceil(F.col("open") / UNIT).alias("down")), "plan")
    rows = rest.join(plan, "cluster")
    row = F.pmod(F.xxhash64("id", F.lit(1)), "down")
    column = F.pmod(F.xxhash64("id"), "across")
    lefts = rows.where("label != main").withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("across") - 1)))
    rights = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("down") - 1)))
    units = lefts.select(F.xxhash64("cluster", row, "at").alias("unit"), F.lit(True).alias("left"), "id", "print", "label").unionAll(
        rights.select(F.xxhash64("cluster", "at", column).alias("unit"), F.lit(False).alias("left"), "id", "print", "label")
    )

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != r[0]:
                    yield links_of(held)
                    held = []
                held.append(r)
        if held:
            yield links_of(held)

    def links_of(rows: list[tuple]) -> pa.RecordBatch:
        a, b = similar_pairs([r[2:] for r in rows if r[1]], [r[2:] for r in rows if not r[1]], radius, similarity)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = units.join(sets, "id").select("unit", "left", "id", "print", "label", "set").repartition(F.col("unit")).sortWithinPartitions("unit")
    return work.save(dealt.mapInArrow(tidied(run), "a bigint, b bigint"), "compared")


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """2048 bits a set, each the parity of the hashes that fall there: two sets differ in at least as many hashes as in bits."""
    flips = [np.bincount((s % np.uint64(2048)).astype(np.int64), minlength=2048).astype(np.uint8) & 1 for s in sets]
    return np.packbits(np.array(flips, np.uint8).reshape(-1, 2048), axis=1).view(np.uint64)


def similar_pairs(lefts: list[tuple], rights: list[tuple], radius: int, similarity: float) -> tuple[list[int], list[int]]:
    """Links that connect the labels of similar texts; texts: ``(id, print, label, set)``.

    Sets are tested exactly unless their sizes or parities exclude the similarity, or
    links before have joined their labels.
    """
    if not lefts or not rights:
        return [], []
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    own, sets = [np.frombuffer(t[3], np.uint64) for t in lefts], [np.frombuffer(t[3], np.uint64) for t in rights]
    bits, own_bits = _parities(sets), _parities(own)
    prints = np.array([t[1] for t in rights], np.int64).view(np.uint64)
    labels, sizes = np.array([t[2] for t in rights], np.int64), np.array([len(s) for s in sets])
    a, b = [], []
    for (i, p, label, _), x, parity in zip(lefts, own, own_bits, strict=True):
        near = (labels != label) & (np.bitwise_count(prints ^ np.array([p], np.int64).view(np.uint64)) <= radius)
        near &= np.minimum(sizes, len(x)) >= (similarity - 1e-9) * np.maximum(sizes, len(x))
        at = np.flatnonzero(near)
        apart = np.bitwise_count(bits[at] ^ parity).sum(axis=1, dtype=np.int64)
        for j in at[apart <= (1 - similarity) / (1 + similarity) * (sizes[at] + len(x)) + 1e-6]:
            one, other = root(label), root(int(labels[j]))
            if one == other:
                continue
            if similar(x, sets[j], similarity):
                parent[other] = one
                a.append(i)
                b.append(rights[j][0])
    return a, b


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least so much; two empty ones have 1."""
    if min(len(x), len(y)) < (similarity - 1e-9) * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return not union or both / union >= similarity


def jaccard(x: str | None, y: str | None, width: int) -> float:
    """Similarity of two texts' sets of word shingles; 1 for two wordless texts."""
    p, q = set(shingles(text_words(x), width)), set(shingles(text_words(y), width))
    return len(p & q) / len(p | q) if p or q else 1.0


def drop_near_duplicates(docs: DataFrame, *, sketches: int = SKETCHES, radius: int = RADIUS, width: int = 5, similarity: float = 0.8, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``docs`` with one row of each group of exact and near copies: that with the smallest ``doc_id``.

    Null ids come last.  Rows that repeat an id and a text are one document, of which one
    row stays.  All columns are kept as they are, whatever their names.
    """
    work = Workspace(docs.sparkSession, "dedup")
    nodes, groups = near_duplicate_classes(docs, sketches=sketches, radius=radius, width=width, similarity=similarity, run_limit=run_limit)
    named = nodes.join(groups.withColumnRenamed("class", "id"), "id", "left").select("h1", "h2", "doc_id", "id", F.coalesce("component", "id").alias("component"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "h1", "h2"))
    keep = work.save(named.groupBy("component").agg(first.alias("first")).select("first.h1", "first.h2", F.col("first.doc_id").alias("keep_id")), "keep")
    rows = docs.select(packed_row(docs), "doc_id", *_text_hash())
    kept = rows.join(keep, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # a row that repeats both id and text: rare, so the text moves again only if there is one
    seen = docs.select("doc_id", *_text_hash()).groupBy("h1", "h2", "doc_id").count().where("count > 1")
    if not seen.join(keep, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty():
        kept = kept.dropDuplicates(["h1", "h2"])
    return kept.select("row.*")
