"""SimHash near-dedup with vantage-point trees.

Texts are lower-cased in A-Z and split at white space; a fingerprint bit is set where over half of the 3-word
shingles' XXH64 values have it.  Fingerprints within ``RADIUS`` (2) bits are linked.  Distinct fingerprints are dealt
to shards by a vantage-point tree: each node parts them by their Hamming distance to a vantage point, and a
fingerprint inside a boundary also visits the shards outside that its radius reaches over (triangle bounds).  Two linked
fingerprints of one node either go the same way, or the inner one lies within the radius of the boundary and goes
outside with the other; so they meet in a shard, and visits are needed in one direction only.  A shard is searched by
a tree of its own with the same pruning, visitors and residents alike, so all pairs within the radius are found, exactly.
A shard hands on a spanning forest of its links, not all pairs; components are joined by alternating large and small
stars, with the table written to the shared folder each round and hot nodes dealt over many tasks.

The shard tree is laid out on the ``SAMPLE`` fingerprints of least hash, or on ``PER_SHARD`` for each shard where that is more:
8 bytes on the driver for each 4096 fingerprints.  Every fingerprint is indexed.  Texts without words (null and empty too) have the fingerprint zero, linked like any
other.  A null doc_id is no candidate for a component's id unless it stands alone.  Repeated rows stay repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import LOWER, SPACES, discard, join_split, materialize, steps, table, text_bytes, word_spans

SHINGLE, SEED, RADIUS = 3, 42, 2
SAMPLE, PER_SHARD, SHARD, LEAF = 4096, 8, 32_768, 48
LAST = (1 << 63) - 1


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text of a column."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets, SPACES)
    out = np.zeros(len(column), np.uint64)
    if not len(row):
        return out
    raw = data.tobytes()
    joined = b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    to = np.cumsum(ends - starts + 1) - 1  # ends of the words once one space apart
    at = to - (ends - starts)
    count = np.bincount(row, minlength=len(column))
    first = np.cumsum(count) - count
    last = np.minimum(np.arange(len(row)) + shingle - 1, (first + count)[row] - 1)
    full = (np.arange(len(row)) + shingle - 1 <= last) | (np.arange(len(row)) == first[row]) & (count[row] < shingle)
    whole = np.flatnonzero(full)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(at[whole].tolist(), to[last[whole]].tolist(), strict=True)], np.uint64)
    n = np.bincount(row[whole], minlength=len(column))
    begin = (np.cumsum(n) - n)[n > 0]
    for k in range(0, 64, 8):  # a byte of the hashes at a time keeps the bits of a step small
        bits = np.unpackbits(((hashes >> np.uint64(k)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        over = 2 * np.add.reduceat(bits, begin, axis=0, dtype=np.int64) > n[n > 0][:, None]
        out[n > 0] |= np.packbits(over, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(k)
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, twin (a hash of the text) and fingerprint (the unsigned value's bits) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("twin", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches):
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("twin"), pa.array(fingerprints_of(batch.column("text")).view(np.int64))], schema=schema)

    rows = docs.select("doc_id", F.xxhash64("text").alias("twin"), "text")
    return rows.mapInArrow(run, "doc_id bigint, twin bigint, fingerprint bigint")


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _vantage(points: np.ndarray, tries: int = 4) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that part ``points``, or None if none of the tried ones parts them.

    Of the tried ones and the radii next to their medians, that with the fewest points on the far side or both.
    """
    best = None
    for vantage in points[:: max(1, len(points) // tries)][:tries]:
        within = np.cumsum(np.bincount(_distance(points, vantage), minlength=65))
        middle = int(np.searchsorted(within, len(points) / 2))
        for radius in range(max(0, middle - 2), min(64, middle + 2)):
            inside = int(within[radius])
            visits = inside - int(within[radius - RADIUS] if radius >= RADIUS else 0)
            cost = max(inside, len(points) - inside + visits) + visits
            if 0 < inside < len(points) and (best is None or cost < best[0]):
                best = (cost, vantage, radius)
    return best and (best[1], best[2])


def shard_tree(sample: np.ndarray, depth: int) -> list:
    """Nested ``[vantage, radius, inner, outer]``; a leaf is None."""
    found = _vantage(sample) if depth and len(sample) > 1 else None
    if found is None:
        return None
    vantage, radius = found
    inside = _distance(sample, vantage) <= radius
    return [int(vantage), radius, shard_tree(sample[inside], depth - 1), shard_tree(sample[~inside], depth - 1)]


def routes(tree, points: np.ndarray, radius: int = RADIUS):
    """(index, shard) of every shard that each point lives in or visits."""
    out, stack = [], [(tree, np.arange(len(points)), 1)]
    while stack:
        node, index, name = stack.pop()
        if not len(index):
            continue
        if node is None:
            out.append((index, np.full(len(index), name, np.int64)))
            continue
        distance = _distance(points[index], np.uint64(node[0])).astype(np.int64)
        stack += [(node[2], index[distance <= node[1]], 2 * name), (node[3], index[distance > node[1] - radius], 2 * name + 1)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def close_pairs(points: np.ndarray, radius: int = RADIUS):
    """Yields index arrays (a, b) that hold all pairs of different points within ``radius``, some more than once."""
    stack = [np.arange(len(points))]
    while stack:
        p = stack.pop()
        found = _vantage(points[p], 2) if len(p) > LEAF else None
        distance = found and _distance(points[p], found[0]).astype(np.int64)
        outer = None if found is None else p[distance > found[1] - radius]
        if found is None or len(outer) == len(p):  # not to be parted further
            step = max(1, (1 << 21) // max(1, len(p)))
            for at in range(0, len(p), step):
                some = p[at : at + step]
                i, k = np.nonzero(np.bitwise_count(points[p][:, None] ^ points[some][None, :]) <= radius)
                apart = p[i] < some[k]
                yield p[i[apart]], some[k[apart]]
            continue
        stack += [p[distance <= found[1]], outer]


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of ``a`` and ``b`` under their least members."""

    def root(x):
        while len(x) and (parent[x] != x).any():
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    while True:
        a, b = root(a), root(b)
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _shard_links(table: pa.Table) -> pa.Table:
    """Edges from each linked fingerprint of a shard to the least one it is joined to there."""
    marks = np.unique(np.asarray(table["fingerprint"]).view(np.uint64))
    parent = np.arange(len(marks))
    for a, b in close_pairs(marks):
        unite(parent, a, b)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(marks)))
    return pa.Table.from_arrays([pa.array(marks[moved].view(np.int64)), pa.array(marks[parent[moved]].view(np.int64))], schema=_EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(a, b): for each node with edges, save the least ones, the least node it is joined to."""
    held = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        told = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == before or not told[0]:
            return held
        before = told
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_split(both, least, ["a"], F.col("b"), 2 * told[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_split(large, low, ["a"], F.col("b"), 2 * told[0])
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        old, held = held, materialize(small, "edges")
        discard(old)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, twin, fingerprint (bits as a bigint), component_id and label (of the component) of each document."""
    marks = materialize(fingerprint(docs), "simhash")
    each = materialize(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    count, total = each.agg(F.count(F.lit(1)), F.sum("n")).first()
    depth = (count // SHARD).bit_length()
    sample = each.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(max(SAMPLE, PER_SHARD << depth))
    sample = np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64)  # one in SHARD / PER_SHARD at most
    tree = shard_tree(sample, depth)

    def dealt(batches):
        for batch in batches:
            own = np.asarray(batch.column("fingerprint")).view(np.uint64)
            index, shard = routes(tree, own)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(own[index].view(np.int64))], names=["shard", "fingerprint"])

    shards = each.select("fingerprint").mapInArrow(dealt, "shard bigint, fingerprint bigint")
    links = components(shards.groupBy("shard").applyInArrow(_shard_links, "a bigint, b bigint"))
    named = each.join(links.select(F.col("a").alias("fingerprint"), "b"), "fingerprint", "left").select("fingerprint", "least", "n", F.coalesce("b", "fingerprint").alias("label"))
    named = materialize(named, "simhash-labels")
    many = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_mark = join_split(named.withColumnRenamed("n", "own"), many, ["label"], F.col("fingerprint"), count)
    of_mark = of_mark.select("fingerprint", "component_id", "label", F.col("own").alias("n"))
    return join_split(marks, of_mark, ["fingerprint"], F.coalesce("doc_id", "twin"), total or 0)


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (of those, of the least text hash)."""
    own = docs.columns
    found = materialize(groups(docs).select("doc_id", "twin", "label"), "simhash-groups")
    key = F.coalesce("doc_id", F.lit(LAST))
    chosen = found.groupBy("label").agg(F.min(F.struct(key.alias("key"), "twin")).alias("m")).select("m.key", "m.twin")
    rows = docs.select(F.struct(*own).alias("row"), key.alias("key"), F.xxhash64("text").alias("twin"))
    first = Window.partitionBy("key", "twin").orderBy("key")
    return rows.join(chosen, ["key", "twin"]).withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
