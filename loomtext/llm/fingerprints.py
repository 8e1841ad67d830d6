"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a piece wherever it is -1 modulo the block size; each piece gives one
character of the signature.  A fingerprint is ``block:signature:signature at twice the block``.  The block size
follows the length and is then moved until a signature has at most 64 pieces and, where it can, at least 32, so no
text is cut short.  Fingerprints are compared by edit distance at equal or neighbouring block sizes.

Null and empty texts have the fingerprint ``3::``.  Equal texts have equal fingerprints and the likeness 1; an
empty text has the likeness 0 to any other.  Repeated ids are ordered by text; a null id stands before all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import NULL_ID, mix, partitions, span_hashes, table

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SMALLEST, MOST, FEWEST = 3, 64, 32


def _signature(ends: np.ndarray, data: np.ndarray) -> str:
    ends = ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))
    starts = np.concatenate(([0], ends[:-1]))
    return LETTERS[(mix(span_hashes(data, starts, ends)) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{SMALLEST}::"
    x = data.astype(np.uint32)
    rolling, shifted = x * np.uint32(8), x.copy()
    for k in range(1, min(7, n)):
        rolling[k:] += x[:-k] * np.uint32(8 - k)
        shifted[k:] ^= x[:-k] << np.uint32(5 * k)
    rolling += shifted
    block = SMALLEST
    while block * MOST < n:
        block *= 2
    cut = lambda b: np.flatnonzero(rolling % np.uint32(b) == b - 1) + 1
    ends = cut(block)
    while len(ends) < FEWEST and block > SMALLEST and len(more := cut(block // 2)) < MOST:
        block, ends = block // 2, more
    while len(ends) >= MOST:
        block *= 2
        ends = cut(block)
    return f"{block}:{_signature(ends, data)}:{_signature(cut(2 * block), data)}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from the two fingerprints alone."""
    x, y = F.split(a, ":"), F.split(b, ":")
    size = lambda p: F.get(p, F.lit(0)).cast("long")

    def score(p: Column, q: Column) -> Column:
        most = F.greatest(F.length(p), F.length(q))
        return F.when(most == 0, 0.0).otherwise(1 - F.levenshtein(p, q) / most)

    one, two = (lambda p: F.get(p, F.lit(1))), (lambda p: F.get(p, F.lit(2)))
    return (
        F.when(a == b, 1.0)
        .when(size(x) == size(y), F.greatest(score(one(x), one(y)), score(two(x), two(y))))
        .when(size(x) == 2 * size(y), score(one(x), two(y)))
        .when(size(y) == 2 * size(x), score(two(x), one(y)))
        .otherwise(0.0)
        .cast("double")
    )


def fingerprints(docs: DataFrame, text: str = "text") -> Column:
    """A column expression: the fingerprint of each whole text."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.fillna("").map(fingerprint)

    return run(F.col(text))


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


PAIR_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def _pairs(batches):
    """Rows come ordered within each bucket; each is emitted once the row after it is known."""
    held, out = None, []

    def flush():
        return pa.RecordBatch.from_pylist(out, schema=_PAIRS)

    for batch in batches:
        for bucket, own, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            mark = fingerprint(text)
            if held and held[0] == bucket and held[1]:
                changed = edited(held[3], text)
                out.append({"doc_id": None if held[2] == NULL_ID else held[2], "n_chars": len(held[3]), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": held[4], "edited_fingerprint": fingerprint(changed), "next_fingerprint": mark})
            held = (bucket, own, i, text, mark)
            if len(out) >= 2000:
                yield flush()
                out = []
    if out:
        yield flush()


_PAIRS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string())])


def with_following(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of the text edited with the next document, and the next one's.

    Ids are dealt in ranges, one a partition (the first id of each is all that the driver holds); a range also gets
    the first document of the range after it, so that one shuffle brings each document and the next together.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    ids = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("i"))
    firsts = ids.repartitionByRange(n, "i").groupBy(F.spark_partition_id()).agg(F.min("i").alias("first"))
    bounds = np.array(sorted(r["first"] for r in firsts.collect()) or [NULL_ID], np.int64)

    @F.pandas_udf("bucket int, first boolean")
    def place_of(i):
        at = np.searchsorted(bounds, i.to_numpy(), "right") - 1
        return pd.DataFrame({"bucket": at.astype(np.int32), "first": bounds[at] == i.to_numpy()})

    placed = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("i"), F.coalesce("text", F.lit("")).alias("text")).withColumn("p", place_of("i"))
    place = lambda bucket, own: F.struct(bucket.cast("int").alias("bucket"), F.lit(own).alias("own"))
    here, before = F.col("p.bucket"), F.when(F.col("p.bucket") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("p.bucket") - 1)
    spread = placed.select("i", "text", F.explode(F.when(F.col("p.first"), F.array(place(here, True), place(before, False))).otherwise(F.array(place(here, True)))).alias("q"))
    spread = spread.select("q.bucket", "q.own", "i", "text")
    dealt = spread.repartitionById(len(bounds), F.col("bucket")).sortWithinPartitions("bucket", F.col("own").desc(), "i", "text")
    return dealt.mapInArrow(_pairs, PAIR_SCHEMA)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_following(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
