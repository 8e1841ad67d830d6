"""Token-id files: one id array and Elias-Fano coded document boundaries in each block.

A block is ``header | boundaries | document ids | ids``.  The boundaries (the end of each document in the block's ids,
which never falls) and the documents' ids less the first are Elias-Fano coded: low bits packed side by side, high
parts in unary, with the position of every 64th one as select samples.  So a boundary costs about 2 + log2(ids /
documents) bits, and ``select`` finds one without a table of offsets: readers take each document's place from it, and
nothing is kept as 64-bit numbers.  Ids take two bytes where the vocabulary allows.  Blocks are rows of a Parquet table
in the shared folder, written and read by Spark's own writers, in ascending doc_id order; a block's place in the corpus
is the sum of those before it.

Null and empty texts hold the end id alone.  A null doc_id comes first; repeated ids are ordered by text.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.bpe import vocabulary, word_table
from loomtext.llm.common import NULL_ID, materialize, partitions, steps, table

MAGIC, SAMPLE = b"TKE2", 64
#: Magic, width of an id, documents, those without an id (they come first), and the first id.
_HEAD = struct.Struct("<4sBxxxQQq")
#: Count, bytes of the unary part and width of the low bits of one sequence.
_SEQUENCE = struct.Struct("<QQB7x")
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """A sequence of numbers below 2^64 that never falls."""

    def __init__(self, raw: bytes, at: int):
        self.n, upper, self.low = _SEQUENCE.unpack_from(raw, at)
        at += _SEQUENCE.size
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(raw, "<u8", samples, at)
        at += 8 * samples
        self.upper = raw[at : at + upper]
        at += upper
        self.end = at + -(-self.n * self.low // 8)
        self.lower = raw[at : self.end]

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        upper[high] = 1
        upper = np.packbits(upper, bitorder="little").tobytes()
        return _SEQUENCE.pack(n, len(upper), low) + high[::SAMPLE].astype("<u8").tobytes() + upper + _pack_bits(values & np.uint64((1 << low) - 1), low)

    def select(self, i: int) -> int:
        """Number ``i``: the place of the i-th one from the sample before it, and the low bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        bits = self.upper[byte] >> (at % 8) << (at % 8)
        while (ones := int(_ONES[bits])) <= left:
            left -= ones
            byte += 1
            bits = self.upper[byte]
        for _ in range(left):
            bits &= bits - 1  # drops the lowest one
        high = 8 * byte + (bits & -bits).bit_length() - 1 - i
        at = i * self.low
        chunk = int.from_bytes(self.lower[at // 8 : (at + self.low + 7) // 8], "little")
        return high << self.low | chunk >> (at % 8) & (1 << self.low) - 1


def encode_block(documents: list[bytes], width: int, names: list[int | None] | None = None) -> bytes:
    """``documents``: ids of each as little-endian unsigned 32-bit integers; ``names``: their doc_ids, rising, null first."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    ends = np.cumsum([len(d) // 4 for d in documents], dtype=np.uint64)
    known = [i for i in (range(len(documents)) if names is None else names) if i is not None]
    first = known[0] if known else 0
    head = _HEAD.pack(MAGIC, width, len(documents), len(documents) - len(known), first)
    return head + EliasFano.encode(ends) + EliasFano.encode(np.array([i - first for i in known], np.uint64)) + ids.astype(f"<u{width}").tobytes()


class Block:
    """A block's documents, found by ``select`` alone."""

    def __init__(self, raw: bytes):
        magic, self.width, self.n, self.nameless, self.first = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        self.ends = EliasFano(raw, _HEAD.size)
        self.names = EliasFano(raw, self.ends.end)
        self.ids = np.frombuffer(raw, f"<u{self.width}", -1, self.names.end)

    def end(self, i: int) -> int:
        return self.ends.select(i)

    def name(self, i: int) -> int | None:
        """The doc_id of document ``i``."""
        return None if i < self.nameless else self.first + self.names.select(i - self.nameless)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.end(i - 1) if i else 0 : self.end(i)]


#: ``part``: the first id of the block's range; ``place``: ids of the range before this block.
BLOCKS = "part bigint, block int, place bigint, n_ids bigint, payload binary"
_BLOCKS = pa.schema([("part", pa.int64()), ("block", pa.int32()), ("place", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])


def write(docs: DataFrame, path: str, end_id: int, block_bytes: int = 2 << 20, words_kept: int = 400_000) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write the blocks; returns the written table.

    ``words_kept``: words whose ids a worker keeps (twice as many at most).
    """
    n = partitions(docs.sparkSession)

    def run(batches):
        words, part, block, place = word_table(path, words_kept), None, 0, 0
        width = 2 if max(end_id, len(words.pieces) - 1) < 1 << 16 else 4
        end = struct.pack("<I", end_id)
        for batch in steps(batches, limit=block_bytes):
            documents = [ids + end for ids in words.encode(batch.column("text").to_pylist())]
            doc_ids = batch.column("i").to_pylist()
            part = doc_ids[0] if part is None else part
            n_ids = sum(map(len, documents)) // 4
            row = {"part": part, "block": block, "place": place, "n_ids": n_ids, "payload": encode_block(documents, width, [None if x == NULL_ID else x for x in doc_ids])}
            block, place = block + 1, place + n_ids
            yield pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

    ordered = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(n, "i").sortWithinPartitions("i", "text")
    return materialize(ordered.mapInArrow(run, BLOCKS), "token-blocks")


READ = "doc_id bigint, part bigint, place bigint, n_tokens bigint, ids_crc32 bigint"
_READ = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            block, at, out = Block(row["payload"]), 0, []
            for i in range(block.n):
                end = block.end(i)
                out.append((block.name(i), row["part"], row["place"] + at, end - at, zlib.crc32(block.ids[at:end].astype("<u4").tobytes())))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)


def read(blocks: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start in the whole corpus, n_tokens, crc32 of its ids."""
    # a row for each range of ids that was written, so one task is enough for their running sum
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    found = blocks.mapInArrow(_documents, READ)
    return found.join(bases, F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2))
