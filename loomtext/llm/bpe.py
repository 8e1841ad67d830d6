"""BPE encoding and decoding through a table of distinct words.

Texts are split into the tokenizer's own words, block by block (about ``BLOCK_BYTES`` of texts, or one longer text): a
block's distinct words are listed once, and each text keeps the places of its words in that list, in one to five
bytes each.  The lists are dealt into buckets by a hash of the word, a packed row a block and bucket; a bucket
(about ``BUCKET`` words) is a part of the table of distinct words, and each of its words is encoded once by the tokenizers
library.  The ids go back to the blocks that hold the word, and from there by the packed places to the texts.  Decoding
joins the blocks with the id-to-piece table, and puts pieces in the ids' places.  So a word is shuffled once for each
block it stands in and not for each place it stands at, and the commonest word costs no more than any other of a block.

Blocks are cut from the rows as they come, once for the lists and once for the texts, so that neither is written twice;
a block's key is a hash of what it holds.  A table that gives its rows in another order when it is read again (one that
was not written) is noticed by a key that lacks its ids, and ends the query rather than giving a wrong text.

Special-token strings in a text are what the library makes of them: single special ids.  The splitting rules here
cover code points below U+0300; a text with any other is split by the library's normalizer and pre-tokenizer, and its
words go through the same table.  ``WordTable`` is the same for a single worker: it keeps the ids of up to twice
``WORDS`` words (the less recent half goes first).

Null counts as empty; an empty text has no ids and decodes to the empty text.  Repeated rows stay repeated.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import partitions, single_thread, steps, table

#: Words whose ids a worker keeps before it starts a new half of its table.
WORDS = 100_000
#: White space below U+0300, and the contractions that are words of their own.
SPACE, CONTRACTIONS = "\t\n\x0b\x0c\r \x85\xa0", "'s|'t|'re|'ve|'m|'ll|'d"
_BEYOND = re.compile("[^\x00-˿]")


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the installed public tokenizers (looked up where it is used)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> tuple[str, str, str]:
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == kind)
    return of("L"), of("N"), re.escape(SPACE)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> list[str]:
    """What stands for each byte in a byte-level vocabulary: itself if it prints, else the next letter from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + rest.index(b)) for b in range(256)]


class _Ids(dict):
    """word -> its ids, packed; a word is encoded when it is first asked for."""

    def __init__(self, tokenizer, special: dict[str, bytes]):
        super().__init__(special)
        self.special, self.older, self.tokenize = special, {}, tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))

    def encode(self, word: str) -> list[int]:
        return [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = packed(self.encode(word))
        self[word] = ids
        return ids

    def renew(self) -> None:
        """Keeps the words as the older half, and starts a new one."""
        self.older = dict(self)
        self.clear()
        self.update(self.special)


class _Places(dict):
    """word -> its place among the distinct words met so far."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class WordTable:
    """Encodes and decodes texts as the tokenizer in the file does (``add_special_tokens=False``)."""

    def __init__(self, path: str, words: int = WORDS):
        single_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        letters, numbers, space = _classes()
        self.lower = plan["normalizer"] is not None
        if self.lower:
            self.word = re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        else:
            self.word = re.compile(f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")
        special = {t["content"]: t["id"] for t in plan["added_tokens"]}
        self.special = {s: packed([i]) for s, i in special.items()}
        self.special_of, self.special_ids = special, set(special.values())
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pieces = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.joined, self.width = plan["decoder"] is None, 2 if len(self.pieces) <= 1 << 16 else 4
        self.byte = {c: chr(b) for b, c in enumerate(byte_letters())}
        self.table, self.most = _Ids(self.tokenizer, self.special), words

    def _split(self, text: str) -> list[str]:
        """Words by the library's own rules."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return ["".join(w).encode("latin-1").decode() for w in (map(self.byte.__getitem__, piece) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))]

    def words(self, text: str) -> list[str]:
        """A special token stands as a word of its own."""
        if not text.isascii() and _BEYOND.search(text):
            parts = [text] if self.cut is None else self.cut.split(text)
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self._split(part))]
        if self.cut is None or "<|" not in text or len(parts := self.cut.split(text)) == 1:
            return self.word.findall(text.lower() if self.lower else text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.word.findall(part.lower() if self.lower else part))]

    def ids(self, word: str) -> list[int]:
        """The ids of one word, or of a special token."""
        return [self.special_of[word]] if word in self.special_of else self.table.encode(word)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.table) > self.most:
            self.table.renew()
        take = self.table.__getitem__
        return [b"".join(map(take, self.words(t or ""))) for t in texts]

    def piece(self, i: int) -> bytes:
        """What an id adds to a decoded text."""
        token = self.pieces[i]
        return token.encode() if self.joined or i in self.special_ids else "".join(map(self.byte.__getitem__, token)).encode("latin-1")

    def text_of(self, pieces: list[bytes]) -> str:
        return (b" " if self.joined else b"").join(pieces).decode("utf-8", "replace")

    def decode(self, ids: bytes | None) -> str:
        """As ``decode(ids, skip_special_tokens=False)``: pieces joined by a space where the file names no decoder."""
        return self.text_of(list(map(self.piece, np.frombuffer(ids or b"", "<u4").tolist())))


@lru_cache(maxsize=2)
def word_table(path: str, words: int = WORDS) -> WordTable:
    """The worker's own table: later tasks find the words of earlier ones."""
    return WordTable(path, words)


def _appended(df: DataFrame, field: str, kind: str) -> T.StructType:
    return T.StructType([*[f for f in df.schema if f.name != field], T.StructField(field, T.DataType.fromDDL(kind))])


def _append(batch: pa.RecordBatch, field: str, column: pa.Array) -> pa.RecordBatch:
    kept = [k for k in batch.schema.names if k != field]
    return pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], column], [*kept, field])


#: Names of the columns that these operators add in between; no column of the input is called so.
BLOCK, PLACES = "own block", "own places"
#: Text of a block, and of the blocks whose words make up a bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each) of numbers below 2^32: seven bits a byte, low ones first, the top bit where more follow."""
    sizes = np.ones(len(values), np.int8)
    for k in range(1, 5):
        sizes += values >= 1 << 7 * k
    ends = np.cumsum(sizes, dtype=np.int64)
    out, starts = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), ends - sizes
    for k in range(5):
        more = sizes > k
        out[starts[more] + k] = values[more] >> np.uint64(7 * k) & np.uint64(127) | (sizes[more] > k + 1).astype(np.uint64) << np.uint64(7)
    return out, ends


def numbers(raw: np.ndarray) -> np.ndarray:
    """The numbers of ``varints``."""
    ends = np.flatnonzero(raw < 128) + 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(5):
        more = ends - starts > k
        out[more] |= (raw[starts[more] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def _gathered(batches, column: str, limit: int):
    """Steps put together up to ``limit`` bytes of ``column``."""
    held, size = [], 0
    for batch in steps(batches, column, limit):
        own = batch.column(column).nbytes
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(batches, column: str, cut):
    """(batch, key, words, place of each word, words of each row); a block's list begins with its commonest words."""
    part = TaskContext.get().partitionId()
    for batch in _gathered(batches, column, BLOCK_BYTES):
        met = _Places()
        found = [np.fromiter(map(met.__getitem__, cut(x)), np.int64) for x in batch.column(column).to_pylist()]
        every, counts, words = np.concatenate(found), list(map(len, found)), list(met)
        order = np.argsort(-np.bincount(every, minlength=len(met)), kind="stable")
        rank = np.empty(len(met), np.uint64)
        rank[order] = np.arange(len(met), dtype=np.uint64)
        places, words = rank[every], [words[k] for k in order.tolist()]
        key = xxhash.xxh3_64(part.to_bytes(4, "little") + np.array(counts, "<u4").tobytes())
        key.update(places.tobytes())
        for w in words:
            key.update(w.encode() + b"\0")
        yield batch, key.intdigest() - (1 << 63), words, places, counts


def _rows(df: DataFrame, column: str, split, drop: bool) -> DataFrame:
    """``df`` with the block of each row and the places of its words in the block's list.

    ``split``: makes the function that cuts a value into words, in the worker.
    """
    kept = [f for f in df.schema if not (drop and f.name == column)]
    schema = T.StructType([*kept, T.StructField(BLOCK, T.LongType()), T.StructField(PLACES, T.BinaryType())])

    def run(batches):
        for batch, key, _, places, counts in _blocks(batches, column, split()):
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array([key] * len(batch), pa.int64()), pa.array(_cut(*varints(places), counts), pa.binary())], [f.name for f in schema])

    return df.mapInArrow(run, schema)


def _cut(raw: np.ndarray, ends: np.ndarray, counts: list[int]) -> list[bytes]:
    """The bytes of so many numbers each."""
    at, raw = np.concatenate(([0], ends))[np.cumsum([0, *counts])].tolist(), raw.tobytes()
    return [raw[a:b] for a, b in pairwise(at)]


def _packed_strings(parts: list[bytes]) -> tuple[bytes, bytes]:
    return varints(np.array(list(map(len, parts)), np.uint64))[0].tobytes(), b"".join(parts)


def _strings(sizes: bytes, raw: bytes) -> list[bytes]:
    ends = np.cumsum(numbers(np.frombuffer(sizes, np.uint8))).tolist()
    return [raw[a:b] for a, b in pairwise([0, *ends])]


WORD_ROWS = "bucket bigint, block bigint, places binary, sizes binary, words binary"
ID_ROWS = "bucket bigint, block bigint, places binary, sizes binary, ids binary"


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], pa.int64() if f.endswith("bigint") else pa.binary()) for f in ddl.split(", ")])


def _dealt(column: str, split, buckets: int):
    """The words of a block's list in each bucket, and their places (as steps from one to the next)."""

    def run(batches):
        for _, key, words, _, _ in _blocks(batches, column, split()):
            raw = [w.encode() for w in words]
            bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64) % np.uint64(buckets)
            order, out = np.argsort(bucket, kind="stable"), []
            edges = [0, *(np.flatnonzero(np.diff(bucket[order].astype(np.int64))) + 1).tolist(), len(order)]
            for a, b in pairwise(edges if len(order) else [0]):
                own = order[a:b]
                out.append((int(bucket[own[0]]), key, varints(np.diff(own, prepend=0).astype(np.uint64))[0].tobytes(), *_packed_strings([raw[k] for k in own.tolist()])))
            # an empty row of a bucket below zero stands for the block itself
            out.append((-1 - key % (1 << 30), key, b"", b"", b""))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _arrow(WORD_ROWS), strict=True)], schema=_arrow(WORD_ROWS))

    return run


def _encoded(path: str):
    """The ids of each row's words; rows come bucket by bucket, and a bucket's words are encoded once."""

    def run(batches):
        found, last, known, width = word_table(path), None, {}, word_table(path).width
        for batch in batches:
            out = []
            for bucket, block, places, sizes, words in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if bucket != last:
                    last, known = bucket, {}
                ids = []
                for w in _strings(sizes, words):
                    own = known.get(w)
                    if own is None:
                        known[w] = own = np.array(found.ids(w.decode()), f"<u{width}").tobytes()
                    ids.append(own)
                out.append((bucket, block, places, *_packed_strings(ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _arrow(ID_ROWS), strict=True)], schema=_arrow(ID_ROWS))

    return run


def _word_ids(docs: DataFrame, path: str, text: str, drop: bool) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``docs``, and for each block and bucket the ids of the words: every distinct word of all texts is encoded once."""

    def split():
        words = word_table(path).words
        return lambda t: words(t or "")

    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    lists = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_dealt("text", split, 1 + size // BUCKET_BYTES), WORD_ROWS)
    dealt = lists.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return _rows(docs, text, split, drop), dealt.mapInArrow(_encoded(path), ID_ROWS)


def _ids_by_place(parts: pa.Table) -> list[bytes]:
    """The ids of the words of a block's list, packed in the vocabulary's width."""
    at, own = [], []
    for places, sizes, ids in zip(*(parts.column(k).to_pylist() for k in ("places", "sizes", "ids")), strict=True):
        at.append(np.cumsum(numbers(np.frombuffer(places, np.uint8))))
        own += _strings(sizes, ids)
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    out = [b""] * len(own)
    for place, x in zip(at.tolist(), own, strict=True):
        out[place] = x
    return out


def _widened(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _joined_back(blocks: DataFrame, parts: DataFrame, make, schema: T.StructType) -> DataFrame:
    """``make`` gets the places of each of a block's rows and the block's ``parts``, and tells the columns to add."""

    def run(rows: pa.Table, parts: pa.Table) -> pa.Table:
        places = (numbers(np.frombuffer(x, np.uint8)).tolist() for x in rows.column(PLACES).to_pylist())  # a row's at a time
        more = make(places, parts)
        return pa.Table.from_arrays([more[f.name] if f.name in more else rows.column(f.name) for f in schema], [f.name for f in schema])

    return blocks.groupBy(BLOCK).cogroup(parts.groupBy("block")).applyInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) for each whole text."""
    blocks, parts = _word_ids(docs, path, text, False)

    def make(places, parts):
        own, width = _ids_by_place(parts), word_table(path).width
        return {ids: pa.array([_widened(b"".join(map(own.__getitem__, p)), width) for p in places], pa.binary())}

    return _joined_back(blocks, parts, make, _appended(docs, ids, "binary"))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The id-to-piece table: a row for each id of the vocabulary."""
    words = word_table(path)
    return spark.createDataFrame([(i, words.piece(i)) for i in range(len(words.pieces))], "id bigint, piece binary")


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with ``into``: the text of each row's ids, as ``decode(ids, skip_special_tokens=False)`` gives it.

    The distinct ids of each block are joined with the id-to-piece table.
    """
    split = lambda: lambda x: map(str, np.frombuffer(x or b"", "<u4").tolist())
    schema = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("id", pa.int64())])

    def distinct(batches):
        for _, key, words, _, _ in _blocks(batches, "ids", split()):
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.int64()), pa.array(range(len(words)), pa.int64()), pa.array(map(int, words), pa.int64())], schema=schema)

    def make(places, parts):
        words, own = word_table(path), dict(zip(parts.column("place").to_pylist(), parts.column("piece").to_pylist(), strict=True))
        return {into: pa.array([words.text_of(list(map(own.__getitem__, p))) for p in places], pa.string())}

    entries = encoded.select(F.col(f"`{ids}`").alias("ids")).mapInArrow(distinct, "block bigint, place bigint, id bigint")
    told = entries.join(pieces(encoded.sparkSession, path), "id").select("block", "place", "piece")
    return _joined_back(_rows(encoded, ids, split, False), told, make, _appended(encoded, into, "string"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of each document.

    Each block of texts is joined with the id-to-piece table, which is one packed row: a vocabulary's size bounds it.
    """
    blocks, parts = _word_ids(docs.select("doc_id", "text"), path, "text", True)
    spark = docs.sparkSession
    words = word_table(path)
    sizes, raw = _packed_strings([words.piece(i) for i in range(len(words.pieces))])
    packed_pieces = spark.createDataFrame([(path, sizes, raw)], "vocabulary string, piece_sizes binary, pieces binary")
    # the row that stands for a block takes the table
    parts = parts.withColumn("vocabulary", F.when(F.col("bucket") < 0, F.lit(path))).join(F.broadcast(packed_pieces), "vocabulary", "left").drop("vocabulary")

    def make(places, parts):
        words, own = word_table(path), _ids_by_place(parts)
        told = parts.select(["piece_sizes", "pieces"]).filter(parts.column("bucket").to_numpy() < 0).to_pylist()[0]
        piece, joint, code = _strings(told["piece_sizes"], told["pieces"]), b" " if words.joined else b"", "H" if words.width == 2 else "I"
        text = [joint.join(map(piece.__getitem__, memoryview(x).cast(code).tolist())) for x in own]
        whole, ids, decoded = all(own), [], []  # a word may have no ids
        for p in places:
            ids.append(_widened(b"".join(map(own.__getitem__, p)), words.width))
            decoded.append(joint.join(map(text.__getitem__, p if whole else [k for k in p if own[k]])).decode("utf-8", "replace"))
        return {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())}

    return _joined_back(blocks, parts, make, T.StructType.fromDDL("doc_id bigint, ids binary, decoded string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    return round_trip(docs, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
