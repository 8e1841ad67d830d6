"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A window is ten consecutive words of
an item (a shorter item is one window).  Both sides keep the least of each six consecutive 5-gram hashes, so any
shared window shares a kept hash.  The distinct kept hashes of documents and benchmark are joined; documents that share
one are read again, and each of their kept grams is joined with the benchmark's by its hash and extended on the words
around it, at most to the length of a window on either side.  A hit is an extension of a window's length or more, so it
needs equal words, not equal hashes, and the hits of a document are the union of its extensions.  Grams with the same
words around them are one row on either side, so repeated words cost no product of places.

Nothing is gathered but a document's own kept hashes and hits, and its items.  Neither join needs the benchmark to be
small: Spark broadcasts its hashes only when it finds them small; otherwise they meet by hash, with the documents dealt
over ``SALTS`` parts of each hash, as one passage may stand in many documents.

Null texts have no words: no hits, not contaminated.  Repeated rows and ids each get their own row.  Items with no
words, and an empty benchmark, hit nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import ALNUM, LOWER, gram_hashes, steps, table, text_bytes, word_hashes, word_spans

WINDOW, GRAM, SALTS = 10, 5, 8


def winnow(hashes: np.ndarray, owner: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of any ``w`` consecutive ones of one owner (all of them on ties).

    Owners rise; grams that cross rows have none (-1) and stand between two rows, so never inside a window.
    """
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    n = len(hashes) - w + 1
    least = hashes[:n].copy()
    for k in range(1, w):
        np.minimum(least, hashes[k : k + n], out=least)
    whole = (owner[:n] == owner[w - 1 :]) & (owner[:n] >= 0)
    kept = np.zeros(len(hashes), bool)
    for k in range(w):
        kept[k : k + n] |= whole & (hashes[k : k + n] == least)
    return np.flatnonzero(kept)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, row) of the words of a column."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    return (data, *word_spans(data, offsets, ALNUM))


class _Kept:
    """The kept grams of a batch of texts, for one length of window at a time."""

    def __init__(self, column: pa.Array):
        self.data, self.starts, self.ends, self.row = words_of(column)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.count = np.bincount(self.row, minlength=len(column))
        self.first = np.searchsorted(self.row, np.arange(len(column)))

    def grams(self, length: int, own_length: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place among all words, hash); ``own_length``: only of texts whose windows have this length."""
        gram = min(GRAM, length)
        hashes = gram_hashes(self.hashes, gram)
        owner = self.row[: len(hashes)].copy()
        owner[self.row[: len(hashes)] != self.row[gram - 1 :]] = -1  # crosses rows
        if own_length:
            owner[np.minimum(self.count, WINDOW)[self.row[: len(hashes)]] != length] = -1
        at = winnow(hashes, owner, length - gram + 1)
        return owner[at], at, hashes[at]

    def around(self, row: int, at: int, length: int) -> tuple[str, int]:
        """The words up to a window's length on either side of a gram, one space apart, and those before the gram."""
        low = max(int(self.first[row]), at - (length - min(GRAM, length)))
        high = min(int(self.first[row] + self.count[row]), at + length)
        words = zip(self.starts[low:high].tolist(), self.ends[low:high].tolist(), strict=True)
        return b" ".join([self.data[a:b].tobytes() for a, b in words]).decode("utf-8", "surrogateescape"), at - low


PRINTS = "key bigint, twin bigint, length int, hash bigint"
_PRINTS = pa.schema([("key", pa.int64()), ("twin", pa.int64()), ("length", pa.int32()), ("hash", pa.int64())])


def _prints(lengths: list[int]):
    """The distinct kept hashes of each document, for windows of each length that the benchmark has."""

    def run(batches):
        for batch in steps(batches):
            kept = _Kept(batch.column("text"))
            keys, twins = (np.asarray(batch.column(k)) for k in ("key", "twin"))
            for length in lengths:
                row, _, hashes = kept.grams(length)
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                row, hashes = row[new], hashes[new]
                yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(twins[row]), pa.array(np.full(len(row), length, np.int32)), pa.array(hashes.view(np.int64))], schema=_PRINTS)

    return run


ITEMS = "item_id bigint, length int, hash bigint, theirs string, before int"
_ITEMS = pa.schema([("item_id", pa.int64()), ("length", pa.int32()), ("hash", pa.int64()), ("theirs", pa.string()), ("before", pa.int32())])


def _item_grams(batches):
    for batch in steps(batches):
        kept, names = _Kept(batch.column("text")), batch.column("item_id").to_pylist()
        for length in range(1, WINDOW + 1):
            found = {(names[r], h, *kept.around(r, a, length)) for r, a, h in zip(*(x.tolist() for x in kept.grams(length, True)), strict=True)}
            if found:
                item, hashes, words, before = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([length] * len(item), pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(words), pa.array(before, pa.int32())], schema=_ITEMS)


PLACED = "key bigint, twin bigint, length int, hash bigint, ours string, ahead int, places array<int>"
_PLACED = pa.schema([("key", pa.int64()), ("twin", pa.int64()), ("length", pa.int32()), ("hash", pa.int64()), ("ours", pa.string()), ("ahead", pa.int32()), ("places", pa.list_(pa.int32()))])


def _placed(batches):
    """The kept grams whose hash the benchmark has, with the words around them and all places that look so."""
    for batch in steps(batches):
        kept, out = _Kept(batch.column("text")), []
        keys, twins, wanted = (batch.column(k).to_pylist() for k in ("key", "twin", "shared"))
        wanted = [{(w["length"], w["hash"]) for w in own} for own in wanted]
        for length in sorted({n for own in wanted for n, _ in own}):
            row, at, hashes = kept.grams(length)
            found: dict[tuple, list[int]] = {}
            for r, a, h in zip(row.tolist(), at.tolist(), hashes.view(np.int64).tolist(), strict=True):
                if (length, h) in wanted[r]:
                    found.setdefault((r, h, *kept.around(r, a, length)), []).append(a - int(kept.first[r]))
            out += [(keys[r], twins[r], length, h, words, ahead, places) for (r, h, words, ahead), places in found.items()]
            while len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[:1024], strict=True), _PLACED, strict=True)], schema=_PLACED)
                out = out[1024:]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PLACED, strict=True)], schema=_PLACED)


def _agree(ours: Column, theirs: Column) -> Column:
    """How many first words of two arrays of one length agree."""
    same = F.zip_with(ours, theirs, lambda a, b: a == b)
    return F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int") - 1


def extended(pairs: DataFrame) -> DataFrame:
    """(key, twin, item_id, start, stop) of the grams whose words agree on either side as far as to make up a window.

    Columns of the JVM, so that a task whose grams meet the benchmark in the same stage needs no second Python worker.
    """
    pairs = pairs.withColumns({"ours": F.split("ours", " "), "theirs": F.split("theirs", " ")})
    most = F.least(F.size("ours") - F.col("ahead"), F.size("theirs") - F.col("before"))
    back = F.least("ahead", "before")
    after = lambda words, at: F.slice(words, F.col(at) + 1, most)
    ahead_of = lambda words, at: F.reverse(F.slice(words, F.col(at) - back + 1, back))
    reach = pairs.select("key", "twin", "length", "places", "item_id", _agree(after("ours", "ahead"), after("theirs", "before")).alias("right"), _agree(ahead_of("ours", "ahead"), ahead_of("theirs", "before")).alias("left"))
    # the gram's own words must agree too: equal hashes are not enough
    whole = reach.where((F.col("right") >= F.least(F.lit(GRAM), "length")) & (F.col("left") + F.col("right") >= F.col("length")))
    return whole.withColumn("place", F.explode("places")).select("key", "twin", "item_id", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("stop"))


def _keyed(docs: DataFrame) -> DataFrame:
    """A document's key is its id and a hash of its text: rows that agree in both have the same hits."""
    return docs.select(F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text", F.col("doc_id").isNull()).alias("twin"), F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def _dealt(rows: DataFrame, theirs: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``salt``: a hash of many documents is dealt over ``salts`` parts, each with a copy of the benchmark's."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("key", "twin"), F.lit(salts)).cast("int")), theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _hits(keyed: DataFrame, benchmark: DataFrame, salts: int) -> DataFrame:
    """(key, twin, item_id, start, stop): the extensions, in words of the document."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().mapInArrow(_item_grams, ITEMS).distinct()
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # ten values at most
    keyed = keyed.select("key", "twin", "text")
    prints, known = _dealt(keyed.mapInArrow(_prints(lengths), PRINTS), items.select("length", "hash").distinct(), salts)
    shared = prints.join(known, ["length", "hash", "salt"], "left_semi")
    shared = shared.groupBy("key", "twin").agg(F.collect_set(F.struct("length", "hash")).alias("shared"))
    placed, theirs = _dealt(keyed.join(shared, ["key", "twin"]).mapInArrow(_placed, PLACED), items, salts)
    return extended(placed.join(theirs, ["length", "hash", "salt"]))


def covered(spans: Column) -> Column:
    """How many places an array of (start, stop) covers."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["reach"]), F.lit(0))).alias("n"), F.greatest(a["reach"], s["stop"]).alias("reach"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"].cast("long"))


def _counted(batches):
    for batch in steps(batches):
        row = words_of(batch.column("text"))[-1]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "key", "twin")), pa.array(np.bincount(row, minlength=len(batch)).astype(np.int64))], ["doc_id", "key", "twin", "n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, salts: int = SALTS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, the ids of items with an occurring window, contaminated."""
    keyed = _keyed(docs.select("doc_id", "text"))
    found = _hits(keyed, benchmark, salts).groupBy("key", "twin").agg(
        covered(F.collect_set(F.struct("start", "stop"))).alias("n_hit"),
        # an item without an id counts too, after all others
        F.collect_set(F.struct(F.col("item_id").isNull().alias("none"), "item_id")).alias("items"),
    )
    counted = keyed.select("row.doc_id", "key", "twin", "text").mapInArrow(_counted, "doc_id bigint, key bigint, twin bigint, n_words bigint")
    names = F.transform(F.array_sort("items"), lambda x: x["item_id"])
    none = F.array().cast("array<bigint>")
    return counted.join(found, ["key", "twin"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(names, none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, salts: int = SALTS) -> DataFrame:
    """``docs`` without the contaminated ones."""
    keyed = _keyed(docs)
    return keyed.join(_hits(keyed, benchmark, salts).select("key", "twin").distinct(), ["key", "twin"], "left_anti").select("row.*")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")


def op5_sql() -> str:
    """Every window of every item as an array of words, against every window of every document."""
    return """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, places.n AS n, i FROM places JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
