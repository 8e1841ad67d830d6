"""Substring dedup by fixed-block anchors.

Words are runs of bytes other than white space (space and U+0009 to U+000D), unchanged; a window is ``WINDOW`` (50)
consecutive words of one document.  A word is removed if a window over it also starts in a document of smaller id.

Every document's non-overlapping blocks of 25 words are indexed and probed with every rolling window of 25 words: a
shared window of 50 words holds a whole block of either document, aligned with a rolling window of the other.  Blocks
and windows meet by the least hash of their 8-word grams; as neighbouring windows mostly share it, runs of them are
one row.  Runs whose key stands in two different texts, once in a block at least, are anchors.  Where anchors
reach over all rolling windows of 50 words, the hit is extended: the bytes of the 50 words are digested (BLAKE2, 128 bits), one row
for each digest of a document however often it stands there, and the smallest document of each digest decides.
Windows in a row that stand first in the same document are joined to a maximal exact repeat (``repeats``).  No pairs of
documents are formed, so a passage in a third of all rows costs one row for each document it stands in, and the joins by
key and by digest cut such hot ones into parts.  Exact copies of a text of smaller id go at once, as one repeat.

Null and empty texts have no words.  Rows with the same id never remove each other's words; a null id counts as larger
than all others.  Equality of windows is that of their digests, of texts that of SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import SPACES, gram_hashes, join_split, materialize, steps, table, text_bytes, word_hashes, word_spans

WINDOW, BLOCK, GRAM = 50, 25, 8
LAST = (1 << 63) - 1
RUNS = "did bigint, twin bigint, key bigint, place bigint, length int, block boolean"
_RUNS = pa.schema([("did", pa.int64()), ("twin", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("length", pa.int32()), ("block", pa.bool_())])


def _words(column: pa.Array):
    data, offsets = text_bytes(column)
    starts, ends, row = word_spans(data, offsets, SPACES)
    return data, offsets, starts, ends, row


def _runs(batches):
    """Rolling windows of ``BLOCK`` words by their keys, runs of equal keys as one row."""
    for batch in steps(batches):
        data, _, starts, ends, row = _words(batch.column("text"))
        hashes = word_hashes(data, starts, ends)
        grams = gram_hashes(hashes, GRAM)
        n = len(hashes) - BLOCK + 1
        if n < 1:
            continue
        key = grams[:n].copy()
        for k in range(1, BLOCK - GRAM + 1):
            np.minimum(key, grams[k : k + n], out=key)
        whole = row[:n] == row[BLOCK - 1 :]
        begins = whole.copy()
        begins[1:] &= ~(whole[:-1] & (row[1:n] == row[: n - 1]) & (key[1:] == key[:-1]))
        at = np.flatnonzero(begins)
        if not len(at):
            continue
        places = np.arange(n) - np.searchsorted(row, np.arange(len(batch)))[row[:n]]
        covered = np.concatenate(([0], np.cumsum(whole)))
        length = np.diff(covered[np.append(at, n)])
        blocks = np.concatenate(([0], np.cumsum(whole & (places % BLOCK == 0))))
        owner = row[at]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(np.asarray(batch.column(k))[owner]) for k in ("did", "twin")), pa.array(key[at].view(np.int64)), pa.array(places[at]), pa.array(length.astype(np.int32)), pa.array(np.diff(blocks[np.append(at, n)]) > 0)],
            schema=_RUNS,
        )


def candidates(n_words: int, runs: np.ndarray) -> np.ndarray:
    """Starts of the windows whose every rolling block is in a shared run, and one in a run that a block anchors."""
    n = n_words - WINDOW + 1
    shared, anchored = np.zeros(n_words + 1, np.int64), np.zeros(n_words + 1, np.int64)
    for place, length, block in runs:
        shared[place : place + length] = 1
        if block:
            anchored[place : place + length] = 1
    shared, anchored, width = np.concatenate(([0], np.cumsum(shared))), np.concatenate(([0], np.cumsum(anchored))), WINDOW - BLOCK + 1
    return np.flatnonzero((shared[width : width + n] - shared[:n] == width) & (anchored[width : width + n] > anchored[:n]))


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>, repeats array<struct<start:bigint,end:bigint,first:bigint>>"
STATE = f"{RESULT}, did bigint, twin bigint, text string, starts binary"
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_REPEATS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64())]))
_RESULT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", _RANGES), ("repeats", _REPEATS)]
_STATE = pa.schema([*_RESULT, ("did", pa.int64()), ("twin", pa.int64()), ("text", pa.string()), ("starts", pa.binary())])


def _kept(batch, data, offsets, starts, ends, row, removed: np.ndarray) -> list[pa.Array]:
    """The result's columns: kept words joined by one space; ``removed``: a flag for each word."""
    kept = np.flatnonzero(~removed)
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts[kept]] += 1
    np.subtract.at(mark, ends[kept], 1)
    keep = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    later = kept[1:][row[kept[1:]] == row[kept[:-1]]]  # kept words with one before them in their text
    joint = starts[later] - 1
    data = data.copy()
    data[joint], keep[joint] = 0x20, True
    ends_of = np.concatenate(([0], np.cumsum(keep)))[offsets]
    raw = data[keep].tobytes()
    digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends_of[:-1].tolist(), ends_of[1:].tolist(), strict=True)]
    ranges: list[list] = [[] for _ in digests]
    if removed.any():
        first = np.searchsorted(row, np.arange(len(digests)))
        edge = np.diff(np.concatenate(([0], removed.astype(np.int8), [0])))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            for r in range(row[a], row[b - 1] + 1):
                lo, hi = max(a, int(np.searchsorted(row, r))), min(b, int(np.searchsorted(row, r, "right")))
                if lo < hi:
                    ranges[r].append({"start": int(lo - first[r]), "end": int(hi - first[r])})
    n = len(digests)
    return [batch.column("doc_id"), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[removed], minlength=n)), pa.array(digests), pa.array(ranges, _RANGES)]


def repeats_of(places: np.ndarray, first: np.ndarray) -> list[dict]:
    """Windows in a row that stand first in the same document, joined to maximal repeats."""
    order = np.argsort(places, kind="stable")
    places, first = places[order], first[order]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(places) != 1) | (np.diff(first) != 0))))
    last = np.append(cut[1:], len(places)) - 1
    return [{"start": a, "end": b + WINDOW, "first": d} for a, b, d in zip(places[cut].tolist(), places[last].tolist(), first[cut].tolist(), strict=True)]


def _settled(batches):
    """Copies and documents with no candidates get their result; the others wait with the starts of their windows."""
    for batch in steps(batches):
        data, offsets, starts, ends, row = _words(batch.column("text"))
        count, first = np.bincount(row, minlength=len(batch)), np.searchsorted(row, np.arange(len(batch)))
        removed, waits, repeats = np.zeros(len(row), bool), [None] * len(batch), [[] for _ in range(len(batch))]
        copies, runs = batch.column("copy_of").to_pylist(), batch.column("runs")
        for k in range(len(batch)):
            if count[k] < WINDOW:
                continue
            if copies[k] is not None:
                removed[first[k] : first[k] + count[k]] = True
                repeats[k] = [{"start": 0, "end": int(count[k]), "first": copies[k]}]
            elif runs[k].is_valid and len(runs[k]):
                own = runs[k].values
                own = zip(*(own.field(f).to_pylist() for f in ("place", "length", "block")), strict=True)
                if len(at := candidates(int(count[k]), own)):
                    waits[k] = at.astype("<u4").tobytes()
        texts = batch.column("text").to_pylist()
        texts = [None if w is None else t for t, w in zip(texts, waits, strict=True)]
        columns = [*_kept(batch, data, offsets, starts, ends, row, removed), pa.array(repeats, _REPEATS)]
        yield pa.RecordBatch.from_arrays([*columns, batch.column("did"), batch.column("twin"), pa.array(texts, pa.string()), pa.array(waits, pa.binary())], schema=_STATE)


WINDOWS = "digest binary, did bigint, twin bigint, places array<int>"
_WINDOWS = pa.schema([("digest", pa.binary()), ("did", pa.int64()), ("twin", pa.int64()), ("places", pa.list_(pa.int32()))])


def _windows(batches):
    """The digests of each document's candidate windows, and the places where each stands."""
    digest = hashlib.blake2b
    for batch in steps(batches):
        data, _, starts, ends, row = _words(batch.column("text"))
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        at = np.concatenate(([0], np.cumsum(ends - starts + 1)))  # of the words once one space apart
        joined, first = b" ".join(words), np.searchsorted(row, np.arange(len(batch))).tolist()
        marks, standing, owner = [], [], []
        for k, (own, begin) in enumerate(zip(batch.column("starts").to_pylist(), first, strict=True)):
            places = np.frombuffer(own, "<u4").astype(np.int64)
            found: dict[bytes, list[int]] = {}
            for p, a, b in zip(places.tolist(), at[begin + places].tolist(), (at[begin + places + WINDOW] - 1).tolist(), strict=True):
                found.setdefault(digest(joined[a:b], digest_size=16).digest(), []).append(p)
            marks += found
            standing += found.values()
            owner += [k] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), *(pa.array(np.asarray(batch.column(x))[owner]) for x in ("did", "twin")), pa.array(standing, _WINDOWS.field("places").type)], schema=_WINDOWS)


def _removed(batches):
    for batch in steps(batches):
        data, offsets, starts, ends, row = _words(batch.column("text"))
        begin, removed, repeats = np.searchsorted(row, np.arange(len(batch))), np.zeros(len(row), bool), []
        for k, own in enumerate(batch.column("later")):
            places = own.values.field("places") if own.is_valid else None
            if places is None or not len(places):
                repeats.append([])
                continue
            first = np.repeat(np.asarray(own.values.field("least")), np.asarray(places.value_lengths()))
            found = repeats_of(np.asarray(places.flatten(), dtype=np.int64), first)
            for r in found:
                removed[begin[k] + r["start"] : begin[k] + r["end"]] = True
            repeats.append(found)
        yield pa.RecordBatch.from_arrays([*_kept(batch, data, offsets, starts, ends, row, removed), pa.array(repeats, _REPEATS)], schema=pa.schema(_RESULT))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, the removed ranges of words, and the repeats that cover them.

    A repeat's ``first`` is the smallest document that it stands in.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64("text").alias("twin"))
    # exact copies of a text of smaller id
    narrow = base.select("did", "twin", F.unhex(F.sha2("text", 256)).alias("whole"))
    groups = materialize(narrow.groupBy("whole").agg(F.min("did").alias("least"), F.max("did").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").drop("most"), "substring-copies")
    copies = join_split(narrow, groups, ["whole"], F.col("did"), _sum(groups)).where("did > least").select("did", "twin", F.col("least").alias("copy_of"), F.lit(None).cast("array<struct<place:bigint,length:int,block:boolean>>").alias("runs"))
    # anchors
    runs = base.select("did", "twin", "text").mapInArrow(_runs, RUNS)
    keys = runs.groupBy("key").agg(F.min("twin").alias("a"), F.max("twin").alias("b"), F.max("block").alias("anchor"), F.count(F.lit(1)).alias("n")).where("a < b").select("key", "anchor", "n")
    keys = materialize(keys, "substring-keys")
    found = join_split(runs.drop("block"), keys, ["key"], F.col("did"), _sum(keys)).groupBy("did", "twin").agg(F.collect_list(F.struct("place", "length", F.col("anchor").alias("block"))).alias("runs"))
    told = found.select("did", "twin", F.lit(None).cast("bigint").alias("copy_of"), "runs").unionByName(copies)
    told = told.groupBy("did", "twin").agg(F.max("copy_of").alias("copy_of"), F.flatten(F.collect_list("runs")).alias("runs"))
    state = materialize(base.join(told, ["did", "twin"], "left").select("doc_id", "did", "twin", "text", "copy_of", "runs").mapInArrow(_settled, STATE), "substrings")
    # exact windows
    waiting = state.where("starts IS NOT NULL")
    windows = materialize(waiting.select("did", "twin", "text", "starts").mapInArrow(_windows, WINDOWS), "substring-windows")
    first = windows.groupBy("digest").agg(F.min("did").alias("least"), F.max("did").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").drop("most")
    first = materialize(first, "substring-firsts")
    later = join_split(windows, first, ["digest"], F.col("did"), _sum(first)).where("did > least").groupBy("did", "twin").agg(F.collect_list(F.struct("places", "least")).alias("later"))
    ended = waiting.select("doc_id", "did", "twin", "text").join(later, ["did", "twin"], "left").select("doc_id", "text", "later").mapInArrow(_removed, RESULT)
    return state.where("starts IS NULL").select(*[x[0] for x in _RESULT]).unionByName(ended)


def _sum(keyed: DataFrame) -> int:
    return keyed.agg(F.sum("n")).first()[0] or 0


def kept_text(text: str, removed: str) -> F.Column:
    """The words of ``text`` outside the ranges ``removed``, joined by one space."""

    @F.pandas_udf("string")
    def run(texts, ranges):
        out = []
        for whole, own in zip(texts.fillna(""), ranges, strict=True):
            words = [w for w in whole.translate(_TO_SPACE).split(" ") if w]
            for r in sorted(own, key=lambda r: -r["start"]):
                del words[r["start"] : r["end"]]
            out.append(" ".join(words))
        return type(texts)(out, index=texts.index, dtype=object)

    return run(F.col(text), F.col(removed))


_TO_SPACE = dict.fromkeys(range(0x09, 0x0E), " ")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("removed", "repeats")


def op6_sql() -> str:
    """Every window of every document, grouped by its words."""
    return """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS p FROM windows JOIN firsts USING (s) WHERE doc_id > least) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda k: NOT list_contains(ps, k)), lambda k: w[k]), ' ') END) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""
