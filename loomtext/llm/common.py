"""Shared plumbing: reading tables, shared storage, Arrow batches and vectorised byte hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled by one step of a Python worker; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch, so that a batch of texts stays small on both sides.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
#: Stands for a null id wherever rows are ordered by id: before every real id.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # the setting is part of a Python worker's environment for some kinds of functions only, and workers are shared by
    # environment: left on, the idle workers of one kind stay beside those of the other
    spark.conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", False)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own where a local session, as in tests, names none."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="loomtext-"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(held: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    spark = held.sparkSession
    root = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in held.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key of more rows than this share of all is split; so there are at most this many such keys.
HOT_KEYS, HOT_ROWS = 10_000, 10_000


def join_split(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: Column, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (one row a key; ``n``: how many of ``rows`` have it), hot keys dealt over many tasks.

    A key is hot above ``max(HOT_ROWS, total / HOT_KEYS)`` rows, so at most HOT_KEYS keys are: only they are broadcast,
    with the number of parts that each is cut into by the hash of ``spread``.  ``keyed`` repeats a hot key once a part.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int")
    hot = keyed.where(F.col("n") > most).select(*keys, parts.alias("parts"))
    cut = rows.join(F.broadcast(hot), keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("parts").cast("long")), F.lit(0)).cast("int")).drop("parts")
    repeated = keyed.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("n")
    return cut.join(repeated, [*keys, "part"], how).drop("part")


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``limit`` bytes of ``text`` (or one row)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(batch):
            continue
        ends = np.cumsum(np.asarray(pa.compute.binary_length(column).fill_null(0), dtype=np.int64))
        at = 0
        while at < len(batch):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        factor = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, np.uint64)
        factor[0] = 1
        _powers[kind] = np.cumprod(factor, dtype=np.uint64)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data``, the same wherever the span stands."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words longer than this are hashed one by one.
LANES = 4


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data``: eight bytes at a time, mixed in between, so no texts are known to collide."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if not len(sizes):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    for k in range(LANES):
        more = slice(None) if not k else np.flatnonzero(sizes > 8 * k)
        at, left = starts[more] + 8 * k, np.minimum(sizes[more] - 8 * k, 8)
        if not len(at):
            return out
        lane = np.ascontiguousarray(eights[at]).view("<u8").ravel() & _MASKS[left]
        out[more] = mix(out[more] ^ mix(lane + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)))
    for i in np.flatnonzero(sizes > 8 * LANES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def gram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` word hashes (crossing documents too: mask those)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xC2B2AE3D27D4EB4F + 2 * salt * 0x165667B19E3779F9) & ((1 << 64) - 1) | 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up = np.full(len(words), base, np.uint64)
    down = np.full(len(words), inverse, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(salt)) * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the maximal runs of word bytes; no run crosses documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Byte classes of the contracts' words: everything but these ASCII bytes.
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def single_thread() -> None:
    """A task is one core: keep libraries from starting threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def held_out(doc_id: str = "doc_id") -> "F.Column":
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def stratified(rows: DataFrame, label: str, per: int, most: int, doc_id: str = "doc_id", through: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, dict]:
    """About ``per`` rows of each label, fewer if all labels together exceed ``most``, chosen by a hash of their ids; and the labels' counts.

    The excess that chance leaves over ``most`` is taken from each label in proportion.  ``through`` makes the chosen rows smaller
    (it keeps their ids and labels) before they are brought together to be ordered.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).limit(most).collect()}
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id)), F.lit(1_000_000))
    own = min(per, max(1, most // max(1, len(counts))))
    bound = F.lit(0)
    for value, n in counts.items():
        bound = F.when(F.col(label) == F.lit(value), F.lit(min(1_000_000, -(-own * 1_000_000 // n)))).otherwise(bound)
    return through(rows.where(place < bound)).orderBy(place / F.greatest(bound, F.lit(1)), doc_id).limit(most).orderBy(place, doc_id), counts
