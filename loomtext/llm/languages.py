"""Language ID with string kernels.

Texts are compared by the blended-spectrum presence kernel: the share of byte 1- to 3-grams (letters alone, A-Z
lower-cased) that both hold, hashed to ``WIDTH`` places for each length and normalised.  ``LANDMARKS`` training texts span
the kernel's space (Nyström), one-versus-rest kernel ridge regression is solved in it, and texts are scored by two
matrix products a batch.  Training takes about ``PER`` documents a language (chosen by a hash of their ids, never
the held-out fifth) and snippets of them, so that short texts are judged by a model that has seen such.

Null texts and texts without a letter are ``und`` with score 0; so is all if there is nothing to learn from.  A null
doc_id is not held out and not learned from.  Ties go to the language whose name comes first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import ALNUM, LOWER, held_out, steps, stratified, table, text_bytes

WIDTH, GRAMS, LANDMARKS, PER, MOST, RIDGE = 4096, 3, 256, 400, 20_000, 1e-2
ROWS = 512
_PLAIN = np.where(ALNUM[LOWER] & ~np.isin(np.arange(256), np.arange(0x30, 0x3A)), LOWER, 0x20).astype(np.uint8)


def presence(column: pa.Array) -> np.ndarray:
    """Rows of unit length: which n-grams each text holds."""
    data, offsets = text_bytes(column)
    data = _PLAIN[data].astype(np.uint32)
    row = np.repeat(np.arange(len(column), dtype=np.int64), np.diff(offsets))
    out = np.zeros((len(column), GRAMS * WIDTH), np.float32)
    flat, code = out.ravel(), np.zeros(len(data), np.uint32)
    for n in range(1, GRAMS + 1):
        code = code[: len(data) - n + 1] << np.uint32(8) | data[n - 1 :] if len(data) >= n else code[:0]
        own = row[: len(code)]
        inside = own == row[n - 1 :][: len(code)]
        place = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - WIDTH.bit_length() + 1)
        at = own * (GRAMS * WIDTH) + (n - 1) * WIDTH + place
        flat[at[inside]] = 1
    size = np.sqrt(out.sum(axis=1, keepdims=True))
    return out / np.maximum(size, 1)


def snippets(text: str) -> list[str]:
    """Two snippets of one to a dozen words, picked by a hash of the text; none where it has no word."""
    words = text.split()
    pick = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    sizes = [int(pick.integers(1, 4)), int(pick.integers(4, 13))] if words else []
    starts = [int(pick.integers(0, max(1, len(words) - n + 1))) for n in sizes]
    return [" ".join(words[at : at + n]) for at, n in zip(starts, sizes, strict=True)]


def examples(texts: list[str]) -> np.ndarray:
    """Which n-grams the texts hold, eight places a byte."""
    return np.packbits(presence(pa.array(texts, pa.string())) > 0, axis=1)


def _unpacked(bits: np.ndarray) -> np.ndarray:
    held = np.unpackbits(bits, axis=1).astype(np.float32)
    return held / np.maximum(np.sqrt(held.sum(axis=1, keepdims=True)), 1)


class Model:
    """``bits``: the examples' n-grams, as ``examples`` gives them; they are unpacked ``ROWS`` at a time."""

    def __init__(self, bits: np.ndarray, labels: list[str]):
        self.names = sorted(set(labels))
        labels = np.array([self.names.index(x) for x in labels])
        pick = np.random.default_rng(11).permutation(len(labels))
        share = max(1, LANDMARKS // len(self.names))
        marks = np.concatenate([pick[labels[pick] == c][:share] for c in range(len(self.names))])
        self.landmarks = _unpacked(bits[marks])
        values, vectors = np.linalg.eigh((self.landmarks @ self.landmarks.T).astype(np.float64))
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        phi = np.concatenate([_unpacked(bits[at : at + ROWS]) @ self.landmarks.T @ root for at in range(0, len(bits), ROWS)])
        weight = (len(labels) / (len(self.names) * np.bincount(labels)))[labels][:, None]
        target = np.where(labels[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        solved = np.linalg.solve(phi.T @ (weight * phi) + RIDGE * len(labels) / LANDMARKS * np.eye(phi.shape[1]), phi.T @ (weight * target))
        self.weights = (root @ solved).astype(np.float32)

    def score(self, column: pa.Array) -> np.ndarray:
        """A row of one-versus-rest scores, made shares of one, for each text."""
        raw = presence(column) @ self.landmarks.T @ self.weights
        raw = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
        return raw / raw.sum(axis=1, keepdims=True)


def train(docs: DataFrame) -> Model | None:
    """Learns from text and lang of the documents given.

    The driver gets the n-grams that a text and its snippets hold, not the text: 1.5 KB an example however long the text
    is, and at most three examples for each of ``MOST`` documents.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")

    def run(batches):
        for batch in steps(batches):
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                own = [[t, *snippets(t)] if any(map(str.isalpha, t)) else [] for t in part.column("text").to_pylist()]
                bits = iter(examples([x for some in own for x in some]))
                held = pa.array([[next(bits).tobytes() for _ in some] for some in own], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), held], names=["doc_id", "lang", "bits"])

    some, _ = stratified(known, "lang", PER, MOST, through=lambda rows: rows.mapInArrow(run, "doc_id bigint, lang string, bits array<binary>"))
    rows = sorted((r["lang"], bytes(b)) for r in some.collect() for b in r["bits"])
    return Model(np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), -1), [lang for lang, _ in rows]) if rows else None


SCHEMA = "doc_id bigint, lang_pred string, score double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    def run(batches):
        for batch in steps(batches):
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                text = part.column("text")
                letters = [any(map(str.isalpha, t or "")) for t in text.to_pylist()]
                if model is None:
                    names, scores = ["und"] * len(part), [0.0] * len(part)
                else:
                    shares = model.score(text)
                    best = shares.argmax(axis=1)
                    names = [model.names[k] if ok else "und" for k, ok in zip(best.tolist(), letters, strict=True)]
                    scores = np.where(letters, shares[np.arange(len(best)), best].astype(np.float64), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=_SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, train(docs.where(~held_out())))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
