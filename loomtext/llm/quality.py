"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  A passage is encoded from its bytes' classes, one and two at a
time, and its words (length, repetition within the passage and the document, capitals); an encoder, a gated
attention over the passages and a logistic layer on their weighted sum are learned together from document
labels.  All passages of a text count, however long; every feature is a share or a logarithm, so none runs out of
range on texts of any shape.  Training takes about ``PER`` labelled documents of each label,
chosen by a hash of their ids and weighted back to the labels' shares; the held-out fifth is never learned from.

Null and empty texts are a bag of one empty passage and are scored like any other.  A label given twice is the lower.
A null doc_id is not held out and not learned from.  With no labels, or one kind of label only, every score is the
share of label 1 (1 where there are none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import SPACES, held_out, steps, stratified, table, text_bytes, word_hashes, word_spans

PASSAGE, PER, MOST, THRESHOLD = 64, 1500, 4000, 0.3
EMBED, GATE, EPOCHS, BATCH = 24, 16, 40, 64


def _byte_classes() -> np.ndarray:
    out = np.full(256, 15, np.uint8)
    for k, own in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b" ", b"\n\r", b".", b",;:", b"!", b"?", b"*", b"#", b"$%", b"&|", b"-'\"", range(0x80, 0x100))):
        out[list(own)] = k
    return out


CLASSES, KINDS = _byte_classes(), 16
FEATURES = KINDS + KINDS * KINDS + 8


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, passages of each text)."""
    data, offsets = text_bytes(column)
    starts, ends, row = word_spans(data, offsets, SPACES)
    count = np.bincount(row, minlength=len(column))
    first = np.cumsum(count) - count
    bags = np.maximum(1, -(-count // PASSAGE))
    base = np.cumsum(bags) - bags
    total = int(bags.sum())
    word_bag = base[row] + (np.arange(len(row)) - first[row]) // PASSAGE
    # bytes up to the next passage's first word belong to a passage
    at = np.concatenate((offsets[:-1], starts[(np.arange(len(row)) - first[row]) % PASSAGE == 0]))
    owner = np.concatenate((base, word_bag[(np.arange(len(row)) - first[row]) % PASSAGE == 0]))
    begin = np.full(total, len(data), np.int64)
    np.minimum.at(begin, owner, at)
    sizes = np.diff(np.append(begin, len(data)))
    of_byte = np.repeat(np.arange(total), sizes)
    kinds = CLASSES[data].astype(np.int64)
    one = np.bincount(of_byte * KINDS + kinds, minlength=total * KINDS).reshape(total, KINDS)
    within = of_byte[1:] == of_byte[:-1]
    pair = np.bincount((of_byte[1:] * KINDS * KINDS + kinds[:-1] * KINDS + kinds[1:])[within], minlength=total * KINDS * KINDS).reshape(total, -1)
    words = np.maximum(np.bincount(word_bag, minlength=total), 1)
    hashes = word_hashes(data, starts, ends)
    fresh = lambda group: _first_seen(group, hashes)
    share = lambda flags: np.bincount(word_bag[flags], minlength=total) / words
    upper = np.concatenate(([0], np.cumsum(kinds == 0)))
    lower = np.concatenate(([0], np.cumsum(kinds == 1)))
    capital, small = upper[ends] - upper[starts], lower[ends] - lower[starts]
    size = np.maximum(sizes, 1)[:, None]
    extra = np.stack(
        [np.log1p(np.bincount(word_bag, weights=ends - starts, minlength=total) / words) / 3, share(fresh(word_bag)), share(fresh(row)), share((capital > 1) & (small == 0)), share((capital == 0) & (small > 0)), share(ends - starts <= 3), share(ends - starts >= 12), np.log1p(np.bincount(word_bag, minlength=total)) / 4],
        axis=1,
    )
    return np.concatenate((np.sqrt(one / size), np.sqrt(pair / size), extra), axis=1).astype(np.float32), bags


def _first_seen(group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each word is the first of its kind in its group."""
    order = np.lexsort((hashes, group))
    g, h = group[order], hashes[order]
    out = np.zeros(len(group), bool)
    if len(group):
        out[order[np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])))]] = True
    return out


class Model:
    """Encoder, gated attention and score; ``prior`` alone where there was nothing to tell apart."""

    def __init__(self, prior: float = 1.0):
        self.prior, self.w = prior, None

    def _forward(self, x, bags):
        w = self.w
        start = np.cumsum(bags) - bags
        e = np.tanh(x @ w["We"] + w["be"])
        v, u = np.tanh(e @ w["V"]), 1 / (1 + np.exp(-(e @ w["U"])))
        g = (v * u) @ w["a"]
        g = np.exp(g - np.repeat(np.maximum.reduceat(g, start), bags))
        a = g / np.repeat(np.add.reduceat(g, start), bags)
        z = np.add.reduceat(a[:, None] * e, start, axis=0)
        return e, v, u, a, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(bags), self.prior)
        # in double precision and rounded: in single, a text's last digits hang on its neighbours in the batch
        return np.round(self._forward(((x - self.mean) / self.scale).astype(np.float64), bags)[-1], 6)

    def fit(self, bags_of: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 5) -> "Model":
        """``bags_of``: the passages' features of each document."""
        if len(set(labels.tolist())) < 2:
            return self
        whole, pick = np.concatenate(bags_of), np.random.default_rng(seed)
        self.mean, self.scale = whole.mean(axis=0), whole.std(axis=0) + 1e-2
        draw = lambda *shape: (pick.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"We": draw(FEATURES, EMBED), "be": np.zeros(EMBED, np.float32), "V": draw(EMBED, GATE), "U": draw(EMBED, GATE), "a": draw(GATE), "c": draw(EMBED), "b": np.float32(np.log(max(self.prior, 1e-3) / max(1 - self.prior, 1e-3)))}
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        bags_of, step = [((x - self.mean) / self.scale).astype(np.float32) for x in bags_of], 0
        for epoch in range(EPOCHS):
            order = pick.permutation(len(bags_of))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                step += 1
                grads = self._grads(np.concatenate([bags_of[k] for k in some]), np.array([len(bags_of[k]) for k in some]), labels[some], weights[some])
                rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
                for k, g in grads.items():
                    m, s = moment[k]
                    m[...] = 0.9 * m + 0.1 * g
                    s[...] = 0.999 * s + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * ((m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + 1e-3 * self.w[k])).astype(np.float32)
        return self

    def _grads(self, x, bags, y, weight) -> dict:
        w, start = self.w, np.cumsum(bags) - bags
        e, v, u, a, z, p = self._forward(x, bags)
        back = (weight * (p - y) / weight.sum()).astype(np.float32)
        dz = np.repeat(back[:, None] * w["c"], bags, axis=0)
        da = (dz * e).sum(axis=1)
        dg = a * (da - np.repeat(np.add.reduceat(a * da, start), bags))
        dv, du = dg[:, None] * w["a"] * u * (1 - v * v), dg[:, None] * w["a"] * v * u * (1 - u)
        de = (a[:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - e * e)
        return {"We": x.T @ de, "be": de.sum(axis=0), "V": e.T @ dv, "U": e.T @ du, "a": (v * u).T @ dg, "c": z.T @ back, "b": np.asarray(back.sum())}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labels given (doc_id, quality) and the texts of their documents."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some, counts = stratified(known, "quality", PER, MOST)
    chosen = [(r["doc_id"], r["quality"]) for r in some.collect()]  # MOST rows at most
    total = sum(counts.values())
    model = Model(counts.get(1, 0) / total if total else 1.0)
    if len({q for _, q in chosen}) < 2:
        return model
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("passages", pa.binary())])

    def run(batches):
        for batch in steps(batches):
            texts = batch.column("text").to_pylist()
            # a few words of each good text are good too: so short texts are judged by a model that has seen such
            starts = [" ".join((t or "").split()[: 3 + i % 10]) if q else None for t, i, q in zip(texts, batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), strict=True)]
            (x, bags), (more, _) = passages(batch.column("text")), passages(pa.array(starts, pa.string()))
            own = [np.concatenate(([a], b)) for a, b in zip(more.astype(np.float16), np.split(x.astype(np.float16), np.cumsum(bags)[:-1]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array([o.tobytes() for o in own], pa.binary())], schema=schema)

    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, quality int"))
    rows = docs.select("doc_id", "text").join(picked, "doc_id").mapInArrow(run, "doc_id bigint, quality int, passages binary").collect()
    rows = sorted((r["doc_id"], bytes(r["passages"]), r["quality"]) for r in rows)
    if len({q for *_, q in rows}) < 2:
        return model
    y = np.array([q for *_, q in rows], np.float32)
    share = {q: counts[q] / max(1, int((y == q).sum())) for q in (0, 1)}
    weights = np.array([share[int(q)] for q in y], np.float32)
    bags = [np.frombuffer(p, np.float16).reshape(-1, FEATURES).astype(np.float32) for _, p, _ in rows]
    good = np.flatnonzero(y == 1)
    return model.fit([*(b[1:] for b in bags), *(bags[k][:1] for k in good)], np.append(y, y[good]), np.append(weights, weights[good]))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``: the likelihood of label 1 of each whole text."""
    from loomtext.llm.bpe import _append, _appended

    def run(batches):
        for batch in steps(batches, text):
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                yield _append(part, into, pa.array(model.score(*passages(part.column(text))), pa.float64()))

    return docs.mapInArrow(run, _appended(docs, into, "double"))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out()))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, trained(spark, docs, sf_dir)).drop("text")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
