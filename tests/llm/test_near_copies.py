import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from loomtext.llm import near_copies as M


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


ODD = [None, "", "  \n", "One", "one two", "One TWO three", "a b c d", "é " * 10, "x y z " * 20_000, "a b c d", "one\ttwo three"]


def test_fingerprints():
    assert M.fingerprints_of(pa.array(ODD)).tolist() == [brute(t) for t in ODD]


def near(marks, radius=2):
    n = len(marks)
    links = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= radius
    label = np.arange(n)
    while True:
        new = np.array([label[links[i]].min() for i in range(n)])
        if (new == label).all():
            return label
        label = new


def clustered(n, seed=1):
    pick = random.Random(seed)
    out = [pick.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        out.append(out[pick.randrange(len(out))] ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)))
    return np.unique(np.array(out, np.uint64))


def test_trees_find_every_pair():
    marks = clustered(600)
    want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 2), strict=True)}
    got = {(int(i), int(j)) for p, q in M.close_pairs(marks) for i, j in zip(p, q, strict=True)}
    assert got == {(i, j) for i, j in want if i < j}
    same = np.arange(200, dtype=np.uint64)  # 200 points in 8 bits, hardly to be parted
    got = {(int(i), int(j)) for p, q in M.close_pairs(same) for i, j in zip(p, q, strict=True)}
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if (i ^ j).bit_count() <= 2}


def test_shards_meet_every_pair():
    marks = clustered(500, 2)
    tree = M.shard_tree(marks[::3], 4)
    index, shard = M.routes(tree, marks)
    visits = {}
    for i, s in zip(index.tolist(), shard.tolist(), strict=True):
        visits.setdefault(i, set()).add(s)
    assert len(visits) == len(marks)
    for i, j in zip(*np.nonzero(np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 2), strict=True):
        assert visits[int(i)] & visits[int(j)]


def test_visits_of_random_fingerprints_are_few():
    marks = np.random.default_rng(1).integers(0, 1 << 64, 20_000, np.uint64)
    for depth in (2, 4, 6):
        index, _ = M.routes(M.shard_tree(marks[:4096], depth), marks)
        assert len(index) / len(marks) < 1.25**depth


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200, 100), (200, 150), (7, 7)]
    got = dict(map(tuple, M.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 150: 100}
    assert M.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups(spark, docs_of, monkeypatch):
    monkeypatch.setattr(M, "SHARD", 8)
    base = " ".join(f"w{k * 31 % 97}" for k in range(400))
    texts = [*ODD, base, base + " end", base.replace("w5 ", "v5 ", 1), (12, base), (None, base), (None, "alone here now")]
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    marks = np.array([brute(t) for _, t in rows], np.uint64)
    label = near(marks)
    least = {k: min((i for (i, _), x in zip(rows, label, strict=True) if x == k and i is not None), default=None) for k in set(label.tolist())}
    want = sorted(((i, int(m), least[x]) for (i, _), m, x in zip(rows, marks, label.tolist(), strict=True)), key=repr)
    docs = docs_of(texts)
    got = [(r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in M.groups(docs).collect()]
    assert sorted(got, key=repr) == want
    kept = M.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label.tolist()))
    assert M.groups(docs.limit(0)).count() == 0 and M.representatives(docs.limit(0)).count() == 0


def test_query(spark, sf, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    marks = np.array([brute(t) for _, t in rows], np.uint64)
    label = near(marks)
    want = sorted((i, f"{int(m):016x}", rows[x][0]) for (i, _), m, x in zip(rows, marks, label.tolist(), strict=True))
    assert sorted(map(tuple, M.op10_simhash_near_dedup(spark, sf).collect())) == want
