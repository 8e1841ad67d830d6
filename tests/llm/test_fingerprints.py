import hashlib

from pyspark.sql import functions as F

from loomtext.llm import fingerprints as M


def test_fingerprint_is_of_the_whole_text():
    assert M.fingerprint("") == "3::"
    long = "abc def " * 200_000
    assert M.fingerprint(long) != M.fingerprint(long + "z") and M.fingerprint(long) == M.fingerprint(long)
    for n in (1, 7, 50, 1000, 40_000):
        block, one, two = M.fingerprint("".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(n))).split(":")
        assert int(block) >= 3 and len(one) <= 64 and len(two) <= len(one)


def test_pairs_and_likeness(docs_of):
    base = " ".join(f"word{i * 37 % 101}" for i in range(300))
    texts = [(3, base), (1, base), (2, None), (2, ""), (None, "tail " + base[:900]), (9, "é" * 5000), (10, "short")]
    rows = docs_of(texts)
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    got = M.with_following(rows).withColumn("near", M.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).collect()
    assert len(got) == len(texts)
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + after[:n]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), M.fingerprint(t), M.fingerprint(e), M.fingerprint(after)))
    own = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["next_fingerprint"]) for r in got]
    key = lambda r: tuple(map(str, r))
    assert sorted(own, key=key) == sorted(want, key=key)
    assert all(0 <= r["near"] <= 1 for r in got) and max(r["near"] for r in got) == 1


def test_edits_are_nearer_than_strangers(spark, sf):
    rows = M.op1_document_fingerprints(spark, sf).where("n_chars > 400").collect()
    edited, strange = sum(r["near_edited"] for r in rows) / len(rows), sum(r["near_next"] for r in rows) / len(rows)
    assert edited > 0.6 and strange < 0.25


def test_empty_table(docs_of):
    assert M.with_following(docs_of([(1, "a")]).limit(0)).count() == 0
    (only,) = M.with_following(docs_of([(1, "abcdefgh")])).collect()
    assert only["fingerprint"] == only["next_fingerprint"] and only["n_chars"] == 8


def plain_fingerprint(text):
    """The fingerprint byte by byte, with whole numbers of Python."""
    data, base, mask = text.encode(), 0x9E3779B97F4A7C15, (1 << 64) - 1

    def letter(piece):
        x = (sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(piece)) + len(piece) * 0xD6E8FEB86659FD93) & mask
        for _ in range(2):  # the hash is finished twice
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            x ^= x >> 31
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[x >> 58]

    rolling = []
    for i in range(len(data)):
        shifted = total = 0
        for k in range(min(7, i + 1)):
            shifted ^= data[i - k] << 5 * k & 0xFFFFFFFF
            total += data[i - k] * (8 - k)
        rolling.append((shifted + total) & 0xFFFFFFFF)

    def pieces(block):
        out, at = [], 0
        for i, r in enumerate(rolling):
            if r % block == block - 1:
                out.append(data[at : i + 1])
                at = i + 1
        return out + [data[at:]] * (at < len(data))

    hits = lambda block: sum(r % block == block - 1 for r in rolling)
    block = 3
    while block * 64 < len(data):
        block *= 2
    while hits(block) < 32 and block > 3 and hits(block // 2) < 64:
        block //= 2
    while hits(block) >= 64:
        block *= 2
    return ":".join([str(block), *("".join(map(letter, pieces(b))) for b in (block, 2 * block))])


def plain_likeness(a, b):
    def near(p, q):
        last = list(range(len(q) + 1))
        for i, x in enumerate(p, 1):
            row = [i]
            for j, y in enumerate(q, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = row
        return 1 - last[-1] / max(len(p), len(q)) if p or q else 0.0

    (m, one, two), (n, eins, zwei) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    if a == b:
        return 1.0
    return max(near(one, eins), near(two, zwei)) if m == n else near(one, zwei) if m == 2 * n else near(two, eins) if n == 2 * m else 0.0


def test_query_against_plain_python(spark, sf):
    """The whole query on its whole table: texts, edits, fingerprints and likenesses."""
    told = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in M.op1_document_fingerprints(spark, sf).collect()}
    assert len(got) == len(told)
    marks = [plain_fingerprint(t) for _, t in told]
    for k, (i, text) in enumerate(told):
        after = (k + 1) % len(told)
        n = len(text) // 4
        changed = text[: len(text) - n] + told[after][1][:n]
        other, row = plain_fingerprint(changed), got[i]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (row["fingerprint"], row["edited_fingerprint"]) == (marks[k], other)
        assert abs(row["near_edited"] - plain_likeness(marks[k], other)) < 1e-12 and abs(row["near_next"] - plain_likeness(marks[k], marks[after])) < 1e-12
