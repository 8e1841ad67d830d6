"""The operators that SQL can express, on tables made for their edges, against brute force."""

import hashlib
import re

from loomtext.llm import decontaminate, substrings, warc

ITEM = "One two three four five six seven eight nine ten eleven twelve"


def words5(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute5(text, items):
    words, hit, named = words5(text), set(), set()
    for i, t in items:
        own = words5(t)
        n = min(10, len(own))
        for k in range(len(own) - n + 1) if n else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[k : k + n]:
                    hit |= set(range(at, at + n))
                    named.add(i)
    return len(words), len(hit), named


def test_decontamination(spark, docs_of):
    items = [(1, ITEM), (2, "Short item"), (3, None), (4, ""), (1, ITEM), (5, ITEM + " thirteen"), (6, "è un due"), (7, "!!")]
    texts = [None, "", "nothing here", ITEM, ITEM.upper() + "!", "x " + ITEM[4:50] + " y", ITEM[:30], "a short, ITEM b", "è un; due", "w " * 20_000 + ITEM, ITEM + " " + ITEM, (3, ITEM), (None, ITEM), "one two three four five six seven eight nine zehn eleven"]
    docs, bench = docs_of(texts), spark.createDataFrame(items, "item_id bigint, text string")
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    want = sorted(((i, *brute5(t, items)[:2], sorted(brute5(t, items)[2])) for i, t in rows), key=repr)
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == want
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr) == sorted(((i, t) for i, t in rows if not brute5(t, items)[1]), key=repr)
    for none in (bench.limit(0), bench.where("item_id = 7")):
        assert decontaminate.contamination(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def words6(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute6(rows):
    key = lambda i: (1 << 63) if i is None else i
    first: dict = {}
    for i, t in rows:
        w = words6(t)
        for k in range(len(w) - 49):
            s = tuple(w[k : k + 50])
            first[s] = min(first.get(s, 1 << 64), key(i))
    out = []
    for i, t in rows:
        w, gone = words6(t), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < key(i):
                gone |= set(range(k, k + 50))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(docs_of):
    w = [f"w{k * 7919 % 1009}" for k in range(400)]
    say = lambda a, b: " ".join(w[a:b])
    texts = [
        None, "", "few words", say(0, 200), "x " + say(20, 69) + " y", "x " + say(20, 70) + " y", say(100, 180) + "\n\t " + say(300, 360), say(0, 200), "same " * 400, "same " * 70, say(310, 370),
        (3, say(120, 190)), (None, say(0, 60)), (None, say(340, 400)), say(150, 200) + " é " + say(0, 49), say(200, 260) + " q " + say(200, 260), (99, say(200, 260)), say(0, 200) + " " + say(0, 400) * 3,
    ]
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    docs = docs_of(texts)
    found = substrings.deduplicate(docs)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()), key=repr) == brute6(rows)
    ranges = {r["doc_id"]: r["removed"] for r in found.where("doc_id IN (5, 10)").collect()}
    assert [(x["start"], x["end"]) for x in ranges[5]] == [(0, 51)]  # its first 50 words stand in document 4 too
    one = docs.where("doc_id = 5").join(found.select("doc_id", "removed"), "doc_id")
    assert one.select(substrings.kept_text("text", "removed")).first()[0] == "y"
    assert substrings.deduplicate(docs.limit(0)).count() == 0


def test_substrings_of_long_words(docs_of):
    a, b = "ab", "ba"  # words that polynomial hashes modulo powers of two take for one
    for _ in range(10):
        a, b = a + b, b + a
    words = [f"w{k}" for k in range(49)]
    texts = [" ".join([*words, a]), " ".join([*words, b]), " ".join([*words, a])]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.deduplicate(docs_of(texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 50}


def test_hot_passages_are_cut_into_parts(docs_of, monkeypatch):
    from loomtext.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    w = [f"w{k * 7919 % 1009}" for k in range(400)]
    texts = [" ".join([f"own{i}", *w[:60], "line of words " * 30, f"end{i}"]) for i in range(20)] + [" ".join(w[10:80])] * 5 + [None, ""]
    found = substrings.deduplicate(docs_of(texts)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=repr) == brute6(list(enumerate(texts)))
    own = next(r for r in found if r["doc_id"] == 7)
    assert [(x["start"], x["end"], x["first"]) for x in own["repeats"]] == [(1, 151, 0)]


def test_warc(spark):
    big = "é<p>" * 400_000
    pages = [(5, "u", "a" * 100), (3, "u", "a" * 100), (4, None, "a" * 99), (6, "u", "a" * 99), (7, "u", None), (8, "u", ""), (9, "u\r\nv", big), (10, "w", big), (None, "n", "a" * 100), (None, "n", "b" * 200), (3, "u", "a" * 100)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, record string")
    chunks = warc.write(df, chunk_bytes=1 << 16)
    assert chunks.where("n_chunks > 1").count() >= 20 and chunks.agg({"n_chunks": "max"}).first()[0] == -(-len(big.encode()) // (1 << 16))
    rows = [(p, (h or "").encode()) for p, _, h in pages]
    want = []
    for p, h in rows:
        least = min((q for q, g in rows if g == h and q is not None), default=None) if len(h) >= 100 else None
        refers = least if least is not None and p != least else None
        want.append((p, len(h), hashlib.sha256(h).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert sorted(map(tuple, warc.read(chunks).collect()), key=repr) == sorted(want, key=repr)
    record = b"".join(bytes(r["body"]) for r in sorted(chunks.where("n_chunks > 1").collect(), key=lambda r: (r["record"], r["chunk"])))
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and big.encode() in record
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_warc_notices_damage(spark):
    import pytest
    from pyspark.sql import functions as F

    chunks = warc.write(spark.createDataFrame([(1, "u", "c" * 500)], "page_id bigint, url string, html string"))
    bad = chunks.withColumn("body", F.encode(F.translate(F.decode("body", "UTF-8"), "c", "d"), "UTF-8"))
    with pytest.raises(Exception, match="digest|KeyError"):
        warc.read(bad).collect()


def test_decontamination_of_repeated_words(spark, docs_of):
    docs = docs_of(["w " * 8000, "w " * 9, "x " + "w " * 30 + "x", "v w " * 40])
    bench = spark.createDataFrame([(7, "w " * 3000), (8, "z"), (None, "w " * 30 + "x")], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [(0, 8000, 8000, [7, None]), (1, 9, 0, []), (2, 32, 31, [7, None]), (3, 80, 0, [])]


def test_hashes_of_words_tell_long_ones_apart():
    import numpy as np

    from loomtext.llm.common import word_hashes

    a, b = "ab", "ba"  # Thue-Morse words collide in any polynomial hash modulo a power of two
    for _ in range(10):
        a, b = a + b, b + a
    words = [a, b, "", "\0", "\0\0", "x" * 8, "x" * 9, "x" * 32, "x" * 33, *(chr(97 + k % 26) * (k % 70) + str(k) for k in range(3000))]
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    hashes = word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
    assert len(set(hashes.tolist())) == len(words)
    again = word_hashes(np.frombuffer(b"?" + b"x" * 8, np.uint8), np.array([1]), np.array([9]))
    assert again[0] == hashes[5]


def test_extended_against_plain_python(spark):
    import random

    pick, pairs, want = random.Random(3), [], []
    for k in range(600):
        length = pick.choice((1, 3, 5, 7, 10))
        gram = min(5, length)
        left, right = ([pick.choice(("a", "ab", "è")) for _ in range(pick.randint(0, n))] for n in (length - gram, length - gram))
        middle = [pick.choice("xy") for _ in range(gram)]
        other = [["z" if pick.random() < 0.07 else w for w in part] for part in (left[pick.randint(0, len(left)) :], middle, right[: pick.randint(0, len(right))])]
        places = sorted(pick.sample(range(20, 400), pick.randint(1, 3)))
        ours, theirs, ahead, before = left + middle + right, sum(other, []), len(left), len(other[0])
        pairs.append((k, -k, length, " ".join(ours), ahead, places, k % 7 or None, " ".join(theirs), before))
        a = next((n for n, (x, y) in enumerate(zip(ours[ahead:], theirs[before:], strict=False)) if x != y), min(len(ours) - ahead, len(theirs) - before))
        b = next((n for n, (x, y) in enumerate(zip(ours[:ahead][::-1], theirs[:before][::-1], strict=False)) if x != y), min(ahead, before))
        if a >= gram and a + b >= length:
            want += [(k, -k, k % 7 or None, p - b, p + a) for p in places]
    df = spark.createDataFrame(pairs, "key bigint, twin bigint, length int, ours string, ahead int, places array<int>, item_id bigint, theirs string, before int")
    found = decontaminate.extended(df)
    assert 100 < len(want) < 900
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "bigint", "bigint", "int", "int"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_decontamination_runs_one_python_function_a_stage(spark):
    """Two in one stage mean two Python workers for each core, and the idle ones stay for the stages that follow."""

    def deepest(node) -> tuple[int, int]:
        """(Python functions of the stage at ``node``, most of any stage below)."""
        below = [deepest(node.children().apply(k)) for k in range(node.children().size())]
        own, most = sum(x[0] for x in below), max([0, *(x[1] for x in below)])
        own += any(x in node.nodeName() for x in ("Python", "Arrow", "Pandas"))
        return (0 if "Exchange" in node.nodeName() else own), max(own, most)

    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))  # of known size, so that Spark may broadcast
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", False)
        for most in ("-1", "1g"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            for df in (decontaminate._hits(decontaminate._keyed(docs), bench, 8), decontaminate.clean(docs, bench)):
                assert deepest(df._jdf.queryExecution().executedPlan())[1] == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
