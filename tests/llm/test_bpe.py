import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomtext.llm import bpe, token_files as files

ODD = [None, "", "a", " a  b\t\nc ", "It's I'LL we've 12 3", "<|endoftext|>x<|startoftext|>", "<|endof text|>", "Éßſİ ²½ _-!", "x́ Ωσς ﬁ 漢字 😀", "\x1c\x85\xa0 z", "the " * 30_000, "a" * 3000, "the"]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_texts_are_the_librarys(docs_of, name):
    path = bpe.vocabulary(name)
    tokenizer = Tokenizer.from_file(path)
    pick, letters = random.Random(3), list("aAbB'stredvl 12 \t\n\r\x1c\x85\xa0²½éÉİßſ_-!<|>́Ωσς漢😀") + ["<|endoftext|>", "'ll"]
    texts = [*ODD, *("".join(pick.choices(letters, k=pick.randint(0, 30))) for _ in range(300))]
    rows = bpe.round_trip(docs_of(texts), path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ids_of(tokenizer, texts[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["decoded"] == tokenizer.decode(want, skip_special_tokens=False)


def test_words_outlive_a_full_table(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 5)
    table = bpe.WordTable(bpe.vocabulary("word_bpe_49k.json"))
    texts = [f"alpha beta gamma w{i} delta" for i in range(30)]
    for t in texts:
        (got,) = table.encode([t])
        assert np.frombuffer(got, "<u4").tolist() == ids_of(table.tokenizer, t)


def test_query_digests(spark, sf, documents):
    tokenizer = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in bpe.op2_bpe_words(spark, sf).collect():
        ids = ids_of(tokenizer, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_keeps_other_columns(docs_of):
    docs = docs_of(["a b", None])
    path = bpe.vocabulary("word_bpe_49k.json")
    out = bpe.decode(bpe.encode(docs, path), path)
    assert out.columns == [*docs.columns, "ids", "decoded"] and out.count() == 2
    assert bpe.encode(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("most", [0, 1, 5, 300])
@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 400])
def test_boundaries_in_a_block(n, most):
    pick = random.Random(n + most)
    documents = [np.array([pick.randrange(50_000) for _ in range(pick.randint(0, most))], "<u4").tobytes() for _ in range(n)]
    names = sorted(pick.choice([pick.randrange(-(1 << 63) + 1, 1 << 63), pick.randrange(n)]) for _ in range(n))
    names[: n // 3] = [None] * (n // 3)
    block = files.Block(files.encode_block(documents, 2, names))
    assert [block.name(i) for i in range(n)] == names
    assert [block.end(i) for i in range(n)] == np.cumsum([len(d) // 4 for d in documents]).tolist()
    assert [block.document(i).astype("<u4").tobytes() for i in range(n)] == documents


def test_boundaries_take_little_space():
    documents = [np.zeros(500, "<u4").tobytes()] * 1000
    raw = files.encode_block(documents, 2)
    assert len(raw) - 2 * 500 * 1000 < 1000 * (12 + 3) / 8 + 400  # ends and ids of a thousand documents


def test_token_files(spark, docs_of):
    import zlib

    path = bpe.vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = [(i * 3 % 41, t) for i, t in enumerate(ODD)] + [(None, "none"), (7, "tie b"), (7, "tie a")]
    got = sorted(files.read(files.write(docs_of(docs), path, 2, block_bytes=2000)).collect(), key=lambda r: r["start"])
    start = 0
    for r, (i, text) in zip(got, sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*ids_of(tokenizer, text), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert files.read(files.write(docs_of(["a"]).limit(0), path, 2)).count() == 0
    with pytest.raises(ValueError):
        files.Block(b"nope" + bytes(60))


def test_places_in_few_bytes():
    pick = np.random.default_rng(2)
    for values in ([], [0], [127, 128, 16383, 16384, (1 << 32) - 1], pick.integers(0, 1 << 20, 1000)):
        raw, ends = bpe.varints(np.array(values, np.uint64))
        assert bpe.numbers(raw).tolist() == list(values) and len(ends) == len(values) and (not len(ends) or ends[-1] == len(raw))


def test_words_of_many_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 200)
    path = bpe.vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [f"the the common words and own{i} " * (i % 7) for i in range(200)]
    docs = docs_of(texts)
    encoded = bpe.encode(docs, path)
    for r in bpe.decode(encoded, path).collect():
        want = ids_of(tokenizer, texts[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["decoded"] == tokenizer.decode(want, skip_special_tokens=False)
    broken = [b"", [255, 254], [0xC3], [0xE2, 0x82], [0xF0, 0x9F, 0x98, 0x41]]  # bytes that are no text
    letters = {c: i for i, c in enumerate(bpe.byte_letters())}
    table = bpe.WordTable(path)
    for raw in broken:
        ids = [table.pieces.index(bpe.byte_letters()[b]) for b in raw]
        assert table.decode(bpe.packed(ids)) == tokenizer.decode(ids, skip_special_tokens=False) and len(letters) == 256


def test_query_of_files(spark, sf, documents):
    import zlib

    tokenizer, start = Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json")), 0
    got = sorted(files.op4_token_files(spark, sf).collect(), key=lambda r: r["start"])
    for r, d in zip(got, documents.orderBy("doc_id").collect(), strict=True):
        ids = [*ids_of(tokenizer, d["text"]), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_all_scripts_go_through_the_table(name):
    made = bpe.WordTable(bpe.vocabulary(name))
    texts = ["It’s “quoted” — 5€ 😀  next\n\n", "Привет, мир! Ёлка 123", "漢字かな交じり文\u3000です", "e\u0301 É ﬁ ǅ İ K", "a…<|endoftext|>b’ <|endoftext|>", " \u2003x\u2028\u00a0y\u200b ", "Ġ ’ Ġthe", "नमस्ते ٣٤ Ⅷ ½ ’s 'S", "\ufeff\0’\x7f\U0010ffff"]
    want = [bpe.packed(made.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert made.encode(texts) == want and "漢字かな交じり文" in "".join(made.table) and made.encode(texts[::-1]) == want[::-1]
    found = len(made.table)
    made.encode(texts)
    assert len(made.table) == found > 20
