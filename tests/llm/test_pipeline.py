"""The stages against plain Python, and the queries against their SQL."""

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from loomtext.llm import bpe, near_copies, secrets
from loomtext.llm.queries import QUERIES, SQL

from test_near_copies import brute, near
from test_sql_twins import brute5

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    told = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(told.columns)
    pick = lambda columns, rows: sorted((tuple(r[columns.index(k)] for k in sorted(columns)) for r in rows), key=repr)
    assert pick(df.columns, df.collect()) == pick(told.columns, told.fetchall())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_stages(spark, documents):
    docs, columns = documents, documents.columns
    stage = dict(pipeline.STAGES)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = stage["quality classifier"](spark, docs, SF).cache()
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns and sum(q == (i in kept) for i, q in labels.items()) / len(labels) > 0.9

    rows = [(r["doc_id"], r["text"]) for r in good.orderBy("doc_id").collect()]
    label = near(np.array([brute(t) for _, t in rows], np.uint64)).tolist()
    single = stage["simhash near-dedup"](spark, good, SF).cache()
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted({rows[x][0] for x in label})

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stage["benchmark decontamination"](spark, single, SF).cache()
    assert clean.columns == columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in single.collect() if not brute5(r["text"], items)[1])

    cut = stage["secret scans"](spark, clean, SF).cache()
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in (clean, cut))
    assert cut.columns == columns and set(before) == set(after)
    for i, r in after.items():
        assert not secrets.scan(r["text"]) and r["n_chars"] == len(r["text"])
        assert (r["text"] == before[i]["text"]) == (not secrets.spans(before[i]["text"]))

    tokenizer = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    for r in stage["bpe encoding and decoding"](spark, cut, SF).collect():
        assert r["n_tokens"] == len(tokenizer.encode(after[r["doc_id"]]["text"], add_special_tokens=False).ids)


def test_stages_take_odd_tables(spark, docs_of):
    docs = docs_of([None, "", "a b c", "a b c", (2, "a b c"), (None, "x"), "long " * 30_000])
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() >= 1
    empty = docs_of(["a"]).limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 50
    assert near_copies.RADIUS == 2
