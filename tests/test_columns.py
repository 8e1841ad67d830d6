"""Patterns as columns and rows: both tiers agree; nulls, empty texts, ties."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomtext.functions import columns as K
from loomtext.functions import grammars as G
from loomtext.functions import patterns as L
from loomtext.operators import rows as R
from loomtext.plans import classes as C
from loomtext.plans.build import P, any_char, at_end, caseless, char_in, char_not_in, date, either, integer_base, join, lazy, number, opt, rep, rep1, seq, text, words
from loomtext.plans.nodes import Char, Const, NotRegular
from loomtext.sources import readers
from loomtext.sources.pcre import regex
from loomtext.streaming import counted, parsed

TEXTS = [None, "", "a", "ab", "abc 12", "Customer#007", "12", "-5x", "a,b,c", "1,2", "1,,2", "éß Ñ", "x" * 5000, "\n", "A.B*C", "0", "ff", "  a", "b", "b"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i bigint, t string").cache()


REGULAR = {
    "number": number(),
    "named": seq("Customer#", no=number()),
    "tuple": seq(L.word, " ", number()),
    "pick": seq(L.word, " ", number())[1],
    "optional": seq(opt(text(rep1(Char(C.DIGIT)))), opt(char_in("xyz"), "none")),
    "letters": rep(Char(C.WORD)),
    "list": join(text(rep(char_not_in(","))), ",", 1),
    "numbers": join(number(), ",", 1),
    "constants": either(P("ab") >> 1, P("a") >> 2, P("12") >> 3),
    "caseless": caseless("cUSTOMER"),
    "hex": integer_base(16),
    "mapped": number().map(lambda n: n + 1, "bigint", column=lambda c: c + 1),
    "lazy": text(seq(lazy(rep(any_char)), "b")),
    "pcre": text(regex(r"(?i)[[:alpha:]]+\.b")),
}


@pytest.mark.parametrize("name", REGULAR)
def test_tiers_agree(texts, name):
    p = REGULAR[name]
    assert K.tier(p) == "regex"
    both = texts.select("t", K.try_parse("t", p, force="regex").alias("a"), K.try_parse("t", p, force="matcher").alias("b"), K.matches("t", p).alias("c"), K.matches("t", p, force="matcher").alias("d"))
    for r in both.collect():
        assert r["a"] == r["b"] and r["c"] == r["d"], r


def test_regular_patterns_stay_in_the_jvm(texts):
    plan = texts.select(K.try_parse("t", REGULAR["named"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("p", [G.arithmetic(), regex(r"(a(?1)?b)"), seq(opt(text(rep("a"))), "b")])
def test_other_patterns_take_the_matcher(texts, p):
    assert K.tier(p) == "matcher"
    with pytest.raises(NotRegular):
        K.try_parse("t", p, force="regex")
    assert texts.select(K.try_parse("t", p)).count() == len(TEXTS)


def test_parse_raises_and_tells_where(texts):
    with pytest.raises(Exception, match="no match"):
        texts.select(K.parse("t", P("zz"))).collect()
    told = [r["e"] for r in texts.select(K.error_of("t", number()).alias("e")).collect()]
    assert told[0] is None and told[2]["excerpt"] == "a" and told[6] is None


def test_match_and_search(texts):
    p = text(rep1(Char(C.DIGIT)))
    rows = texts.select("t", K.match("t", p).alias("a"), K.match("t", p, force="matcher").alias("b"), K.contains("t", p).alias("c"), K.match_each("t", p).alias("d")).collect()
    assert all(r["a"] == r["b"] for r in rows)
    assert [r["c"] for r in rows][:5] == [None, False, False, False, True] and rows[4]["d"] == ["12"] and rows[0]["d"] is None
    groups = texts.select(K.match("t", regex(r"(\w)(,)?")).alias("m")).collect()
    assert groups[0]["m"] is None and groups[1]["m"] is None and groups[2]["m"]["captures"][1]["text"] is None and groups[8]["m"]["captures"][1]["text"] == ","


def test_replace(texts):
    rows = texts.select(K.replace_each("t", char_in("ab"), "$1").alias("a"), K.replace_each("t", regex(r"(a|b)(?(1)|x)"), "$1").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and rows[3]["a"] == "$1$1"


def test_rows(spark, texts):
    some = texts.where("i IN (3, 0, 1)")
    assert [(r["i"], r["ordinal"], r["found"]["match"]) for r in R.match_rows(some, "t", regex("ab?")).collect()] == [(3, 1, "ab"), (3, 2, "a")]
    assert [r["value"] for r in R.parse_rows(some.where("i = 3"), "t", text(rep(any_char))).orderBy("ordinal").collect()] == ["ab", "a", ""]
    a = R.first_at_each(texts.where("length(t) < 20"), "t", text(rep(Char(C.DIGIT), 1, 9)))
    b = R.first_at_each(texts.where("length(t) < 20"), "t", regex(r"(\d)(?(1)\d*)"))
    assert sorted(a.select("i", "offset", "match").collect()) == sorted(b.select("i", "offset", "match").collect())


def test_dictionaries(spark, texts):
    words = spark.createDataFrame([("a", 1), ("ab", 2), ("abcd", 3), ("12", 4)], "word string, id bigint")
    got = R.lookup_prefix(texts, ["i", "t"], "t", words)
    assert {r["t"]: r["id"] for r in got.collect()} == {"a": 1, "ab": 2, "abc 12": 2, "12": 4, "a,b,c": 1}
    every = R.lookup_everywhere(texts, "i", "t", words).where("i = 4").collect()
    assert sorted((r["offset"], r["word"]) for r in every) == [(1, "a"), (1, "ab"), (5, "12")]
    assert R.lookup_prefix(texts.limit(0), ["i"], "t", words).count() == 0


def test_sql_function_and_trace(spark, texts):
    R.register(spark, "loom_number", number())
    texts.createOrReplaceTempView("loom_texts")
    assert [r[0] for r in spark.sql("SELECT loom_number(t) FROM loom_texts WHERE i < 8 ORDER BY i").collect()] == [None, None, None, None, None, None, 12, -5]
    told = texts.where("i = 4").select(K.trace("t", seq(L.word.named("w"), " ", number().named("n"))).alias("x")).first()["x"]
    assert [(e["name"], e["start"], e["after"]) for e in told] == [("w", 1, 4), ("n", 5, 7)]
    assert texts.where("i = 11").select(K.byte_offset("t", F.lit(3))).first()[0] == 5


def test_json_results_and_unions(spark):
    df = spark.createDataFrame([('{"a":[1]}',), ("nope",), (None,)], "t string")
    assert [r[0] for r in df.select(K.try_parse("t", G.json_value())).collect()] == ['{"a":[1]}', None, None]
    p = either(number(), text(rep1(Char(C.Category("L")))))
    assert df.select(K.try_parse("t", p).alias("x")).collect()[1]["x"].asDict() == {"tag": 1, "_1": None, "_2": "nope"}
    assert df.select(K.try_parse_at("t", Const("no")).alias("x")).collect()[1]["x"]["pos"] == 3
    assert df.select(K.parse_all("t", text(rep1(any_char))).alias("x")).collect()[1]["x"] == ["nope", "nop", "no", "n"]
    assert df.select(K.match_all("t", Const("e")).alias("x")).collect()[1]["x"][0]["offset"] == 4


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("/a(b)?/i\n    AB\n 0: AB\n 1: B\n    a\n 0: a\n\\= Expect no match\n    c\nNo match\n\n/x\\/y/\n    x/y\n 0: x/y\n")
    rows = readers.corpus(spark, str(tmp_path)).collect()
    assert [(r["pattern"], r["flags"], r["sequence"], r["matches"]) for r in rows] == [("a(b)?", "i", "AB", True), ("a(b)?", "i", "a", True), ("a(b)?", "i", "c", False), ("x\\/y", "", "x/y", True)]
    for r in rows:
        from loomtext.plans.matcher import compiled

        m = compiled(regex(r["pattern"], r["flags"])).match(r["sequence"])
        assert (m is not None) == r["matches"] and (not m or m["match"] == r["captures"][0]["result"])
    assert readers.texts(spark, str(tmp_path)).count() == 1 and readers.texts(spark, str(tmp_path), whole=False).count() == 13
    assert readers.binaries(spark, str(tmp_path)).first()["content"][:2] == b"/a"


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "k=1"), ("2024-01-01 00:20:00", "k=1"), ("2024-01-01 02:00:00", "k=2"), ("2024-01-01 02:00:00", "bad")]
    df = spark.createDataFrame([(datetime.fromisoformat(a), b) for a, b in rows], "ts timestamp, t string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    p = seq("k=", number())[1]
    for name, out, mode in (("plain", parsed(stream, "t", p), "append"), ("counts", counted(stream, "ts", "t", p), "complete")):
        q = out.writeStream.format("memory").queryName(f"loom_{name}").outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["value"] for r in spark.sql("SELECT value FROM loom_plain").collect()) == [1, 1, 2]
    assert sorted((r["value"], r["n"]) for r in spark.sql("SELECT value, n FROM loom_counts").collect()) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("p", [text(rep(either("ab", "a"))), text(join(text(rep(char_not_in(" "))), " ", 1)), seq(text(rep(either("a", "b", " "))), at_end)[0], text(seq(rep(seq(rep1("a"), either("b", " "))), opt("a")))])
def test_repeated_groups_take_long_texts(spark, p):
    said = spark.createDataFrame([("ab" * 50_000,), ("ab a " * 20_000,), ("ab a",)], "t string")
    got = said.select("t", K.try_parse("t", p).alias("a"), K.try_parse("t", p, force="matcher", budget=None).alias("b"))
    assert all(r["a"] == r["b"] for r in got.collect())


def test_repeated_groups_that_may_give_back_have_no_regex(texts):
    assert K.tier(text(seq(rep(either("ab", "a")), "b"))) == "matcher" and K.tier(text(seq(rep(either("ab", "cd")), "x"))) == "regex"
    assert K.tier(text(seq(rep(seq("a", rep("b"))), "b"))) == "matcher"


DAYS = ["2024-02-29", "2023-02-29", "2024-1-45", "2024-13-01", "2024-02-30x", "0000-01-01", "31.12.2024 5", "31.2.2024", "1.1.20245", "9999-12-31", "2024-12-3", "2024-00-10", "2024-10-00", "2024-10-0", "", None, "x", "10000-01-01"]


def test_dates_agree(spark):
    said = spark.createDataFrame([(d,) for d in DAYS], "t string")
    p = date("%Y-%m-%d", "%d.%m.%Y")
    assert K.tier(p) == "regex"
    for r in said.select("t", K.try_parse("t", p).alias("a"), K.try_parse("t", p, force="matcher").alias("b"), K.matches("t", p).alias("c")).collect():
        assert r["a"] == r["b"] and r["c"] == (None if r["t"] is None else r["b"] is not None), r
    times = ["2024-02-29 23:59:59", "2024-02-29 24:00:00", "2024-02-29 1:2:60", "2024-02-29 12:61:00", "29.02.2024 7:05", "2024-02-29 23:59:7x"]
    p = date("%Y-%m-%d %H:%M:%S", "%d.%m.%Y %H:%M", time=True)
    said = spark.createDataFrame([(d,) for d in times], "t string")
    assert K.tier(p) == "regex" and K.tier(date("%d %b %Y")) == "matcher"
    for r in said.select("t", K.try_parse("t", p).alias("a"), K.try_parse("t", p, force="matcher").alias("b")).collect():
        assert r["a"] == r["b"], r


def test_json_at_agrees(spark):
    said = spark.createDataFrame([(x,) for x in ['{"a": [1, {"b": 2}]}', '{"a": []}', "[1]", "nope", '{"a": [1, {"b": "7"}]}', None, ' {"a" : [ 0 , {"b":-3} ] } ']], "t string")
    p = G.json_at("$.a[1].b", "bigint")
    found = said.select("t", K.try_parse("t", p).alias("a")).collect()
    assert [r["a"] for r in found] == [2, None, None, None, 7, None, -3]
    again = said.where("t NOT LIKE '%7%'").select(K.try_parse("t", p).alias("a"), K.try_parse("t", p, force="matcher").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in again)


def test_tries_of_many_words(spark):
    import random

    pick = random.Random(4)
    some = sorted({"".join(pick.choices("abc", k=pick.randint(1, 8))) for _ in range(3000)})
    said = spark.createDataFrame([("".join(pick.choices("abcd", k=30)),) for _ in range(200)] + [("",), (None,)], "t string")
    p = words(some)
    assert K.tier(p) == "regex"
    for r in said.select("t", K.try_parse("t", p).alias("a"), K.try_parse("t", p, force="matcher").alias("b"), K.try_parse("t", seq(p, "c")[0]).alias("c")).collect():
        if r["t"] is None:
            assert r["a"] is None
            continue
        fits = [w for w in some if r["t"].startswith(w)]
        assert r["a"] == r["b"] == max(fits, key=len, default=None)
        assert r["c"] == max((w for w in fits if r["t"][len(w) :].startswith("c")), key=len, default=None)
    table = spark.createDataFrame([(w, i) for i, w in enumerate(some)], "word string, id bigint")
    texts = said.where("t <> ''").distinct()
    one, other = (sorted(map(tuple, R.lookup_everywhere(texts, "t", "t", table, most=n).collect())) for n in (10, 100_000))
    assert one == other and len(one) > 1000


def test_errors_tell_how_far_a_parse_came(spark):
    said = spark.createDataFrame([("abcx",), ("abcd",), ("x",), (None,)], "t string")
    assert [r[0] and r[0]["index"] for r in said.select(K.error_of("t", seq("abc", "d"))).collect()] == [4, None, 1, None]
    assert [r[0] and r[0]["index"] for r in said.select(K.error_of("t", seq(rep1(char_not_in("x")), "d", at_end))).collect()] == [4, None, 1, None]


def test_pieces_of_texts_are_not_broadcast(spark):
    """Spark takes the pieces to be as few as the texts, so it must not choose to broadcast them."""
    texts = spark.range(10).selectExpr("id AS i", "concat('w', id, 'tail') AS t")  # of known size
    words = spark.range(2000).selectExpr("if(id = 1999, 'w1t', concat('w', id)) AS word", "id AS n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000b")
    try:
        found = R.lookup_prefix(texts, ["i"], "t", words)
        assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == [(i, "w1t" if i == 1 else f"w{i}", 1999 if i == 1 else i) for i in range(10)]
        every = R.lookup_everywhere(texts, "i", "t", words)
        assert "BuildLeft" not in every._jdf.queryExecution().executedPlan().toString()
        assert every.where("i = 1").sort("word").select("offset", "word").collect() == [(1, "w1"), (1, "w1t")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_of_runs(spark, monkeypatch):
    """A dictionary beyond the trie: pieces are made once for each different run of the words' letters, common runs are dealt out."""
    monkeypatch.setattr(R, "HOT_RUN", 50, raising=False)
    table = spark.createDataFrame([("ab", 1), ("b-", 2), ("b-", 3), ("😀]", 4), ("", 5), (None, 6), ("abab", 7)], "word string, id int")
    said = [" ".join(["ab", "xx", "abab", "a", "é😀]\\ab-"] * 40), "", None, "b-b", "zzz"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    got = sorted(map(tuple, R.lookup_everywhere(texts, "i", "t", table, most=2).collect()))
    words = [("ab", 1), ("b-", 2), ("b-", 3), ("😀]", 4), ("abab", 7)]
    assert got == sorted((i, k + 1, w, n) for i, t in enumerate(said) if t for w, n in words for k in range(len(t)) if t.startswith(w, k))
    pieces = spark.range(1, 2).selectExpr("1 AS i", "repeat('abcdefghij ', 20000) AS t")
    words = spark.range(3000).selectExpr("concat('abcdefghi', chr(97 + id % 26), id) AS word").union(spark.sql("SELECT explode(array('abc', 'ghij', 'j a'))")).where("word != 'j a'")
    found = R.lookup_everywhere(pieces, "i", "t", words, most=2)
    assert found.groupBy("word").count().sort("word").collect() == [("abc", 20000), ("ghij", 20000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
