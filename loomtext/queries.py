"""Queries over the test tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import columns as K
from loomtext.functions import grammars as G
from loomtext.functions import patterns as L
from loomtext.operators import rows as R
from loomtext.plans import classes as C
from loomtext.plans.build import (
    Blank, P, any_char, at_end, at_start, atomic, backwards, caseless, capture, char_in, char_not_in, date, effect, either, integer_base, join,
    lazy, look, map_deep, mapped, matched_range, memo, number, opt, raw, rep, rep1, rep_stop, rep_until, reparsed, seq, spaced, text, trim, where,
    strip_single, where_result, without, without_effects, words,
)
from loomtext.plans.nodes import Char, Const
from loomtext.sources.ebnf import ebnf, ebnf_text
from loomtext.sources.pcre import regex
from loomtext.sources.readers import binaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query by its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- sequences, choices, constants -------------------------------------------------------------


@query("SELECT c_custkey, CAST(substr(c_name, 10) AS BIGINT) AS no FROM customer")
def parse_key_number(spark, sf_dir):
    p = seq("Customer#", no=number())
    return table(spark, sf_dir, "customer").select("c_custkey", K.parse("c_name", p)["no"].alias("no"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part")
def parse_named_tuple(spark, sf_dir):
    p = seq(seq(adj=L.word), Blank(Const(" ")), seq(noun=L.word))
    found = K.parse("p_name", p)
    return table(spark, sf_dir, "part").select("p_partkey", found["_1"]["adj"].alias("adj"), found["_2"]["noun"].alias("noun"))


@query("SELECT p_partkey, split_part(p_name, ' ', 2) AS noun FROM part")
def pick_part(spark, sf_dir):
    p = seq(L.word, Blank(Const(" ")), L.word)[1]
    return table(spark, sf_dir, "part").select("p_partkey", K.parse("p_name", p).alias("noun"))


@query("SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'rest' END AS rank FROM orders")
def either_constant(spark, sf_dir):
    p = either(P("1-URGENT") >> "urgent", P("2-HIGH") >> "high", P("3-MEDIUM") >> "medium", P("4-NOT SPECIFIED") >> "rest", P("5-LOW") >> "rest")
    return table(spark, sf_dir, "orders").select("o_orderkey", K.parse("o_orderpriority", p).alias("rank"))


@query("SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10 AS level, substr(o_orderpriority, 3) AS label FROM orders")
def map_result(spark, sf_dir):
    p = seq(level=number().map(lambda n: 10 * n, "bigint", column=lambda c: c * 10), label=seq(Blank(Const("-")), text(rep1(any_char)))[0])
    found = K.parse("o_orderpriority", p)
    return table(spark, sf_dir, "orders").select("o_orderkey", found["level"].alias("level"), found["label"].alias("label"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS label FROM orders")
def flat_sequence(spark, sf_dir):
    p = (char_in(("1", "5")) * "-" * text(rep1(any_char)))[2]
    return table(spark, sf_dir, "orders").select("o_orderkey", K.parse("o_orderpriority", p).alias("label"))


@query("SELECT e.event_id, CAST(json_extract(e.props, '$.k') AS BIGINT) AS k FROM events e")
def spaced_sequence(spark, sf_dir):
    p = spaced("{", '"k"', ":", number().named("k"), "}")
    return table(spark, sf_dir, "events").select("event_id", K.parse("props", p)["k"].alias("k"))


# -- characters --------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '[^A-Z]', '', 'g'), ''), lambda c: c <> '')) AS BIGINT) AS capitals FROM documents")
def char_class(spark, sf_dir):
    found = K.match_each("text", char_in(("A", "Z")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("bigint").alias("capitals"))


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) AS BIGINT) AS capitals FROM documents")
def unicode_class(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(K.replace_each("text", char_not_in(C.Category("Lu")), "")).cast("bigint").alias("capitals"))


@query("SELECT p_partkey, CAST(length(translate(p_name, 'aeiou ', '')) AS BIGINT) AS consonants FROM part")
def class_algebra(spark, sf_dir):
    p = without(Char(C.WORD), char_in("aeiou"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(K.match_each("p_name", p)).cast("bigint").alias("consonants"))


@query("SELECT p_partkey, replace(translate(p_name, 'aeiou', '*****'), ' ', '*') AS masked FROM part")
def char_not_in_class(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.replace_each("p_name", char_in("aeiou ") | " ", "*").alias("masked"))


@query("SELECT n_nationkey, substr(n_name, 1, 1) AS first, substr(n_name, 2, 1) AS second FROM nation")
def any_character(spark, sf_dir):
    found = K.parse("n_name", seq(any_char, any_char))
    return table(spark, sf_dir, "nation").select("n_nationkey", found["_1"].alias("first"), found["_2"].alias("second"))


# -- repetition --------------------------------------------------------------------------------


@query("SELECT c_custkey, regexp_extract(c_name, '[0-9]{3,5}') AS digits FROM customer")
def repeat_minmax(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", K.match("c_name", text(rep(char_in(("0", "9")), 3, 5)))["match"].alias("digits"))


@query("SELECT r_regionkey, list_filter(string_split(r_name, ''), lambda c: c <> '') AS letters FROM region")
def repeat_list(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", K.parse("r_name", rep1(any_char)).alias("letters"))


@query("SELECT page_id, regexp_extract(html, '<.+?>') AS first, CAST(length(regexp_extract(html, '<.+>')) AS BIGINT) AS widest FROM pages")
def lazy_vs_greedy(spark, sf_dir):
    inner = rep1(Char(~C.chars("\n")))
    short, long = seq("<", lazy(inner), ">"), seq("<", inner, ">")
    return table(spark, sf_dir, "pages").select("page_id", K.match("html", short)["match"].alias("first"), F.length(K.match("html", long)["match"]).cast("bigint").alias("widest"))


@query("SELECT page_id, split_part(url, '://', 1) AS scheme FROM pages")
def repeat_until(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", K.parse("url", rep_until(any_char, "://", text=True)).alias("scheme"))


@query("SELECT page_id, split_part(url, '?', 1) AS before FROM pages")
def repeat_stop(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", K.parse("url", text(rep_stop(any_char, "?"))).alias("before"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, string_split(text, chr(10))[1] AS first FROM documents")
def join_skip(spark, sf_dir):
    found = K.parse("text", join(text(rep(char_not_in("\n"))), "\n", 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("bigint").alias("n_lines"), found[0].alias("first"))


@query("SELECT c_custkey, CAST(c_custkey AS BIGINT) + 7 - c_nationkey AS value FROM customer")
def join_prefix(spark, sf_dir):
    p = join(number(), char_in("+-"), 1, infix="prefix").map(lambda xs: sum(-n if s == "-" else n for s, n in xs), "bigint")
    said = F.concat_ws("", F.col("c_custkey"), F.lit("+7-"), F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", K.parse(said, p).alias("value"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) || ';' AS first, CAST(2 AS BIGINT) AS n FROM customer")
def join_suffix(spark, sf_dir):
    p = join(text(rep1(Char(C.DIGIT))), ";", 1, infix="suffix").map(lambda xs: {"first": xs[0][0] + xs[0][1], "n": len(xs)}, "struct<first:string,n:bigint>")
    found = K.parse(F.concat_ws(";", "c_custkey", "c_nationkey"), p)
    return table(spark, sf_dir, "customer").select("c_custkey", found["first"].alias("first"), found["n"].alias("n"))


@query("SELECT page_id, CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END AS fragment FROM pages")
def optional_default(spark, sf_dir):
    p = seq(Blank(rep(char_not_in("#"))), opt(text(seq("#", rep(any_char)))))[0]
    return table(spark, sf_dir, "pages").select("page_id", K.parse("url", p).alias("fragment"))


@query("SELECT p_partkey, false AS held, starts_with(p_name, 'small') AS plain FROM part")
def atomic_choice(spark, sf_dir):
    held, plain = seq(atomic(either("s", "sm")), "all"), seq(either("s", "sm"), "all")
    return table(spark, sf_dir, "part").select("p_partkey", K.matches("p_name", held).alias("held"), K.matches("p_name", plain).alias("plain"))


# -- context and conditions --------------------------------------------------------------------


@query("SELECT c_custkey, substr(c_name, 1, CAST(c_custkey % 7 AS INT)) AS taken FROM customer")
def flatmap_length(spark, sf_dir):
    said = F.concat((F.col("c_custkey") % 7).cast("string"), F.lit(":"), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", K.parse(said, G.length_prefixed()).alias("taken"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS even FROM customer")
def filter_result(spark, sf_dir):
    p = seq(where_result(number(), lambda n: n % 2 == 0), at_end)[0]
    return table(spark, sf_dir, "customer").select("c_custkey", K.try_parse(F.col("c_custkey").cast("string"), p).alias("even"))


@query("SELECT p_partkey, substr(p_name, 1, strpos(p_name, ' ') - 1) AS word FROM part")
def filter_place(spark, sf_dir):
    p = text(where(rep1(any_char), lambda t, a, b: t[b : b + 1] == " "))
    return table(spark, sf_dir, "part").select("p_partkey", K.try_parse("p_name", p).alias("word"))


@query("SELECT c_custkey, c_custkey AS inner_no FROM customer")
def parse_again(spark, sf_dir):
    p = reparsed(text(rep1(any_char)), seq("Customer#", number())[1])
    return table(spark, sf_dir, "customer").select("c_custkey", K.try_parse(F.concat(F.lit("Customer#"), F.col("c_custkey").cast("string")), p).alias("inner_no"))


@query("SELECT page_id, contains(url, 'example.org') AS org, contains(url, 'example') AND NOT contains(url, 'example.org') AS other FROM pages")
def lookahead(spark, sf_dir):
    org, other = seq("example", look(".org")), seq("example", look(".org", wanted=False))
    return table(spark, sf_dir, "pages").select("page_id", K.contains("url", org).alias("org"), K.contains("url", other).alias("other"))


@query("SELECT event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1) AS digits FROM events")
def lookbehind(spark, sf_dir):
    p = P('"k": ') / text(rep1(Char(C.DIGIT)))
    return table(spark, sf_dir, "events").select("event_id", K.match("props", p)["match"].alias("digits"))


@query("SELECT p_partkey, starts_with(p_name, 'small') AS begins, ends_with(p_name, 'ring') AS ends, p_name = 'small ring' AS whole FROM part")
def anchors(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", K.contains(name, seq(at_start, "small")).alias("begins"), K.contains(name, seq("ring", at_end)).alias("ends"), K.matches(name, L.whole(P("small ring"))).alias("whole"))


@query("SELECT p_partkey, regexp_matches(lower(p_type), '^promo') AS promo FROM part")
def caseless_literal(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.matches("p_type", caseless("ProMo")).alias("promo"))


@query("SELECT p_partkey, starts_with(lower(p_type), 'eco') AS eco FROM part")
def mapped_sequence(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.matches("p_type", mapped(str.lower, "eco")).alias("eco"))


@query("SELECT n_nationkey, reverse(split_part(n_name, '_', 2)) AS turned FROM nation")
def reversed_pattern(spark, sf_dir):
    p = backwards(seq("_", text(rep1(Char(C.DIGIT)))))
    return table(spark, sf_dir, "nation").select("n_nationkey", K.parse(F.reverse("n_name"), p)["_1"].alias("turned"))


@query("SELECT o_orderkey, length(o_orderpriority) > 0 AS always, false AS never FROM orders")
def always_never(spark, sf_dir):
    from loomtext.plans.build import always, never

    return table(spark, sf_dir, "orders").select("o_orderkey", K.matches("o_orderpriority", always).alias("always"), K.matches("o_orderpriority", never).alias("never"))


# -- results -----------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(url, '/[a-z][a-z]/') AS hit, CAST(nullif(strpos(url, nullif(regexp_extract(url, '/[a-z][a-z]/'), '')), 0) AS BIGINT) AS offset FROM pages WHERE regexp_matches(url, '/[a-z][a-z]/')")
def match_record(spark, sf_dir):
    found = K.match("url", seq("/", rep(char_in(("a", "z")), 2, 2), "/"))
    return table(spark, sf_dir, "pages").select("page_id", found["match"].alias("hit"), found["offset"].alias("offset")).where("hit IS NOT NULL")


@query("SELECT p_partkey, CAST(1 AS BIGINT) AS start, CAST(strpos(p_name, ' ') - 1 AS BIGINT) AS stop FROM part")
def match_range(spark, sf_dir):
    found = K.parse("p_name", matched_range(L.word))
    return table(spark, sf_dir, "part").select("p_partkey", found["start"].alias("start"), found["stop"].alias("stop"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS adj, CAST(NULL AS VARCHAR) AS none, CAST(strpos(p_name, ' ') + 1 AS BIGINT) AS noun_at FROM part")
def captures(spark, sf_dir):
    p = seq(capture(text(rep1(L.word_char)), "adj"), either(" ", capture("-")), capture(L.word, "noun"))
    found = K.match("p_name", p)["captures"]
    return table(spark, sf_dir, "part").select("p_partkey", found[0]["text"].alias("adj"), found[1]["text"].alias("none"), found[2]["start"].alias("noun_at"))


_OVERLAP = """
SELECT p_partkey, CAST(i AS BIGINT) AS "offset", substr(p_name, i, n) AS hit
FROM (SELECT p_partkey, p_name, unnest(generate_series(1, CAST(length(p_name) AS INT))) AS i FROM part), (VALUES (1), (2)) v(n)
WHERE i + n - 1 <= length(p_name) AND regexp_full_match(substr(p_name, i, n), '[a-z]+')"""


@query(_OVERLAP)
def match_all_overlap(spark, sf_dir):
    p = seq(Char(C.POSIX["lower"]), opt(Char(C.POSIX["lower"])))
    found = R.match_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", p)
    return found.select("p_partkey", F.col("found.offset").alias("offset"), F.col("found.match").alias("hit"))


@query("""
SELECT p_partkey, CAST(i AS BIGINT) AS "offset", regexp_extract(substr(p_name, i), '^[a-z]+') AS "match"
FROM (SELECT p_partkey, p_name, unnest(generate_series(1, CAST(length(p_name) AS INT))) AS i FROM part) WHERE regexp_matches(substr(p_name, i), '^[a-z]')""")
def first_at_each_place(spark, sf_dir):
    return R.first_at_each(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", text(rep1(Char(C.POSIX["lower"])))).drop("p_name")


@query("""
SELECT r_regionkey, CAST(length(r_name) - k + 1 AS INT) AS ordinal, substr(r_name, 1, CAST(k AS INT)) AS "value"
FROM (SELECT r_regionkey, r_name, unnest(generate_series(0, length(r_name))) AS k FROM region)""")
def parse_all_prefixes(spark, sf_dir):
    return R.parse_rows(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_name", text(rep(any_char))).drop("r_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS value, CASE WHEN c_custkey % 2 = 0 THEN CAST(length(CAST(c_custkey AS VARCHAR)) + 1 AS BIGINT) END AS pos FROM customer")
def parse_position(spark, sf_dir):
    said = F.concat(F.when(F.col("c_custkey") % 2 == 0, "").otherwise("x"), F.col("c_custkey").cast("string"))
    found = K.try_parse_at(said, number())
    return table(spark, sf_dir, "customer").select("c_custkey", found["value"].alias("value"), found["pos"].alias("pos"))


@query("SELECT p_partkey, CASE WHEN NOT starts_with(p_name, 'small') THEN substr(p_name, 1, 20) END AS excerpt FROM part")
def parse_error(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.error_of("p_name", P("small"))["excerpt"].alias("excerpt"))


@query("SELECT p_partkey, CAST(strpos(p_name, ' ') AS BIGINT) AS adj_after, CAST(length(p_name) + 1 AS BIGINT) AS noun_after FROM part")
def trace_events(spark, sf_dir):
    told = K.trace("p_name", seq(text(L.word).named("adj"), " ", text(L.word).named("noun")))
    after_of = lambda name: F.filter(told, lambda e: e["name"] == name)[0]["after"]
    return table(spark, sf_dir, "part").select("p_partkey", after_of("adj").alias("adj_after"), after_of("noun").alias("noun_after"))


@query("SELECT doc_id, CAST(octet_length(encode(substr(text, 1, 10))) + 1 AS BIGINT) AS at_byte FROM documents WHERE length(text) > 10")
def byte_offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 10)
    return docs.select("doc_id", K.byte_offset("text", F.lit(11)).alias("at_byte"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS at_byte FROM documents")
def byte_offset_ends(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.byte_offset("text", F.length("text") + 1).alias("at_byte"))


# -- numbers, dates, bytes ---------------------------------------------------------------------


@query("SELECT c_custkey, c_custkey AS value FROM customer")
def numeric_base(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", K.parse(F.lower(F.hex("c_custkey")), integer_base(16)).alias("value"))


@query("SELECT c_custkey, CAST(c_custkey AS DOUBLE) / 4 AS value FROM customer")
def numeric_double(spark, sf_dir):
    said = F.concat(F.col("c_custkey").cast("decimal(20,2)") / 4, F.lit(" units"))
    return table(spark, sf_dir, "customer").select("c_custkey", K.parse(said, number("double")).alias("value"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_multi(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "d.M.yyyy"))
    found = K.parse(said, date("%Y-%m-%d", "%d.%m.%Y"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(found, "yyyy-MM-dd").alias("day"))


@query("SELECT c_custkey, CAST(ascii(substr(c_name, 1, 1)) + 256 * ascii(substr(c_name, 2, 1)) AS INT) AS word FROM customer")
def bytes_le(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", K.parse(F.encode("c_name", "UTF-8"), raw(2, "H")).alias("word"))


@query("SELECT p_partkey, p_name AS inner_text FROM part")
def trimmed(spark, sf_dir):
    said = F.concat(F.lit(" \t"), "p_name", F.lit("  "))
    p = trim(text(join(L.word, " ", 1)))
    return table(spark, sf_dir, "part").select("p_partkey", K.parse(said, p).alias("inner_text"))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS at FROM orders")
def date_time(spark, sf_dir):
    said = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    found = K.parse(said, date("%Y-%m-%d %H:%M:%S", "%d.%m.%Y %H:%M", time=True))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(found.cast("timestamp")).alias("at"))


@query("""
SELECT p_partkey, CAST(i AS BIGINT) AS "offset", substr(p_name, i, 2) AS "match"
FROM (SELECT p_partkey, p_name, unnest(generate_series(1, CAST(length(p_name) AS INT))) AS i FROM part) WHERE regexp_full_match(substr(p_name, i, 2), '[a-z]{2}')""")
def pairs_at_each_place(spark, sf_dir):
    return R.first_at_each(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", text(rep(Char(C.POSIX["lower"]), 2, 2))).drop("p_name")


@query("SELECT p_partkey, strpos(p_name, ' ') > 0 AS spaced, regexp_replace(p_name, '\\b[a-z]', '#', 'g') AS starred FROM part")
def word_edges(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.contains("p_name", seq(L.word_char, L.non_word_char)).alias("spaced"), K.replace_each("p_name", seq(L.word_boundary, Char(C.POSIX["lower"])), "#").alias("starred"))


@query("SELECT doc_id, string_split(text, chr(10))[2] AS second FROM documents WHERE contains(text, chr(10))")
def line_anchors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("\n")))
    p = seq(look("\n", ahead=False), L.at_linestart, L.inline, L.at_lineend)
    return docs.select("doc_id", K.match("text", p)["match"].alias("second"))


# -- dictionaries ------------------------------------------------------------------------------

_WORDS = "SELECT 'ring' AS word, CAST(1 AS BIGINT) AS id UNION ALL SELECT 'bolt', 2 UNION ALL SELECT 'a', 3 UNION ALL SELECT 'an', 4 UNION ALL SELECT 'th', 5 UNION ALL SELECT 'the', 6 UNION ALL SELECT 'then', 7"


@query(f"SELECT p_partkey, w.word AS word, w.id AS id FROM part JOIN ({_WORDS}) w ON starts_with(split_part(p_name, ' ', 2), w.word) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(w.word) DESC) = 1")
def trie_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"))
    return R.lookup_prefix(parts, ["p_partkey"], "noun", spark.sql(_WORDS))


@query(f"""
SELECT conv_id, turn, CAST(count(w.word) AS BIGINT) AS n, CAST(sum(length(w.word)) AS BIGINT) AS letters
FROM (SELECT conv_id, turn, k, max_by(word, length(word)) AS word FROM
  (SELECT conv_id, turn, k, t.toks[k] AS tok FROM (SELECT conv_id, turn, toks, unnest(generate_series(1, len(toks))) AS k FROM (SELECT conv_id, turn, string_split(lower(text), ' ') AS toks FROM conversations)) t) u
  JOIN ({_WORDS}) d ON starts_with(u.tok, d.word) GROUP BY conv_id, turn, k) w GROUP BY conv_id, turn""")
def trie_longest(spark, sf_dir):
    tokens = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split(F.lower("text"), " ")).alias("tok"))
    dictionary = either(*[Const(w) >> w for w in ("then", "the", "th", "an", "a", "ring", "bolt")])
    found = tokens.select("conv_id", "turn", K.try_parse("tok", dictionary).alias("word")).where("word IS NOT NULL")
    return found.groupBy("conv_id", "turn").agg(F.count("word").alias("n"), F.sum(F.length("word")).cast("bigint").alias("letters"))


@query(f"""
SELECT p_partkey, CAST(i AS BIGINT) AS "offset", w.word AS word, w.id AS id
FROM (SELECT p_partkey, p_name, unnest(generate_series(1, CAST(length(p_name) AS INT))) AS i FROM part) JOIN ({_WORDS}) w ON substr(p_name, i, length(w.word)) = w.word""")
def dictionary_everywhere(spark, sf_dir):
    return R.lookup_everywhere(table(spark, sf_dir, "part"), "p_partkey", "p_name", spark.sql(_WORDS))


_TEXT_WORDS = "SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w FROM documents)"


def _text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), 0)).alias("word"))
    return found.distinct()


@query(f"""
SELECT p_partkey, max(length(word)) AS longest FROM (SELECT p_partkey, substr(said, 1, CAST(k AS INT)) AS piece FROM
  (SELECT p_partkey, said, unnest(generate_series(1, length(said))) AS k FROM (SELECT p_partkey, split_part(p_name, ' ', 2) || p_brand AS said FROM part)))
  JOIN ({_TEXT_WORDS}) ON piece = word GROUP BY p_partkey""")
def dictionary_of_texts(spark, sf_dir):
    """The longest word of all texts (thousands of them) that a name starts with, by a join."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), "p_brand").alias("said"))
    found = R.lookup_prefix(parts, ["p_partkey"], "said", _text_words(spark, sf_dir))
    return found.select("p_partkey", F.length("word").cast("bigint").alias("longest"))


@query(f"""
SELECT conv_id, turn, count(*) AS n, CAST(sum(length(word)) AS BIGINT) AS letters FROM
  (SELECT conv_id, turn, substr(text, CAST(i AS INT), CAST(k AS INT)) AS piece FROM
    (SELECT conv_id, turn, text, i, unnest(generate_series(3, least(length(text) - i + 1, (SELECT max(length(word)) FROM ({_TEXT_WORDS}))))) AS k FROM
      (SELECT conv_id, turn, text, unnest(generate_series(1, length(text))) AS i FROM conversations)))
  JOIN ({_TEXT_WORDS}) ON piece = word GROUP BY conv_id, turn""")
def words_everywhere(spark, sf_dir):
    """All words of all texts at every place of the conversations, overlapping ones too, through a trie."""
    said = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    found = R.lookup_everywhere(said, "key", "text", _text_words(spark, sf_dir))
    return found.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("word")).cast("bigint").alias("letters")).select("key.*", "n", "letters")


@query("""
SELECT p_partkey, CASE split_part(p_brand, '#', 1) || substr(split_part(p_brand, '#', 2), 1, 1) WHEN 'Brand1' THEN 10 WHEN 'Brand2' THEN 20 WHEN 'Brand3' THEN 30 ELSE 0 END AS value FROM part""")
def trie_values(spark, sf_dir):
    """A dictionary with results: the longest word's, in the JVM."""
    p = words({"Brand#1": 10, "Brand#2": 20, "Brand#3": 30, "Brand#": 0, "Brand": -1})
    return table(spark, sf_dir, "part").select("p_partkey", K.try_parse("p_brand", p, "int").cast("int").alias("value"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_name, 'small') THEN CAST(NULL AS BIGINT) WHEN starts_with(p_name, 's') THEN 1 ELSE 1 END AS place, CAST(strpos(p_name, ' ') AS BIGINT) AS stop FROM part WHERE NOT starts_with(p_name, 'small')")
def stopping_places(spark, sf_dir):
    """Where a parse could go no further: at once for a literal, at the first space for letters and a figure."""
    names = table(spark, sf_dir, "part").where(~F.startswith("p_name", F.lit("small")))
    letters = seq(rep1(Char(C.POSIX["lower"])), Char(C.DIGIT))
    return names.select("p_partkey", K.error_of("p_name", P("small"))["index"].alias("place"), K.error_of("p_name", letters)["index"].alias("stop"))


# -- more of the builder -----------------------------------------------------------------------


@query("SELECT p_partkey, length(regexp_extract(p_name, '^[aeiou]?[a-z]', 0)) AS n, regexp_extract(p_name, '^[^aeiou ]*') AS head FROM part")
def predicates(spark, sf_dir):
    """Characters by a function of one's own."""
    vowel, other = char_in(lambda c: c in "aeiou"), char_not_in(lambda c: c in "aeiou ")
    found = K.try_parse("p_name", text(seq(opt(vowel), Char(C.POSIX["lower"]))))
    return table(spark, sf_dir, "part").select("p_partkey", F.length(found).cast("bigint").alias("n"), K.try_parse("p_name", text(rep(other))).alias("head"))


@query("SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10 AS tens, upper(substr(o_orderpriority, 3)) AS label FROM orders")
def deep_maps(spark, sf_dir):
    """A function over the parts of one name, however deep they are."""
    p = map_deep(lambda n: n * 10, seq(seq(number().named("level"), "-")["level"], text(rep1(any_char))), "level", "bigint")
    found = K.parse("o_orderpriority", p)
    return table(spark, sf_dir, "orders").select("o_orderkey", found["_1"].alias("tens"), F.upper(found["_2"]).alias("label"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS told, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS is_open FROM orders")
def grown_choice(spark, sf_dir):
    """A choice that options are added to at both ends, and one of its options by name."""
    p = either(Const("F") >> "done").push(any_char >> "other").push_first(Const("O") >> "open", "open")
    status = table(spark, sf_dir, "orders").select("o_orderkey", K.parse("o_orderstatus", p).alias("told"), K.matches("o_orderstatus", p["open"]).cast("int").alias("is_open"))
    return status


@query("SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS value FROM customer")
def converted_choice(spark, sf_dir):
    """Options of several kinds, converted to one."""
    said = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.concat("c_nationkey", F.lit(".0")))
    p = either(text(seq(rep1(Char(C.DIGIT)), ".", rep1(Char(C.DIGIT)))), number(), result="double", convert=True)
    return table(spark, sf_dir, "customer").select("c_custkey", K.parse(said, p).alias("value"))


@query("SELECT conv_id, turn, CAST(len(string_split(text, ' ')) AS BIGINT) AS n, string_split(text, ' ')[1] AS first FROM conversations")
def folded_lists(spark, sf_dir):
    """Functions of a repetition's and an optional part's result."""
    words_ = join(text(rep(char_not_in(" "))), " ", 1).map(len, "bigint", column=lambda c: F.size(c).cast("bigint"))
    head = opt(text(rep1(char_not_in(" "))), "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", K.parse("text", words_).alias("n"), K.parse("text", head).alias("first"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part")
def sliced_parts(spark, sf_dir):
    """Several parts of a sequence."""
    found = K.parse("p_name", seq(L.word, " ", L.word)[0:3])
    return table(spark, sf_dir, "part").select("p_partkey", found["_1"].alias("a"), found["_3"].alias("b"))


@query("""
SELECT p_partkey, replace(p_name, ' ', '.*') = p_name AS single, p_type LIKE '%STEEL' OR p_type LIKE '%STEEL %' AS steel, p_name LIKE '% b%' AS b_noun,
       regexp_matches(p_name, '^(?:small|large) ') AS sized FROM part""")
def pcre_literals(spark, sf_dir):
    """Quotations, comments, alpha forms of look-arounds and atomic groups."""
    contains = lambda of, p, flags="": K.contains(of, regex(p, flags))
    return table(spark, sf_dir, "part").select(
        "p_partkey", (~contains("p_name", r"\x20")).alias("single"), contains("p_type", r"\QSTEEL\E(*pla:\s|\z)").alias("steel"),
        contains("p_name", r"(*plb:\x{20})(?#a noun)b").alias("b_noun"), contains("p_name", r"\A (*atomic: small | large ) \o{40} # a size", "x").alias("sized"),
    )


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\r\\n|[\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}]')) AS BIGINT) AS lines, regexp_matches(text, '[\\t ]') AS spaced FROM documents")
def pcre_line_ends(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(K.match_each("text", regex(r"\R"))).cast("bigint").alias("lines"), K.contains("text", regex(r"[\t\x{20}]")).alias("spaced"))


@query("SELECT c_custkey, substr(CAST(c_custkey AS VARCHAR), 1, 1) AS figure FROM customer")
def pcre_duplicate_names(spark, sf_dir):
    said = F.concat(F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b"), F.col("c_custkey").cast("string"))
    found = K.match(said, regex(r"a(?<n>\d)|b(?<n>\d)", "J"))["captures"]
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(found[0]["text"], found[1]["text"]).alias("figure"))


@query("SELECT p_partkey, lower(split_part(p_type, ' ', 1)) AS word FROM part")
def pcre_back_references(spark, sf_dir):
    """A back reference by name, in any case."""
    first = F.split_part("p_type", F.lit(" "), F.lit(1))
    found = K.match(F.concat(F.lower(first), F.lit("="), first), regex(r"(?i)(?<w>\w+)=\k<w>\z"))
    return table(spark, sf_dir, "part").select("p_partkey", found["captures"][0]["text"].alias("word"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}]+')) AS BIGINT) AS breaks, CAST(len(regexp_extract_all(text, '[ \\t\\x0B\\f\\x{85}\\x{200E}\\x{200F}\\x{2028}\\x{2029}]+')) AS BIGINT) AS gaps FROM documents")
def space_runs(spark, sf_dir):
    """Runs of line ends and of spaces within lines, in whole texts."""
    count = lambda p: F.size(K.match_each("text", p)).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", count(L.vertical_space).alias("breaks"), count(L.whitespace).alias("gaps"))


@query("SELECT c_custkey, CAST(CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey * 10 ELSE -1 END AS BIGINT) AS value, c_name AS name FROM customer")
def optional_mapped(spark, sf_dir):
    """A function of an optional part's result, and the default where the part is left out."""
    said = F.when(F.col("c_nationkey") % 2 == 0, F.concat("c_nationkey", F.lit(":"), "c_name")).otherwise(F.col("c_name"))
    p = seq(value=opt(seq(number(), ":")[0], -1, f=lambda n: n * 10, kind="bigint"), name=text(rep(any_char)))
    found = K.try_parse(said, p)
    return table(spark, sf_dir, "customer").select("c_custkey", found["value"].alias("value"), found["name"].alias("name"))


@query("SELECT p_partkey, regexp_extract(substr(p_name, 4), '[0-9A-Za-z_]+') AS word FROM part")
def match_from_place(spark, sf_dir):
    """The first match from a place on."""
    return table(spark, sf_dir, "part").select("p_partkey", K.match("p_name", L.word, start=4)["match"].alias("word"))


@query("SELECT p_partkey, contains(p_name, 'large') AS large, contains(p_name, 'a') AS marked, regexp_matches(p_name, '^s[a-z]+ [a-z]*t') AS two FROM part")
def pcre_verbs(spark, sf_dir):
    """An option that always fails, a mark, and options set for a part."""
    has = lambda of, p: K.contains(of, regex(p))
    return table(spark, sf_dir, "part").select("p_partkey", has("p_name", r"(?:small(*FAIL)|large)").alias("large"), has("p_name", r"(*MARK:here)a").alias("marked"), has("p_name", r"^(?i)S[A-Z]+ (?-i)[a-z]*t").alias("two"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS head FROM part")
def simplified(spark, sf_dir):
    """Choices of one option and effects taken out of a pattern, which so stays in the JVM."""
    p = without_effects(strip_single(seq(effect(either(text(rep1(char_in(("a", "z")))))), " ")))[0]
    return table(spark, sf_dir, "part").select("p_partkey", K.parse("p_name", p, force="regex").alias("head"))


@query("SELECT n_nationkey, 'PAR1' AS magic FROM nation")
def file_magic(spark, sf_dir):
    """The first bytes of a table's own files, read as binaries."""
    found = binaries(spark, f"{sf_dir}/nation.parquet").select(K.try_parse("content", raw(4)).cast("string").alias("magic")).distinct()
    return table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(found))


# -- PCRE and EBNF text ------------------------------------------------------------------------


@query("SELECT doc_id, regexp_extract(text, '[A-Z][a-z]+, [a-z]+') AS hit FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+, [a-z]+')")
def pcre_search(spark, sf_dir):
    found = K.match("text", regex(r"[[:upper:]][[:lower:]]+, [[:lower:]]+"))
    return table(spark, sf_dir, "documents").select("doc_id", found["match"].alias("hit")).where("hit IS NOT NULL")


@query("""
SELECT p_partkey, min(CASE WHEN substr(p_name, i, 1) = substr(p_name, i + 1, 1) THEN substr(p_name, i, 2) END) IS NOT NULL AS doubled
FROM (SELECT p_partkey, p_name, unnest(generate_series(1, CAST(length(p_name) AS INT))) AS i FROM part) WHERE i < length(p_name) GROUP BY p_partkey""")
def backreference(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.contains("p_name", regex(r"(\w)\1")).alias("doubled"))


@query("SELECT c_custkey, repeat('(', CAST(c_custkey % 5 AS INT) + 1) || 'x' || repeat(')', CAST(c_custkey % 5 AS INT) + 1) AS balanced FROM customer")
def recursion_parens(spark, sf_dir):
    said = F.concat(F.lit("a("), F.expr("repeat('(', cast(c_custkey % 5 as int) + 1)"), F.lit("x"), F.expr("repeat(')', cast(c_custkey % 5 as int) + 1)"), F.lit("y"))
    return table(spark, sf_dir, "customer").select("c_custkey", K.match(said, regex(r"\((?:[^()]++|(?R))*+\)"))["match"].alias("balanced"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '\"' || c_custkey || '\"' ELSE CAST(c_custkey AS VARCHAR) END AS hit FROM customer")
def conditional_group(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), key, F.lit('"'))).otherwise(F.concat(key, F.lit('"')))
    return table(spark, sf_dir, "customer").select("c_custkey", K.match(said, regex(r'(")?\d+(?(1)")'))["match"].alias("hit"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/?#]*example') AS example, lower(split_part(url, ':', 1)) = 'https' AS secure FROM pages")
def pcre_options(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", K.contains("url", regex(r"\A HTTPS? :// [^/?\#]* example", "ix")).alias("example"), K.contains("url", regex(r"^(?i:HTTPS):")).alias("secure"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS first, split_part(o_orderpriority, '-', 2) AS second FROM orders")
def pcre_names(spark, sf_dir):
    found = K.match("o_orderpriority", regex(r"(?<level>\d)-(?P<label>.+)"))["captures"]
    return table(spark, sf_dir, "orders").select("o_orderkey", found[0]["text"].alias("first"), found[1]["text"].alias("second"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS digit FROM orders")
def pcre_branch_reset(spark, sf_dir):
    found = K.match("o_orderpriority", regex(r"(?|([1-3])-|([45])-)(?&rest)(?(DEFINE)(?<rest>[A-Z ]+))"))["captures"]
    return table(spark, sf_dir, "orders").select("o_orderkey", found[0]["text"].alias("digit"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS figure FROM customer")
def ebnf_integer(spark, sf_dir):
    p = ebnf_text("digit = '0'|'1'|'2'|'3'|'4'|'5'|'6'|'7'|'8'|'9'; integer = [ '-' ], digit, { digit };", "integer")
    return table(spark, sf_dir, "customer").select("c_custkey", K.parse(F.col("c_custkey").cast("string"), p).alias("figure"))


@query("SELECT n_nationkey, ('NATION' || '_') AS head FROM nation")
def ebnf_factor(spark, sf_dir):
    p = text(ebnf("letter = 'N' | 'A' | 'T' | 'I' | 'O'; head = 6 * letter, '_'; (* six letters *)")["head"])
    return table(spark, sf_dir, "nation").select("n_nationkey", K.parse("n_name", p).alias("head"))


# -- whole grammars ----------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", K.try_parse("props", G.json_at("$.k", "bigint")).alias("k"))


@query("""
SELECT p_partkey, p_name AS name, CAST(p_size AS BIGINT) AS size, CAST(p_size % 3 AS BIGINT) AS n, p_size % 2 = 0 AS even,
       CASE WHEN p_size % 3 > 0 THEN p_type END AS first FROM part""")
def json_shapes(spark, sf_dir):
    """Texts of several shapes through the grammar: nested tables, lists of no to two items, numbers, truths and nulls."""
    items = F.when(F.col("p_size") % 3 == 0, F.lit("[ ]")).when(F.col("p_size") % 3 == 1, F.concat(F.lit('["'), "p_type", F.lit('"]'))).otherwise(F.concat(F.lit('["'), "p_type", F.lit('", null]')))
    said = F.concat(F.lit(' {"name": "'), "p_name", F.lit('", "in" : {"size":'), "p_size", F.lit(', "even":'), (F.col("p_size") % 2 == 0).cast("string"), F.lit('}, "items": '), items, F.lit("} "))
    p = G.json_value().map(lambda v: {"name": v["name"], "size": v["in"]["size"], "n": len(v["items"]), "even": v["in"]["even"], "first": v["items"][0] if v["items"] else None}, "struct<name:string,size:bigint,n:bigint,even:boolean,first:string>")
    found = K.try_parse(said, p)
    return table(spark, sf_dir, "part").select("p_partkey", *(found[k].alias(k) for k in ("name", "size", "n", "even", "first")))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS BIGINT) AS n FROM pages")
def html_links(spark, sf_dir):
    p = seq(Blank(Const('href="')), text(rep(char_not_in('"'))), Blank(Const('"')))
    return table(spark, sf_dir, "pages").select("page_id", F.size(K.match_each("html", p)).cast("bigint").alias("n"))


@query("SELECT p_partkey, 'href' AS key, '/' || p_name AS \"value\", p_type AS child FROM part")
def html_element(spark, sf_dir):
    said = F.concat(F.lit('<a href="/'), "p_name", F.lit('"><b>'), "p_type", F.lit("</b></a>"))
    p = G.html_element().map(lambda e: {"key": e[1][0]["key"], "value": e[1][0]["value"], "child": e[2][0][2][0]}, "struct<key:string,value:string,child:string>")
    found = K.try_parse(said, p)
    return table(spark, sf_dir, "part").select("p_partkey", found["key"].alias("key"), found["value"].alias("value"), found["child"].alias("child"))


@query("""
SELECT page_id, split_part(url, '://', 1) AS scheme, split_part(split_part(url, '://', 2), '/', 1) AS host,
       split_part(split_part(url, '://', 2), '/', 2) AS lang, split_part(split_part(split_part(split_part(url, '://', 2), '/', 3), '?', 1), '#', 1) AS id FROM pages""")
def url_grammar(spark, sf_dir):
    part = text(rep1(char_not_in("/?#")))
    p = seq(scheme=L.word, host=seq(Blank(Const("://")), part)[0], lang=seq(Blank(Const("/")), part)[0], id=seq(Blank(Const("/")), part)[0])
    found = K.parse("url", p)
    return table(spark, sf_dir, "pages").select("page_id", *[found[k].alias(k) for k in ("scheme", "host", "lang", "id")])


@query("SELECT n_nationkey, list_concat(generate_series(CAST(n_nationkey AS BIGINT), CAST(n_nationkey + n_regionkey AS BIGINT)), [CAST(99 AS BIGINT)]) AS numbers FROM nation")
def number_ranges(spark, sf_dir):
    said = F.concat(F.lit("["), "n_nationkey", F.lit("-"), F.col("n_nationkey") + F.col("n_regionkey"), F.lit(", 99]"))
    return table(spark, sf_dir, "nation").select("n_nationkey", K.parse(said, G.number_ranges()).alias("numbers"))


@query("SELECT c_custkey, (1 + 2) * c_custkey // gcd(3 * c_custkey, 4) AS num, CAST(4 // gcd(3 * c_custkey, 4) AS BIGINT) AS den FROM customer")
def arithmetic(spark, sf_dir):
    found = K.parse(F.concat(F.lit("(1+2)*"), "c_custkey", F.lit("/4")), G.arithmetic())
    return table(spark, sf_dir, "customer").select("c_custkey", found["num"].alias("num"), found["den"].alias("den"))


@query("SELECT s_suppkey, 'Doe' AS lastname, CAST(s_suppkey AS BIGINT) AS no, CAST(10000 + s_suppkey AS BIGINT) AS zip FROM supplier")
def person_address(spark, sf_dir):
    said = F.concat(F.lit("Doe, Jane\nMain Street "), "s_suppkey", F.lit(", "), F.col("s_suppkey") + 10000, F.lit(" New Town"))
    found = K.parse(said, G.people())[0]
    return table(spark, sf_dir, "supplier").select("s_suppkey", found["person"]["lastname"].alias("lastname"), found["addresses"][0]["door"]["no"].alias("no"), found["addresses"][0]["zip"].alias("zip"))


@query("SELECT s_suppkey, CAST(s_suppkey AS BIGINT) AS k FROM supplier")
def bson_document(spark, sf_dir):
    byte = lambda n: F.unhex(F.lpad(F.hex(n), 2, "0"))
    little = F.concat(*[byte(F.shiftright(F.col("s_suppkey"), 8 * k).bitwiseAND(255)) for k in range(8)])
    bson = F.concat(F.unhex(F.lit("10000000126B00")), little, F.unhex(F.lit("00")))
    found = K.try_parse(bson, G.bson_document().map(lambda kv: dict(kv)["k"], "bigint"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("k"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Doe' ELSE 'Roe' END AS lastname, s_name AS first_city FROM supplier")
def person_orders(spark, sf_dir):
    """Both orders of names, with labels and without."""
    city = F.regexp_replace("s_name", "[^A-Za-z]", "")
    said = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Name: Jane Doe").otherwise("Roe, Mary Ann"), F.lit("\nAddress: Long Road 7, 12345 "), city)
    found = K.try_parse(F.when(F.col("s_suppkey") % 2 == 0, said).otherwise(F.regexp_replace(said, " Ann", "")), G.people())[0]
    head = F.concat(found["addresses"][0]["city"], F.substring("s_name", F.length(city) + 1, F.lit(99)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", found["person"]["lastname"].alias("lastname"), head.alias("first_city"))


@query("""
SELECT p_partkey, CAST(i AS BIGINT) AS "offset", substr(p_name, i, n) AS hit
FROM (SELECT p_partkey, p_name, unnest(generate_series(1, CAST(length(p_name) AS INT))) AS i FROM part), (SELECT unnest(generate_series(2, 60)) AS n) v
WHERE i + n - 1 <= length(p_name) AND substr(p_name, i, n) = reverse(substr(p_name, i, n)) AND NOT contains(substr(p_name, i, n), ' ')""")
def palindromes(spark, sf_dir):
    found = R.match_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", G.palindromes())
    return found.select("p_partkey", F.col("found.offset").alias("offset"), F.col("found.match").alias("hit"))


@query("SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS BIGINT)) AS lengths FROM conversations")
def mapped_words(spark, sf_dir):
    word = text(rep(char_not_in(" "))).map(len, "bigint", column=lambda c: F.length(c).cast("bigint"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", K.parse("text", join(word, " ", 1)).alias("lengths"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS word FROM part")
def memoised(spark, sf_dir):
    p = seq(memo(either(seq(L.word, "!"), seq(L.word, " "))))[0].map(lambda x: x[0], "string")
    return table(spark, sf_dir, "part").select("p_partkey", K.try_parse("p_name", p, force="matcher").alias("word"))


@query("SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level FROM orders")
def sql_function(spark, sf_dir):
    R.register(spark, "parse_level", seq(number(), "-")[0])
    table(spark, sf_dir, "orders").createOrReplaceTempView("loomtext_orders")
    return spark.sql("SELECT o_orderkey, parse_level(o_orderpriority) AS level FROM loomtext_orders")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9a-f]{40}')) AS BIGINT) AS tokens, contains(text, 'Apache License') AS licensed FROM documents")
def document_scan(spark, sf_dir):
    token = seq(Char(C.HEX - C.chars(("A", "F"))), rep(Char(C.HEX - C.chars(("A", "F"))), 39, 39))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(K.match_each("text", text(token))).cast("bigint").alias("tokens"), K.contains("text", P("Apache License")).alias("licensed"))


