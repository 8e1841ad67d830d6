"""Patterns over DataFrames: a row for each match or parse, and dictionaries as joins."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions import columns as K
from loomtext.plans.build import lift
from loomtext.plans.java import is_regular, nodes, regex, width
from loomtext.plans.matcher import compiled
from loomtext.plans.nodes import At, Look, Words, as_type


def match_rows(df: DataFrame, column: str, p, into: str = "found") -> DataFrame:
    """A row for each match of ``match_all``: its number from 1 in ``ordinal``, and the record's fields in ``into``."""
    return df.select("*", F.posexplode(K.match_all(column, p)).alias("ordinal", into)).withColumn("ordinal", F.col("ordinal") + 1)


def parse_rows(df: DataFrame, column: str, p, kind=None, into: str = "value") -> DataFrame:
    """A row for each result of ``parse_all``, the preferred ones first."""
    return df.select("*", F.posexplode(K.parse_all(column, p, kind)).alias("ordinal", into)).withColumn("ordinal", F.col("ordinal") + 1)


def first_at_each(df: DataFrame, column: str, p) -> DataFrame:
    """Overlapping matches, the preferred one at each position: rows (..., offset, match).  Regular patterns of bounded width that do not look around stay in the JVM."""
    p = lift(p)
    looks = any(isinstance(n, (At, Look)) for n in nodes(p))
    most = width(p)[1]
    if is_regular(p) and not looks and most is not None:  # a piece of the widest match's length is all a position needs
        every = df.select("*", F.explode(F.sequence(F.lit(1), F.length(column) + 1)).alias("_i"))
        rest, pattern = F.substring(F.col(column), F.col("_i"), F.lit(most)), f"\\A({regex(p)})"
        return every.where(rest.rlike(pattern)).select(*df.columns, F.col("_i").cast("bigint").alias("offset"), F.regexp_extract(rest, pattern, 1).alias("match"))
    program = compiled(p)

    def each(own, t: str) -> list:
        out = []
        for at in range(len(t) + 1):
            for ctx, end, _ in own.ways(t, at):
                out.append({"offset": at + 1, "match": t[at:end]})
                break
        return out

    kind = as_type("array<struct<offset:bigint,match:string>>")
    return df.select("*", F.explode(K._run(program, each, kind, F.col(column), None)).alias("_m")).select(*df.columns, "_m.offset", "_m.match")


def lookup_prefix(df: DataFrame, keys: list[str], column: str, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """The longest word of the dictionary that each text starts with: (keys, the dictionary's columns).

    ``keys`` tell rows apart.  One row for each length of word (there are few) meets the dictionary by an equi-join, which
    Spark broadcasts if it finds it small; the longest stays by an aggregate.  Texts with none are left out.  The join keeps all
    pieces until then, so that Spark may broadcast the dictionary alone: it takes the pieces to be as few as the texts.
    """
    lengths = sorted(r[0] for r in dictionary.select(F.length(word)).distinct().collect() if r[0])
    tried = df.select(*keys, F.col(column).alias("_text"), F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_n")).where(F.length("_text") >= F.col("_n"))
    tried = tried.select(*keys, F.substring(F.col("_text"), F.lit(1), F.col("_n")).alias(word))
    met = tried.join(dictionary.withColumn("_known", F.lit(True)), word, "left")
    best = met.groupBy(*keys).agg(F.max_by(F.when(F.col("_known"), F.struct(*dictionary.columns)), F.when(F.col("_known"), F.length(word))).alias("_best"))
    return best.where("_best IS NOT NULL").select(*keys, "_best.*")


#: Words of a dictionary that each task holds as one automaton; a larger one meets the texts by a join.
MOST_WORDS = 200_000


def lookup_everywhere(df: DataFrame, key: str, column: str, dictionary: DataFrame, word: str = "word", most: int = MOST_WORDS) -> DataFrame:
    """Every word of the dictionary at every place it stands: (key, offset, the dictionary's columns).

    Up to ``most`` words go to the tasks as a trie, which each text is walked through, so the rows are the finds alone.  Beyond
    that the texts are cut into runs of letters that the words are made of (any find lies within one), the pieces of each
    different run, of the dictionary's lengths, are joined with it, and each run's finds go back to all its places.
    """
    known = [r[0] for r in dictionary.select(word).where(F.length(word) > 0).distinct().limit(most + 1).collect()]
    if len(known) > most:
        return _lookup_by_runs(df, key, column, dictionary, word)
    trie = Words.of(known).trie

    def each(own, t: str) -> list:
        out = []
        for at in range(len(t)):
            node, here = own, at
            while here < len(t) and (node := node.get(t[here])) is not None:
                here += 1
                if "" in node:
                    out.append({"offset": at + 1, "word": t[at:here]})
        return out

    kind = as_type("array<struct<offset:bigint,word:string>>")
    found = df.select(key, F.explode(K._run(trie, each, kind, F.col(column), None)).alias("_m"))
    # all finds are in the dictionary; an outer join lets Spark broadcast that alone, as it takes the finds to be few
    return found.select(key, "_m.offset", F.col("_m.word").alias(word)).join(dictionary, word, "left").select(key, "offset", *dictionary.columns)


#: A run of more places than this is dealt over several tasks where the places meet the finds.
HOT_RUN = 100_000


def _lookup_by_runs(df: DataFrame, key: str, column: str, dictionary: DataFrame, word: str) -> DataFrame:
    letters = F.transform(F.split(word, ""), lambda c: F.struct(c.alias("letter"), F.lit(0).alias("length")))
    marks = F.concat(letters, F.array(F.struct(F.lit("").alias("letter"), F.length(word).alias("length"))))
    told = dictionary.where(F.length(word) > 0).select(F.explode(marks).alias("_m")).select("_m.*").distinct().collect()
    letters, lengths = sorted(r[0] for r in told if r[0]), sorted(r[1] for r in told if r[1])
    pattern = re.compile("[%s]{%d,}" % ("".join(map(re.escape, letters)), lengths[0]))

    @F.pandas_udf("places array<int>, runs array<string>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        found = [[] if t is None else list(pattern.finditer(t)) for t in texts]
        return pd.DataFrame({"places": [[m.start() for m in ms] for ms in found], "runs": [[m.group() for m in ms] for ms in found]})

    runs = df.select(key, cut(column).alias("_cut")).select(key, F.explode(F.arrays_zip("_cut.places", "_cut.runs")).alias("_r"))
    runs = runs.select(key, F.col("_r.places").alias("_at"), F.col("_r.runs").alias("_run"))
    parts = (F.count(F.lit(1)) / HOT_RUN).cast("int") + 1
    each = runs.groupBy("_run").agg(parts.alias("_parts"))
    pieces = each.select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_n")).where(F.length("_run") >= F.col("_n"))
    pieces = pieces.select("_run", "_parts", "_n", F.explode(F.sequence(F.lit(1), F.length("_run") - F.col("_n") + 1)).alias("_i"))
    pieces = pieces.select("_run", "_parts", "_i", F.substring(F.col("_run"), F.col("_i"), F.col("_n")).alias(word))
    # Spark would take the pieces to be few, and broadcast them
    met = pieces.join(dictionary.hint("merge"), word)
    finds = met.groupBy("_run", "_parts").agg(F.collect_list(F.struct("_i", F.struct(*dictionary.columns).alias("_word"))).alias("_finds"))
    finds = finds.select("_run", "_finds", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    hot = F.broadcast(each.where("_parts > 1"))
    dealt = runs.join(hot, "_run", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(key), F.col("_parts")), F.lit(0)).cast("int"))
    found = dealt.join(finds.hint("merge"), ["_run", "_part"]).select(key, "_at", F.explode("_finds").alias("_f"))
    return found.select(key, (F.col("_at") + F.col("_f._i")).cast("bigint").alias("offset"), "_f._word.*")


def register(spark, name: str, p, kind=None) -> None:
    """The pattern's parse as a SQL function of one text."""
    p = lift(p)
    kind = as_type(kind) or p.kind()
    program = compiled(p)
    if isinstance(kind, T.StructType):

        def go(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([K.plain(program.try_parse(t), kind) or dict.fromkeys(kind.names) if t is not None else dict.fromkeys(kind.names) for t in texts], columns=kind.names)
    else:

        def go(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else K.plain(program.try_parse(t), kind) for t in texts], dtype=object)

    spark.udf.register(name, F.pandas_udf(go, kind))
