"""Texts and bytes for patterns, and the test corpus of a regex library as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """path, value: whole text files, or their lines."""
    return spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), "value")


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """path, content (binary) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


CASES = "pattern string, flags string, sequence string, matches boolean, captures array<struct<i:string,result:string>>"


def cases(text: str) -> Iterator[dict]:
    """The cases of a corpus: ``/pattern/flags``, indented subjects, `` n: capture`` lines, and ``No match``."""
    pattern = flags = subject = None
    captures: list[dict] = []

    def told():
        return {"pattern": pattern, "flags": flags, "sequence": subject, "matches": bool(captures), "captures": captures}

    lines = iter(text.split("\n"))
    for line in lines:
        if line.startswith("/"):
            if subject is not None:
                yield told()
            body = line
            while not re.search(r"(?<!\\)(?:\\\\)*/[\w,=]*\s*$", body[1:]):
                more = next(lines, None)
                if more is None:
                    return
                body += "\n" + more
            end = body.rstrip().rfind("/")
            pattern, flags, subject, captures = body[1:end], body.rstrip()[end + 1 :], None, []
        elif line.startswith("\\="):  # announces subjects without a match, which their lack of captures tells too
            continue
        elif m := re.match(r"\s{0,1}(\d+|MK): ?(.*)$", line):
            captures.append({"i": m[1], "result": None if m[2] == "<unset>" else m[2]})
        elif line.startswith("    ") and pattern is not None:
            if subject is not None:
                yield told()
            subject, captures = line.strip(), []
    if subject is not None:
        yield told()


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """The cases of corpus files as rows."""

    @F.udtf(returnType=CASES)
    class Cases:
        def eval(self, text: str):
            for c in cases(text):
                yield c["pattern"], c["flags"], c["sequence"], c["matches"], [(x["i"], x["result"]) for x in c["captures"]]

    return texts(spark, path).alias("t").lateralJoin(Cases(F.col("t.value").outer()), how="inner").drop("value")
