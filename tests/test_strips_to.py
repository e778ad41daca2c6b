"""The length of a stripped text, asked without stripping it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.text import strip, strips_to
from tidewatch.operators.path_scan import false_positive_reason

TEXTS = [None, "", " ", "\n\t ", "a", " a ", "ab", " a \nb ", "a        b", "abcdefghi", "abcdefghij", "  a" + " " * 7 + "b\n", "a" + "\n" * 8 + "b",
         "١\U0001f600\U0001f600 x", "x" + "　" * 30, " abcdefghijk ", "a" * 21, " " * 40 + "b" * 20 + " " * 40, "a" + "\x1c" * 3 + "b", "a\r\n"]


def test_same_as_the_length_of_the_stripped_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for least in (1, 2, 5, 6, 10, 11, 21):
        rows = df.select("t", strips_to(F.col("t"), least).alias("new"), (F.length(strip(F.col("t"))) >= least).alias("old")).collect()
        assert [r.new for r in rows] == [r.old for r in rows], least


def test_the_empty_body_test_reads_no_whole_body(spark):
    """A body is not rewritten to learn that it isn't empty."""
    df = spark.createDataFrame([("x" * 20, 200)], "body string, status int")
    reason = false_positive_reason(F.col("status"), F.col("body"), F.lit("text/plain"), F.lit("LOG_FILE"), F.lower("body"))
    plan = df.select(reason.alias("r"))._jdf.queryExecution().analyzed().toString()
    empty = plan[: plan.index("Empty response body")]
    assert "regexp_replace" not in empty and df.select(reason).first()[0] is None
