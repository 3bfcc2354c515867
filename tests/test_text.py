"""F1-F4 edge rows: blank test, code-point length, dollar amounts, verdict parsing."""

from retentia.functions import text as X


def _one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"s {typ}")
    return [r[0] for r in df.select(fn("s")).collect()]


def test_dollar_amount_readings(spark):
    got = _one(spark, ["$15 and $15.00", "$15.5", "$1,200", "$5 vs $50", "none", "$7 $7"], X.dollar_amounts)
    assert got == [["$15", "$15.00"], ["$15"], ["$1"], ["$5", "$50"], [], ["$7"]]


def test_blank(spark):
    got = _one(spark, ["", "\t\n", "   ", "x", None], X.is_blank)
    assert got == [True, True, True, False, True]


def test_length_is_code_points(spark):
    got = _one(spark, ["a" * 19, "é" * 20, "😀" * 3], X.n_chars)
    assert got == [19, 20, 3]


def test_verdicts(spark):
    values = ["GROUNDED\nok", "grounded.", "UNGROUNDED\nbad", "\n\n  Grounded - fine", "", None, "  \n"]
    got = _one(spark, values, X.verdict_passed)
    assert got == [True, True, False, True, False, False, False]


def test_first_line_crlf(spark):
    got = _one(spark, ["  first \r\nsecond", "only"], X.first_line)
    assert got == ["first", "only"]


def test_format_context_empty_and_numbered(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [(1, [(1, "billing_issue", "negative", "charged twice")]), (2, [])],
        "k int, items array<struct<rank:int, interaction_type:string, sentiment:string, text:string>>",
    )
    got = dict(df.select("k", X.format_context(F.col("items"))).collect())
    assert got[1] == "1. [billing_issue, negative] charged twice"
    assert got[2] == "(No interaction history available for this customer.)"


def test_first_line_other_breaks(spark):
    got = _one(spark, ["a b", "c\x0bd", "e\x85f", "g\fh", "  i  "], X.first_line)
    assert got == ["a", "c", "e", "g", "i"]
