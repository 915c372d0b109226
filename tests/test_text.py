import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(
    "host,kind",
    [("www.mckinsey.com", "consultancy"), ("oecd.org", "government"), ("nist.gov", "government"), ("mit.edu", "academic"), ("ox.ac.uk", "academic"), ("semi.org", "association"), ("nvidia.com", "company"), ("host.example", ""), ("", "")],
)
def test_source_type(spark, host, kind):
    assert one(spark, X.classify_source_type(F.col("h")), h=host) == kind


def test_year_prefers_detected(spark):
    assert one(spark, X.manifest_year(F.col("a"), F.col("b")), a="", b="y2019x") == "2019"
    assert one(spark, X.manifest_year(F.col("a"), F.col("b")), a="FY2018", b="2019") == "2018"
    assert one(spark, X.manifest_year(F.col("a"), F.col("b")), a="0", b="2019") == ""


def test_words_by_unicode_blanks(spark):
    assert one(spark, X.words(F.col("t")), t=" a\u00a0b\u2003c\x1cd\x85e ") == ["a", "b", "c", "d", "e"]
    assert one(spark, X.words(F.col("t")), t=None) == []


def test_citations(spark):
    a = "x [2] y [1][2] z [9] [0]"
    assert one(spark, X.cited_indices(F.col("a")), a=a) == [2, 1, 9, 0]
    assert one(spark, X.invalid_citations(F.col("a"), F.lit(3)), a=a) == [9, 0]


def test_renumber_tidies():
    assert X.renumber("a [1] b [2] , c [3] .", {1: 4, 3: 5}) == "a [4] b, c [5]."
    assert X.renumber("x [9] \ny\n ,", {}) == "x\ny\n,"
    assert X.renumber(None, {}) is None


def test_needles_fold():
    assert X.normalize_needle("17 .1 R&amp;D “x”–y inter-\nest") == X.normalize_needle('17.1 r&d "x"-Y interest')


def test_anchors_longest_first(spark):
    assert one(spark, X.numeric_anchors(F.col("t")), t="$1,200.5 and 7%, 7% and 12.") == ["$1,200.5", "12", "7%"]


def test_context(spark):
    assert one(spark, X.numbered_context(F.array(F.lit("a"), F.lit("b")))) == "[1] a\n[2] b"
    assert one(spark, X.numbered_context(F.array().cast("array<string>"))) == "(no relevant context found)"
