import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grafloom.functions.matching import MatchStrategy, as_text, compare_values, cosine, match, match_token_overlap
from grafloom.functions.text import normal, stripped, tokens


def scores(spark, column, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e string, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("e"), F.col("x"))).collect()]


def test_token_overlap_is_asymmetric(spark):
    rows = [("Fronius TPS 400i", "MIG-Schweißgerät Fronius TPS 400i"), ("Fronius TPS 400i", "Fronius Gerät"), ("", ""), (" ", "a"), ("a", ""), ("a a b", "A")]
    assert scores(spark, match_token_overlap, rows) == pytest.approx([1.0, 1 / 3, 1.0, 0.0, 0.0, 0.5])


def test_strategies(spark):
    rows = [("hello", "hello"), ("Hello  World ", "hello world"), ("a", "b")]
    assert scores(spark, lambda e, x: match(MatchStrategy.EXACT, e, x), rows) == [1.0, 0.0, 0.0]
    assert scores(spark, lambda e, x: match(MatchStrategy.NORMALIZED, e, x), rows) == [1.0, 1.0, 0.0]
    assert scores(spark, lambda e, x: match("no such", e, x), rows) == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("text", ["a b", "a  b", "a\x1cb", " 　a b ", "İ ẞ Σ", "", "\t\n"])
def test_white_space_is_that_of_python(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    got = df.select(normal(F.col("s")), tokens(F.col("s")), stripped(F.col("s"))).first()
    assert got[0] == " ".join(text.lower().split())
    assert got[1] == list(dict.fromkeys(text.lower().split()))
    assert got[2] == text.strip()


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([1.0, 0.0, 0.0, math.sqrt(0.5)])


def compared(spark, kind, e, x, x_kind=None, **more):
    schema = T.StructType([T.StructField("e", kind), T.StructField("x", x_kind or kind)])
    row = spark.createDataFrame([(e, x)], schema).select(compare_values(F.col("e"), F.col("x"), kind, x_kind or kind, **more).alias("c")).first()["c"]
    return row["match"], row["score"], row["strategy"], row["expected"], row["extracted"]


def test_compare_branches(spark):
    s, d, b = T.StringType(), T.DoubleType(), T.BooleanType()
    assert compared(spark, s, None, None, threshold=2.0)[:2] == (True, 1.0)
    assert compared(spark, s, "a", None, threshold=0.0)[:2] == (False, 0.0)
    assert compared(spark, b, True, True)[1:3] == (1.0, "exact")
    assert compared(spark, b, True, 1, T.IntegerType())[1] == 1.0
    assert compared(spark, b, True, "True", s)[1] == 0.0
    assert compared(spark, d, 10.0, 9.0)[1:3] == (pytest.approx(0.9), "numeric")
    assert compared(spark, d, 0.0, 0.0)[1] == 1.0
    assert compared(spark, d, 0.0, 1.0)[1] == 0.0
    assert compared(spark, d, 1.0, 5.0)[1] == 0.0
    assert compared(spark, d, float("nan"), 1.0)[1] == 0.0
    assert compared(spark, d, 1.0, "1", s)[1:3] == (0.0, "numeric")
    assert compared(spark, s, "TIG torch", "tig  TORCH") == (True, 1.0, "normalized", "TIG torch", "tig  TORCH")


def test_text_of_nested_values(spark):
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("certifications", T.ArrayType(T.StringType())), T.StructField("ok", T.BooleanType())])
    df = spark.createDataFrame([(("Hans", None, ["a", "b"], True),)], T.StructType([T.StructField("w", kind)]))
    assert df.select(as_text(F.col("w"), kind)).first()[0] == "name='Hans' description=None certifications=['a', 'b'] ok=True"
