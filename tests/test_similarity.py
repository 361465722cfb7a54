import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridsense.functions import similarity, values


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@given(st.text("abcé ", max_size=20), st.text("abcé ", max_size=20))
def test_lcs(a, b):
    assert similarity.lcs_length(a, b) == plain_lcs(a, b) == similarity.lcs_length(b, a)


def one(spark, expression, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expression.alias("x")).first().x


@pytest.mark.parametrize("a,b,r", [("universal", "universal picture", 18 / 26), ("mufc", "mnufc", 8 / 9), ("paris", "berlin", 4 / 11), ("abcd", "dcba", 2 / 8), ("", "", 1.0), ("x", "", 0.0)])
def test_ratio(spark, a, b, r):
    assert abs(one(spark, similarity.ratio("a", "b"), a=a, b=b) - r) < 1e-12


def test_token_ratios(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, similarity.token_sort_ratio(a, b), a="new york  city", b="city new york") == 1.0
    assert one(spark, similarity.token_set_ratio(a, b), a="new york", b="york new city hall") == 1.0
    assert one(spark, similarity.token_set_ratio(a, b), a="", b="x") == 0.0
    assert one(spark, similarity.partial_ratio("a", "b"), a="yankees", b="new york yankees") == 1.0
    assert one(spark, similarity.textual_similarity(a, b), a="Universal", b="universal PICTURE") == (18 / 26 + 1) / 2


def test_quantities(spark):
    from gridsense.functions import units
    from gridsense.plans import views

    df = spark.createDataFrame([("5 km and 5,010 m",), ("10 euro",), ("$3",), ("7 apples",), ("1 h",)], "value string")
    got = sorted((r.value, r.base_unit, round(r.amount, 6)) for r in units.quantities(df, views.units(spark).unionByName(units.currency_units(spark))).collect())
    assert got == [("$3", "dollar", 3.0), ("1 h", "second", 3600.0), ("10 euro", "dollar", 11.0), ("5 km and 5,010 m", "metre", 5000.0)]


def test_values(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, values.float_parse(a), a="1,234.5") == 1234.5 and one(spark, values.float_parse(a), a="x") is None
    assert one(spark, values.date_score(a, b), a="1994", b="1994-11-26") == 1.0
    assert one(spark, values.date_score(a, b), a="1994-10-26", b="1994-11-26") == 0.8
    assert one(spark, values.date_score(a, b), a="11/26/1994", b="1994-11-26") == 1.0
    assert one(spark, values.date_score(a, b), a="soon", b="1994") == 0.0
    assert one(spark, values.period_score(a, b), a="1990:1995", b="1990 – 1995") == 1.0
    assert one(spark, values.period_score(a, b), a="1990", b="1990 - 1995") == 0.0
    assert one(spark, values.clean_date(a), a="1994-00-00") == "1994"
    assert one(spark, values.flip(a), a="(-)P1") == "P1" and one(spark, values.flip(a), a="P1") == "(-)P1"
    assert one(spark, values.prefixed(a), a="Q5").endswith("/Q5") and one(spark, values.prefixed(a), a="x") == "x"
    assert one(spark, values.number_similarity(a, b), a=2.0, b=2.0) == 1.0
    assert one(spark, values.popularity(a), a=0) == 0.0 and abs(one(spark, values.popularity(a), a=98) - 0.25) < 1e-12
