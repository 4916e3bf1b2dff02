from basalt.llm.common import materialise, number_equal_rows
from basalt.llm.components import components


def test_number_equal_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    assert sorted((r.x, r.copy) for r in number_equal_rows(df).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_equal_rows_are_dealt_in_two_steps(spark):
    df = spark.range(25_001).selectExpr("1 as x").unionAll(spark.range(10_000).selectExpr("2 as x"))
    got = {r.x: r for r in number_equal_rows(df).groupBy("x").agg({"copy": "max", "*": "count"}).collect()}
    assert {x: (r["max(copy)"], r["count(1)"]) for x, r in got.items()} == {1: (25_000, 25_001), 2: (9_999, 10_000)}
    assert number_equal_rows(df).distinct().count() == 35_001


def test_materialise_keeps_schema(spark):
    df = spark.createDataFrame([], "x int, y array<long>")
    out = materialise(df, "test")
    assert out.schema == df.schema and out.count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(20, 40)] + [(5, 9), (9, 7), (3, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 20 for i in range(20, 41)} | {5: 5, 7: 5, 9: 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
