"""JSON columns whose texts are broken, missing or of several shapes."""

from pyspark.sql import functions as F

from siftloom.operators import properties

TEXTS = ['{"a": {"b": [1, 2]}, "s": "x"}', '{"a": {"b": ["y"]}}', '{"a": 5}', "[1, 2]", "null", "", "{", '{"a": {"b": [3.5]}} trailing', None]


def rows(spark):
    return properties.parsed(spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string"), "t")


def test_what_is_no_json_is_counted(spark):
    got = properties.quality(rows(spark)).first()
    assert (got["rows"], got["bad"], got["missing"]) == (9, 2, 1) and "VARIANT" in got["schema"]


def test_values_by_path(spark):
    df = rows(spark)
    got = {r["i"]: r["x"] for r in df.select("i", properties.value("v", "$.a.b[0]", "long").alias("x")).collect()}
    assert got == dict.fromkeys(range(9)) | {0: 1, 7: 3}
    assert {(r["value"], r["n"]) for r in properties.facet(df, "$.s", keys=(), sums={"all": F.lit(1)}).collect()} == {("x", 1), (None, 8)}


def test_fields(spark):
    got = properties.unnested(rows(spark), "$", ("i",)).select("i", "key", F.to_json("value").alias("j")).collect()
    assert {(r["i"], r["key"], r["j"]) for r in got} == {(0, "a", '{"b":[1,2]}'), (0, "s", '"x"'), (1, "a", '{"b":["y"]}'), (2, "a", "5"), (7, "a", '{"b":[3.5]}')}
