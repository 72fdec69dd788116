import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators import profile as p


def test_key_bar_is_strict(spark):
    df = spark.range(200).select(
        "id",
        F.when(F.col("id") < 3, 0).otherwise(F.col("id")).alias("k990"),  # 198 of 200
        F.when(F.col("id") < 5, 0).otherwise(F.col("id")).alias("k980"),  # 196 of 200: not over 98%
        F.when(F.col("id") < 10, F.col("id")).alias("ten"),
        F.when(F.col("id") < 11, F.col("id")).alias("eleven"),
    )
    assert {r["column"] for r in p.candidate_keys(df).collect()} == {"id", "k990", "eleven"}


def test_time_column(spark):
    df = spark.createDataFrame(
        [("x", f"2024/01/{i + 1:02d} 00:00:00" if i < 19 else "junk", i) for i in range(20)], "a string, b string, n int"
    )
    assert p.time_column(df) == "b"
    assert p.time_column(df.drop("b")) is None
    assert p.time_column(df.drop("b"), numeric_as_time=True) == "n"


def test_relationships_compare_numbers_by_value(spark):
    parents = spark.range(40).select("id", F.col("id").cast("string").alias("name"))
    children = spark.range(100).select(
        (F.col("id") % 20).cast("double").alias("ref"),
        (F.col("id") % 20 + F.lit(0.5)).alias("half"),
        (F.col("id") % 2 == 0).alias("flag"),
        (F.col("id") % 20).cast("string").alias("text"),
        (F.col("id") % 5).alias("few"),
    )
    found = p.as_relationships(p.relationships({"p": parents, "c": children}, {"p": ["id", "name"], "c": []}))
    assert found == [p.Relationship("p", "id", "c", "ref"), p.Relationship("p", "name", "c", "text")]


def test_many_columns_and_long_text_in_one_exchange(spark):
    """More columns than a word of bits has, stacked in several pieces; text that differs late."""
    wide = spark.range(60).select("id", *[(F.col("id") * (i + 2) % 97).alias(f"n{i}") for i in range(70)], F.concat(F.lit("x" * 500), F.col("id").cast("string")).alias("text"))
    child = spark.range(200).select((F.col("id") % 30).alias("ref"), F.concat(F.lit("x" * 500), (F.col("id") % 40).cast("string")).alias("words"), F.lit(None).cast("int").alias("none"))
    sets = p.column_sets({"w": wide, "c": child})
    sizes = {sets.attributes[r["attribute"]].column: r["size"] for r in sets.sizes().collect()}
    pdf = wide.toPandas()
    assert all(sizes[c] == pdf[c].nunique() for c in pdf.columns) and sizes["ref"] == 30 and "none" not in sizes
    keys = {}
    for r in p.candidate_keys_of({"w": wide, "c": child}, sets).collect():
        keys.setdefault(r["table"], []).append(r["column"])
    assert keys["w"][0] == "id" and "text" in keys["w"] and "c" not in keys
    found = p.as_relationships(p.relationships({"w": wide, "c": child}, {"w": ["id", "text"]}, sets=sets))
    assert found == [p.Relationship("w", "id", "c", "ref"), p.Relationship("w", "text", "c", "words")]


def test_relationship_overlap_bar(spark):
    parents = spark.range(90)
    nine_tenths = spark.range(100).select(F.col("id").alias("r"))
    less = spark.range(101).select(F.col("id").alias("r"))
    found = p.relationships({"p": parents, "a": nine_tenths, "b": less}, {"p": ["id"]})
    assert [(r["child"], r["overlap"]) for r in found.where("parent = 'p'").collect()] == [("a", 0.9)]


def test_anchor(spark):
    tables = {"a": spark.range(5), "b": spark.range(9), "c": spark.range(9)}
    assert p.choose_anchor(tables) == "c"
    assert p.choose_anchor(tables, "a") == "a"
    assert p.choose_anchor(tables, "zzz") == "c"


def test_schema_modes(spark):
    df = spark.createDataFrame([("1", 2), ("x", 3)], "a string, b int")
    expected = T.StructType().add("a", "long").add("b", "integer")
    with pytest.raises(ValueError):
        p.check_schema(df, expected)
    with pytest.raises(ValueError):
        p.check_schema(df, expected, coerce=True)  # "x" does not cast
    cast, report = p.check_schema(df, expected, mode="warn", coerce=True)
    assert [r["a"] for r in cast.collect()] == [1, None]
    assert {r["column"]: (r["status"], r["failed_rows"]) for r in report.collect()} == {"a": ("coerced", 1), "b": ("ok", 0)}
    same, _ = p.check_schema(df, expected, mode="off", coerce=True)
    assert same.schema == df.schema
    with pytest.raises(ValueError):
        p.check_schema(df.withColumn("c", F.lit(1)), df.schema)
    p.check_schema(df.withColumn("c", F.lit(1)), df.schema, allow_new=True)


def test_feature_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    rows = [tuple(r) for r in p.feature_schema(df).collect()]
    assert rows == [(0, "a", "int", False, 2, 2), (1, "b", "string", True, 2, 2)]


def test_quality_counts_unknown_as_good(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "a int")
    assert [tuple(r) for r in p.data_quality(df, {"negative": F.col("a") < 0}).collect()] == [("negative", 1, 3, 1 / 3)]
