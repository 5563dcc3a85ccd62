import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import paths
from marlstone.functions.values import as_array, field_values, js_string, nested_property, prefix_of, prefix_path, unwrap_single

NESTED = "slug string, name string, count double, a struct<b:struct<c:string>>, tags array<struct<name:string, n:int>>, lists array<array<string>>, flags array<boolean>, m map<string,int>"
ROW = ("s", "foo", 42.0, (("deep",),), [("x", 1), ("y", None), (None, 3)], [["p", None], ["q"]], [True, False], {"k": 7})


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([ROW, ("t", *[None] * 7)], NESTED)


@pytest.mark.parametrize(
    "path, want",
    [
        ("name", ["foo"]), ("count", ["42"]), ("a.b.c", ["deep"]), ("tags.name", ["x", "y"]), ("tags.n", ["1", "3"]), ("lists", ["p", "q"]), ("flags", ["true", "false"]),
        ("m.k", ["7"]), ("missing", []), ("a.x", []), ("name.x", []), ("tags.x", []),
    ],
)
def test_field_values(df, path, want):
    got = df.orderBy("slug").select(field_values(df.schema, path).alias("v")).collect()
    assert [r.v for r in got] == [want, []]


def test_nested_property(df):
    got = df.orderBy("slug").select(nested_property(df.schema, "tags.n").alias("v")).collect()
    assert got[0].v == [1, 3] and not got[1].v


@pytest.mark.parametrize(
    "value, want",
    [(42.0, "42"), (-0.5, "-0.5"), (12345678.5, "12345678.5"), (0.0001, "0.0001"), (1e14, "100000000000000"), (99993.1, "99993.1"), (0.0, "0"), (float("nan"), "NaN"), (float("-inf"), "-Infinity"), (None, None)],
)
def test_numbers_as_text(spark, value, want):
    assert spark.createDataFrame([(value,)], "v double").select(js_string(F.col("v"), T.DoubleType()).alias("v")).first().v == want


def test_other_values_as_text(spark):
    df = spark.sql("SELECT 7L AS l, true AS b, CAST(1.50 AS DECIMAL(5,2)) AS d, CAST(2 AS DECIMAL(5,0)) AS e")
    assert list(df.select(*[js_string(F.col(f.name), f.dataType) for f in df.schema.fields]).first()) == ["7", "true", "1.5", "2"]


@pytest.mark.parametrize("value, depth, want", [("abc", 1, "0061"), ("abc", 2, "0061/0062"), ("あx", 2, "3042/0078"), ("𠮷z", 2, "d842/007a"), ("", 3, ""), ("a", 5, "0061")])
def test_prefix_path(spark, value, depth, want):
    assert prefix_of(value, depth) == want
    assert spark.createDataFrame([(value,)], "v string").select(prefix_path(F.col("v"), depth)).first()[0] == want


def test_arrays(spark):
    df = spark.createDataFrame([([[[5]]], [1, 2], 3)], "a array<array<array<int>>>, b array<int>, c int")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    got = df.select(unwrap_single(F.col("a"), kinds["a"]), unwrap_single(F.col("b"), kinds["b"]), as_array(F.col("c"), kinds["c"]), as_array(F.col("b"), kinds["b"])).first()
    assert list(got) == [5, None, [3], [1, 2]]


@pytest.mark.parametrize(
    "pattern, path, want",
    [
        ("content/**/*.md", "content/a.md", True), ("content/**/*.md", "content/x/y/a.md", True), ("content/*.md", "content/x/a.md", False), ("content/*.md", "content/a.mdx", False),
        ("a.b/*.md", "aXb/c.md", False), ("**", "any/thing", True), ("data/tags.yaml", "data/tags.yaml", True),
    ],
)
def test_globs(pattern, path, want):
    assert paths.glob_match(path, pattern) is want


def test_paths():
    assert paths.slug_of("content/recipes/g1/001.md", "content/recipes/**/*.md") == "g1--001"
    assert paths.path_of("g1--001", "content/recipes/**/*.md") == "content/recipes/g1/001.md"
    assert (paths.join_path("a//", "/b"), paths.parent("a/b/c/"), paths.tail("a/b/c/"), paths.trim_slash("/x/")) == ("a/b", "a/b", "c", "x")
    assert paths.prefix_dictionary(" 0061 \n\n0062\n") == ["0061", "0062"] and paths.base_dir("c/h/*.md") == "c/h/" and paths.base_dir("c/t.yaml") == "c/"
