import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meshtally.operators import runs, tableops as T
from meshtally.operators.process import keep_range, merge, process


def test_merge_like_pandas(spark, rows):
    a = pd.DataFrame({"node": [1, 2, 3, 3], "v": [1.0, 2.0, 3.0, 4.0], "m": ["a", "b", "c", "d"]})
    b = pd.DataFrame({"node": [2, 3, 4], "v": [20.0, 30.0, 40.0], "h": [5, 6, 7]})
    sa, sb = spark.createDataFrame(a), spark.createDataFrame(b)
    for how in ("inner", "left", "right", "outer"):
        want = a.merge(b, how, left_on="node", right_on="node")
        got = merge(sa, sb, "node", "node", how)
        assert got.columns == list(want.columns)
        clean = want.astype(object).where(want.notna(), None)
        assert rows(got) == sorted([tuple(None if pd.isna(x) else x for x in r) for r in clean.itertuples(index=False)], key=repr), how
    with pytest.raises(ValueError):
        merge(sa, sb, "node", "node", "cross")


def test_merge_on_other_names_and_null_keys(spark, rows):
    a = spark.createDataFrame([(1, 5), (None, 6)], "k int, v int")
    b = spark.createDataFrame([(1, 7), (None, 8)], "j int, v int")
    assert merge(a, b, "k", "j").columns == ["k", "v_x", "j", "v_y"]
    assert rows(merge(a, b, "k", "j")) == [(1, 5, 1, 7)]
    assert rows(merge(a, b, "k", "j", null_safe=True)) == [(1, 5, 1, 7), (None, 6, None, 8)]


def test_steps_see_earlier_results(spark, rows):
    a = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "node int, hops int")
    p = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.1)], "node int, rdc double")
    cut = {"filter": {"col": "hops", "min": 1, "max": 5}}
    got = process({"node": a, "pow": p}, {
        "node": [cut], "pow": [{"merge": {"df": "node", "left_on": "node", "right_on": "node"}}, cut], "none": [cut]})
    assert rows(got["pow"]) == [(1, 0.5, 1)]
    assert rows(keep_range(a, "hops", 1, 9)) == [(1, 1), (2, 9)]


def test_rows(spark, rows):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None), (3, None, float("nan")), (1, "a", 5.0)], "n int, s string, v double")
    assert rows(T.duplicates(df, ["n", "s"]), "v") == [(2.0,), (5.0,)]
    assert rows(T.in_list(df, "s", ["a"], keep=False), "n") == [(2,), (3,)]
    assert rows(T.nan_to_null(df).where("v is null"), "n") == [(2,), (3,)]
    assert rows(T.search_rows(df, ["1", "a"]), "v") == [(2.0,), (5.0,)]
    assert T.search_rows(df, ["aa"]).count() == 0
    assert rows(T.first_per_group(df, ["n"], [F.desc("v")], 1).where("n = 1"), "v") == [(5.0,)]
    assert rows(T.unique(df, "n")) == [(1,), (2,), (3,)]
    assert rows(T.where_keys(df, {"n": 1, "s": "a"}), "v") == [(2.0,), (5.0,)]
    assert rows(T.duplicates(df.select("s").unionByName(df.select("s").where("s is null")), ["s"])) == [("a",), ("a",), (None,), (None,)]


def test_text_and_numbers(spark, rows):
    df = spark.createDataFrame([(" a.b ", "k: v: w"), ("", "plain")], "s string, t string")
    assert rows(T.tidy_text(df), "s") == [("a.b",), (None,)]
    assert rows(T.split_in_two(df, "t", ": ", "x", "y"), "x", "y") == [("k", "v: w"), ("plain", None)]
    assert rows(T.replace_everywhere(df, "[^a-z]"), "s", "t") == [("", "plain"), ("ab", "kvw")]
    assert T.last_name_part(T.lower_names(df.toDF("A.S", "B.T"))).columns == ["s", "t"]
    assert rows(T.to_number(df, "s", coerce=True), "s") == [(None,), (None,)]
    with pytest.raises(PySparkException):
        T.to_number(df, "t").collect()
    n = spark.createDataFrame([(None, 2), (1, 2)], "a int, b int")
    assert rows(T.null_safe_sum(n, "a", "b", "c"), "c") == [(2,), (3,)]
    assert rows(T.add_columns(n, "a", "b", "c"), "c") == [("12",), (None,)]
    assert rows(T.set_where(n, F.col("b") == 2, "a", 9), "a") == [(9,), (9,)]


def test_shapes(spark, rows):
    df = spark.createDataFrame([("x", "p", 1.0), ("x", "p", 3.0), ("x", "q", 5.0), (None, "q", 7.0)], "i string, c string, v double")
    assert rows(T.pivot_mean(df, ["i"], "c", "v", ["p", "q"], "c_")) == [("x", 2.0, 5.0)]
    assert T.pivot_mean(df, ["i"], "c", "v", ["p", "q"], "c_").columns == ["i", "c_p", "c_q"]
    u = T.union_by_name(df.select("i", "v"), df.select("c", "i").limit(1))
    assert u.columns == ["i", "v", "c"] and u.count() == 5
    m = spark.createDataFrame([(1, {"a": 1, "b": 2})], "n int, m map<string,int>")
    assert rows(T.from_map(m, "m")) == [(1, "a", 1), (1, "b", 2)]
    h = spark.createDataFrame([(1, 10.0, 1), (1, 30.0, 3), (2, 20.0, 2)], "h int, v double, t int")
    assert rows(T.occurrence_matrix(h, "h", [1, 2], "v", "t", "t")) == [(0, 10.0, 20.0), (1, 30.0, None)]


def test_run_catalogue(spark, rows):
    two = F.create_map(F.lit("K"), F.lit("[1, 2]"), F.lit("L"), F.lit("x"))
    r = spark.createDataFrame([("a", "f1"), ("b", None)], "run string, flow_id string").withColumn(
        "params", F.when(F.col("run") == "a", two).otherwise(F.create_map(F.lit("K"), F.lit("1"))))
    f = spark.createDataFrame([("f1", 2, {"D": "1, 2"})], "flow_id string, num_apps int, flows map<string,string>")
    assert rows(runs.catalogue(r, f), "run", "makeargs") == [("a", "K=[1,2] L=x NUM_APPS=2 D=1,2"), ("b", "K=1")]


def test_grids(spark, rows):
    df = spark.createDataFrame([([1, 2], ["u", "v"])], "A array<int>, B array<string>")
    assert len(rows(runs.grid(df, ["A", "B"]), "A", "B")) == 4
    assert runs.grid(df, ["A", "B"]).first()["params"] == {"A": "1", "B": "u"}
    m = spark.createDataFrame([([{"a": 1, "b": 1}, {"a": 2}], [{"b": 9}])], "l array<map<string,int>>, r array<map<string,int>>")
    assert [x["params"] for x in runs.grid_of_maps(m, "l", "r").collect()] == [{"a": 1, "b": 9}, {"a": 2, "b": 9}]
    assert [x["params"] for x in runs.zip_maps(m, "l", "r").collect()] == [{"a": 1, "b": 9}]
    k = spark.createDataFrame([({"f": [1, 2]},)], "m map<string,array<int>>")
    assert rows(runs.key_values(k, "m", "f"), "key", "value") == [("f", 1), ("f", 2)]
