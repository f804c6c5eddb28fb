import pytest
from pyspark.sql import functions as F

from meshtally.operators import series as S
from meshtally.sources import tables


def bars(spark):
    df = spark.createDataFrame(
        [("sim-30", 1, 5.0), ("sim-30", 3, 7.0), ("sim-20", 1, 4.0), ("sim-20", 2, 6.0), ("other", 2, 1.0)],
        "run string, hops int, y double")
    return S.to_series(df, F.col("run"), "pdr", "bar", "hops", "y", "Hops", "PDR")


def lines(spark):
    df = spark.createDataFrame(
        [("sim-30-b", 1, 5.0), ("sim-30-b", 2, 7.0), ("sim-30-a", 1, 4.0), ("sim-9", 2, 6.0)], "run string, k int, y double")
    return S.to_series(df, F.col("run"), "lat", "line", "k", "y")


def test_points(spark, rows):
    assert rows(bars(spark), "run", "pos", "x", "x_num", "y") == [
        ("other", 0, "2", 2.0, 1.0), ("sim-20", 0, "1", 1.0, 4.0), ("sim-20", 1, "2", 2.0, 6.0),
        ("sim-30", 0, "1", 1.0, 5.0), ("sim-30", 1, "3", 3.0, 7.0)]
    floats = spark.createDataFrame([(2.7, 1.0)], "x double, y double")
    assert S.to_series(floats, "r", "m", "bar", "x", "y").first()["x"] == "2"
    text = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "x string, y double")
    assert rows(S.to_series(text, "r", "m", "bar", "x", "y"), "pos", "x", "x_num") == [(0, "a", None), (1, "b", None)]


def test_storage_and_lookup(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    tables.save_series(bars(spark), path)
    tables.save_series(lines(spark), path)
    tables.save_series(bars(spark).where("run = 'other'").withColumn("y", F.lit(99.0)), path)
    stored = tables.load_series(spark, path)
    assert rows(S.lookup(stored, ["other"], ["pdr"]), "x", "y") == [("2", 99.0)]
    assert S.lookup(stored, ["sim-30", "sim-20"], ["pdr"]).count() == 4
    with pytest.raises(LookupError, match="lat of sim-30"):
        S.lookup(stored, ["sim-30"], ["pdr", "lat"])
    plan = stored.where("run = 'other'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan


def test_align_on_x(spark, rows):
    assert rows(S.align(bars(spark), ["sim-30", "sim-20"]), "x", "run", "y") == [
        ("1", "sim-20", 4.0), ("1", "sim-30", 5.0), ("2", "sim-20", 6.0), ("2", "sim-30", 0.0),
        ("3", "sim-20", 0.0), ("3", "sim-30", 7.0)]


def test_concatenate(spark, rows):
    assert rows(S.concatenate(lines(spark)), "id", "run", "pos", "y") == [
        ("30", "sim-30-a", 0, 4.0), ("30", "sim-30-b", 1, 5.0), ("30", "sim-30-b", 2, 7.0), ("9", "sim-9", 0, 6.0)]


def test_compare(spark, rows):
    hist = bars(spark).withColumns({"metric": F.lit("join"), "kind": F.lit("violin")})
    lat = lines(spark).withColumn("run", F.when(F.col("run") == "sim-9", "sim-20").otherwise("sim-30"))
    every = bars(spark).unionByName(lat).unionByName(hist)
    got = rows(S.compare(every, ["sim-30", "sim-20"], ["pdr", "lat", "join"]), "metric", "kind", "id", "label", "x", "y")
    assert len([r for r in got if r[0] == "pdr"]) == 6 and ("pdr", "bar", "30", "sim-30", "2", 0.0) in got
    assert len([r for r in got if r[1] == "violin"]) == 4
    with pytest.raises(LookupError):
        S.compare(every, ["sim-30", "none"], ["pdr"])


def test_run_ids(spark):
    df = spark.createDataFrame([("a30b4",), ("none",)], "run string")
    assert [r[0] for r in df.select(S.run_id()).collect()] == ["30", "none"]


def test_clip_summary_sweep(spark, rows):
    assert rows(S.clip_labels(bars(spark).withColumn("y", F.col("y") + 0.2), 7), "y", "label")[-1] == (7.2, 8)
    s = {r["run"]: r for r in S.summarise(bars(spark)).collect()}
    assert (s["sim-30"]["mean"], s["sim-30"]["median"], s["sim-30"]["mode"]) == (6.0, 6.0, 5.0)
    m = spark.createDataFrame([("0", "pdr", 90.0), ("0", "lat", 5.0), ("25", "pdr", 80.0), ("x", "pdr", 1.0)],
                              tables.METRICS_SCHEMA)
    assert rows(S.sweep(m, ["0", "25"], ["pdr", "lat"])) == [("0", 90.0, 5.0), ("25", 80.0, None)]


def test_metric_store(spark, rows, tmp_path):
    path = str(tmp_path / "m")
    assert tables.load_metrics(spark, path).count() == 0
    m = spark.createDataFrame([("0", "pdr", 90.0)], tables.METRICS_SCHEMA)
    tables.save_metrics(m, path)
    for _ in range(2):  # saving again adds nothing
        tables.save_metrics(m.withColumn("run", F.lit("1")), path)
    assert rows(tables.load_metrics(spark, path)) == [("0", "pdr", 90.0), ("1", "pdr", 90.0)]
    tables.save_metrics(m.withColumn("value", F.lit(1.0)).unionByName(m.withColumn("name", F.lit("lat"))), path)
    assert rows(tables.load_metrics(spark, path)) == [("0", "lat", 90.0), ("0", "pdr", 1.0), ("1", "pdr", 90.0)]
    assert rows(tables.load_metrics(spark, path, ["1"])) == [("1", "pdr", 90.0)]


def test_saved_tables(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    tables.save_tables({"node": df}, str(tmp_path), "10")
    tables.save_tables({"node": df.withColumn("n", F.lit(2))}, str(tmp_path), "20")
    tables.save_tables({"node": df.withColumn("n", F.lit(3))}, str(tmp_path), "10")
    assert rows(tables.load_table(spark, str(tmp_path), "node")) == [(2, "a", "20"), (3, "a", "10")]
    assert rows(tables.load_table(spark, str(tmp_path), "node", ["20"])) == [(2, "a", "20")]


def test_null_columns_csv_xml(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, None, "a,b"), (2, None, None)], "n int, gone int, s string")
    kept = tables.drop_null_columns(df)
    assert kept.columns == ["n", "s"]
    tables.write_csv(kept, str(tmp_path / "c"))
    assert rows(tables.read_csv(spark, str(tmp_path / "c"), "n int, s string")) == rows(kept)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csc").write_text("<simconf><simulation><mote/>\n<mote/></simulation><mote/></simconf>")
    assert tables.element_count(tables.read_documents(spark, str(tmp_path / "x"))).first()["n"] == 2
