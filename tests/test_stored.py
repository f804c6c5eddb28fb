"""Stores, numbered lines, bucketed tables, growing folders, rejects and sessions on awkward rows."""

import json
import math
import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meshtally.operators import formats, runs, sketches, stats
from meshtally.operators.process import merge
from meshtally.operators.reconcile import reconcile, reconcile_stored, round_trips, store_events
from meshtally.operators.sessions import part_reused, sessions
from meshtally.plans import queries_sources
from meshtally.plans import views as V
from meshtally.plans.queries_stored import grow
from meshtally.sources import logs, tables
from meshtally.sources.buckets import open_bucketed, save_bucketed
from meshtally.sources.growing import GrowingLogs
from meshtally.sources.numbered import read_numbered
from meshtally.sources.rejects import scrape_checked
from meshtally.sources.store import Conflict, Store

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- store

def test_store_replaces_keys_whole(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "t"), ["k"])
    assert store.read() is None and store.version() == 0 and store.entries() is None
    def df(*r):
        return spark.createDataFrame(list(r), "k string, v int")
    assert store.put(df(("007", 1), ("1e3", 2), (None, 3), ("", 4), ("a/b=c d%20é", 5))) == 1
    assert store.put(df(("007", 10), ("007", 11))) == 2
    want = [("", 4), ("007", 10), ("007", 11), ("1e3", 2), ("a/b=c d%20é", 5), (None, 3)]
    assert rows(store.read()) == sorted(want, key=repr)
    assert rows(store.read(["007"])) == [("007", 10), ("007", 11)]
    assert rows(store.read([None, "1e3"])) == sorted([("1e3", 2), (None, 3)], key=repr)
    assert rows(store.read(["7", "1000"])) == [] and store.read([]).count() == 0
    for _ in range(2):  # again: nothing is added
        store.put(df((None, 30)))
    assert rows(store.read([None])) == [(None, 30)]
    gone = spark.createDataFrame([(None,), ("007",)], "k string")
    store.put(df(), keys=spark.createDataFrame([("1e3",)], "k string"), gone=gone)
    assert rows(store.read()) == sorted([("", 4), ("a/b=c d%20é", 5)], key=repr)
    assert rows(store.entries()) == sorted([("",), ("1e3",), ("a/b=c d%20é",)], key=repr)


def test_store_columns_may_differ(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "t"), ["k"])
    store.put(spark.createDataFrame([(1, "x")], "k int, a string"))
    store.put(spark.createDataFrame([(2, 0.5)], "k int, b double"))
    assert rows(store.read(), "k", "a", "b") == [(1, "x", None), (2, None, 0.5)]
    with pytest.raises(ValueError, match="column a"):
        store.put(spark.createDataFrame([(3, 4)], "k int, a int"))


def test_readers_see_whole_commits(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    store = Store(spark, path, ["k"])
    store.put(spark.createDataFrame([(1, 1)], "k int, v int"))
    # a save that never got to its commit, and a draft of one
    spark.createDataFrame([(1, 99)], "k int, v int").write.parquet(f"{path}/save=dead")
    (tmp_path / "t" / "_drafts").mkdir(exist_ok=True)
    (tmp_path / "t" / "_drafts" / "x").write_text("{")
    assert rows(store.read()) == [(1, 1)]


def test_commits_that_race(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store, other = Store(spark, path, ["k"]), Store(spark, path, ["k"])
    store.put(spark.createDataFrame([(1, 1)], "k int, v int"))
    real, calls = store._files.create, []

    def late(name, text):
        if not calls:  # another writer commits this number first
            calls.append(name)
            other.put(spark.createDataFrame([(2, 2)], "k int, v int"))
        return real(name, text)

    monkeypatch.setattr(store._files, "create", late)
    assert store.put(spark.createDataFrame([(3, 3)], "k int, v int")) == 3
    assert rows(other.read()) == [(1, 1), (2, 2), (3, 3)]
    monkeypatch.setattr(store._files, "create", lambda name, text: False)
    with pytest.raises(Conflict):
        store.put(spark.createDataFrame([(4, 4)], "k int, v int"))
    assert rows(other.read()) == [(1, 1), (2, 2), (3, 3)]
    commits = sorted(p for p in (tmp_path / "t" / "_commits").iterdir() if not p.name.startswith("."))
    assert [json.loads(p.read_text())["number"] for p in commits] == [1, 2, 3]


def test_saved_runs_keep_their_names(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    names = ["007", "1e3", "2024-01-01", "true", "a/b", " ", "x=1", "é%41"]
    for name in names:
        tables.save_tables({"node": df}, str(tmp_path), name)
    assert rows(tables.load_table(spark, str(tmp_path), "node")) == sorted(((1, "a", n) for n in names), key=repr)
    for name in names:
        assert rows(tables.load_table(spark, str(tmp_path), "node", [name])) == [(1, "a", name)]
    tables.save_tables({"node": df.limit(0)}, str(tmp_path), "007")
    assert tables.load_table(spark, str(tmp_path), "node", ["007"]).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path), "other")


# --- line numbers

@pytest.mark.parametrize("split", [None, 1 << 20, 97, 7])
def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    r = random.Random(3)
    want = []
    for name in ("a.log", "sub/b c.log", "empty.log", "end.log"):
        text = [] if name == "empty.log" else ["x" * r.randint(0, 40) for _ in range(60)]
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        # newline="" keeps \r\n; one file has no line end at its end
        path.write_bytes(("\r\n" if "b" in name else "\n").join(text).encode() + (b"" if name == "end.log" else b"\n" if text else b""))
        want += [(path.name.replace(" ", "%20"), i + 1, line) for i, line in enumerate(text)]
    if want[-1][2] == "":
        want.pop()
    got = read_numbered(spark, str(tmp_path / "logs"), recursive=True, split_bytes=split)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = [(r["file"].split("/")[-1], r["line"], r["value"]) for r in got.collect()]
    assert sorted(found) == sorted(want)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_line_numbers_take_many_splits(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(5000)))
    read = spark.read.text(str(tmp_path))
    assert read.rdd.getNumPartitions() < 20
    got = read_numbered(spark, str(tmp_path), split_bytes=1000)
    assert all(r["value"] == f"line {r['line'] - 1}" for r in got.collect()) and got.count() == 5000


# --- bucketed tables

@needs_tables
def test_stored_tables_need_no_exchange(spark, rows, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fixed = ("type", "id", "seq")
        keyed = formats.keyed_sdn(V.sdn_rows(spark, SF))
        stored = store_events(keyed, "t_events", str(tmp_path / "e"), fixed, buckets=5)
        packets = reconcile_stored(stored, fixed)
        assert "Exchange" not in plan(packets)
        want = reconcile(keyed, fixed)
        assert rows(packets) == rows(want)
        by_id = save_bucketed(want, "t_packets", str(tmp_path / "p"), ["id"], 5)
        trips = round_trips(by_id)
        assert "Exchange" not in plan(trips) and plan(trips).count("Bucketed: true") == 2
        assert rows(trips) == rows(round_trips(want))
        one = save_bucketed(want.select("packet", "lat"), "t_one", str(tmp_path / "one"), ["packet"], 5)
        two = save_bucketed(want.select("packet", "hops"), "t_two", str(tmp_path / "two"), ["packet"], 5)
        both = merge(one, two, "packet", "packet", "outer")
        assert "Exchange" not in plan(both)
        assert rows(both) == rows(want.select("packet", "lat", "hops"))
        assert len([p for p in (tmp_path / "one").iterdir() if p.suffix == ".parquet"]) <= 5
        spark.sql("DROP TABLE t_one")
        again = open_bucketed(spark, "t_again", str(tmp_path / "one"), ["packet"], 5)
        assert rows(again) == rows(want.select("packet", "lat")) and "Exchange" not in plan(again.groupBy("packet").count())
        with_run = keyed.withColumn("run", F.when(F.col("node") % 2 == 0, "a"))
        by_run = store_events(with_run, "t_runs", str(tmp_path / "r"), fixed, ["run"], 5)
        assert rows(reconcile_stored(by_run, fixed, ["run"])) == rows(reconcile(with_run, fixed, ["run"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("t_events", "t_packets", "t_one", "t_two", "t_again", "t_runs"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


# --- growing folders

@needs_tables
def test_refresh_reads_new_and_changed_files_only(spark, tmp_path):
    logs_of, first, second = grow(spark, SF, str(tmp_path / "logs"))
    assert (first.changed, first.gone, first.version) == (0, 0, 1) and first.new > 1
    assert second.new >= 1 and second.changed == 1 and second.gone >= 1 and second.version == 2
    again = logs_of.refresh()
    assert (again.new, again.changed, again.gone, again.version) == (0, 0, 0, 2)


def test_refresh_parses_what_changed(spark, rows, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    parsed = []

    def parse(lines):
        parsed.append(sorted(r["file"].split("/")[-1] for r in lines.select("file").distinct().collect()))
        return lines.select("file", "value").where("value <> ''")

    grown = GrowingLogs(spark, str(folder), str(tmp_path / "store"), parse)
    with pytest.raises(LookupError):
        grown.rows()
    assert grown.refresh() == type(grown.refresh())(0, 0, 0, 1)  # an empty folder is a state too
    (folder / "a[1].log").write_text("a1\na2\n")
    (folder / "b {x}.log").write_text("b1\n")
    (folder / "empty.log").write_text("")
    grown.refresh()
    (folder / "b {x}.log").write_text("b1\nb2\n")
    (folder / "c*.log").write_text("c1\n")
    (folder / "c2.log").write_text("not in c*\n")
    found = grown.refresh()
    assert (found.new, found.changed, found.gone) == (2, 1, 0)
    assert [len(p) for p in parsed][-2:] == [2, 3]
    assert rows(grown.rows(), "value") == [("a1",), ("a2",), ("b1",), ("b2",), ("c1",), ("not in c*",)]
    (folder / "a[1].log").unlink()
    found = grown.refresh()
    assert (found.new, found.changed, found.gone) == (0, 0, 1)
    assert rows(grown.rows(), "value") == [("b1",), ("b2",), ("c1",), ("not in c*",)]


# --- rejects

def test_rejects_and_counts_from_one_scan(spark, rows, tmp_path):
    lines = ["100: 3: [STAT: RPL] h:2, n:5", "junk", "", None, "99999999999999999999: 3: [STAT: RPL] h:2, n:5",
             "50: 2: [STAT: ICMP]  type:155 code:99999999999", "700: 4: INFO: OP ep:12 CLCT h:2 cp: 3",
             "\u0002x", "junk"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    s = scrape_checked(df, ["node", "icmp", "atomic-op", "atomic-energy"], str(tmp_path / "s"))
    assert s.lines == 9 and s.unmatched == 5
    assert s.matches == {"node": 2, "icmp": 1, "atomic-op": 1, "atomic-energy": 1}
    assert {f: n for f, n in s.failed.items() if n} == {"time": 1, "code": 1}
    assert rows(s.rejects.select("n", "value", "pattern", F.array_join("failed", ",").alias("f"))) == sorted([
        (1, "junk", None, ""), (2, "", None, ""), (7, "\u0002x", None, ""), (8, "junk", None, ""),
        (4, lines[4], "node", "time"), (5, lines[5], "icmp", "code")], key=repr)
    for name in ("node", "icmp", "atomic-op"):
        assert rows(s.tables[name].drop("n")) == rows(logs.parse(df.select("value"), name))
    empty = scrape_checked(df.limit(0), ["node"], str(tmp_path / "e"))
    assert (empty.lines, empty.unmatched, empty.rejects.count(), empty.tables["node"].count()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        scrape_checked(df, ["none"], str(tmp_path / "n"))


# --- sessions

def brute_sessions(data, gap):
    out, last = [], {}
    for k, t, i in sorted(data, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2])):
        n, before = last.get(k, (0, None))
        n += before is not None and t is not None and t - before > gap
        last[k] = (n, t)
        out.append((k, t, i, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 8])
def test_sessions_across_partitions(spark, rows, shuffles, parts):
    shuffles(parts)
    r = random.Random(7)
    data = [("hot", r.randint(0, 4000), i) for i in range(1500)] + [
        (r.choice(["a", "b", None, "", "c"]), r.choice([None, 5, 5, r.randint(0, 900)]), 2000 + i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t bigint, i int").repartition(6)
    got = sessions(df, ["k"], "t", 3, ["i"])
    assert rows(got, "k", "t", "i", "session") == brute_sessions(data, 3)
    assert len({n for k, _, _, n in brute_sessions(data, 3) if k == "hot"}) > 5
    assert sessions(df.limit(0), ["k"], "t", 3).count() == 0


def test_packets_whose_numbers_start_over(spark, rows):
    raw = [(1_000_000, 5, "OUT", "NSU", 5, 1, 0, 2), (1_200_000, 1, "IN", "NSU", 5, 1, 0, 2),
           (900_000_000, 5, "OUT", "NSU", 5, 1, 0, 2),  # after a reboot, and lost
           (901_000_000, 7, "OUT", "NSU", 7, 1, 0, 2)]
    events = formats.keyed_sdn(spark.createDataFrame(
        raw, "time bigint, node int, state string, type string, src int, dest int, seq bigint, hops int"))
    merged = reconcile(events).select("packet", "TX", "RX", "received")
    assert rows(merged) == [("NSU_5_1_0", 2, 1, "correct"), ("NSU_7_1_0", 1, 0, "missed")]
    apart = reconcile(part_reused(events, 60_000_000)).select("packet", "id", "TX", "RX", "received")
    assert rows(apart) == sorted([("NSU_5_1_0", "5_0", 1, 1, "correct"), ("NSU_5_1_0#1", "5_0#1", 1, 0, "missed"),
                                  ("NSU_7_1_0", "7_0", 1, 0, "missed")], key=repr)


# --- entry file

def test_library_queries_without_the_training_data_package(monkeypatch):
    """A library that only the training-data operators need is missing: all other queries are still there."""
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as driver
    from meshtally.plans import registered

    gone = re.compile(r"meshtally\.llm|corpus_pipeline|ahocorasick")
    for name in [n for n in sys.modules if gone.match(n)]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert set(registered.QUERIES) <= set(driver.queries())
    assert "op8_decontamination" not in driver.queries() and set(driver.oracle_sql()) == set(registered.SQL)


# --- sketches, density, grids

def test_sketches_merge_and_keep_their_error(spark, rows, tmp_path):
    r = random.Random(5)
    data = [(f"run-{i % 3}", "lat", r.lognormvariate(0, 2)) for i in range(30000)]
    data += [("few", "lat", float(i)) for i in range(5)] + [("none", "lat", None), ("nan", "lat", float("nan"))]
    df = spark.createDataFrame(data, "run string, metric string, v double").repartition(7)
    made = sketches.sketch(df, "v", ["run", "metric"])
    sketches.save_sketches(made, str(tmp_path / "k"))
    sketches.save_sketches(made.where("run = 'run-1'"), str(tmp_path / "k"))  # again
    stored = sketches.load_sketches(spark, str(tmp_path / "k"))
    assert rows(stored, "run", "n") == [("few", 5), ("run-0", 10000), ("run-1", 10000), ("run-2", 10000)]
    assert sketches.load_sketches(spark, str(tmp_path / "none")).count() == 0
    probs = {"a": 0.1, "m": 0.5, "z": 0.95}
    assert rows(sketches.sketched_quantiles(stored.where("run = 'few'"), {"lo": 0.0, "m": 0.5, "hi": 1.0}), "name", "value") == [
        ("hi", 4.0), ("lo", 0.0), ("m", 2.0)]
    every = sorted(v for run, _, v in data if run.startswith("run"))
    merged = sketches.merge_sketches(stored.where("run <> 'few'"))
    for q in sketches.sketched_quantiles(merged, probs).collect():
        rank = sum(v <= q["value"] for v in every) / len(every)
        assert q["n"] == 30000 and abs(rank - q["p"]) <= q["error"] < 0.02
    for s in sketches.sketched_shares(merged, [0.5, 1.0, 100.0]).collect():
        assert abs(sum(v <= s["x"] for v in every) / len(every) - s["y"]) <= s["error"]


def test_density_far_from_boxes(spark):
    r = random.Random(6)
    data = [("a", r.gauss(0, 1)) for _ in range(400)] + [("a", r.gauss(400, 0.01)) for _ in range(5)] + [("b", 1.0), ("b", 2.0)]
    df = spark.createDataFrame(data, "g string, v double")
    for name in ("a", "b"):
        own = [v for g, v in data if g == name]
        mean = sum(own) / len(own)
        h = (sum((v - mean) ** 2 for v in own) / (len(own) - 1)) ** 0.5 * len(own) ** -0.2
        for row in stats.density(df, "v", "g", [name], 60).collect():
            want = sum(math.exp(-((row["x"] - v) / h) ** 2 / 2) for v in own) / (len(own) * h * math.sqrt(2 * math.pi))
            assert abs(row["y"] - want) < 1e-13


def test_grids_are_made_by_many_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 7)
    df = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"], [True]), (2, [5] * 100, ["x"] * 3, [False, None]), (3, [], ["a"], [True]),
                                (4, None, ["a"], [True])], "id int, n array<int>, s array<string>, t array<boolean>")
    got = runs.grid(df, ["n", "s", "t"])
    assert got.columns == ["id", "n", "s", "t", "params"]
    small = rows(got.where("id = 1").select("n", "s", "t", F.col("params")["n"]))
    assert small == sorted(((n, s, True, str(n)) for n in (1, 2, 3) for s in "ab"), key=repr)
    assert got.where("id = 2").count() == 600 and got.where("id > 2").count() == 0
    big = spark.range(1).select(F.expr("sequence(1, 3000)").alias("a"), F.expr("sequence(1, 50)").alias("b"))
    monkeypatch.setattr(runs, "BLOCK", 1000)
    made = runs.grid(big, ["a", "b"]).select("a", "b", F.spark_partition_id().alias("p"))
    assert made.distinct().count() == 150000 and made.select("a", "b").distinct().count() == 150000
    assert made.select("p").distinct().count() > 4


def moved_bytes(df):
    """Bytes that the exchanges of a collected query held."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found += node.metrics().apply("dataSize").value()
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else \
            [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_grid_blocks_do_not_carry_long_lists(spark, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 1000)
    df = spark.range(1).select(F.expr("sequence(id + 1, id + 40001)").alias("a"), F.expr("sequence(1, 9)").alias("b"))
    made = runs.grid(df, ["a", "b"]).agg(F.count(F.lit(1)), F.sum("a"), F.sum("b"), F.count_distinct("a"))
    assert tuple(made.collect()[0]) == (360_009, 9 * 40001 * 40002 // 2, 45 * 40001, 40001)
    # whole, the list of 320 kB would go with each of 361 blocks
    assert 0 < moved_bytes(made) < 20e6


def test_every_share_of_the_documents_has_a_task(spark, rows, tmp_path, monkeypatch):
    keys = [(k, k % 7) for k in range(1, 65)]
    spark.createDataFrame(keys, "s_suppkey bigint, s_nationkey int").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(queries_sources, "scratch_dir", lambda _: str(tmp_path / "scratch"))
    assert rows(queries_sources.xml_files(spark, str(tmp_path))) == sorted(((k, k % 5 + n % 3) for k, n in keys), key=repr)
    files = list((tmp_path / "scratch").rglob("part-*"))
    assert len(files) == 64 and len({re.match(r"part-(\d+)", f.name).group(1) for f in files}) > 4
