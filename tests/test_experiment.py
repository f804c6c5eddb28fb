"""Log files with known drops and latencies, through tables, metrics and series."""

import pytest
from pyspark.sql import functions as F

from meshtally.plans import experiment as X
from meshtally.sources import logs

CUT = [{"filter": {"col": "hops", "min": 1, "max": 5}}]


def layered_log(drop_every):
    """20 packets at 1 hop taking 10 ms, 20 at 2 hops taking 30 ms; every n-th is lost."""
    out = []
    for i in range(40):
        hops, node, at = 1 + i % 2, 2 + i % 2, 1_000_000 + i * 100_000
        out.append(f"{at}: {node}: [STAT: SDN ] OUT NSU s:{node} d:1 id:{i} h:{hops} m:0")
        if i % drop_every:
            out.append(f"{at + (10_000 if hops == 1 else 30_000)}: 1: [STAT: SDN ] IN NSU s:{node} d:1 id:{i} h:{hops} m:0")
    for node, hops, rdc in ((2, 1, "1.-50"), (3, 2, "2.50")):
        out += [f"5: {node}: [STAT: RPL] h:{hops}, n:4", f"9: {node}: [STAT: POW] PW (r {rdc} / 0.25)",
                f"{node * 1_000_000}: {node}: [STAT: RPL] dag:1", f"7: {node}: [STAT: ICMP]  type:155 code:2"]
    return "\n".join(out + ["noise", ""])


@pytest.fixture(scope="module")
def layered(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "run5.log").write_text(layered_log(5))
    (root / "run10.log").write_text(layered_log(10))
    lines = logs.read_logs(spark, str(root)).withColumn("run", F.regexp_extract("file", r"(run\d+)\.log", 1))
    return lines, str(root)


PLOTS = {
    "pdr_v_hops": {"df": "sdn", "packets": ["NSU"], "file": "pdr_v_hops"},
    "latency_v_hops": {"df": "sdn", "packets": ["NSU"]},
    "energy_v_hops": {"df": "pow"},
    "association_v_time": {"df": "join", "packets": ["dag"]},
    "latency": {"df": "sdn", "packets": ["NSU"], "xlabel": "30"},
    "pdr": {"df": "sdn"},
    "traffic_ratio": None,
}


@pytest.mark.parametrize("store", [False, True])
def test_many_runs_in_one_job(spark, layered, rows, store, tmp_path):
    lines, _ = layered
    steps = {"sdn": CUT, "pow": [{"merge": {"df": "node", "left_on": "node", "right_on": "node"}}]}
    # merging tables of many runs needs the run in the keys
    steps["pow"][0]["merge"].update(left_on=["run", "node"], right_on=["run", "node"])
    tables, series = X.analyse(lines, "layered", ["node", "sdn", "pow", "join", "icmp"], PLOTS, steps, by=["run"],
                               store=str(tmp_path / "store") if store else None)
    got = {(r["run"], r["metric"], r["x"]): r for r in series.where("kind <> 'hist'").collect()}

    def y(*key):
        return got[key]["y"]

    # run5 loses 0, 5, ..: four even and four odd packets; run10 loses 0, 10, 20, 30: even ones
    assert (y("run5", "pdr_v_hops", "1"), y("run5", "pdr_v_hops", "2")) == (80.0, 80.0)
    assert (y("run10", "pdr_v_hops", "1"), y("run10", "pdr_v_hops", "2")) == (80.0, 100.0)
    for run in ("run5", "run10"):
        assert (y(run, "latency_v_hops", "1"), y(run, "latency_v_hops", "2")) == (10.0, 30.0)
        assert got[run, "latency_v_hops", "1"]["err"] == pytest.approx(20 / 10 ** 0.5)
        assert (y(run, "energy_v_hops", "1"), y(run, "energy_v_hops", "2")) == (1.5, 2.5)
    assert y("run5", "30_latency", "30") == 20.0
    assert (y("run5", "pdr", "ALL"), y("run10", "pdr", "ALL")) == (80.0, 90.0)
    assert y("run5", "traffic_ratio", "ratio") == 20.0
    curve = series.where("kind = 'hist' and run = 'run5'").orderBy("pos").collect()
    assert [r["x"] for r in curve[:3]] == ["0.0", "0.1", "0.2"] and curve[-1]["y"] == pytest.approx(1.0)
    assert len(curve) == 30


def test_one_run(spark, layered):
    lines, root = layered
    one = logs.read_logs(spark, f"{root}/run10.log")
    _, series = X.analyse(one, "layered", ["node", "sdn"], {"pdr_v_hops": {"df": "sdn", "packets": ["NSU"]}}, {"sdn": CUT}, run="r")
    assert [(r["run"], r["x"], r["y"]) for r in series.orderBy("pos").collect()] == [("r", "1", 80.0), ("r", "2", 100.0)]


def test_flat_profile(spark, tmp_path):
    text = []
    for i in range(10):
        text.append(f"{i * 1000}: 4: [STAT: NET] TX DATA s:4 d:1 id:{i} h:2")
        text.append(f"{i * 1000 + 500}: 1: [STAT: NET] RX DATA s:4 d:1 id:{i} h:2" if i else "x")
    text += ["8: 4: [STAT: POW] PW (r 3.00 / 1.00)", "9: 4: [STAT: POW] PW (r 5.00 / 1.00)"]
    (tmp_path / "a.log").write_text("\n".join(text))
    lines = logs.read_logs(spark, str(tmp_path / "a.log"))
    X.register_profile("my-stack", "flat")
    _, series = X.analyse(lines, "my-stack", ["all", "pow"], {
        "energy_v_hops": {"df": "pow"}, "pdr": {"df": "all", "packets": ["DATA"]},
        "latency": {"df": "all"}}, {"all": CUT}, run="r")
    assert {r["metric"]: (r["x"], r["y"]) for r in series.collect()} == {
        "energy_v_hops": ("2", 4.0), "pdr": ("DATA", 90.0), "latency": ("ALL", 0.5)}


def test_what_is_missing_is_named(spark, layered):
    lines, _ = layered
    tables = X.build_tables(lines, ["sdn"])
    with pytest.raises(LookupError, match="node"):
        X.metric_series("pdr_v_hops", tables, "layered", {"df": "sdn", "packets": ["NSU"]})
    with pytest.raises(KeyError):
        X.metric_series("nothing", tables, "layered")
    with pytest.raises(KeyError):
        X.metric_series("atomic_op_times", tables, "layered")
    with pytest.raises(KeyError):
        X.build_tables(lines, ["testbed"])


def test_own_metric_and_formatter(spark, layered):
    from meshtally.operators.formats import register_formatter

    register_formatter("testbed-strict", lambda rows, by=(): rows)
    X.register_metric("rows", X.Metric(
        lambda df, tables, by, profile: df.agg(F.lit("n").alias("x"), F.count(F.lit(1)).alias("y")), {"layered": ["sdn"]}, "bar", "", ""))
    lines, _ = layered
    series = X.metric_series("rows", X.build_tables(lines, ["sdn"]), "layered", run="r")
    assert series.first()["y"] == 40.0
