import random
import re

import pytest
from pyspark.sql import functions as F

from meshtally.sources import logs, patterns

SAMPLES = [
    "61500000: 7: [STAT: SDN ] OUT FTQ s:7 d:1 a:2 id:14 h:3 m:0",
    "61500000: 7: [STAT: SDN ] OUT FTQ s:7 id:14",
    "61500000: 7: [STAT: SDN ] TX NSU s:7 s:8 id:14 h:",
    "61500000: 7: [STAT: SDN ] IN FTS s:7 s:8 id:14 h:",
    "61500000: 7: [STAT: SDN ] TX DATA m:3 t:4 s:5 d:6 id:7 h:12",
    "200: 3: [STAT: RPL] h:2, n:5",
    "900: 3: [STAT: SDN]  n:4 c:1",
    "900: 3: [STAT: RPL] dag:1",
    "1000: 5: [STAT: POW] PW (r 1.23 / 0.-45)",
    "50: 2: [STAT: ICMP]  type:155 code:2",
    "700: 4: INFO: OP ep:12 CLCT h:2 cp: 3 tp: 9 dur: 220 tdur: 900 an:1",
    "700: 4: INFO: PW ep:12 CLCT h:2 np:6 gon:10 ron:20 con:30 (r 4.56 / 1.23)",
    "2019-05-01 10:00:00.123| D: ep:3 TX ab cd ef id:17 s:4",
    "[2019-05-01 10:00:00.123] D: ep:3 RX 0a1b2c3d4e5f6a7b id:17 s:4",
    "garbage line", "", "  12:  3: [STAT: A,b-c ] BUF X h:2 h:3", "12:3: [STAT: RPL] h:2, n:5",
    "5: 1: [STAT: SDN ] OUT \u0001odd\u0001 s:1 d:2 id:3", "\u00025: 1: x",
    "\u0002[1] D: ep:1 TX 0123456789abcdef id:2 s:3", "5: 1: [STAT: SDN ] OUT caf\u00e9 s:\u0663 d:2",
]


def random_lines(n, seed=3):
    r = random.Random(seed)
    tags = ["s", "d", "a", "id", "h", "m", "t", "n", "c", "dag", "dao", "type", "code"]
    out = []
    for _ in range(n):
        head = f"{r.choice(['', ' '])}{r.randint(0, 10**9)}:{r.choice(['', ' ', '  '])} {r.randint(1, 70)}:"
        if r.random() < 0.3:
            body = " INFO: " + r.choice(["OP", "PW"]) + f" ep:{r.randint(0, 99)} " + r.choice(["CONF", "CLCT"])
            extra = [f" h:{r.randint(0, 9)}", f" cp: {r.randint(0, 9)}", f" tp:{r.randint(0, 9)}", f" np:{r.randint(0, 9)}",
                     f" dur: {r.randint(0, 999)}", f" tdur:{r.randint(0, 999)}", f" an:{r.randint(0, 1)}",
                     f" gon:{r.randint(0, 9)}", f" con:{r.randint(0, 9)} (r {r.randint(0, 9)}.{r.randint(0, 99)} / 3.-4)"]
        else:
            body = f" [STAT: {r.choice(['SDN', 'RPL ', 'A-b,c'])} ] " + r.choice(
                ["OUT FTQ", "IN FTS", "BUF NSU", "TX DATA", "RX X", "", "PW (r 1.-20 / 3.4)", "h:2, n:4"])
            extra = [f"{r.choice([' ', '  ', ' x'])}{t}:{r.choice(['', str(r.randint(0, 12))])}" for t in tags]
        r.shuffle(extra)
        out.append(head + body + "".join(extra[: r.randint(0, 6)]) + r.choice(["", " tail", "\x00", "\r"]))
    return out


def expected(pattern, line):
    text = line.replace(".-", ".") if pattern.repair else line
    m = re.compile(pattern.regex).match(text)
    return None if m is None else {k: v or None for k, v in m.groupdict("").items()}


@pytest.mark.parametrize("name", patterns.pattern_names())
def test_same_fields_as_python(spark, name):
    lines = SAMPLES + random_lines(600)
    p = patterns.get_pattern(name)
    as_text = patterns.Pattern(name, p.regex, {g: "string" for g in p.groups}, p.needs, p.repair)
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    got = {r["n"]: r.asDict() for r in logs.parse(df, as_text).collect()}
    for n, line in enumerate(lines):
        want = expected(p, line)
        have = got.get(n)
        assert (have is None) == (want is None), (name, line)
        if want:
            assert {k: have[k] for k in want} == want, (name, line)


def test_types_and_missing_fields(spark):
    df = spark.createDataFrame([(SAMPLES[1],)], "value string")
    row = logs.parse(df, "sdn").first()
    assert (row["time"], row["node"], row["src"], row["seq"], row["dest"], row["hops"]) == (61500000, 7, 7, 14, None, None)
    power = logs.parse(spark.createDataFrame([(SAMPLES[8],)], "value string"), "pow").first()
    assert (power["all_rdc"], power["rdc"]) == (1.23, 0.45)


def test_overlong_number_is_null(spark):
    df = spark.createDataFrame([("1: 99999999999: [STAT: RPL] h:1, n:2",)], "value string")
    assert logs.parse(df, "node").first()["node"] is None


def test_hop_class_takes_one_digit(spark):
    df = spark.createDataFrame([(SAMPLES[4],)], "value string")
    assert logs.parse(df, "all").first()["hops"] == 1


def test_route_agrees_with_parse(spark, rows, tmp_path):
    names = ["atomic-op", "atomic-energy", "sdn", "node", "icmp", "pow", "join", "testbed"]
    lines = SAMPLES + random_lines(300, 5)
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    stored = logs.scrape_once(df, names, str(tmp_path / "t"))
    for name in names:
        want = logs.parse(df, name)
        assert stored[name].columns == want.columns
        assert rows(stored[name]) == rows(want), name
    both = {r["n"] for r in stored["atomic-op"].collect()} & {r["n"] for r in stored["atomic-energy"].collect()}
    assert SAMPLES.index(SAMPLES[10]) in both


def test_regex_is_evaluated_once(spark):
    df = spark.createDataFrame([("x",)], "value string")
    plan = logs.parse(df, "sdn").select("hops", "src")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_files_and_lookup(spark, tmp_path, rows):
    for name, text in {"testbed1.txt": "[2019-05-01 10:00:00.5] D: ep:3\x00 RX 0a1b2c3d4e5f6a7b id:17 s:4\nnoise\n",
                       "sub/ttx.txt": "[2019-05-01 10:00:01] D: ep:3 TX 0a1b2c3d4e5f6a7b id:17 s:4\n",
                       "other.txt": "[2019-05-01 10:00:02] D: ep:3 TX 0a1b2c3d4e5f6a7b id:17\n"}.items():
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "ids.csv").write_text("name,id\ntestbed1,11\nttx,12\n")
    before = {p: p.read_bytes() for p in (tmp_path / "logs").rglob("*.txt")}
    lines = logs.read_logs(spark, str(tmp_path / "logs"), recursive=True)
    got = logs.parse_testbed(lines, logs.read_lookup(spark, str(tmp_path / "ids.csv")))
    assert rows(got, "node", "type", "packet", "id", "src", "epoch") == [
        (11, "RX", "0a1b2c3d4e5f6a7b", 17, 4, 3), (12, "TX", "0a1b2c3d4e5f6a7b", 17, 4, 3)]
    assert {p: p.read_bytes() for p in before} == before


def test_tags_after_a_short_packet_name(spark):
    df = spark.createDataFrame([(SAMPLES[12],)], "value string")
    loose, strict = logs.parse(df, "testbed").first(), logs.parse(df, "testbed-strict").first()
    assert loose["epoch"] == 4
    assert (strict["epoch"], strict["packet"], strict["id"], strict["src"]) == (3, "ab cd ef", 17, 4)


def test_registering(spark):
    patterns.register_pattern("beat", r"\s+beat=(?P<beat>\d+)", {"beat": "bigint"})
    df = spark.createDataFrame([("1: 2: beat=7",)], "value string")
    assert logs.parse(df, "beat").first().asDict() == {"time": 1, "node": 2, "beat": 7}
    with pytest.raises(KeyError):
        patterns.get_pattern("bea")
    with pytest.raises(ValueError):
        patterns.register_pattern("none", "x", prefix="")


def test_no_blank_prefix(spark):
    p = patterns.register_pattern("near", patterns.PATTERNS_TEXT["node"], prefix=patterns.PREFIX_NO_BLANK)
    df = spark.createDataFrame([("12:3: [STAT: RPL] h:2, n:5",)], "value string")
    assert logs.parse(df, p).first()["node"] == 3
    assert logs.parse(df, "node").count() == 0


def test_streaming_text_is_accepted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(SAMPLES[0] + "\n")
    stream = logs.parse(spark.readStream.text(str(tmp_path / "in")), "sdn")
    assert stream.isStreaming and "hops" in stream.columns


def test_any_number_of_fields_on_one_line(spark):
    for name, line, column in (("sdn", SAMPLES[1] + " id:9" * 200_000, "seq"),
                               ("atomic-op", SAMPLES[10] + " h:9" * 200_000, "hops"),
                               ("testbed", SAMPLES[13] + " id:9" * 200_000, "id")):
        df = spark.createDataFrame([(line,)], "value string")
        assert logs.parse(df, name).first()[column] == 9
