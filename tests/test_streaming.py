"""A file stream in drops ends with the batch result."""

from pyspark.sql import functions as F

from meshtally.operators.formats import format_sdn
from meshtally.sources.logs import parse
from meshtally.streaming import late_events, stream_events, stream_lines, stream_packets

SECOND = 1_000_000


def line(time, node, state, kind, src, dest, seq, hops):
    return f"{time}: {node}: [STAT: SDN ] {state} {kind} s:{src} d:{dest} a:2 id:{seq} h:{hops} m:0"


def packets(start, n):
    for i in range(n):
        at = start + i * SECOND
        yield line(at, 5, "OUT", "NSU", 5, 1, start // SECOND + i, 2)
        if i % 3:
            yield line(at + 200_000, 1, "IN", "NSU", 5, 1, start // SECOND + i, 2)
        if i % 5 == 0:
            yield line(at + 300_000, 1, "IN", "NSU", 5, 1, start // SECOND + i, 3)


def test_three_drops_are_one_batch(spark, rows, tmp_path, shuffles):
    shuffles(4)
    folder = tmp_path / "logs"
    folder.mkdir()
    events = stream_events(stream_lines(spark, str(folder)), wait="10 seconds")
    query = stream_packets(events, "10 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    every = []
    try:
        drops = [[*packets(0, 30)], [*packets(40 * SECOND, 30), "junk", ""], [*packets(80 * SECOND, 30)]]
        # a packet whose send and receive come in different drops
        drops[0].append(line(41 * SECOND, 9, "OUT", "NSU", 9, 1, 7, 1))
        drops[1].append(line(41 * SECOND + 500_000, 1, "IN", "NSU", 9, 1, 7, 1))
        for i, drop in enumerate(drops):
            every += drop
            (folder / f"{i}.log").write_text("\n".join(drop) + "\n")
            query.processAllAvailable()
        # later than the watermark: counted, not merged
        (folder / "late.log").write_text(line(100_000, 1, "IN", "NSU", 5, 1, 0, 2) + "\n")
        query.processAllAvailable()
        # time goes on, so that the last packets are complete
        (folder / "z.log").write_text(line(1000 * SECOND, 5, "OUT", "NSU", 5, 1, 999_999, 1) + "\n")
        query.processAllAvailable()
        query.processAllAvailable()
        assert late_events(query) == 1
    finally:
        query.stop()
    columns = ["packet", "TX", "RX", "RTX", "FWD", "received", "hops", "lat", "mintime", "maxtime"]
    batch = format_sdn(parse(spark.createDataFrame([(v,) for v in every], "value string"), "sdn"))
    got = spark.read.parquet(str(tmp_path / "out")).where("packet <> 'NSU_5_1_999999'")
    assert rows(got, *columns) == rows(batch, *columns) and got.count() == 91
    assert got.where(F.col("received") == "superfluous").count() > 0
