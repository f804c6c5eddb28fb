"""Near-duplicate embeddings by NN-descent.

Every vector keeps a list of its nearest known neighbours. Lists begin with
vectors that lie side by side in orders of random signatures, and are refined by
comparing, around each vector, its neighbours and those that have it as theirs with
one another, until few lists change. Lists whose last entry still is a link are
saturated and get longer; beyond ``most`` entries an exact search in blocks
counts the links of those vectors, on both ends. Links found are checked in double precision, and
the recall is audited by brute force for a sample of vectors; while it falls short, all
lists get longer and are refined again, and where that does not help the exact search takes all vectors.

Equal vectors of a label are one class, with its number of rows as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.llm.common import arrow_map, bounded
from meshtally.llm.components import Links, components
from meshtally.session import settle

# Half-precision components are off by 2^-11 of their size, so unit vectors by 2^-11 and products by less than 2^-10,
# however the sizes of the components differ; the rest is for sums in single precision over long vectors.
SLACK = 0.002
LONGEST = 384  # entries of a list, beyond which refining gives way to the exact search
BLOCK = 4096


def _units(vectors: list[bytes], kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1)


def _rough(vectors: list[bytes]) -> np.ndarray:
    """Rows, float32, from unit vectors of one length in half precision."""
    return np.frombuffer(b"".join(vectors), np.float16).reshape(len(vectors), -1).astype(np.float32)


def classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows with vec_id and the key of their class; classes with id, key, unit vector and weight.

    Rows that can link with nothing (NULL label or vector, a zero vector, NULL or
    non-finite components) have no class.
    """
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("label").isNotNull() & ~bad & F.exists(x, lambda v: v != 0)
    rows = df.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), F.struct(
        "label", F.size("embedding").alias("dims"), "embedding")).alias("key"))
    found = rows.where("key is not null").groupBy("key").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"))

    def of(batch: pa.RecordBatch) -> dict:
        exact, rough = [], []
        for v in batch.column(0).to_pylist():
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()  # so that no square under- or overflows
            x = x / np.sqrt(x @ x)
            exact.append(x.tobytes())
            rough.append(x.astype(np.float16).tobytes())
        return {"embedding": batch.column(0), "label": batch.column(1), "dims": batch.column(2),
                "weight": batch.column(3), "first": batch.column(4),
                "unit": pa.array(exact, pa.binary()), "rough": pa.array(rough, pa.binary())}

    kinds = dict(df.dtypes)
    cut = arrow_map(
        found.select("key.embedding", "key.label", "key.dims", "weight", "first"), of,
        f"embedding {kinds['embedding']}, label {kinds['label']}, dims int, weight bigint, "
        f"first {kinds['vec_id']}, unit binary, rough binary")
    return rows, settle(cut.withColumn("id", F.monotonically_increasing_id()))


def first_pairs(nodes: DataFrame, orders: int, window: int, seed: int = 3) -> DataFrame:
    """(a, b, sim): vectors close to each other in one of several orders by random signatures."""
    bits = 24

    def sign(batch: pa.RecordBatch) -> dict:
        ids, rough, dims = (batch.column(i).to_pylist() for i in (0, 3, 2))
        code = np.zeros((len(ids), orders), np.int64)
        for d in set(dims):
            at = [i for i, own in enumerate(dims) if own == d]
            planes = np.random.default_rng([seed, d]).standard_normal((orders, d, bits)).astype(np.float32)
            x = _rough([rough[i] for i in at])
            for t in range(orders):
                code[at, t] = ((x @ planes[t]) > 0) @ (1 << np.arange(bits, dtype=np.int64))
        take = pa.array(np.repeat(np.arange(len(ids)), orders))
        return {"turn": pa.array(np.tile(np.arange(orders), len(ids)), pa.int32()), "label": batch.column(1).take(take),
                "dims": batch.column(2).take(take), "code": pa.array(code.ravel()), "id": batch.column(0).take(take),
                "rough": batch.column(3).take(take)}

    kind = dict(nodes.dtypes)["label"]
    signed = settle(arrow_map(nodes.select("id", "label", "dims", "rough"), sign,
                              f"turn int, label {kind}, dims int, code bigint, id bigint, rough binary"))
    order = ["turn", "label", "dims", "code", "id"]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            rows = held + list(zip(*cols))
            a, b, sim = [], [], []
            starts = [0, *(i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3]), len(rows)]
            for s, e in zip(starts, starts[1:]):
                if e - s < 2:
                    continue
                x = _rough([r[5] for r in rows[s:e]])
                ids = np.array([r[4] for r in rows[s:e]])
                for gap in range(1, min(window, e - s - 1) + 1):
                    late = np.arange(gap, e - s) + s >= len(held)  # those before were compared already
                    a.append(ids[:-gap][late])
                    b.append(ids[gap:][late])
                    sim.append((x[:-gap] * x[gap:]).sum(1)[late])
            held = rows[-window:]
            if a:
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64()),
                    "sim": pa.array(np.concatenate(sim), pa.float32())})

    sorted_rows = signed.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(slide, "a bigint, b bigint, sim float")


def keep_nearest(lists: DataFrame, link: float, most: int) -> DataFrame:
    """The lists (src, dst, sim, k, new) cut to each src's k nearest; saturated ones get room for twice as many.

    Adds bound: the similarity a new entry must exceed, -1 where there is room.
    """
    one = lists.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.max("k").alias("k"), F.min("new").alias("new"))
    own = W.partitionBy("src")
    ranked = one.withColumn("k", F.max("k").over(own)).withColumn(
        "at", F.row_number().over(own.orderBy(F.desc("sim"), "dst"))).where("at <= k")
    full = F.count(F.lit(1)).over(own) >= F.col("k")
    least = F.min("sim").over(own)
    more = full & (least >= link - SLACK) & (F.col("k") < most)
    return ranked.select(
        "src", "dst", "sim", "new", F.when(more, F.least(F.col("k") * 2, F.lit(most))).otherwise(F.col("k")).alias("k"),
        F.when(full & ~more, least).otherwise(F.lit(-1.0)).cast("float").alias("bound"))


def around(lists: DataFrame, nodes: DataFrame, block: int = 64) -> DataFrame:
    """(a, b, sim): pairs of neighbours of one vector that would enter a list of either.

    Around each vector stand its list and those that list it. The latter may be very
    many; they stand in blocks of about ``block``, the list in each of them.
    """
    degree = lists.groupBy("dst").count().select(
        F.col("dst").alias("mid"), F.ceil(F.col("count") / block).cast("int").alias("parts"))
    forward = lists.select(F.col("src").alias("mid"), F.col("dst").alias("u"), "new").join(degree, "mid", "left").select(
        "mid", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "u", "new")
    reverse = lists.select(F.col("dst").alias("mid"), F.col("src").alias("u"), "new").join(degree, "mid").select(
        "mid", F.pmod(F.xxhash64("u", "mid"), F.col("parts")).cast("int").alias("part"), "u", "new")
    bounds = lists.groupBy("src").agg(F.min("bound").alias("bound"))
    known = nodes.select("id", "rough").join(bounds, F.col("id") == F.col("src"), "left").select(
        "id", "rough", F.coalesce("bound", F.lit(-1.0)).cast("float").alias("bound"))
    both = forward.unionByName(reverse).groupBy("mid", "part", "u").agg(F.max("new").alias("new"))
    standing = both.join(known, F.col("u") == F.col("id")).select("mid", "part", "u", "new", "bound", "rough")
    standing = standing.repartition("mid", "part").sortWithinPartitions("mid", "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def solve(table: pa.Table) -> pa.RecordBatch:
            mid, part, u, new, bound = (table.column(i).to_numpy() for i in range(5))
            rough = table.column(5).to_pylist()
            cuts = np.flatnonzero((mid[1:] != mid[:-1]) | (part[1:] != part[:-1])) + 1
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mid)]):
                if e - s < 2 or not new[s:e].any():
                    continue
                x = _rough(rough[s:e])
                sim = x @ x.T
                wanted = (sim > np.minimum(bound[s:e, None], bound[None, s:e])) & (new[s:e, None] | new[None, s:e])
                i, j = np.nonzero(np.triu(wanted, 1))
                out.append((u[s:e][i], u[s:e][j], sim[i, j]))
            return pa.RecordBatch.from_pydict({
                "a": pa.array(np.concatenate([o[0] for o in out]) if out else [], pa.int64()),
                "b": pa.array(np.concatenate([o[1] for o in out]) if out else [], pa.int64()),
                "sim": pa.array(np.concatenate([o[2] for o in out]) if out else [], pa.float32())})

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            mid, part = table.column(0).to_numpy(), table.column(1).to_numpy()
            last = np.flatnonzero((mid != mid[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = table.slice(cut)  # the last group may go on
            if cut:
                yield solve(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield solve(rest)

    return standing.mapInArrow(compare, "a bigint, b bigint, sim float")


def _both_ways(pairs: DataFrame, k: int, new: bool) -> DataFrame:
    one = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim")
    two = pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "sim")
    return one.unionByName(two).where("src <> dst").select(
        "src", "dst", "sim", F.lit(k).alias("k"), F.lit(new).alias("new"))


def descend(lists: DataFrame, nodes: DataFrame, link: float, most: int, rounds: int, still: float) -> DataFrame:
    """Refine until at most a share of ``still`` of the entries is new, or for ``rounds`` rounds."""
    for _ in range(rounds):
        found = around(lists, nodes)
        old = lists.select("src", "dst", "sim", "k", F.lit(False).alias("new"))
        lists = settle(keep_nearest(old.unionByName(_both_ways(found, 0, True)), link, most))
        entries, new = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("new").cast("long")), F.lit(0))).first()
        if new <= still * max(1, entries):
            break
    return lists


def checked(lists: DataFrame, nodes: DataFrame, link: float) -> DataFrame:
    """(a, b), a < b: list entries whose cosine is ``link`` or more in double precision."""
    pairs = lists.where(F.col("sim") >= link - SLACK).select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    side = nodes.select("id", "unit")
    pairs = pairs.join(side.withColumnsRenamed({"id": "a", "unit": "x"}), "a").join(
        side.withColumnsRenamed({"id": "b", "unit": "y"}), "b").select("a", "b", "x", "y")

    def of(batch: pa.RecordBatch) -> dict:
        cos = np.array([np.frombuffer(x) @ np.frombuffer(y) for x, y in zip(
            batch.column(2).to_pylist(), batch.column(3).to_pylist())])
        good = pa.array(cos >= link)
        return {"a": batch.column(0).filter(good), "b": batch.column(1).filter(good)}

    return arrow_map(pairs, of, "a bigint, b bigint")


def exact_links(asked: DataFrame, nodes: DataFrame, link: float) -> DataFrame:
    """(a, b, n): in blocks of all vectors of its label, the links of each vector ``asked`` (id).

    Rows with b NULL give in n the weight of a's links in one block: for a vector that asked, all of them; for one that
    did not, those to vectors that did. Rows with n NULL are links that connect what all of them would.
    """
    members = nodes.select("label", "dims", "id", "unit", "weight").join(
        asked.select("id", F.lit(True).alias("asks")), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    sizes = members.groupBy("label", "dims").count()
    queries = members.where("asks").join(sizes, ["label", "dims"]).select(
        "label", "dims", "id", "unit", "weight",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / BLOCK).cast("int"))).alias("i"))
    many = queries.groupBy("label", "dims", "i").count().select(
        "label", "dims", "i", F.ceil(F.col("count") / BLOCK).cast("int").alias("q"))
    spread = F.shiftrightunsigned(F.xxhash64("id"), 1)
    queries = queries.join(many, ["label", "dims", "i"]).withColumn("j", (spread % F.col("q")).cast("int")).drop("q")
    targets = members.join(sizes, ["label", "dims"]).withColumn(
        "i", (spread % F.ceil(F.col("count") / BLOCK)).cast("int")).join(many, ["label", "dims", "i"]).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).drop("count", "q")
    units = queries.withColumns({"asks": F.lit(True), "query": F.lit(True)}).unionByName(
        targets.withColumn("query", F.lit(False)))

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        query, asks = (table.column(c).to_numpy() for c in ("query", "asks"))
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        order = np.concatenate((np.flatnonzero(query), np.flatnonzero(~query)))
        n = int(query.sum())
        x = _units(table.column("unit").to_pylist())[order]
        ids, weight, silent = ids[order], weight[order], ~asks[order][n:]
        # a vector that asks and is in the block is one item
        same = {v: i for i, v in enumerate(ids[:n].tolist())}
        item = np.array([same.get(v, i + n) for i, v in enumerate(ids[n:].tolist())], np.int64)
        links = Links(len(ids))
        total, back = np.zeros(n, np.int64), np.zeros(len(ids) - n, np.int64)
        for at in range(0, n, 256):
            to = min(n, at + 256)
            hit = x[at:to] @ x[n:].T >= link
            hit &= ids[at:to, None] != ids[None, n:]
            total[at:to] = np.rint(hit.astype(np.float64) @ weight[n:].astype(np.float64))
            back += np.rint(weight[at:to].astype(np.float64) @ hit.astype(np.float64)).astype(np.int64)
            q, t = np.nonzero(hit)
            links.add(q + at, item[t])
        pairs = ids[links.pairs()]
        reached = np.flatnonzero(silent & (back > 0))
        counted = np.concatenate((ids[:n], ids[n:][reached]))
        return pa.table({
            "a": pa.array(np.concatenate((counted, pairs[:, 0]))),
            "b": pa.array([None] * len(counted) + pairs[:, 1].tolist(), pa.int64()),
            "n": pa.array(total.tolist() + back[reached].tolist() + [None] * len(pairs), pa.int64())})

    return units.groupBy("label", "dims", "i", "j").applyInArrow(solve, "a bigint, b bigint, n bigint")


def audit(nodes: DataFrame, links: DataFrame, apart: DataFrame, link: float, sample: int) -> float:
    """Recall: the share of true links, by brute force for ``sample`` vectors, that ``links`` has.

    Vectors in ``apart`` (id) are not asked: their links come from the exact search.
    """
    drawn = settle(bounded(nodes.join(apart, "id", "left_anti").select("id", "label", "dims", "unit"), "id", sample))
    asked: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for r in drawn.collect():
        asked.setdefault((r["label"], r["dims"]), []).append((r["id"], bytes(r["unit"])))
    asked = {k: (np.array([i for i, _ in v]), _units([u for _, u in v])) for k, v in asked.items()}

    def of(batch: pa.RecordBatch) -> dict:
        ids, labels, dims, unit = (batch.column(i).to_pylist() for i in range(4))
        a, b = [], []
        for key in set(zip(labels, dims)) & asked.keys():
            at = [i for i, own in enumerate(zip(labels, dims)) if own == key]
            who, x = asked[key]
            mine = np.array([ids[i] for i in at])
            q, t = np.nonzero(x @ _units([unit[i] for i in at]).T >= link)
            a.extend(who[q].tolist())
            b.extend(mine[t].tolist())
        return {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}

    true = settle(arrow_map(nodes.select("id", "label", "dims", "unit"), of, "a bigint, b bigint").where("a <> b"))
    ends = true.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).alias("one"))
    have = ends.join(links.select("a", "b"), ["a", "b"], "left_semi").count()
    want = ends.count()
    return have / want if want else 1.0


@dataclass
class Found:
    """One row per vector, and the audited recall of the links (1 where all come from the exact search)."""

    rows: DataFrame
    recall: float


def near_vectors(df: DataFrame, link: float = 0.98, k: int = 12, most: int = 48, orders: int = 4, rounds: int = 8,
                 still: float = 0.002, sample: int = 256, recall: float = 0.995) -> Found:
    """(vec_id, n_links, component_id, kept, recall) for every row of ``df`` (vec_id, embedding, label; others are ignored).

    Rows of equal label and length whose cosine is ``link`` or more are linked. n_links: other rows linked directly;
    component_id: smallest vec_id reachable; kept: whether it is the row's own; recall: the share of links that the audit
    found, the same in all rows. Rows that can link with
    nothing (see ``classes``) are their own components. A NULL vec_id counts as a link but is no component's id, unless
    there is no other. Repeated rows are linked rows. No rows give none.
    """
    rows, nodes = classes(df)
    lists = settle(keep_nearest(_both_ways(first_pairs(nodes, orders, k // 2), k, True), link, most))
    while True:
        lists = descend(lists, nodes, link, most, rounds, still)
        stuck = settle(lists.groupBy(F.col("src").alias("id")).agg(
            F.count(F.lit(1)).alias("n"), F.min("sim").alias("least"), F.max("k").alias("k")).where(
            (F.col("n") >= F.col("k")) & (F.col("least") >= link - SLACK)).select("id"))
        links = settle(checked(lists, nodes, link))
        got = audit(nodes, links, stuck, link, sample)
        if got >= recall:
            break
        if most >= LONGEST:  # longer lists did not find them either
            stuck, got = nodes.select("id"), 1.0
            break
        most *= 2
        lists = settle(keep_nearest(lists.select("src", "dst", "sim", (F.col("k") * 2).alias("k"), F.lit(True).alias("new")),
                                    link, most))
    exact = settle(exact_links(stuck, nodes, link))
    weight = nodes.select("id", "weight")
    # links with an end that asked are all counted by the exact search
    listed = links.join(stuck.withColumnRenamed("id", "a"), "a", "left_anti").join(
        stuck.withColumnRenamed("id", "b"), "b", "left_anti")
    ends = listed.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(
        listed.select(F.col("b").alias("id"), F.col("a").alias("o")))
    counted = ends.join(weight.withColumnsRenamed({"id": "o", "weight": "n"}), "o").select("id", "n").unionByName(
        exact.where("b is null").select(F.col("a").alias("id"), "n")).groupBy("id").agg(F.sum("n").alias("n"))
    linked = components(links.unionByName(exact.where("b is not null").select("a", "b")))
    members = nodes.select("id", "label", "dims", "embedding", "weight", "first").join(
        linked.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = settle(members.groupBy("root").agg(F.min("first").alias("component_id")))
    known = settle(members.join(least, "root").join(counted, "id", "left").select(
        F.struct("label", "dims", "embedding").alias("key"), "component_id",
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    placed = rows.where("key is not null").join(known, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    out = placed.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return Found(out.withColumn("recall", F.lit(float(got))), got)
