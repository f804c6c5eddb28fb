"""Exact top-k search by inner product in an M-tree.

Vectors are whole numbers. One more component, the root of M^2 - |v|^2 with M the greatest length, and 0 for
queries, makes the distance d(q, v)^2 = |q|^2 + M^2 - 2 q.v fall as the inner product rises, and it is a metric.

**Tree.** Routing objects, a bounded sample, stand under the root; each vector goes to the nearest. A routing object's
vectors, in parts of some thousand rows, are loaded into pages around vectors of their own. A page keeps its
covering radius, its distance to its parent, and for each entry, in this order, the distance to the page's centre.
Pages are rows of a table in the shared folder.

**Search.** Best first: the part nearest to a query gives a first k-th best score; then every part whose routing
object's distance less its covering radius allows a score as good is asked. Inside a part a query takes pages by rising
lower bound and stops at the first that is too far. Stored distances spare others: a page by its distance to
its parent, entries by theirs to the centre, both against the query's own distance. All bounds hold, so results
are exact; scores are whole numbers throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.llm.common import arrow_map
from meshtally.llm.vectors import matrix, padded, whole_numbers
from meshtally.session import settle

ROUTES = 256  # routing objects at most
PART, PAGE, ASK = 4096, 128, 4096  # rows of a part, entries of a page, queries that meet a part in one task
LAST = np.iinfo(np.int64).max  # stands for a NULL vec_id, which comes after all others
NONE = np.iinfo(np.int64).min  # no score yet


@dataclass(frozen=True)
class Space:
    """Length of the vectors, the square of the greatest length, how they are stored, and a type for exact products."""

    width: int
    top: int
    stored: str
    exact: type

    def unpack(self, column) -> np.ndarray:
        """Rows from an Arrow column of packed vectors."""
        return np.frombuffer(b"".join(column.to_pylist()), self.stored).reshape(len(column), self.width)

    def away(self, queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Distances of queries to objects of the tree."""
        q, c = queries.astype(self.exact), centres.astype(self.exact)
        own = (queries.astype(np.float64) ** 2).sum(1)
        return np.sqrt(np.maximum(0.0, own[:, None] + float(self.top) - 2.0 * (q @ c.T).astype(np.float64)))

    def between(self, objects: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Distances of objects of the tree to others."""
        a, b = objects.astype(np.float64), centres.astype(np.float64)
        a_more = np.sqrt(np.maximum(0.0, self.top - (a * a).sum(1)))
        b_more = np.sqrt(np.maximum(0.0, self.top - (b * b).sum(1)))
        return np.sqrt(np.maximum(0.0, 2.0 * self.top - 2.0 * (a @ b.T) - 2.0 * np.outer(a_more, b_more)))

    @property
    def slack(self) -> float:
        """More than the error of a distance: added before anything is left out."""
        return 1e-6 * (1.0 + float(self.top) ** 0.5)


@dataclass
class Tree:
    """The routing objects with covering radii, the pages under them, and all vectors (row, vec_id, vector)."""

    space: Space
    routes: np.ndarray
    parts: dict[int, tuple[int, float]]
    pages: DataFrame
    vectors: DataFrame


def read_vectors(df: DataFrame, scale: int) -> tuple[DataFrame, Space] | None:
    """(row, vec_id, vector) as packed whole numbers, written out, and their space; None without rows."""
    kept = whole_numbers(df, scale, F.col("vec_id").cast("bigint").alias("vec_id"))
    dot = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    size, most, top = kept.agg(F.max(F.size("vector")), F.max(F.greatest(
        F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))), F.max(dot)).first()
    if size is None:
        return None
    most, top = int(most or 0), int(top)
    if top >= 2**62:
        raise ValueError("inner products exceed a long")
    space = Space(size, top, "<i2" if most < 2**15 else "<i8",
                  np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64)

    def pack(batch: pa.RecordBatch) -> dict:
        x = matrix(batch.column(1), space.width).astype(space.stored)
        return {"vec_id": batch.column(0), "vector": pa.array([v.tobytes() for v in x], pa.binary())}

    packed = arrow_map(kept.select("vec_id", padded("vector", size).alias("vector")), pack, "vec_id bigint, vector binary")
    return settle(packed.withColumn("row", F.monotonically_increasing_id())), space


def build_tree(df: DataFrame, scale: int) -> Tree | None:
    read = read_vectors(df, scale)
    if read is None:
        return None
    vectors, space = read
    n = vectors.count()
    wanted = min(ROUTES, -(-n // PART))
    drawn = vectors.select(F.xxhash64("row", F.lit(5)).alias("h"), "vector").orderBy("h").limit(wanted).collect()
    routes = space.unpack(pa.array([bytes(r["vector"]) for r in drawn], pa.binary()))

    def nearest(batch: pa.RecordBatch) -> dict:
        away = space.between(space.unpack(batch.column(2)), routes)
        return {"row": batch.column(0), "vec_id": batch.column(1), "vector": batch.column(2),
                "route": pa.array(away.argmin(1).astype(np.int32))}

    placed = settle(arrow_map(vectors.select("row", "vec_id", "vector"), nearest,
                              "row bigint, vec_id bigint, vector binary, route int"))
    sizes = {r["route"]: -(-r["count"] // PART) for r in placed.groupBy("route").count().collect()}  # ROUTES rows at most
    many = F.lit(1)
    for route, parts in sizes.items():
        if parts > 1:
            many = F.when(F.col("route") == route, parts).otherwise(many)
    parted = placed.withColumn("part", F.pmod(F.xxhash64("row", F.lit(11)), many.cast("bigint")).cast("int"))
    schema = ("route int, part int, centre binary, up double, radius double, reach double, "
              "rows binary, ids binary, vectors binary, near binary")

    def load(key: tuple, table: pa.Table) -> pa.Table:
        x = space.unpack(table.column("vector"))
        rows = table.column("row").to_numpy()
        ids = table.column("vec_id").fill_null(LAST).to_numpy()
        route = routes[key[0].as_py()][None, :]
        # the centres: rows of the part, spread by a hash
        mixed = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        centres = np.sort(np.argsort(mixed)[:-(-len(rows) // PAGE)])
        away = space.between(x, x[centres])
        own = away.argmin(1)
        near = away[np.arange(len(x)), own]
        out = []
        for c, centre in enumerate(centres.tolist()):
            mine = np.flatnonzero(own == c)
            mine = mine[np.lexsort((ids[mine], near[mine]))]
            for at in range(0, len(mine), 4 * PAGE):  # a crowded centre has several pages, one outside the other
                some = mine[at:at + 4 * PAGE]
                out.append({
                    "route": key[0].as_py(), "part": key[1].as_py(), "centre": x[centre].tobytes(),
                    "up": float(space.between(x[centre:centre + 1], route)[0, 0]), "radius": float(near[some].max()),
                    "reach": float(space.between(x[some], route).max()), "rows": rows[some].tobytes(),
                    "ids": ids[some].tobytes(), "vectors": x[some].tobytes(), "near": near[some].tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("route", pa.int32()), ("part", pa.int32()), ("centre", pa.binary()), ("up", pa.float64()),
            ("radius", pa.float64()), ("reach", pa.float64()), *[(c, pa.binary()) for c in ("rows", "ids", "vectors", "near")]]))

    pages = settle(parted.groupBy("route", "part").applyInArrow(load, schema))
    reach = {r["route"]: (sizes[r["route"]], r["reach"]) for r in pages.groupBy("route").agg(
        F.max("reach").alias("reach")).collect()}
    return Tree(space, routes, reach, pages, vectors)


class Best:
    """The ``k`` best (score, id) of each query, equal scores by ascending id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray) -> None:
        self.score = np.full((queries, k), NONE)
        self.id = np.full((queries, k), LAST)
        self.floor = floor  # scores below are of no use

    def least(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (len(at), len(ids)) of new entries; NONE where there is none."""
        k = self.score.shape[1]
        every = np.concatenate((self.score[at], score), 1)
        own = np.concatenate((self.id[at], np.broadcast_to(ids, score.shape)), 1)
        order = np.lexsort((own, ~every), axis=1)[:, :k]
        self.score[at] = np.take_along_axis(every, order, 1)
        self.id[at] = np.take_along_axis(own, order, 1)


def search_part(space: Space, route: np.ndarray, pages: list[dict], queries: np.ndarray, rows: np.ndarray,
                floor: np.ndarray, k: int) -> tuple[Best, int]:
    """The queries' best entries among ``pages``, all under ``route``; and how many products that took.

    ``rows`` are the queries' own rows, which do not count; ``floor`` is a score each query already has ``k`` times, or NONE.
    """
    best = Best(len(queries), k, floor)
    q = queries.astype(space.exact)
    own = (queries.astype(np.float64) ** 2).sum(1)
    done = 0

    def reach(at) -> np.ndarray:
        least = best.least()[at]
        far = np.sqrt(np.maximum(0.0, own[at] + float(space.top) - 2.0 * least.astype(np.float64)))
        return np.where(least == NONE, np.inf, far + space.slack)

    to_route = space.away(queries, route[None, :])[:, 0]
    up = np.array([p["up"] for p in pages])
    radius = np.array([p["radius"] for p in pages])
    lower = np.abs(to_route[:, None] - up[None, :]) - radius[None, :]  # from stored distances alone
    to_centre = np.full(lower.shape, np.nan)
    limit = reach(np.arange(len(queries)))
    for p, page in enumerate(pages):
        near = np.flatnonzero(lower[:, p] <= limit)
        if len(near):
            centre = np.frombuffer(page["centre"], space.stored)[None, :]
            to_centre[near, p] = space.away(queries[near], centre)[:, 0]
            lower[near, p] = np.maximum(lower[near, p], to_centre[near, p] - radius[p])
            done += len(near)
    order = np.argsort(lower, axis=1, kind="stable")
    active = np.arange(len(queries))
    for turn in range(len(pages)):
        page_of = order[active, turn]
        going = lower[active, page_of] <= reach(active)
        active, page_of = active[going], page_of[going]  # bounds rise: who stops has finished
        if not len(active):
            break
        for p in np.unique(page_of).tolist():
            at = active[page_of == p]
            page = pages[p]
            near = np.frombuffer(page["near"], np.float64)
            limit = reach(at)
            lo = int(np.searchsorted(near, np.min(to_centre[at, p] - limit) - space.slack, "left"))
            hi = int(np.searchsorted(near, np.max(to_centre[at, p] + limit) + space.slack, "right"))
            if lo >= hi:
                continue
            x = np.frombuffer(page["vectors"], space.stored).reshape(-1, space.width)[lo:hi]
            ids = np.frombuffer(page["ids"], np.int64)[lo:hi]
            mine = np.frombuffer(page["rows"], np.int64)[lo:hi]
            score = (q[at] @ x.astype(space.exact).T).astype(np.int64)
            done += score.size
            score[(mine[None, :] == rows[at][:, None]) | (score < best.least()[at][:, None])] = NONE
            some = np.flatnonzero((score != NONE).any(1))
            if len(some):
                best.add(at[some], score[some], ids)
    return best, done


def _ask(tree: Tree, pairs: DataFrame, k: int) -> DataFrame:
    """(row, query_id, vec_id, score): up to ``k`` entries per pair (row, query_id, vector, floor, route, part)."""
    space, routes = tree.space, tree.routes
    met = pairs.groupBy("route", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "route", "part", F.ceil(F.col("n") / ASK).cast("int").alias("turns"))
    asked = pairs.join(met, ["route", "part"]).withColumn(
        "turn", F.pmod(F.xxhash64("row", F.lit(13)), F.col("turns").cast("bigint")).cast("int")).drop("turns")
    pages = tree.pages.join(met, ["route", "part"]).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns", "reach")

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("row", "query_id", "vec_id", "score")})
        queries, rows = space.unpack(left.column("vector")), left.column("row").to_numpy()
        floor = left.column("floor").fill_null(NONE).to_numpy()
        best, _ = search_part(space, routes[key[0].as_py()], right.to_pylist(), queries, rows, floor, k)
        at, j = np.nonzero(best.score != NONE)
        ids = best.id[at, j]
        return pa.table({"row": pa.array(rows[at]), "query_id": left.column("query_id").combine_chunks().take(pa.array(at)),
                         "vec_id": pa.array(ids, pa.int64(), mask=ids == LAST), "score": pa.array(best.score[at, j])})

    return asked.groupBy("route", "part", "turn").cogroup(pages.groupBy("route", "part", "turn")).applyInArrow(
        solve, "row bigint, query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    at = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", at).where(F.col("rank") <= k)


def search(df: DataFrame, k: int = 20, scale: int = 64, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest inner products of each row whose vec_id ``every`` divides.

    Each other row of ``df`` (vec_id, embedding) is a candidate, equal scores by ascending vec_id, NULL last. Rows
    whose embedding is NULL or holds NULL or non-finite components take no part. Shorter vectors count as filled up
    with zeros. Rows that share a vec_id are rows of their own, as queries and as candidates. Other columns are
    ignored. No rows, or one, give none. Vectors whose squared length reaches 2^62 raise.
    """
    out = "query_id bigint, rank int, vec_id bigint, score bigint"
    tree = build_tree(df, scale)
    if tree is None:
        return df.sparkSession.createDataFrame([], out)
    space, routes = tree.space, tree.routes
    used = sorted(tree.parts)
    parts = np.array([tree.parts[r][0] for r in used])
    radius = np.array([tree.parts[r][1] for r in used])
    queries = tree.vectors.where(F.col("vec_id") % every == 0)

    def home(batch: pa.RecordBatch) -> dict:
        away = space.away(space.unpack(batch.column(2)), routes[used])
        at = away.argmin(1)
        part = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return {"row": batch.column(0), "query_id": batch.column(1), "vector": batch.column(2),
                "floor": pa.nulls(len(at), pa.int64()), "route": pa.array(np.array(used, np.int32)[at]),
                "part": pa.array((part % parts[at].astype(np.uint64)).astype(np.int32))}

    pair = "row bigint, query_id bigint, vector binary, floor bigint, route int, part int"
    first = settle(arrow_map(queries.select("row", "vec_id", "vector"), home, pair))
    begun = settle(_best(_ask(tree, first, k), k).drop("rank"))
    floors = begun.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select(
        "row", F.when(F.col("n") == k, F.col("least")).alias("least"))
    rest = first.join(floors, "row", "left").select("row", "query_id", "vector", "least", "route", "part")

    def others(batch: pa.RecordBatch) -> dict:
        x = space.unpack(batch.column(2))
        least = batch.column(3).fill_null(NONE).to_numpy()
        own = (x.astype(np.float64) ** 2).sum(1)
        limit = np.sqrt(np.maximum(0.0, own + float(space.top) - 2.0 * least.astype(np.float64))) + space.slack
        limit = np.where(least == NONE, np.inf, limit)
        q, r = np.nonzero(space.away(x, routes[used]) - radius[None, :] <= limit[:, None])
        q, r = np.repeat(q, parts[r]), np.repeat(r, parts[r])  # every part of a routing object
        first_of = np.concatenate(([True], (q[1:] != q[:-1]) | (r[1:] != r[:-1]))) if len(q) else np.zeros(0, bool)
        starts = np.flatnonzero(first_of)
        part = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        route = np.array(used, np.int32)[r]
        new = (route != batch.column(4).to_numpy()[q]) | (part != batch.column(5).to_numpy()[q])
        q, route, part = q[new], route[new], part[new].astype(np.int32)
        take = pa.array(q)
        return {"row": batch.column(0).take(take), "query_id": batch.column(1).take(take),
                "vector": batch.column(2).take(take), "floor": batch.column(3).take(take),
                "route": pa.array(route), "part": pa.array(part)}

    more = _ask(tree, settle(arrow_map(rest, others, pair)), k)
    return _best(begun.unionByName(more), k).select("query_id", "rank", "vec_id", "score")
