"""Exact top-k inner-product search with a paged M-tree.

Rows are split by the size of their largest component (a class spans a factor of 16), so that one
outsize vector spoils no one else's bounds. Within a class one more component brings all rows to
the same length; nearest in that metric space is then the same as largest inner product. Routing
nodes come from a bounded sample; every row is indexed. A node keeps its covering radius, and
its rows are cut into pages, each with a centre, a covering radius, its centre's distance
from the node (its parent), and each entry's distance from the centre.

A query first searches the node nearest to it, which gives it a threshold; then it is sent only
to nodes that may hold better rows, and visits their pages best first, where the stored
distances and the triangle inequality skip pages and entries. What is left is scored exactly.

Bound: ``sample`` rows of a class (by hash) give its routing nodes and each query's first threshold;
a double has at most some 500 classes, real tables one or two.

Defined results: a null vector, or one with null or non-finite components, takes no part;
shorter vectors count as padded with zeros, an empty one as all zeros; equal rows count once,
and a query meets no row with its own vec_id; null vec_id takes no part; extra columns play no
part; an empty table gives no rows. Scores are exact at any size of components and ranked as
such; a score beyond a long is returned as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep

PAGE = 256
#: Pages of one search group, and queries of one block: what a task holds.
GROUP_PAGES = 64
BLOCK = 512
#: Beyond this size a double times the scale is whole anyway.
WHOLE = float(2**44)
PAGES = "node int, page long, radius double, parent_distance double, centre binary, ids binary, rows binary, distances binary"
FOUND = "query_id long, vec_id long, score long, exact binary"


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): each component as floor(scale * x) / scale, which a double holds exactly.
    ``scale`` is a power of two."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    rows = table.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(fine).select("vec_id", F.transform("x", lambda e: F.when(F.abs(e) < WHOLE, F.floor(e * scale).cast("double") / scale).otherwise(e)).alias("v"))


def size_class(v: Column) -> Column:
    """4 bits of binary exponent a class, by the largest component."""
    largest = F.coalesce(F.array_max(F.transform(v, lambda e: F.abs(e))), F.lit(0.0))
    return F.when(largest > 0, F.floor(F.log2(largest) / 4)).otherwise(-3).cast("int")


def _exponent(size: int) -> int:
    """All components of a class are at most two to this power."""
    return 4 * size + 5


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of a matrix, padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), dim))
    out[row, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def exact_scores(rows: np.ndarray, q: np.ndarray, scale: int) -> list[int]:
    """Inner products of integer vectors, given as multiples of 1 / ``scale``."""
    if not len(rows):
        return []
    bound = float(np.abs(rows).max(initial=0)) * scale * float(np.abs(q).max(initial=0)) * scale * max(1, len(q))
    if bound < 2**53:  # every partial sum is a whole number that a double holds
        return ((rows * scale) @ (q * scale)).astype(np.int64).tolist()
    if bound < 2**62:
        return ((rows * scale).astype(np.int64) @ (q * scale).astype(np.int64)).tolist()
    whole = lambda e: int(e) * scale if abs(e) >= WHOLE else int(e * scale)
    other = [whole(e) for e in q.tolist()]
    return [sum(whole(a) * b for a, b in zip(r, other, strict=True)) for r in rows.tolist()]


def best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k highest of (score, id), ties to smaller ids."""
    return sorted(found, key=lambda r: (-r[0], r[1]))[:k]


def _signed(value: int) -> bytes:
    return value.to_bytes(value.bit_length() // 8 + 1, "big", signed=True)


def sort_key(score: int) -> bytes:
    """Bytes that order as whole numbers of any size do."""
    body = _signed(score)
    return (b"\x01" + len(body).to_bytes(4, "big") if score >= 0 else b"\x00" + (2**32 - 1 - len(body)).to_bytes(4, "big")) + body


class Tree:
    """The routing nodes of all classes: pivots in their class's metric space, and what is known of the sample."""

    def __init__(self, dim: int, scale: int, tops: dict[int, float], main: int, sample: dict[int, tuple[list[int], np.ndarray]], nodes: int):
        self.dim, self.scale, self.tops, self.main = dim, scale, tops, main
        pivots, classes = [], []
        for size, (_, rows) in sorted(sample.items()):
            own = _pivots(self.lift(rows, size), nodes)
            pivots.append(own)
            classes += [size] * len(own)
        self.pivots, self.classes = np.concatenate(pivots), np.array(classes)
        _, first = np.unique(np.concatenate([ids for ids, _ in sample.values()]), return_index=True)
        self.known_ids = np.concatenate([np.array(ids, np.int64) for ids, _ in sample.values()])[first]
        self.known = np.concatenate([rows for _, rows in sample.values()])[first]

    def lift(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Rows of a class, scaled to at most one, and the component that makes all norms equal."""
        unit = np.ldexp(rows, -_exponent(size))
        return np.c_[unit, np.sqrt(np.maximum(self.tops[size] - (unit * unit).sum(1), 0))]

    def point(self, q: np.ndarray) -> tuple[np.ndarray, int]:
        """A query scaled to at most one, and the exponent it was scaled by."""
        exponent = math.frexp(float(np.abs(q).max(initial=0)))[1]
        return np.r_[np.ldexp(q, -exponent), 0.0], exponent

    def reach(self, point: np.ndarray, exponent: int, floor: int | None, size: int) -> float:
        """How far a row of a class that scores ``floor`` or more can be from a query."""
        if floor is None:
            return math.inf
        cut = max(0, abs(floor).bit_length() - 62)
        power = cut - exponent - _exponent(size) - 2 * self.scale.bit_length() + 2
        score = math.ldexp(floor >> cut, power) if power < 900 else math.inf * (1 if floor > 0 else -1)
        return math.sqrt(max(float(point @ point) + self.tops[size] - 2 * score, 0)) * (1 + 1e-9) + 2e-6

    def floor(self, query_id: int, q: np.ndarray, k: int) -> int | None:
        """A score that k rows of the sample reach."""
        scores = exact_scores(self.known[self.known_ids != query_id], q, self.scale)
        return sorted(scores)[-k] if len(scores) >= k else None


def _assign(tree: Tree):
    """Each row with the nearest node of its class and its distance from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes = _matrix(batch["v"], tree.dim), batch["size"].to_numpy()
            node, distance = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for s in np.unique(sizes).tolist():
                own, at = np.flatnonzero(sizes == s), np.flatnonzero(tree.classes == s)
                lifted, pivots = tree.lift(rows[own], s), tree.pivots[at]
                squares = (lifted**2).sum(1)[:, None] - 2 * lifted @ pivots.T + (pivots**2).sum(1)
                near = squares.argmin(1)
                node[own], distance[own] = at[near], np.sqrt(((lifted - pivots[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(node), pa.array(distance)], names=["vec_id", "v", "node", "distance"])

    return run


def _pages(tree: Tree):
    """Rows sorted by node and distance become pages; a page never mixes nodes."""

    def page(node: int, ids: np.ndarray, rows: np.ndarray, number: int) -> dict:
        lifted = tree.lift(rows, int(tree.classes[node]))
        centre = lifted[int(((lifted - lifted.mean(0)) ** 2).sum(1).argmin())]
        distances = np.sqrt(((lifted - centre) ** 2).sum(1))
        return {
            "node": node, "page": number, "radius": float(distances.max()),
            "parent_distance": float(np.sqrt(((centre - tree.pivots[node]) ** 2).sum())),
            "centre": centre.tobytes(), "ids": ids.tobytes(), "rows": rows.tobytes(), "distances": distances.tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        node, ids, rows = -1, np.zeros(0, np.int64), np.zeros((0, tree.dim))
        for batch in batches:
            out, nodes = [], batch["node"].to_numpy()
            new_ids, new_rows = batch["vec_id"].to_numpy(), _matrix(batch["v"], tree.dim)
            cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1), len(nodes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if nodes[a] != node:
                    if len(ids):
                        out.append(page(node, ids, rows, number))
                        number += 1
                    node, ids, rows = int(nodes[a]), new_ids[a:b], new_rows[a:b]
                else:
                    ids, rows = np.r_[ids, new_ids[a:b]], np.r_[rows, new_rows[a:b]]
                while len(ids) >= PAGE:
                    out.append(page(node, ids[:PAGE], rows[:PAGE], number))
                    number, ids, rows = number + 1, ids[PAGE:], rows[PAGE:]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=PAGE_SCHEMA)
        if len(ids):
            yield pa.RecordBatch.from_pylist([page(node, ids, rows, number)], schema=PAGE_SCHEMA)

    return run


PAGE_SCHEMA = pa.schema([("node", pa.int32()), ("page", pa.int64()), ("radius", pa.float64()), ("parent_distance", pa.float64()), ("centre", pa.binary()), ("ids", pa.binary()), ("rows", pa.binary()), ("distances", pa.binary())])
FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("exact", pa.binary())])


class Search:
    """Pages of one node, searched best first."""

    def __init__(self, pages: list[dict], tree: Tree):
        self.tree, self.scored, self.node = tree, 0, pages[0]["node"]
        self.size = int(tree.classes[self.node])
        self.radius = np.array([p["radius"] for p in pages])
        self.parent = np.array([p["parent_distance"] for p in pages])
        self.centre = np.array([np.frombuffer(p["centre"]) for p in pages])
        self.ids = [np.frombuffer(p["ids"], np.int64) for p in pages]
        self.rows = [np.frombuffer(p["rows"]).reshape(-1, tree.dim) for p in pages]
        self.distances = [np.frombuffer(p["distances"]) for p in pages]

    def top_k(self, query_id: int, q: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(score, id) of the best k, those below ``floor`` left out. ``floor`` is a score that k
        other rows are known to reach."""
        point, exponent = self.tree.point(q)
        limit = self.tree.reach(point, exponent, floor, self.size)
        # how near a page can come, from the stored distance of its centre to its node alone
        nearest = np.abs(np.sqrt(((self.tree.pivots[self.node] - point) ** 2).sum()) - self.parent) - self.radius
        open_ = np.flatnonzero(nearest <= limit)
        to_centre = np.sqrt(((self.centre[open_] - point) ** 2).sum(1))
        nearest = np.maximum(nearest[open_], to_centre - self.radius[open_])
        found: list[tuple[int, int]] = []
        for i in np.argsort(nearest):
            if nearest[i] > limit:
                break
            p = open_[i]
            near = np.flatnonzero(np.abs(to_centre[i] - self.distances[p]) <= limit)
            near = near[self.ids[p][near] != query_id]
            self.scored += len(near)
            scores = exact_scores(self.rows[p][near], q, self.tree.scale)
            fine = [(s, i) for s, i in zip(scores, self.ids[p][near].tolist(), strict=True) if floor is None or s >= floor]
            if not fine:
                continue
            found = best(found + fine, k)
            if len(found) == k and (floor is None or found[-1][0] > floor):
                floor = found[-1][0]
                limit = self.tree.reach(point, exponent, floor, self.size)
        return found


def _search(tree: Tree, k: int):
    low, high = -(2**63), 2**63 - 1

    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        if not pages.num_rows or not queries.num_rows:
            return FOUND_SCHEMA.empty_table()
        search, out = Search(pages.to_pylist(), tree), []
        rows = _matrix(queries["v"].combine_chunks(), tree.dim)
        for query_id, floor, q in zip(queries["vec_id"].to_pylist(), queries["floor"].to_pylist(), rows, strict=True):
            known = int.from_bytes(floor, "big", signed=True) if floor is not None else None
            out += [(query_id, i, max(low, min(high, s)), sort_key(s)) for s, i in search.top_k(query_id, q, k, known)]
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND_SCHEMA, strict=True)], schema=FOUND_SCHEMA)

    return run


def _route(tree: Tree, radius: np.ndarray, k: int, home: bool):
    """Rows (vec_id, v, floor, node): a query for its nearest node, or for every other node that may
    hold a row as good as its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = _matrix(batch["v"], tree.dim), batch["vec_id"].to_pylist()
            better = [None] * len(ids) if home else batch["floor"].to_pylist()
            each, floors, nodes = [], [], []
            for i, (query_id, q) in enumerate(zip(ids, rows, strict=True)):
                point, exponent = tree.point(q)
                near = np.sqrt(((tree.pivots - point) ** 2).sum(1)) - radius
                first = int(np.where(tree.classes == tree.main, near, np.inf).argmin())
                floor = tree.floor(query_id, q, k)
                if better[i] is not None:
                    floor = max(x for x in (int.from_bytes(better[i], "big", signed=True), floor) if x is not None)
                if home:
                    some = [first]
                else:
                    limits = {s: tree.reach(point, exponent, floor, s) for s in set(tree.classes.tolist())}
                    some = [n for n in range(len(near)) if n != first and near[n] <= limits[int(tree.classes[n])]]
                each += [i] * len(some)
                floors += [None if floor is None else _signed(floor)] * len(some)
                nodes += some
            at = pa.array(each, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(at), batch["v"].take(at), pa.array(floors, pa.binary()), pa.array(nodes, pa.int32())], names=["vec_id", "v", "floor", "node"])

    return run


def _pivots(lifted: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample far from each other: each next one is farthest from those chosen."""
    chosen = [0]
    far = ((lifted - lifted[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(lifted)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
    # one round of means, as routing objects need not be rows
    squares = (lifted**2).sum(1)[:, None] - 2 * lifted @ lifted[chosen].T + (lifted[chosen] ** 2).sum(1)
    near = squares.argmin(1)
    return np.array([lifted[near == i].mean(0) if (near == i).any() else lifted[c] for i, c in enumerate(chosen)])


def _floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort keys back to plain signed numbers."""
    for batch in batches:
        out = [None if key is None else _signed(int.from_bytes(key[5:], "big", signed=True)) for key in batch["exact"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["query_id"], pa.array(out, pa.binary())], names=["query_id", "floor"])


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, sample: int = 1024, nodes: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products for each row whose
    vec_id is divisible by ``every``, over all rows but its own."""
    spark = table.sparkSession
    vectors = integer_vectors(table, scale).distinct()
    rows = keep(vectors.withColumn("size", size_class(F.col("v"))), "vectors")
    unit = F.transform("v", lambda e: e / F.pow(F.lit(2.0), (F.col("size") * 4).cast("double")) / 32)
    squares = F.aggregate(unit, F.lit(0.0), lambda a, e: a + e * e)
    stats = rows.groupBy("size").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(squares).alias("top")).collect()  # a row a class
    dim = max((r["dim"] for r in stats), default=0)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by_hash = Window.partitionBy("size").orderBy(F.xxhash64("vec_id"), "vec_id")
    picked = rows.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= sample).drop("n").collect()
    known: dict[int, list] = {}
    for r in picked:
        known.setdefault(r["size"], []).append(r)
    samples = {s: ([r["vec_id"] for r in of], _matrix(pa.array([r["v"] for r in of], pa.list_(pa.float64())), dim)) for s, of in known.items()}
    tree = Tree(dim, scale, {r["size"]: float(r["top"]) * (1 + 1e-12) for r in stats}, max(stats, key=lambda r: r["n"])["size"], samples, nodes)

    # of equal vectors only the smallest ids can be among the best k, besides the query's own
    alike = Window.partitionBy("v").orderBy("vec_id")
    indexed = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).drop("n")
    placed = keep(indexed.mapInArrow(_assign(tree), "vec_id long, v array<double>, node int, distance double"), "placed")
    radius = np.zeros(len(tree.classes))
    for r in placed.groupBy("node").agg(F.max("distance").alias("radius")).collect():  # a row a node
        radius[r["node"]] = r["radius"] * (1 + 1e-9) + 1e-9
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paged = placed.repartitionByRange(parts, "node", "distance", "vec_id").sortWithinPartitions("node", "distance", "vec_id")
    pages = keep(paged.mapInArrow(_pages(tree), PAGES), "pages")
    # pages that follow each other by distance make a group; a query meets all groups of a node it is sent to
    grouped = pages.withColumn("group", F.floor(F.col("page") / GROUP_PAGES))
    groups = keep(grouped.select("node", "group").distinct(), "groups")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v")

    def search(asked: DataFrame) -> DataFrame:
        """Blocks of queries meet groups of pages, so both sides of a task are bounded."""
        asked = keep(asked, "asked")
        blocks = asked.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        spread = grouped.join(F.broadcast(blocks), "node")  # a row a node
        spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        dealt = asked.join(F.broadcast(blocks), "node").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).drop("blocks").join(groups, "node")
        keys = ["node", "group", "block"]
        return keep(spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_search(tree, k), FOUND), "found")

    routed = "vec_id long, v array<double>, floor binary, node int"
    order = Window.partitionBy("query_id").orderBy(F.col("exact").desc(), "vec_id")
    near = search(queries.mapInArrow(_route(tree, radius, k, True), routed))
    least = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "exact").mapInArrow(_floors, "query_id long, floor binary")
    asked = queries.join(least, queries["vec_id"] == least["query_id"], "left").select("vec_id", "v", "floor")
    far = search(asked.mapInArrow(_route(tree, radius, k, False), routed))
    return near.union(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50, scale=256)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
