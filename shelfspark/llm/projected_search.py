"""Nearest neighbours by stable projections in a kd-tree.

Vectors are projected on a few Gaussian directions, so that a projected squared distance
divided by the true one is chi-square distributed. A kd-tree over the projections is cut
into cells; its upper levels are fitted on a bounded sample, every row is put in its cell.
A query takes its projected neighbours in order, verifies them on the original vectors
and stops once the chi-square test says that a nearer one would have shown up with the
wanted confidence. It visits its own cell first and then the cells that the test leaves.

The largest inner product is the nearest neighbour after one more coordinate has brought
every vector to the length of the longest one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

DIRECTIONS = 8
CONFIDENCE = 0.97
LEAF = 64
CELL_ROWS = 8_192
SAMPLE_ROWS = 20_000
BLOCK_QUERIES = 20_000


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """The distribution function for an even number of degrees of freedom."""
    half = x / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, freedom // 2):
        term = term * half / i
        total = total + term
    return np.where(half > 700, 1.0, 1 - np.exp(-np.minimum(half, 700)) * total)


@dataclass
class Tree:
    """A kd-tree of fixed depth: node i splits at ``value`` in ``dim``; its children are 2i+1 and 2i+2."""

    dims: np.ndarray
    values: np.ndarray
    depth: int

    def cells(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.dims[at]] > self.values[at]
            at = 2 * at + 1 + right
        return at - ((1 << self.depth) - 1)

    def boxes(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corners of the cells; without end where nothing splits."""
        low, high = np.full((1, m), -np.inf), np.full((1, m), np.inf)
        for level in range(self.depth):
            first = (1 << level) - 1
            next_low, next_high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
            for k in range(1 << level):
                d, v = self.dims[first + k], self.values[first + k]
                next_high[2 * k, d] = v
                next_low[2 * k + 1, d] = v
            low, high = next_low, next_high
        return low, high


def fit_tree(points: np.ndarray, depth: int) -> Tree:
    """Splits at the median of the widest direction, level by level."""
    nodes = (1 << depth) - 1
    dims, values = np.zeros(nodes, np.int64), np.zeros(nodes)
    held = {0: points}
    for i in range(nodes):
        mine = held.pop(i)
        if len(mine):
            dims[i] = int(np.argmax(np.ptp(mine, axis=0)))
            values[i] = float(np.median(mine[:, dims[i]]))
        right = mine[:, dims[i]] > values[i] if len(mine) else np.zeros(0, bool)
        held[2 * i + 1], held[2 * i + 2] = mine[~right], mine[right]
    return Tree(dims, values, depth)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point (row) to each box (column)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - points[:, d, None], points[:, d, None] - high[None, :, d]), 0)
        out += gap * gap
    return out


def search_cell(
    vectors: np.ndarray, lengths: np.ndarray, points: np.ndarray, ids: np.ndarray,
    queries: np.ndarray, q_points: np.ndarray, bounds: np.ndarray, k: int, top: float, confidence: float,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of up to ``k`` rows of a cell for each query, best first.

    ``bounds`` is the squared distance that each query has to beat, ``top`` the largest
    squared length of any vector.
    """
    depth = max(0, math.ceil(math.log2(max(1, len(ids)) / LEAF)))
    leaf_of = fit_tree(points, depth).cells(points)
    order = np.argsort(leaf_of, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(leaf_of[order]) != 0])
    ends = np.r_[starts[1:], len(order)]
    low = np.minimum.reduceat(points[order], starts, axis=0)
    high = np.maximum.reduceat(points[order], starts, axis=0)
    vectors, ids = vectors[order], ids[order]
    m = points.shape[1]
    for part in range(0, len(queries), 512):
        near = box_distance(q_points[part : part + 512], low, high)
        for i, reach in enumerate(near):
            q = queries[part + i]
            length, bound = float(q @ q), float(bounds[part + i])
            turn = np.argsort(reach, kind="stable")
            got_ids, got = np.empty(0, np.int64), np.empty(0)
            at, step = 0, 4
            while at < len(turn):
                r = reach[turn[at]]
                if r > 0 and (bound <= 0 or chi_square(np.array(r / bound), m) >= confidence):
                    break
                rows = np.concatenate([np.arange(starts[x], ends[x]) for x in turn[at : at + step]])
                got = np.concatenate([got, (vectors[rows] * q).sum(1)])
                got_ids = np.concatenate([got_ids, ids[rows]])
                best = np.lexsort((got_ids, -got))[:k]
                got, got_ids = got[best], got_ids[best]
                if len(got) == k:  # |q|^2 + top - 2 q.x is the squared distance of the lengthened vectors
                    bound = min(bound, max(0.0, length + top - 2 * float(got[-1])))
                at += step
                step *= 2
            yield part + i, got_ids, got


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    directions: int = DIRECTIONS,
    confidence: float = CONFIDENCE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cell_rows: int = CELL_ROWS,
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` rows of largest inner product.

    ``queries`` holds ids of rows of ``vectors`` under ``id_col``; a row is no candidate of
    its own. Ties go to the smaller id. Vectors that are null, all zero, hold null or
    non-finite components or have another length than most take no part; nor do null ids.
    Rows that repeat an id and vector count once. ``score`` is computed in double precision
    on the original vectors. Equal vectors are searched once and share what is found.
    Each of a query's true neighbours is found with at least about ``confidence``.
    """
    if directions % 2:
        raise ValueError("the number of directions must be even")
    spark = vectors.sparkSession
    v = F.col("v")
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        v.isNotNull() & F.col("id").isNotNull() & F.exists(v, lambda x: x != 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    squared = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    facts = sound.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(squared).alias("top")).orderBy(F.desc("n"), "size").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if facts is None:
        return spark.createDataFrame([], schema)
    size, top = facts["size"], float(facts["top"])
    # A vector's class holds the k + 1 smallest ids: one may be the query itself.
    sound = sound.where(F.size("v") == size).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    first = Window.partitionBy("v").orderBy("id")
    classes = cut_lineage(
        sound.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("rep", F.element_at("ids", 1))
    )
    gauss = np.random.default_rng(seed).standard_normal((size + 1, directions))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            more = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
            points = np.c_[x, more] @ gauss
            aimed = x @ gauss[:-1]
            as_list = lambda p: pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), directions).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), as_list(points), as_list(aimed)], names=["rep", "v", "point", "aim"]
            )

    placed = cut_lineage(classes.select("rep", "v").mapInArrow(project, "rep bigint, v array<double>, point array<double>, aim array<double>"))
    total = placed.count()
    depth = max(0, math.ceil(math.log2(total / cell_rows)))
    draw = F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(min(1.0, SAMPLE_ROWS / total) * (1 << 20)) + 1
    sample = np.array([r[0] for r in placed.where(draw).select("point").limit(2 * SAMPLE_ROWS).collect()]).reshape(-1, directions)
    tree = fit_tree(sample, depth)
    low, high = tree.boxes(directions)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, aim = (tree.cells(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, directions)) for c in batch.columns[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(aim)], names=["rep", "cell", "home"])

    cells = placed.select("rep", "point", "aim").mapInArrow(put, "rep bigint, cell bigint, home bigint")
    rows = cut_lineage(placed.join(cells, "rep"))
    # A cell with more rows than wanted is cut into pieces; there are as many cells as the tree has.
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    pieces = [max(1, math.ceil(counts.get(c, 0) / (2 * cell_rows))) for c in range(1 << depth)]
    of_cell = F.element_at(F.lit(pieces), (F.col("cell") + 1).cast("int"))
    wanted = queries.select(F.col(id_col).cast("long").alias("id")).distinct()
    members = cut_lineage(sound.join(wanted, "id", "left_semi").distinct().join(classes.select("v", "rep"), "v").select("id", "rep"))
    asked = cut_lineage(rows.join(members.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("q"), "v", "aim", "home"))
    blocks = max(1, math.ceil(members.count() / BLOCK_QUERIES))
    shards = rows.withColumn("piece", F.pmod(F.xxhash64("rep"), of_cell)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shards = shards.select("cell", "piece", "block", "rep", "v", "point")
    out = "q bigint, found array<struct<rep:bigint,score:double>>"

    def visit(there: pa.Table, here: pa.Table) -> pa.Table:
        def matrix(t: pa.Table, name: str, width: int) -> np.ndarray:
            return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

        kind = pa.list_(pa.struct([("rep", pa.int64()), ("score", pa.float64())]))
        if not there.num_rows or not here.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "found": pa.array([], kind)})
        x, ids = matrix(there, "v", size), there.column("rep").to_numpy()
        asks = here.column("q").to_numpy()
        got = list(search_cell(
            x, (x * x).sum(1), matrix(there, "point", directions), ids,
            matrix(here, "v", size), matrix(here, "aim", directions), here.column("bound").to_numpy(), k + 1, top, confidence,
        ))
        return pa.table({
            "q": pa.array([asks[i] for i, _, _ in got], pa.int64()),
            "found": pa.array([[{"rep": int(a), "score": float(b)} for a, b in zip(r, s, strict=True)] for _, r, s in got], kind),
        })

    def searched(routed: DataFrame) -> DataFrame:
        """``routed`` has ``q, v, aim, cell, bound``."""
        spread = routed.withColumn("piece", F.explode(F.sequence(F.lit(0), of_cell - 1))).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
        keys = ["cell", "piece", "block"]
        left = shards.select(F.col("cell"), F.col("piece").cast("int").alias("piece"), "block", "rep", "v", "point")
        return left.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(visit, out)

    def best(found: DataFrame) -> DataFrame:
        order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["rep"] < b["rep"], -1).when(a["rep"] > b["rep"], 1).otherwise(0)
        return found.groupBy("q").agg(F.flatten(F.collect_list("found")).alias("found")).withColumn("found", F.slice(F.array_sort("found", order), 1, k + 1))

    far = F.lit(float("inf"))
    home = cut_lineage(best(searched(asked.select("q", "v", "aim", F.col("home").alias("cell"), far.alias("bound")))))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    bound = F.when(F.size("found") == k + 1, F.greatest(F.lit(0.0), length + top - 2 * F.element_at("found", -1)["score"])).otherwise(far)
    bounded = asked.join(home, "q", "left").select("q", "v", "aim", "home", F.coalesce(bound, far).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that the test leaves, each query's own aside."""
        for batch in batches:
            aim = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, directions)
            homes, limit = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            reach = box_distance(aim, low, high)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(reach > 0, reach / limit[:, None], 0.0)
            open_ = chi_square(ratio, directions) < confidence
            open_[np.arange(len(homes)), homes] = False
            who, cell = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(cell)], names=["q", "cell"])

    routed = bounded.select("q", "aim", "home", "bound").mapInArrow(route, "q bigint, cell bigint").join(bounded.drop("home"), "q")
    found = best(home.unionByName(searched(routed)))
    named = (
        found.select("q", F.explode("found").alias("f")).select("q", F.col("f.rep").alias("rep"), F.col("f.score").alias("score"))
        .join(classes.select("rep", "ids"), "rep")
        .groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("lists"))
    )
    candidates = F.flatten(F.transform("lists", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("less"), i.alias("id")))))
    ranked = F.slice(F.filter(F.array_sort("candidates"), lambda c: c["id"] != F.col("id")), 1, k)
    return (
        members.withColumnRenamed("rep", "q").join(named.select("q", candidates.alias("candidates")), "q")
        .select("id", F.posexplode(ranked).alias("at", "c"))
        .select(F.col("id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("c.id").alias("vec_id"), (-F.col("c.less")).alias("score"))
    )
