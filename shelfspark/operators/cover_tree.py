"""A tree of pivots over unit vectors, with exact bounds on which cells can hold neighbours.

Pivots are nested: level l holds the first ``FAN`` ** l of them, each below the nearest pivot
of the level above. Their number grows with the rows, and the first ones are spread out: each
is the sampled vector farthest from those before it. A vector goes down to one leaf; every
node knows the largest angle between its pivot and a vector below it. A vector has neighbours
within angle theta below a node only if its angle to the pivot is at most that radius plus
theta (triangle inequality on angles), so whole subtrees are left out. The nodes of one level
are the cells: finer ones where the bounds prune, coarser ones where they do not, as the
costs of a bounded sample of vectors tell.

Where two blocks of vectors meet, the products of their leading components (those in which
the pivots vary most) and the norms of the rest bound every cosine (Cauchy-Schwarz); only
pairs whose bound reaches the threshold are multiplied in full.
"""

from __future__ import annotations

import dataclasses
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.session import cut_lineage

log = logging.getLogger(__name__)

FAN = 16
#: Rows per leaf, on average, until the pivots reach their bound.
LEAF_ROWS = 64
#: Pivots that are picked by distance; the others are a plain sample. Vectors sampled for each pivot.
SPREAD_PIVOTS = 2048
SAMPLED = 4
#: Vectors whose costs choose the level, and what moving a vector costs in multiplied pairs.
COST_SAMPLE = 2000
MOVE_COST = 500
#: Moves of a vector beyond this share of all vectors cost more than multiplying them.
MOVE_SHARE = 64
#: Vectors that one task multiplies with as many others, at first: beyond ``MOST_BLOCKS`` blocks of
#: a cell blocks grow with it, to ``BLOCK_BYTES`` of doubles, so that a vector moves to a bounded number of tasks.
BLOCK_ROWS = 4096
MOST_BLOCKS = 8
BLOCK_BYTES = 32 << 20
#: Products that a task holds at once.
STRIP_PAIRS = 2 << 20
#: Bytes of pivots that the driver and every task hold at most.
PIVOT_BYTES = 64 << 20
LEADING = 16
DIGITS = 9
EPS = 1e-6


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit-length rows in double precision; an all-zero vector stays zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 1))
    lengths = np.asarray(column.value_lengths())
    if (lengths != lengths[0]).any():
        raise ValueError("vector lengths differ")
    rows = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), int(lengths[0]))
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


@dataclasses.dataclass
class CoverTree:
    """``pivots`` in nesting order, ``sizes`` of the levels, ``parents`` and ``children`` of their nodes.

    ``radii``, ``held`` (rows below each node) and ``level`` (that of the cells) are known once rows are placed.
    """

    pivots: np.ndarray
    sizes: list[int]
    parents: list[np.ndarray]
    children: list[dict[int, np.ndarray]]
    radii: list[np.ndarray]
    held: list[np.ndarray]
    basis: np.ndarray
    level: int = 0

    @classmethod
    def of(cls, pivots: np.ndarray, fan: int = FAN) -> CoverTree:
        sizes = [min(1, len(pivots))]
        while sizes[-1] < len(pivots):
            sizes.append(min(sizes[-1] * fan, len(pivots)))
        parents, children = [], []
        for above, here in zip(sizes, sizes[1:]):
            parent = np.concatenate([_angles(pivots[i : min(i + 4096, here)], pivots[:above]).argmin(axis=1) for i in range(0, here, 4096)])
            parents.append(parent)
            children.append({node: np.flatnonzero(parent == node) for node in range(above)})
        _, axes = np.linalg.eigh(pivots.T @ pivots) if len(pivots) else (None, np.zeros((0, 0)))
        return cls(pivots, sizes, parents, children, [], [], axes[:, ::-1][:, :LEADING])

    def paths(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, angle to it) of each row at each level.

        The nearest node of the deepest level that is still compared as a whole, those above
        it, and from there down to the nearest child.
        """
        nodes = np.zeros((len(rows), len(self.sizes)), dtype=np.int32)
        angles = np.zeros((len(rows), len(self.sizes)))
        whole = max(i for i, n in enumerate(self.sizes) if n <= SPREAD_PIVOTS)
        far = _angles(rows, self.pivots[: self.sizes[whole]])
        every = np.arange(len(rows))
        nodes[:, whole] = far.argmin(axis=1)
        for level in range(whole, 0, -1):
            nodes[:, level - 1] = self.parents[level - 1][nodes[:, level]]
        for level in range(whole + 1):
            angles[:, level] = far[every, nodes[:, level]]
        for level in range(whole + 1, len(self.sizes)):
            for node in np.unique(nodes[:, level - 1]):
                here, under = np.flatnonzero(nodes[:, level - 1] == node), self.children[level - 1][int(node)]
                far = _angles(rows[here], self.pivots[under])
                nodes[here, level], angles[here, level] = under[far.argmin(axis=1)], far.min(axis=1)
        return nodes, angles

    def measure(self, level: int, node: np.ndarray, radius: np.ndarray, rows: np.ndarray) -> None:
        while len(self.radii) <= level:
            self.radii.append(np.full(self.sizes[len(self.radii)], -np.inf))
            self.held.append(np.zeros(self.sizes[len(self.held)], dtype=np.int64))
        np.maximum.at(self.radii[level], node, radius)
        np.add.at(self.held[level], node, rows)

    def choose(self, sample: np.ndarray, reach: float) -> None:
        """The level whose cells cost least for a sample of vectors."""
        reaches, costs = np.full(len(sample), reach), []
        move = max(MOVE_COST, int(self.held[0].sum()) // MOVE_SHARE) if self.held else MOVE_COST
        for self.level in range(len(self.sizes)):
            size = self.held[self.level][np.concatenate([np.zeros(0, np.int32), *self.visits(sample, reaches)])]
            costs.append((size + move * np.minimum(np.ceil(size / BLOCK_ROWS), self.most_blocks(size))).sum())
        self.level = int(np.argmin(costs)) if costs else 0

    def block_rows(self) -> int:
        """Vectors of ``BLOCK_BYTES``."""
        return max(1, BLOCK_BYTES // (8 * max(1, self.pivots.shape[1])))

    def most_blocks(self, size):
        """Blocks that a cell of so many vectors is cut into at most."""
        return np.maximum(MOST_BLOCKS, np.ceil(size / self.block_rows()))

    def visits(self, rows: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        """Cells that can hold a vector within ``reach`` (an angle for each row)."""
        limit = reach[:, None] + EPS
        first = np.arange(self.sizes[0])
        row, node = np.nonzero(_angles(rows, self.pivots[first]) <= self.radii[0][first] + limit)
        for level, below in enumerate(self.children[: self.level], 1):
            found_row, found_node = [], []
            for parent in np.unique(node):
                here, under = row[node == parent], below[int(parent)]
                at, child = np.nonzero(_angles(rows[here], self.pivots[under]) <= self.radii[level][under] + limit[here])
                found_row.append(here[at])
                found_node.append(under[child])
            row = np.concatenate(found_row) if found_row else np.zeros(0, dtype=np.int64)
            node = np.concatenate(found_node) if found_node else np.zeros(0, dtype=np.int64)
        order = np.lexsort((node, row))
        cuts = np.searchsorted(row[order], np.arange(1, len(rows)))
        return np.split(node[order].astype(np.int32), cuts) if len(rows) else []


def near_pairs(left: np.ndarray, right: np.ndarray, threshold: float, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of all pairs of ``threshold`` or more, by row, then column; cosines have nine digits."""
    if left.shape[1] != right.shape[1]:
        raise ValueError("vector lengths differ")
    lead_l, lead_r = left @ basis, right @ basis
    rest = lambda rows, lead: np.sqrt(np.maximum((rows * rows).sum(axis=1) - (lead * lead).sum(axis=1), 0.0))
    bound = lead_l @ lead_r.T + np.outer(rest(left, lead_l), rest(right, lead_r))
    row, column = np.nonzero(bound >= threshold - EPS)
    if 4 * len(row) > bound.size:
        cosines = np.round(left @ right.T, DIGITS)[row, column]
    else:
        cosines = np.empty(len(row))
        for i in range(0, len(row), 1 << 16):
            part = slice(i, i + (1 << 16))
            cosines[part] = np.einsum("ij,ij->i", left[row[part]], right[column[part]])
        cosines = np.round(cosines, DIGITS)
    keep = cosines >= threshold
    return row[keep], column[keep], cosines[keep]


def near_strips(
    left: np.ndarray, right: np.ndarray, threshold: float, basis: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``near_pairs`` of a few left rows after the other, so that ``STRIP_PAIRS`` products are held at once."""
    step = max(1, STRIP_PAIRS // max(1, len(right)))
    for i in range(0, len(left), step):
        row, column, cosines = near_pairs(left[i : i + step], right, threshold, basis)
        yield row + i, column, cosines


def usable(vectors: DataFrame) -> DataFrame:
    """``id, embedding`` of the vectors that have a direction."""
    return vectors.select("id", "embedding").where(
        "embedding IS NOT NULL AND size(embedding) > 0 AND exists(embedding, x -> x <> 0)"
    )


def spread_out(sample: np.ndarray, wanted: int, spread: int = SPREAD_PIVOTS) -> np.ndarray:
    """``wanted`` rows of the sample: first each row that is farthest from those before, then the others in order."""
    chosen = [0] if len(sample) else []
    nearest = sample @ sample[0] if len(sample) else np.zeros(0)
    while len(chosen) < min(wanted, spread, len(sample)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - EPS:
            break  # what is left are copies
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    rest = np.setdiff1d(np.arange(len(sample)), chosen)[: wanted - len(chosen)]
    return sample[[*chosen, *rest.tolist()]] if len(sample) else sample


def plant(vectors: DataFrame, reach: float, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> tuple[DataFrame, CoverTree]:
    """(``id, embedding, cell, angle``, tree) of the usable vectors; ``angle`` is that to the cell's pivot.

    ``reach`` is the angle that will be searched. Pivots come from the vectors with the
    lowest id hashes, one for every ``leaf_rows`` rows and at most ``PIVOT_BYTES`` of
    sampled vectors, which reach the driver; so does one radius per node. The placed rows are
    written to the shared folder.
    """
    rows = usable(vectors)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    wanted = math.ceil(size.n / leaf_rows)
    sampled = max(1, min(SAMPLED * wanted, PIVOT_BYTES // (8 * (size.d or 1))))
    sample = unit_rows(rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sampled).select("embedding").toArrow()["embedding"])
    tree = CoverTree.of(spread_out(sample, max(1, min(wanted, sampled // SAMPLED))), fan)
    schema = T.StructType([*rows.schema.fields, T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("angles", T.ArrayType(T.DoubleType()))])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes, angles = tree.paths(unit_rows(batch["embedding"]))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["embedding"], pa.array(list(nodes), pa.list_(pa.int32())), pa.array(list(angles), pa.list_(pa.float64()))],
                    names=["id", "embedding", "path", "angles"],
                )

    placed = cut_lineage(rows.mapInArrow(go, schema))
    nodes = placed.select(F.posexplode(F.arrays_zip("path", "angles")).alias("level", "at"))
    found = nodes.groupBy("level", F.col("at.path").alias("node")).agg(F.max("at.angles").alias("radius"), F.count("*").alias("n")).collect()  # one row per node
    for level in range(len(tree.sizes)):
        mine = [r for r in found if r.level == level]
        tree.measure(level, np.array([r.node for r in mine], np.int64), np.array([r.radius for r in mine]), np.array([r.n for r in mine], np.int64))
    tree.choose(sample[:COST_SAMPLE], reach)
    at = F.lit(tree.level)
    return placed.select("id", "embedding", F.get("path", at).alias("cell"), F.get("angles", at).alias("angle")), tree


def with_visits(vectors: DataFrame, tree: CoverTree, reach: float | str) -> DataFrame:
    """``vectors`` with ``visits``: the cells that can hold one within ``reach`` (an angle, or a column of them)."""
    asked = vectors.withColumn("_reach", F.col(reach) if isinstance(reach, str) else F.lit(float(reach)))
    schema = T.StructType([*vectors.schema.fields, T.StructField("visits", T.ArrayType(T.IntegerType()))])
    names = vectors.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = tree.visits(unit_rows(batch["embedding"]), np.asarray(batch["_reach"], dtype=np.float64))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(found, pa.list_(pa.int32()))], names=[*names, "visits"])

    return asked.mapInArrow(go, schema)


def mean_visits(placed: DataFrame) -> float:
    """Share of the cells that a vector meets on average; ``placed`` has ``cell`` and ``visits``."""
    row = placed.agg(F.avg(F.size("visits")).alias("visits"), F.count_distinct("cell").alias("cells")).first()
    return row.visits / row.cells if row.cells else 0.0
