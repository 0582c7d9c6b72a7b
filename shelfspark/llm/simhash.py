"""Near duplicates by SimHash fingerprints and BK-trees.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. Two
fingerprints link if they differ in a few bits. Distinct fingerprints are dealt into
shards by pigeonhole: cut into blocks, two that link agree on so many whole blocks that
they meet in at least one shard. Each shard is a BK-tree (children are keyed by their
distance to the parent); a search follows the edges within the radius only. Shards grow
in number with the data, so they are shuffled and not broadcast. What leaves a shard is
a spanning forest of its links, from which the components are found.

Near duplicates by Jaccard similarity use such components, of wider fingerprints and a wide
radius, as candidates only: within each, the shingle sets themselves are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.components import connected_components
from shelfspark.session import cut_lineage

SHINGLE_WORDS = 4
RADIUS = 4
BLOCKS = 6
SEED = 42
#: Most members of a shard that one task holds as one tree; larger shards are cut into pieces.
PIECE = 8_192
PAIRS_AT_ONCE = 2_000_000
#: Most shingle sets, and shingles, of a component that are compared as one block; larger components are cut.
SETS_AT_ONCE = 2_048
SHINGLES_AT_ONCE = 4_000_000


def shingle_hashes(raw: bytes, words: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a UTF-8 text, in portions; none without words."""
    found = raw.lower().split()  # of bytes: A-Z and ASCII white space only
    digest, total = xxhash.xxh64_intdigest, max(1, len(found) - words + 1) if found else 0
    for part in range(0, total, 1 << 16):
        yield np.array(
            [digest(b" ".join(found[i : i + words]), seed) for i in range(part, min(total, part + (1 << 16)))], dtype="<u8"
        )


def shingle_set(raw: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, sorted."""
    return np.unique(np.concatenate([np.array([], "<u8"), *shingle_hashes(raw, words, seed)]))


def majority(portions: Iterable[np.ndarray], longs: int) -> np.ndarray:
    """The fingerprint of shingle hashes as ``longs`` unsigned 64-bit numbers; 0 without any.

    The first number is the majority of the shingles' own hashes, the others are those of
    numbers mixed from them.
    """
    counts, total = np.zeros((longs, 64), np.int64), 0
    steps = np.arange(1, longs, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for hashes in portions:
        total += len(hashes)
        if not len(hashes):
            continue
        mixed = (hashes ^ steps) * np.uint64(0xFF51AFD7ED558CCD)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        mixed ^= mixed >> np.uint64(29)
        every = np.concatenate([hashes[None], mixed])
        # A byte per bit, eight in a long: sums of 255 rows stay within their bytes.
        bits = np.unpackbits(every.view(np.uint8).reshape(-1), bitorder="little").view(np.uint64).reshape(longs, -1, 8)
        sums = np.add.reduceat(bits, np.arange(0, len(hashes), 255), axis=1)
        counts += sums.view(np.uint8).sum(1, dtype=np.int64)
    return np.packbits(counts * 2 > total, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(raw: bytes, words: int = SHINGLE_WORDS, seed: int = SEED, longs: int = 1) -> np.ndarray:
    """The fingerprint of a UTF-8 text; a repeated shingle counts as often as it occurs."""
    return majority(shingle_hashes(raw, words, seed), longs)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, longs: int = 1
) -> DataFrame:
    """``doc_id, text_hash, fp``: one row per row of ``docs``; ``fp`` is an array of signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py() or b"", words, SEED, longs).view(np.int64) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fp"]
            )

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("raw"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp array<bigint>")


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over ``values``, one for each value of ``groups``, built level by level.

    ``values`` has a row of 64-bit numbers per fingerprint. Edges are kept as sorted keys
    node * (bits + 1) + distance, so that those of a range of distances are a slice.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values, n = values, len(values)
        self.step = 64 * values.shape[1] + 1
        _, first = np.unique(groups, return_index=True)
        order = np.argsort(groups, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(groups[order]) != 0]) if n else np.array([], np.int64)
        self.roots = np.empty(n, np.int64)
        self.roots[order] = np.repeat(order[starts], np.diff(np.r_[starts, n]))
        keys, nodes = [], []
        left = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.roots[left]
        while len(left):
            edge = at * self.step + bits_apart(values[left], values[at])
            new, where = np.unique(edge, return_index=True)
            keys.append(new)
            nodes.append(left[where])
            stay = np.ones(len(left), bool)
            stay[where] = False
            at = left[where][np.searchsorted(new, edge[stay])]
            left = left[stay]
        keys = np.concatenate(keys) if keys else np.array([], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.nodes = np.concatenate(nodes)[order] if nodes else keys

    def links(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in ``queries``, nodes) within the radius, in portions of bounded size."""
        stack = [(np.arange(len(queries)), roots)]
        while stack:
            who, at = stack.pop()
            if len(who) > PAIRS_AT_ONCE // 16 and len(who) > 1:
                half = len(who) // 2
                stack += [(who[:half], at[:half]), (who[half:], at[half:])]
                continue
            distance = bits_apart(queries[who], self.values[at])
            hit = distance <= radius
            if hit.any():
                yield who[hit], at[hit]
            low = np.searchsorted(self.keys, at * self.step + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.keys, at * self.step + np.minimum(distance + radius, self.step - 1), side="right")
            count = high - low
            total = int(count.sum())
            if total:
                offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                stack.append((np.repeat(who, count), self.nodes[np.repeat(low, count) + offset]))


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (least member of each set so far) after the sets of each a and b are united."""
    while True:
        one, two = labels[a], labels[b]
        open_ = one != two
        if not open_.any():
            return labels
        a, b, one, two = a[open_], b[open_], one[open_], two[open_]
        np.minimum.at(labels, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(labels, up := labels[labels]):
            labels = up


def _shards(blocks: int, radius: int) -> list[int]:
    """Bit masks, one of which two words within the radius agree on."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, piece: int = PIECE) -> DataFrame:
    """``a, b``: links between the distinct values of ``prints.fp`` (one long) that span their components.

    Every pair within the radius is joined by links of its shard. More ``blocks`` than the
    radius make shards smaller and more numerous: 6 blocks for up to 10^8 fingerprints,
    8 (70 shards of 32 bits each) beyond.
    """
    if blocks <= radius:
        raise ValueError("blocks must be more than the radius")
    signed = [m - (1 << 64) if m >> 63 else m for m in _shards(blocks, radius)]
    first = F.element_at("fp", 1)
    distinct = prints.select("fp").where("fp IS NOT NULL").distinct()
    dealt = distinct.select(
        first.alias("node"), "fp", F.posexplode(F.array(*(first.bitwiseAND(F.lit(m)) for m in signed))).alias("shard", "part")
    )
    return _links(dealt, 1, radius, piece)


def banded_links(sets: DataFrame, longs: int, radius: int, band_bits: int, piece: int = PIECE) -> DataFrame:
    """``a, b``: links between the nodes of ``sets`` (``node, fp`` of ``longs`` longs; a node once).

    A wide radius leaves no block untouched, so shards are those that agree on one of the
    bands of ``band_bits`` bits: a pair that differs in a share x of all bits is missed with
    probability (1 - (1 - x)^band_bits)^bands. Wider bands make smaller shards.
    """
    whole = F.array_join(F.transform("fp", lambda x: F.lpad(F.bin(x), 64, "0")), "")
    bands = 64 * longs // band_bits
    dealt = sets.select("node", "fp", whole.alias("bits")).select(
        "node", "fp",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.col("bits").substr(i * band_bits + 1, F.lit(band_bits))))).alias("shard", "part"),
    )
    return _links(dealt, longs, radius, piece)


def _links(dealt: DataFrame, longs: int, radius: int, piece: int) -> DataFrame:
    """Links within the shards of ``dealt`` (``node, fp, shard, part``).

    A shard of more than ``piece`` members is cut into pieces; each piece is a tree that all
    members of the shard search.
    """
    # Few shards are that large: their table is small, and the fingerprints are shuffled once, to their trees.
    large = cut_lineage(
        dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).where(F.col("n") > piece)
        .select("shard", "part", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    )
    full = dealt.join(large, ["shard", "part"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    # Members of a cut shard search every piece and stand in one.
    sent = full.withColumn("own", own).select(
        F.xxhash64("shard", "part").alias("shard_hash"), "node", "fp", "own",
        F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
    ).select(F.xxhash64("shard_hash", "piece").alias("tree"), "node", "fp", (F.col("own") == F.col("piece")).alias("stands"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trees, names, values, stands in _whole_groups(batches, longs):
            node = np.flatnonzero(stands)
            forest = Forest(values[node], trees[node])
            named, first = np.unique(trees[node], return_index=True)
            labels = np.arange(len(values))
            if len(named):
                at = np.minimum(np.searchsorted(named, trees), len(named) - 1)
                search = np.flatnonzero(named[at] == trees)
                for who, hit in forest.links(values[search], forest.roots[first[at[search]]], radius):
                    labels = merged(labels, search[who], node[hit])
            linked = np.flatnonzero(labels != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[labels[linked]])], names=["a", "b"])

    return (
        sent.repartition("tree").sortWithinPartitions("tree").mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()
    )


def _whole_groups(batches: Iterator[pa.RecordBatch], longs: int, least: int = 50_000) -> Iterator[tuple[np.ndarray, ...]]:
    """(tree, node, fingerprint, stands) of sorted rows in portions that hold whole trees."""
    kept: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        tree, node, stands = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        values = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, longs)
        kept.append((tree, node, values, stands.astype(bool)))
        rows += len(tree)
        if rows < least:
            continue
        joined = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
        cut = int(np.searchsorted(joined[0], joined[0][-1]))  # the last tree may go on
        if cut:
            yield tuple(x[:cut] for x in joined)
        kept, rows = [tuple(x[cut:] for x in joined)], len(joined[0]) - cut
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the least id reachable by
    links of at most ``radius`` differing bits, the document itself included. A text that
    is null or without words has fingerprint zero and links like any other. Copies share a
    fingerprint and are never expanded into pairs. Repeated rows give repeated results; a
    null id gets the component of its fingerprint, null if no row there has an id. An empty
    table gives no rows; other columns play no part.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words).select("doc_id", "fp"))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.element_at("fp", 1))
    parts = connected_components(near_links(prints, radius, blocks))
    roots = classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = roots.groupBy("component").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "component").select("node", "component_id")
    return prints.withColumn("node", F.element_at("fp", 1)).join(named, "node").select(
        "doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id"
    )


def similar_radius(similarity: float, bits: int, slack: float = 3.0) -> int:
    """Differing bits that two shingle sets of this Jaccard similarity have on average, plus ``slack`` deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + slack * math.sqrt(bits * share * (1 - share)))


def set_prints(docs: DataFrame, id_col: str, text_col: str, words: int, longs: int) -> DataFrame:
    """``doc_id, text_hash, node, size, fp``: a row per row of ``docs``; ``node`` names its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints = [], [], []
            for x in batch.column(2):
                found = shingle_set(x.as_py(), words)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                # In portions, as a long text's bits are many.
                prints.append(majority((found[i : i + (1 << 16)] for i in range(0, len(found), 1 << 16)), longs).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 pa.array(prints, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "size", "fp"],
            )

    rows = _raw(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, node bigint, size bigint, fp array<bigint>")


def _raw(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("raw"))


def similar_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, positions) of the pairs of a left and a right set whose Jaccard similarity is enough, in portions.

    Counts of common members come from an inverted index, so sets that share nothing never meet.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.r_[0, np.cumsum(sizes)]
    listed = np.flatnonzero(right[owner])
    listed = listed[np.argsort(name[listed], kind="stable")]
    count = np.bincount(name[listed], minlength=int(name.max(initial=-1)) + 1)
    start, holders = np.cumsum(count) - count, owner[listed]
    a, b, held = [], [], 0
    for i in np.flatnonzero(left):
        own = name[bounds[i] : bounds[i + 1]]
        common = np.zeros(len(sets), np.int64)
        # A long set's lists are read in portions.
        ends = np.cumsum(count[own])
        for part in np.split(own, np.flatnonzero(np.diff(ends // PAIRS_AT_ONCE)) + 1):
            n = count[part]
            at = np.arange(int(n.sum())) + np.repeat(start[part] - (np.cumsum(n) - n), n)
            common += np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero(common)
        hit = near[common[near] / (sizes[i] + sizes[near] - common[near]) >= similarity]
        a.append(np.full(len(hit), i))
        b.append(hit)
        held += len(hit)
        if held > PAIRS_AT_ONCE:
            yield np.concatenate(a), np.concatenate(b)
            a, b, held = [], [], 0
    if a:
        yield np.concatenate(a), np.concatenate(b)


def confirmed_links(
    docs: DataFrame, members: DataFrame, id_col: str, text_col: str, words: int, similarity: float,
    sets_at_once: int = SETS_AT_ONCE, shingles_at_once: int = SHINGLES_AT_ONCE,
) -> DataFrame:
    """``a, b``: links that span what pairs of sets of one candidate component with enough similarity connect.

    ``members`` has ``component, node, size, doc_id, text_hash``, the last two of one document
    that has the set. A large component is cut into pieces, and every two pieces are a block.
    """
    totals = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    pieces = F.greatest(F.ceil(F.col("n") / sets_at_once), F.ceil(F.col("total") / shingles_at_once)).cast("int")
    placed = members.join(totals.select("component", pieces.alias("pieces")), "component").select(
        "component", "node", "pieces", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("own"),
        F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"),
    )
    rows = _raw(docs, id_col, text_col)
    texts = rows.join(placed, rows["doc_id"].eqNullSafe(placed["m_id"]) & (rows["text_hash"] == placed["m_hash"]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_set(x.as_py(), words).tobytes() for x in batch.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], found], names=["component", "node", "pieces", "own", "members"])

    made = texts.select("component", "node", "pieces", "own", "raw").mapInArrow(
        sets, "component bigint, node bigint, pieces int, own int, members binary"
    )
    other = made.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    sent = other.select(
        F.xxhash64("component", low, high).alias("block"), "node", (F.col("own") == low).alias("left"), (F.col("own") == high).alias("right"), "members"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_blocks(batches):
            node = np.array(list(held), np.int64)
            left, right, found = zip(*held.values(), strict=True)
            labels = np.arange(len(node))
            for a, b in similar_sets(list(found), np.array(left), np.array(right), similarity):
                labels = merged(labels, a, b)
            linked = np.flatnonzero(labels != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[labels[linked]])], names=["a", "b"])

    return sent.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint").distinct()


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple[bool, bool, np.ndarray]]]:
    """For each block of sorted rows: left, right and the set of each node; rows that repeat count once."""
    block, held = None, {}
    for batch in batches:
        for key, node, left, right, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != block and held:
                yield held
                held = {}
            block = key
            held[node] = left, right, np.frombuffer(found, "<u8")
    if held:
        yield held


def near_duplicate_keepers(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    longs: int = 8,
    band_bits: int = 12,
) -> DataFrame:
    """``doc_id, text_hash`` of the document that stays of each group of near duplicates.

    Documents link where the Jaccard similarity of their sets of shingles of ``words`` words
    is ``similarity`` or more; groups are the components. Candidates are the components of
    fingerprints of ``longs`` 64-bit numbers that differ in up to three deviations more bits
    than that similarity has on average; in each of them all sets are compared, as sets of
    64-bit hashes. The least id stays (rows without an id come last, then the least text
    hash); ``text_hash`` is xxhash64 of the text's bytes. Texts without words are copies of
    one another. Rows that repeat id and text are one document.
    """
    prints = cut_lineage(set_prints(docs, id_col, text_col, words, longs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = cut_lineage(prints.groupBy("node").agg(first, F.first("size").alias("size"), F.first("fp").alias("fp")))
    loose = connected_components(banded_links(classes, longs, similar_radius(similarity, 64 * longs), band_bits))
    members = classes.join(loose, "node").select("component", "node", "size", "first.doc_id", "first.text_hash")
    parts = connected_components(confirmed_links(docs, cut_lineage(members), id_col, text_col, words, similarity))
    kept = (
        classes.select("node", "first").join(parts, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    )
    return kept.select("first.doc_id", "first.text_hash")
