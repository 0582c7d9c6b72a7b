"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are told apart by most-significant-digit passes and only down to the threshold:

1. The digit of a window is the least hash among its short grams, which is all that its
   neighbours need to say too: consecutive windows with one digit form a run, and only
   runs are sorted. Digits that one document holds alone are done.
2. Runs of one digit are told apart by all the bytes they cover. If they are all alike,
   the group is settled: the smallest document keeps it.
3. What is left, runs of one digit with unlike bytes, is told apart window by window at
   the full depth. Equal groups then are exactly the repeated windows.

Documents are dealt into chunks. A pass sends each chunk's distinct digits to buckets,
where equal ones meet, and gets back what the chunk needs to go on; so a passage that is
everywhere sends a row per chunk, not per document. Digits are 64-bit hashes (32 bits
within a bucket in the first pass, which only filters).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 50
GRAM = 24
PIECE_BYTES = 1 << 20
CHUNK_BYTES = 8 << 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_BYTES = np.random.default_rng(50).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Odd factors of the substring hashes, one for each size.
_FACTOR = {int(i): np.uint64(int(x) | 1) for i, x in enumerate(np.random.default_rng(51).integers(0, 1 << 64, 256, dtype=np.uint64))}


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b
    x ^= x >> np.uint64(31)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def window_hashes(raw: bytes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window, least gram hash of each window); both empty for short texts."""
    n = len(raw)
    if n < width:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    by_size = {1: _BYTES[np.frombuffer(raw, np.uint8)]}

    def of(size: int) -> np.ndarray:
        """Hashes of all substrings of a size, from two overlapping halves of a power of two."""
        if size not in by_size:
            half = 1 << (size - 1).bit_length() - 1
            part = of(half)
            joined = part[: n - size + 1] * _FACTOR[size % 256]
            joined += part[size - half : size - half + n - size + 1]
            by_size[size] = joined
        return by_size[size]

    low = of(gram) ^ (of(gram) >> np.uint64(31))
    low *= _C
    low ^= low >> np.uint64(29)
    span, size = width - gram + 1, 1
    whole = of(width)
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = span - size
    return whole, np.minimum(low[: n - width + 1], low[rest : rest + n - width + 1])


def pieces(raw: bytes, width: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first position, window hashes, digits) of a text in pieces of bounded size."""
    for at in range(0, max(1, len(raw) - width + 1), PIECE_BYTES):
        whole, low = window_hashes(raw[at : at + PIECE_BYTES + width - 1], width, gram)
        if len(whole):
            yield at, whole, low


def runs(raw: bytes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digit, hash of the covered bytes, first window, windows) of each run of a text."""
    out = []
    for at, whole, low in pieces(raw, width, gram):
        starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        ends = np.concatenate([starts[1:], [len(low)]])
        if (ends - starts).max() > width:  # what two windows at its ends cover is at most this long
            place = np.arange(len(low)) - np.repeat(starts, ends - starts)
            starts = np.flatnonzero(place % width == 0)
            ends = np.r_[starts[1:], len(low)]
        digit = _mix(low[starts], np.full(len(starts), _B))
        covered = _mix(_mix(whole[starts], whole[ends - 1]), (ends - starts).astype(np.uint64))
        out.append((digit, _mix(digit, covered), starts + at, ends - starts))
    if not out:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def least_by(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, least id of each, greatest id of each)."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(k)] - 1 if len(k) else first
    return k[first], i[first], i[last]


def looked_up(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of each key in the sorted ``known``, whether it is there)."""
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)


class Chunk:
    """The runs of a chunk's documents."""

    def __init__(self, table: pa.Table, width: int, gram: int):
        self.table, self.width, self.gram = table, width, gram
        self.ids = table.column("doc_id").to_pylist()
        found = [self.of(i) for i in range(len(self.ids))]
        self.digit, self.cover, self.first, self.count = (
            tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else runs(b"", width, gram)
        )
        self.row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        self.doc = np.array([i if i is not None else 0 for i in self.ids], np.int64)[self.row]
        self.covers, self.least, _ = least_by(self.cover, self.doc)

    def raw(self, row: int) -> bytes:
        return self.table.column("raw")[row].as_py() or b""

    def of(self, row: int) -> tuple:
        """A document without an id has no place in the order and takes no part."""
        return runs(self.raw(row) if self.ids[row] is not None else b"", self.width, self.gram)

    def settle(self, verdicts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(runs that repeat a smaller document, runs to be told apart window by window)."""
        least, mixed = self.least.copy(), np.zeros(len(self.covers), bool)
        at, there = looked_up(verdicts["key"], self.covers)
        np.minimum.at(least, at[there], verdicts["least"][there])
        mixed[at[there]] = verdicts["mixed"][there]
        where = np.searchsorted(self.covers, self.cover)
        gone = self.doc > least[where]
        return gone, ~gone & mixed[where]

    def windows(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, position) of every window of the marked runs."""
        keys, rows, places = [], [], []
        chosen = np.flatnonzero(open_)
        for row in np.unique(self.row[chosen]):
            mine = chosen[self.row[chosen] == row]
            first, count = self.first[mine], self.count[mine]
            place = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            for at, whole, _ in pieces(self.raw(row), self.width, self.gram):
                inside = place[(place >= at) & (place < at + len(whole))]
                keys.append(whole[inside - at])
                rows.append(np.full(len(inside), row))
                places.append(inside)
        if not keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(places)


def _dealt(chunk: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """A row per bucket that is hit, each column packed."""
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    cut = first[1:]
    packed = {k: [x.tobytes() for x in np.split(v[order], cut)] if len(names) else [] for k, v in columns.items()}
    return pa.table({
        "bucket": pa.array(names, pa.int32()), "chunk": pa.array(np.full(len(names), chunk), pa.int32()),
        **{k: pa.array(v, pa.binary()) for k, v in packed.items()},
    })


def _unpacked(table: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a packed column."""
    parts = [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
    if not parts:
        return np.empty(0, kind), np.empty(0, np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


VERDICT = "chunk int, kind int, keys binary, least binary, mixed binary"


def _verdicts(table: pa.Table, kind: int) -> dict[str, np.ndarray]:
    mine = table.filter(pa.compute.equal(table.column("kind"), kind))
    return {
        "key": _unpacked(mine, "keys", np.uint64)[0], "least": _unpacked(mine, "least", np.int64)[0],
        "mixed": _unpacked(mine, "mixed", np.uint8)[0].astype(bool),
    }


def _answers(chunks: np.ndarray, kind: int, keys: np.ndarray, least: np.ndarray, mixed: np.ndarray) -> pa.Table:
    packed = _dealt(0, chunks, {"keys": keys, "least": least, "mixed": mixed.astype(np.uint8)})
    return pa.table({
        "chunk": packed.column("bucket"), "kind": pa.array(np.full(packed.num_rows, kind), pa.int32()),
        **{k: packed.column(k) for k in ("keys", "least", "mixed")},
    })


def repeated_spans(
    docs: DataFrame,
    width: int = WIDTH,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int | None = None,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``: one row per row of ``docs``.

    A byte is removed if a window of ``width`` bytes covers it that also starts in a
    document of a smaller id. ``spans`` are the maximal removed runs as ``low, high`` byte
    positions, end exclusive. Texts are UTF-8 bytes; null is empty. Rows that share an id
    do not count against each other, so repeated rows have equal results; rows without an
    id neither lose anything nor take part. An empty table gives no rows; other columns
    play no part. ``parts`` sets how many chunks and buckets there are, by default one of each
    for ``CHUNK_BYTES`` of text: a chunk is what one task holds at a time.

    All passes are one plan, in which the shuffle that deals the texts into chunks stands
    once and is read by each pass; a lost executor costs its part of that shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    if parts is None:
        parts = math.ceil((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) / CHUNK_BYTES)
    n_chunks = n_buckets = max(1, parts)
    buckets = np.uint64(n_buckets)
    chunked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("raw"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n_chunks)).cast("int").alias("chunk"),
    )

    def short(digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((digit >> np.uint64(32)) % buckets).astype(np.int64), (digit & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def first_digits(key: tuple, table: pa.Table) -> pa.Table:
        held = Chunk(table, width, gram)
        digit, low, high = least_by(held.digit, held.doc)
        bucket, value = short(digit)
        return _dealt(key[0].as_py(), bucket, {"keys": value, "many": (low != high).astype(np.uint8)})

    def first_bucket(key: tuple, table: pa.Table) -> pa.Table:
        keys, row = _unpacked(table, "keys", np.uint32)
        many = _unpacked(table, "many", np.uint8)[0]
        _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
        again = count > 1
        again[at[many > 0]] = True
        stay = again[at]
        back = _dealt(key[0].as_py(), table.column("chunk").to_numpy()[row[stay]], {"keys": keys[stay]})
        return pa.table({"chunk": back.column("bucket"), "bucket": back.column("chunk"), "keys": back.column("keys")})

    def second_digits(key: tuple, table: pa.Table, alive: pa.Table) -> pa.Table:
        held = Chunk(table, width, gram)
        kept, row = _unpacked(alive, "keys", np.uint32)
        kept = np.sort((alive.column("bucket").to_numpy().astype(np.uint64)[row] << np.uint64(32)) | kept) if len(kept) else np.empty(0, np.uint64)
        bucket, value = short(held.digit)
        _, on = looked_up((bucket.astype(np.uint64) << np.uint64(32)) | value, kept)
        cover, least, _ = least_by(held.cover[on], held.doc[on])
        order = np.argsort(held.cover[on], kind="stable")
        digit = held.digit[on][order][np.searchsorted(held.cover[on][order], cover)]
        return _dealt(_chunk_of(key, table, alive), short(digit)[0], {"digit": digit, "keys": cover, "least": least})

    def second_bucket(table: pa.Table) -> pa.Table:
        digit, row = _unpacked(table, "digit", np.uint64)
        cover, least = _unpacked(table, "keys", np.uint64)[0], _unpacked(table, "least", np.int64)[0]
        covers, lowest, _ = least_by(cover, least)
        at = np.searchsorted(covers, cover)
        # A digit is mixed if it has more than one kind of run.
        order = np.lexsort((cover, digit))
        d, c = digit[order], cover[order]
        kinds = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])]) if len(d) else np.empty(0, np.int64)
        names, count = np.unique(d[kinds], return_counts=True)
        mixed = count[np.searchsorted(names, digit)] > 1 if len(names) else np.zeros(0, bool)
        tell = mixed | (lowest[at] < least)
        return _answers(table.column("chunk").to_numpy()[row[tell]], 2, cover[tell], lowest[at][tell], mixed[tell])

    def full_depth(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        held = Chunk(table, width, gram)
        _, open_ = held.settle(_verdicts(told, 2))
        keys, row, _ = held.windows(open_)
        keys, least, _ = least_by(keys, np.array([i or 0 for i in held.ids], np.int64)[row])
        return _dealt(_chunk_of(key, table, told), ((keys >> np.uint64(32)) % buckets).astype(np.int64), {"keys": keys, "least": least})

    def last_bucket(table: pa.Table) -> pa.Table:
        keys, row = _unpacked(table, "keys", np.uint64)
        least = _unpacked(table, "least", np.int64)[0]
        known, lowest, _ = least_by(keys, least)
        found = lowest[np.searchsorted(known, keys)] if len(known) else least
        tell = found < least
        return _answers(table.column("chunk").to_numpy()[row[tell]], 3, keys[tell], found[tell], np.zeros(int(tell.sum()), bool))

    def removed(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        held = Chunk(table, width, gram)
        gone, open_ = held.settle(_verdicts(told, 2))
        keys, rows, places = held.windows(open_)
        numbers = np.array([i or 0 for i in held.ids], np.int64)
        known, least, _ = least_by(keys, numbers[rows])
        last = _verdicts(told, 3)
        at, there = looked_up(last["key"], known)
        np.minimum.at(least, at[there], last["least"][there])
        hit = numbers[rows] > least[np.searchsorted(known, keys)] if len(known) else np.zeros(0, bool)
        out = []
        rows, places = rows[hit], places[hit]
        order = np.argsort(rows, kind="stable")
        rows, places = rows[order], places[order]
        run_rows, run_first, run_count = held.row[gone], held.first[gone], held.count[gone]
        for i in range(len(held.ids)):
            raw = held.raw(i)
            edge = np.zeros(len(raw) + 1, np.int64)
            low, high = np.searchsorted(rows, [i, i + 1])
            edge[places[low:high]] += 1  # positions are distinct
            edge[places[low:high] + width] -= 1
            low, high = np.searchsorted(run_rows, [i, i + 1])
            edge[run_first[low:high]] += 1
            edge[run_first[low:high] + run_count[low:high] - 1 + width] -= 1
            covered = np.cumsum(edge) > 0
            turns = np.flatnonzero(np.diff(np.r_[False, covered[:-1], False].astype(np.int8)))
            spans = turns.reshape(-1, 2)
            digest, at_ = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(raw[at_:a])
                at_ = b
            digest.update(raw[at_:])
            out.append((held.ids[i], len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest(), [{"low": int(a), "high": int(b)} for a, b in spans]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    by_chunk = chunked.groupBy("chunk")
    alive = by_chunk.applyInArrow(first_digits, "bucket int, chunk int, keys binary, many binary").groupBy("bucket").applyInArrow(
        first_bucket, "chunk int, bucket int, keys binary"
    )
    told = (
        by_chunk.cogroup(alive.groupBy("chunk"))
        .applyInArrow(second_digits, "bucket int, chunk int, digit binary, keys binary, least binary")
        .groupBy("bucket").applyInArrow(second_bucket, VERDICT)
    )
    last = (
        by_chunk.cogroup(told.groupBy("chunk"))
        .applyInArrow(full_depth, "bucket int, chunk int, keys binary, least binary")
        .groupBy("bucket").applyInArrow(last_bucket, VERDICT)
    )
    return by_chunk.cogroup(told.unionByName(last).groupBy("chunk")).applyInArrow(
        removed,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<low:bigint,high:bigint>>",
    )


def _chunk_of(key: tuple, *tables: pa.Table) -> int:
    return next((t.column("chunk")[0].as_py() for t in tables if t.num_rows), key[0].as_py() if key else 0)
