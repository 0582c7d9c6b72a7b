"""Cross-tokenizer alignment counts by minimal perfect hashing of distinct pairs.

Two tokenizers cut the same bytes. Where tokens of both end at one place, a group ends;
tokens of a group whose bytes overlap are linked. First pass: blocks of documents are
aligned and give their distinct (A id, B id) pairs with counts. The distinct pairs of the
corpus are dealt into shards, each with a minimal perfect hash; counts become dense vectors
indexed by it, which are summed in a tree. Second pass: blocks, whose token ids the first pass
has written, are linked again and look up the corpus-wide counts of their pairs; each lookup
is verified against the key stored at its place.

Text is cut into units at single blanks between other characters. Both tokenizers start a
token at such a blank (their files are checked for it), so units are encoded alone and a
worker remembers the short ones.
"""

from __future__ import annotations

import contextlib
import gc
import json
import math
import re
import sys
import types
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.perfect_hash import PerfectHash, VerifiedIndex
from shelfspark.session import cut_lineage

#: Bytes of text that a block of documents holds on average.
BLOCK_BYTES = 4 << 20
#: Distinct pairs of a shard, on average.
SHARD_KEYS = 1 << 17
#: Counted pairs that meet a shard's hash in one task, on average.
GROUP_ROWS = 1 << 20
#: Vectors that one step of the tree adds up.
FAN = 16
#: Bounds of a worker's memory of units.
MEMO_UNITS = 100_000
MEMO_BYTES = 48

SPACE_MARK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Encoder:
    """A tokenizer file as ``encode`` (lists of units, a blank before each, to lists of ids) and ``spell`` (id to bytes).

    ``by_unit`` tells whether the file proves that a token starts at a single blank between
    two other characters, so that units may be encoded alone.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            self._pieces(path)
        else:
            self._byte_level(path)
        self.width = np.array([len(x) for x in self.spell], dtype=np.int64)
        self.before_comma, self.before_bar, self.before_semicolon = (
            np.array([f"{i}{mark}" for i in range(len(self.spell))], dtype=object) for mark in ",|;"
        )

    def _byte_level(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or model.get("type") != "BPE":
            raise ValueError(f"{path} is not a byte-level vocabulary")
        self.by_unit = pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        letters, vocabulary = byte_letters(), model["vocab"]
        ranks = {bytes(letters[c] for c in token): number for token, number in vocabulary.items()}
        self.spell = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            self.spell[number] = token
        merged = [vocabulary["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
        if self.by_unit and merged == sorted(set(merged)) and all(bytes([b]) in ranks for b in range(256)):
            # Merges rank as the ids do, so the faster library for ranks gives the same encodings.
            import public_tokenizers
            import tiktoken

            ranked = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            encode = ranked._core_bpe.encode_ordinary  # units are whole UTF-8 texts, which the outer method would check
            self.encode = lambda units: [encode(" " + u) for u in units]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            library.encode_special_tokens = True
            self.encode = lambda units: [x.ids for x in library.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]

    def _pieces(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules = proto.normalizer_spec
        if not rules.add_dummy_prefix or rules.remove_extra_whitespaces:
            raise ValueError(f"{path} does not open texts with a blank, or drops blanks")
        inner = any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p.piece) for p in proto.pieces)
        own = any(p.type == p.USER_DEFINED for p in proto.pieces)
        self.by_unit = proto.trainer_spec.model_type == proto.trainer_spec.BPE and not rules.precompiled_charsmap and not inner and not own
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spell = [
            bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(SPACE_MARK, " ").encode() for p in proto.pieces
        ]
        self.encode = lambda units: library.encode(units, num_threads=1)


class Numbering(dict):
    """Numbers keys in the order in which they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as planes of bytes, of which the upper ones are mostly zero, compressed."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Links:
    """The distinct units of a block, aligned: one flat array per side, and where both sides end."""

    def __init__(self, n_a: np.ndarray, ids_a: np.ndarray, n_b: np.ndarray, ids_b: np.ndarray, a: Encoder, b: Encoder):
        self.n_a, self.n_b, self.a, self.b = (x.astype(np.int64) for x in (n_a, n_b, ids_a, ids_b))
        # Both sides cover the same bytes, so the place of a byte in the block tells all.
        ends_a, ends_b = np.cumsum(a.width[self.a]), np.cumsum(b.width[self.b])
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        first = np.r_[True, both[1:] != both[:-1]][: len(both)]
        ends, shared = both[first], both[~first]  # a link for each stretch of bytes between two ends
        self.link_a, self.link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.group_a, self.group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        unit_a = np.repeat(np.arange(len(n_a)), self.n_a)
        self.owner = unit_a[self.link_a]
        self.pairs = self.a[self.link_a] << 32 | self.b[self.link_b]
        self.n_links = np.bincount(self.owner, minlength=len(n_a))
        self.n_groups = np.bincount(unit_a[np.searchsorted(ends_a, shared)], minlength=len(n_a))

    @classmethod
    def of(cls, ids_a: list[list[int]], ids_b: list[list[int]], a: Encoder, b: Encoder) -> Links:
        flat = lambda ids: (np.fromiter(map(len, ids), np.int32, len(ids)), np.fromiter(chain.from_iterable(ids), np.int32))
        return cls(*flat(ids_a), *flat(ids_b), a, b)

    def pack(self) -> list[bytes]:
        """What ``unpack`` needs to align the units again without their texts."""
        return [_packed(x) for x in (self.n_a, self.a, self.n_b, self.b)]

    @classmethod
    def unpack(cls, packed: list[bytes], a: Encoder, b: Encoder) -> Links:
        return cls(*map(_unpacked, packed), a, b)

    def shown(self, a: Encoder, b: Encoder) -> list[str]:
        """The groups of each unit as text, each followed by a semicolon."""
        last_a, last_b = np.r_[self.group_a[1:] != self.group_a[:-1], True], np.r_[self.group_b[1:] != self.group_b[:-1], True]
        pieces = np.concatenate([np.where(last_a, a.before_bar[self.a], a.before_comma[self.a]), np.where(last_b, b.before_semicolon[self.b], b.before_comma[self.b])])
        order = np.argsort(np.concatenate([self.group_a, self.group_b]), kind="stable")
        pieces, cuts = pieces[order].tolist(), np.r_[0, np.cumsum(self.n_a + self.n_b)].tolist()
        return ["".join(pieces[low:high]) for low, high in zip(cuts, cuts[1:])]


def _unit_ends(ids: list[list[int]], width: np.ndarray) -> np.ndarray:
    """Where each unit ends among the bytes of all."""
    held = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
    return np.r_[0, np.cumsum(width[np.fromiter(chain.from_iterable(ids), np.int64)])][held]


@contextlib.contextmanager
def _no_collections():
    """Without the cycle collector, which would walk the many small lists of a block again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Aligner:
    """Two encoders; what they make of short units is remembered."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a), Encoder(path_b)
        self.by_unit = self.a.by_unit and self.b.by_unit
        self.memo: dict[str, tuple[list[int], list[int]]] = {}

    def block(self, texts: Iterable[bytes | None]) -> tuple[list[np.ndarray | None], Links]:
        """Numbers of the units of each text, None where it has no tokens, and the alignment of all units."""
        with _no_collections():
            return self._block(texts)

    def _block(self, texts: Iterable[bytes | None]) -> tuple[list[np.ndarray | None], Links]:
        numbers, cut = Numbering(), []
        for raw in texts:
            try:
                text = raw.decode() if raw else ""
            except UnicodeDecodeError:
                text = ""
            units = (_CUT.split(text) if self.by_unit else [text]) if text else None
            cut.append(units and np.fromiter(map(numbers.__getitem__, units), np.int32, len(units)))
        units = list(numbers)
        ids_a, ids_b = self.encoded(units)
        broken = self.broken(units, ids_a, ids_b)
        if broken:
            for i in broken:
                ids_a[i], ids_b[i] = [], []
            lost = np.zeros(len(units), dtype=bool)
            lost[broken] = True
            cut = [None if at is None or lost[at].any() else at for at in cut]
        return cut, Links.of(ids_a, ids_b, self.a, self.b)

    def encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        found = [self.memo.get(u) for u in units]
        new = [i for i, x in enumerate(found) if x is None]
        for low in range(0, len(new), 4096):
            some = new[low : low + 4096]
            fresh = [units[i] for i in some]
            for i, u, pair in zip(some, fresh, zip(self.a.encode(fresh), self.b.encode(fresh), strict=True), strict=True):
                found[i] = pair
                if len(self.memo) < MEMO_UNITS and len(u) <= MEMO_BYTES:
                    self.memo[u] = pair
        return [x[0] for x in found], [x[1] for x in found]

    def broken(self, units: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[int]:
        """Units that an encoding does not spell byte for byte."""
        spelled = lambda ids, spell: b"".join([spell[i] for i in ids])
        whole = " ".join(["", *units]).encode()
        if spelled(chain.from_iterable(ids_a), self.a.spell) == whole == spelled(chain.from_iterable(ids_b), self.b.spell):
            # The joins agree, and so do the units, if each also ends where it should.
            ends = np.cumsum(np.fromiter((1 + len(u.encode()) for u in units), np.int64, len(units)))
            if all(np.array_equal(_unit_ends(x, e.width), ends) for e, x in ((self.a, ids_a), (self.b, ids_b))):
                return []
        return [
            i for i, u in enumerate(units)
            if not spelled(ids_a[i], self.a.spell) == b" " + u.encode() == spelled(ids_b[i], self.b.spell)
        ]


#: Kinds of rows of the first pass.
_PAIR, _UNITS, _TEXT = range(3)


def _values(column: pa.ChunkedArray) -> Iterator[bytes | None]:
    return (x.as_py() for x in column)


def _kept_aligner(*paths: str) -> Aligner:
    """The aligner of this Python worker: Spark reuses workers, so its memory outlives a task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.modules.setdefault("_shelfspark_aligners", types.ModuleType("_shelfspark_aligners")).__dict__
    if paths not in kept:
        kept[paths] = Aligner(*paths)
    return kept[paths]


def count_pairs(cut: list[np.ndarray | None], links: Links) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs of the texts and how many links hold each."""
    held = [at for at in cut if at is not None]
    times = np.bincount(np.concatenate(held), minlength=len(links.n_a)) if held else np.zeros(len(links.n_a), dtype=np.int64)
    used = times[links.owner] > 0  # units that only texts without tokens hold count nowhere
    pairs, at = np.unique(links.pairs[used], return_inverse=True)
    counts = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(counts, at, times[links.owner[used]])
    return pairs, counts


def look_up(
    aligner: Aligner, cut: list[np.ndarray | None], links: Links, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray
) -> Iterator[tuple[int, int, int, int, int, int, str]]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each text; ``pairs`` is sorted."""
    place = np.minimum(np.searchsorted(pairs, links.pairs), max(0, len(pairs) - 1))
    known = pairs[place] == links.pairs if len(pairs) else np.zeros(len(links.pairs), dtype=bool)
    per_unit = lambda values: np.bincount(links.owner[known], values[place[known]], len(links.n_a)) if known.any() else np.zeros(len(links.n_a))
    unknown = np.zeros(len(links.n_a), dtype=bool)
    unknown[links.owner[~known]] = True
    sums = np.zeros(len(links.n_a), dtype=np.int64)
    np.add.at(sums, links.owner[known], counts[place[known]] if known.any() else 0)
    totals = np.stack([links.n_a, links.n_b, links.n_groups, links.n_links, per_unit(best).astype(np.int64), sums], axis=1)
    shown = links.shown(aligner.a, aligner.b)
    for at in cut:
        if at is None:
            yield 0, 0, 0, 0, 0, 0, ""
        elif unknown[at].any():
            raise KeyError("a pair has no count")
        else:
            yield *totals[at].sum(axis=0).tolist(), "".join(map(shown.__getitem__, at.tolist()))[:-1]


def _with_group(parts: DataFrame, shards: int, groups: int) -> DataFrame:
    return parts.withColumns({"shard": _shard(shards), "g": F.pmod("block", F.lit(groups))})


def _shard(shards: int):
    return F.pmod(F.xxhash64("pair"), F.lit(shards)).cast("int")


def _spread(df: DataFrame, groups: int) -> DataFrame:
    """Each shard's row once for every group of blocks."""
    return df.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


def _build(table: pa.Table) -> pa.Table:
    index = VerifiedIndex.of(table["pair"].to_numpy())
    sizes, bits = index.hashed.pack()
    return pa.table({
        "shard": table["shard"].slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()),
        "keys": pa.array([index.keys.tobytes()], pa.binary()),
    })


def _index_of(table: pa.Table) -> VerifiedIndex:
    hashed = PerfectHash.unpack(table["sizes"][0].as_py(), table["bits"][0].as_py())
    return VerifiedIndex(hashed, np.frombuffer(table["keys"][0].as_py(), dtype=np.int64))


_VECTOR = "shard int, g int, vector binary"


def _vector(shard: int, g: int, vector: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "g": pa.array([g], pa.int32()), "vector": pa.array([vector.tobytes()], pa.binary())})


def _count(key: tuple, parts: pa.Table, index: pa.Table) -> pa.Table:
    """The dense counts of one shard from one group of blocks."""
    if not parts.num_rows:
        return _vector(0, 0, np.zeros(0, dtype=np.int64)).slice(0, 0)
    known = _index_of(index)
    vector = np.zeros(len(known.keys), dtype=np.int64)
    np.add.at(vector, known.index(parts["pair"].to_numpy()), parts["n"].to_numpy())
    return _vector(key[0].as_py(), key[1].as_py(), vector)


def _add(key: tuple, vectors: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_py(), dtype=np.int64) for v in vectors["vector"])
    return _vector(key[0].as_py(), key[1].as_py(), total)


def pair_counts(parts: DataFrame, shard_keys: int = SHARD_KEYS, group_rows: int = GROUP_ROWS, fan: int = FAN) -> tuple[DataFrame, int, int]:
    """(``shard, sizes, bits, keys, vector`` of each shard, shards, groups of blocks) from ``parts`` (``block, pair, n``).

    ``keys`` and ``vector`` hold int64 values in hash order: the pairs (A id * 2^32 + B id)
    and their counts over all parts.
    """
    keys = cut_lineage(parts.select("pair").distinct())
    shards = max(1, math.ceil(keys.count() / shard_keys))
    groups = max(1, math.ceil(parts.count() / (shards * group_rows)))
    built = keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(
        _build, "shard int, sizes array<bigint>, bits binary, keys binary"
    )
    hashes = cut_lineage(built)
    met = _with_group(parts, shards, groups).groupBy("shard", "g").cogroup(_spread(hashes, groups).groupBy("shard", "g"))
    vectors = met.applyInArrow(_count, _VECTOR)
    width = groups
    while width > 1:
        width = math.ceil(width / fan)
        vectors = vectors.withColumn("g", F.pmod("g", F.lit(width))).groupBy("shard", "g").applyInArrow(_add, _VECTOR)
    return cut_lineage(hashes.join(vectors.drop("g"), "shard")), shards, groups


def _highest(index: DataFrame) -> dict[int, int]:
    """The highest count of each B id: at most one entry per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, vector in zip(batch["keys"], batch["vector"]):
                b, n = np.frombuffer(keys.as_py(), dtype=np.int64) & 0xFFFFFFFF, np.frombuffer(vector.as_py(), dtype=np.int64)
                ids, at = np.unique(b, return_inverse=True)
                most = np.zeros(len(ids), dtype=np.int64)
                np.maximum.at(most, at, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(most)], names=["b", "n"])

    return {r.b: r.n for r in index.select("keys", "vector").mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.max("n").alias("n")).collect()}


def _answers(parts: DataFrame, index: DataFrame, shards: int, groups: int) -> DataFrame:
    """``block, pair, n, best``: the corpus-wide count of each pair of each block."""
    highest = _highest(index)
    ids = np.array(sorted(highest), dtype=np.int64)
    most = np.array([highest[i] for i in sorted(highest)], dtype=np.int64)
    schema = pa.schema({"block": pa.int32(), "pair": pa.int64(), "n": pa.int64(), "best": pa.bool_()})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return schema.empty_table()
        pairs = asked["pair"].to_numpy()
        counts = np.frombuffer(known["vector"][0].as_py(), dtype=np.int64)[_index_of(known).index(pairs)]
        best = counts == most[np.searchsorted(ids, pairs & 0xFFFFFFFF)]
        return pa.table([asked["block"], pa.array(pairs), pa.array(counts), pa.array(best)], schema=schema)

    met = _with_group(parts, shards, groups).groupBy("shard", "g").cogroup(_spread(index, groups).groupBy("shard", "g"))
    return met.applyInArrow(answer, "block int, pair bigint, n bigint, best boolean")


def align(
    docs: DataFrame,
    tokenizer_a: str,
    tokenizer_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    shard_keys: int = SHARD_KEYS,
    group_rows: int = GROUP_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``, one row per row of ``docs``.

    The tokenizers are paths of vocabulary files that every worker can open: byte-level
    .json files or sentencepiece .model files. Both encode a blank and the text, without
    special tokens; strings of special tokens in texts are plain text. ``groups`` is
    ``a1,a2|b1;a3|b2,b3``, with the ids of each group. Texts that are null, empty, no
    UTF-8, or not spelled byte for byte by both encodings have zeros and no groups, and
    their links count nowhere. Repeated rows give repeated results and count repeatedly,
    a null id stays null, an empty table gives no rows, other columns are not read. Ties
    for a B id's highest count are all best. Texts of any length are aligned whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    bytes_ = rows.agg(F.sum(F.octet_length("raw")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(bytes_ / block_bytes))
    has_text = F.coalesce(F.octet_length("raw") > 0, F.lit(False))
    dealt = rows.where(has_text).withColumn("block", F.pmod(F.xxhash64("id", "raw"), F.lit(blocks)).cast("int"))
    out = pa.schema({n: pa.int64() for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")} | {"groups": pa.string()})
    kinds = f"`{id_col}` {kind}, " + ", ".join(f"{n} {'string' if n == 'groups' else 'bigint'}" for n in out.names)

    # A row of the first pass is a pair of a block, the units of a block (token ids) or a text (units by number; null: no tokens).
    spark_kinds = f"kind int, block int, pair bigint, n bigint, id {kind}, at binary, units array<binary>"

    def first(key: tuple, table: pa.Table) -> pa.Table:
        cut, links = _kept_aligner(tokenizer_a, tokenizer_b).block(_values(table["raw"]))
        pairs, counts = count_pairs(cut, links)
        ids = table["id"].combine_chunks()
        sizes = {_PAIR: len(pairs), _UNITS: 1, _TEXT: len(cut)}
        parts = {
            "pair": (_PAIR, pa.int64(), pairs), "n": (_PAIR, pa.int64(), counts), "units": (_UNITS, pa.list_(pa.binary()), [links.pack()]),
            "id": (_TEXT, ids.type, ids), "at": (_TEXT, pa.binary(), [None if at is None else _packed(at) for at in cut]),
        }
        held = lambda of, type_, values: pa.chunked_array(
            [pa.array(values, type_) if of == some and not isinstance(values, pa.Array) else values if of == some else pa.nulls(n, type_) for some, n in sizes.items()], type_
        )
        columns = {"kind": np.repeat(list(sizes), list(sizes.values())), "block": np.full(sum(sizes.values()), key[0].as_py())}
        out_columns = {n: pa.array(x, pa.int32()) for n, x in columns.items()} | {n: held(*x) for n, x in parts.items()}
        return pa.table({n: out_columns[n] for n in ("kind", "block", "pair", "n", "id", "at", "units")})

    def second(table: pa.Table, answers: pa.Table) -> pa.Table:
        aligner = _kept_aligner(tokenizer_a, tokenizer_b)
        is_text = np.asarray(table["kind"]) == _TEXT
        texts, units = table.filter(pa.array(is_text)), table.filter(pa.array(~is_text))
        links = Links.unpack(units["units"][0].as_py(), aligner.a, aligner.b)
        cut = [None if x is None else _unpacked(x) for x in _values(texts["at"])]
        answers = answers.sort_by("pair")
        pairs, counts, best = (answers[c].to_numpy() for c in ("pair", "n", "best"))
        found = look_up(aligner, cut, links, pairs, counts, best)
        columns = [pa.array(values, f.type) for values, f in zip(zip(*found), out)] or [pa.array([], f.type) for f in out]
        return pa.table([texts["id"], *columns], names=[id_col, *out.names])

    passed = cut_lineage(dealt.select("block", "id", "raw").groupBy("block").applyInArrow(first, spark_kinds))
    parts = passed.where(F.col("kind") == _PAIR).select("block", "pair", "n")
    index, shards, groups = pair_counts(parts, shard_keys, group_rows, fan)
    answers = _answers(parts, index, shards, groups)
    encoded = passed.where(F.col("kind") != _PAIR).select("kind", "block", "id", "at", "units")
    aligned = encoded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(second, kinds)
    bare = rows.where(~has_text).select(
        F.col("id").alias(id_col), *[F.lit(0).cast("bigint").alias(n) for n in out.names[:-1]], F.lit("").alias("groups")
    )
    return aligned.unionAll(bare)
