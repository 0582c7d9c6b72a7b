"""Token counts by overlap resynchronisation.

Short documents are counted in one piece. A huge document is encoded in overlapping
chunks with offsets. Two neighbouring encodings are spliced at a character position
where both start a token behind white space and agree, token for token, on both sides
of it; where no such position lies in the overlap the overlap is widened, in the end
to the whole text, so the count always is the one of the undivided text.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 512
AGREE_TOKENS = 4
MEMO_WORDS = 1_000_000
SPACES = " \t\n\r\x0b\x0c"

Encoding = tuple[np.ndarray, np.ndarray, np.ndarray]


def common_boundary(left: Encoding, right: Encoding, text: str, low: int, high: int, agree: int) -> int | None:
    """A position in [low, high) where both encodings may be spliced, or None.

    Encodings are (ids, starts, ends) with positions in ``text``. At the position both
    start a token, white space stands before it or opens it, and ``agree`` tokens before
    and behind it are the same in both.
    """
    ids_a, starts_a, ends_a = left
    ids_b, starts_b, ends_b = right
    shared = np.intersect1d(starts_a[(starts_a >= low) & (starts_a < high)], starts_b)
    middle = (low + high) / 2
    for p in sorted(shared.tolist(), key=lambda x: abs(x - middle)):
        if p == 0 or not (text[p - 1] in SPACES or text[p] in SPACES):
            continue
        a, b = int(np.searchsorted(starts_a, p)), int(np.searchsorted(starts_b, p))
        if min(a, b) < agree or min(len(ids_a) - a, len(ids_b) - b) < agree:
            continue
        one, two = slice(a - agree, a + agree), slice(b - agree, b + agree)
        if (
            np.array_equal(ids_a[one], ids_b[two])
            and np.array_equal(starts_a[one], starts_b[two])
            and np.array_equal(ends_a[one], ends_b[two])
        ):
            return p
    return None


def spliced_count(
    encode: Callable[[str], Encoding],
    text: str,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    agree: int = AGREE_TOKENS,
) -> tuple[int, int]:
    """(tokens of ``text``, widenings). ``encode`` gives ids and character offsets of a piece."""

    def at(low: int, high: int) -> Encoding:
        ids, starts, ends = encode(text[low:high])
        return ids, starts + low, ends + low

    low, high, start = 0, min(chunk, len(text)), 0
    total = widened = 0
    current = at(low, high)
    while high < len(text):
        width = overlap
        while True:
            next_low, next_high = max(low, high - width), min(len(text), high + chunk)
            following = at(next_low, next_high)
            cut = common_boundary(current, following, text, max(next_low, start), high, agree)
            if cut is not None:
                break
            widened += 1
            if next_low == low:  # it holds all of the current chunk, which it replaces
                cut = start
                break
            width *= 2
        starts = current[1]
        total += int(np.count_nonzero((starts >= start) & (starts < cut)))
        start, low, high, current = cut, next_low, next_high, following
    return total + int(np.count_nonzero(current[1] >= start)), widened


def drops_white_space(spec: dict) -> bool:
    """Whether the tokenizer file proves that words between ASCII white space are encoded alone.

    That holds where the pre-tokenizer keeps only matches of a pattern none of whose
    alternatives can match white space, nothing is prefixed, and normalisers are local.
    """
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    split = parts[0] if parts else {}
    pattern = (split.get("pattern") or {}).get("Regex", "")
    normal = spec.get("normalizer") or {}
    kinds = {x.get("type") for x in normal.get("normalizers", [normal]) if x}
    return (
        split.get("type") == "Split"
        and split.get("invert") is True
        and split.get("behavior") == "Removed"
        and all(x.get("add_prefix_space", False) is False for x in parts)
        and kinds <= {"NFC", "Replace", "Lowercase"}
        and r"[^\s\p{L}\p{N}]+" in pattern
        and r"\s" not in pattern.replace(r"[^\s", "")
        and "." not in pattern
        and " " not in pattern
    )


def _counter(path: str, chunk: int, overlap: int, agree: int) -> Callable[[bytes], tuple[int, int]]:
    """bytes of a text -> (tokens, widenings), by the library that the file belongs to."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)

        def piece_encode(text: str) -> Encoding:
            found = pieces.encode(text, out_type="immutable_proto").pieces
            return (
                np.array([x.id for x in found], dtype=np.int64),
                np.array([x.begin for x in found], dtype=np.int64),
                np.array([x.end for x in found], dtype=np.int64),
            )

        def count_pieces(raw: bytes) -> tuple[int, int]:
            # A model's dummy prefix and space rules are not local: whole texts only.
            return len(pieces.encode(raw.decode("utf-8", "replace"))), 0

        return count_pieces

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def encode(text: str) -> Encoding:
        got = library.encode(text, add_special_tokens=False)
        offsets = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)
        return np.array(got.ids, dtype=np.int64), offsets[:, 0], offsets[:, 1]

    with open(path, encoding="utf-8") as file:
        by_word = drops_white_space(json.load(file))
    memo: dict[bytes, int] = {}

    def count(raw: bytes) -> tuple[int, int]:
        if len(raw) > chunk and len(text := raw.decode("utf-8", "replace")) > chunk:
            return spliced_count(encode, text, chunk, overlap, agree)
        if not by_word:
            return len(library.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids), 0
        words = raw.split()
        new = list(set(words).difference(memo))
        if not new:
            return sum(map(memo.__getitem__, words)), 0
        found = library.encode_batch_fast([x.decode("utf-8", "replace") for x in new], add_special_tokens=False)
        fresh = dict(zip(new, (len(x) for x in found), strict=True))
        total = sum(memo[x] if x in memo else fresh[x] for x in words)
        if len(memo) < MEMO_WORDS:  # frequent words come early; a full memo is kept
            memo.update(fresh)
        return total, 0

    return count


def _kept_counter(*settings) -> Callable[[bytes], tuple[int, int]]:
    """The counter of this Python worker: Spark reuses workers, so its memo outlives a task."""
    kept = sys.modules.setdefault("_shelfspark_counters", types.ModuleType("_shelfspark_counters")).__dict__
    if settings not in kept:
        kept[settings] = _counter(*settings)
    return kept[settings]


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    agree: int = AGREE_TOKENS,
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit, n_widened``, one row per row of ``docs``.

    ``tokenizer`` is the path of a vocabulary file that every worker can open (.json or
    .model). A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated
    results, a null id stays null, an empty table gives no rows, and other columns of
    ``docs`` play no part. ``n_widened`` tells how often an overlap had to be widened.
    Words of texts below ``chunk`` characters are remembered by each worker (a bounded
    memo) where the file proves that white space separates them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _kept_counter(tokenizer, chunk, overlap, agree)
        for batch in batches:
            sizes, tokens, widened = [], [], []
            for value in batch.column(1):
                raw = value.as_py() or b""
                n, wide = count(raw)
                sizes.append(len(raw))
                tokens.append(n)
                widened.append(wide)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                    pa.array(widened, pa.int64()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_widened"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("raw"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_widened bigint"
    )
