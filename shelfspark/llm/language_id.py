"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weighted character n-grams (hashed, of length 1 to 3) of whole texts.
Document frequencies cover every row that may be learnt from; the regression itself is
fitted on a bounded sample of them with follow-the-regularised-leader and elastic-net
penalties, and a temperature fitted on held-back sample rows calibrates its scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 1 << 15
SAMPLE_ROWS = 4_000
MAX_LANGS = 200
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
PIECE_CHARS = 1 << 18
NONE = "und"
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of the n-grams of a text in lower case; None without any letter.

    Runs of what is no letter count as one blank. Long texts are read in pieces that
    overlap by the length of an n-gram less one.
    """
    total, letters = np.zeros(BUCKETS, np.int64), False
    kept = np.array([32], np.uint32)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for part in range(0, len(text), PIECE_CHARS):
        piece = text[part : part + PIECE_CHARS].lower()
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        named = points > 127
        low = (points >= 97) & (points <= 122)
        if named.any():
            unique, where = np.unique(points[named], return_inverse=True)
            named[named] = np.array([chr(x).isalpha() for x in unique])[where]
        is_letter = low | named
        letters = letters or bool(is_letter.any())
        clean = np.where(is_letter, points, 32).astype(np.uint32)
        stay = is_letter.copy()
        stay[1:] |= is_letter[:-1]
        if len(stay):
            stay[0] |= kept[-1] != 32
        clean = np.concatenate([kept, clean[stay]]).astype(np.uint64)
        new = len(clean) - len(kept)
        for n in range(1, 4):
            size = min(len(clean) - n + 1, new)
            if size > 0:
                start = len(clean) - n + 1 - size
                code = clean[start : start + size] * _MIX[0]
                for k in range(1, n):
                    code = (code ^ (code >> np.uint64(29))) * _MIX[k] + clean[start + k : start + k + size] * _MIX[0]
                code = (code ^ (code >> np.uint64(32))) * _MIX[n - 1]
                total += np.bincount((code >> shift).astype(np.int64), minlength=BUCKETS)
        kept = clean[-2:].astype(np.uint32)
    if not letters:
        return None
    where = np.flatnonzero(total)
    return where, total[where]


@dataclass
class Model:
    """``weights`` has a row per bucket and a column per language; ``bias`` and ``temperature`` are its own."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = (1 + np.log(counts)) * self.idf[where]
        return values / max(float(np.sqrt(values @ values)), 1e-12)

    def logits(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(where, counts) @ self.weights[where] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = gram_counts(text) if text and self.langs else None
        if found is None:
            return NONE, 0.0
        p = softmax(self.logits(*found) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> None:
    """Follow-the-regularised-leader over ``rows`` of (language, buckets, counts); sets the weights."""
    n_langs = len(model.langs)
    z, n = np.zeros((BUCKETS + 1, n_langs)), np.zeros((BUCKETS + 1, n_langs))

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            # Made anew in each epoch: many small arrays that are held leave the driver's memory in pieces.
            y, where, counts = rows[k]
            at, x = np.append(where, BUCKETS), np.append(model.features(where, counts), 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squared
    full = weights(slice(None))
    model.weights, model.bias = full[:-1].astype(np.float32), full[-1]


def fit_temperature(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """The temperature of least log loss on ``rows``, by golden section on its logarithm.

    Targets are smoothed by one row in all, so that rows without an error leave a finite
    temperature.
    """
    logits = np.array([model.logits(w, c) for _, w, c in rows])
    y = np.array([r[0] for r in rows])
    if len(model.langs) < 2 or not rows:
        return
    smooth = 1 / (len(rows) + 2)

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        top = s.max(1)
        log_p = s - (np.log(np.exp(s - top[:, None]).sum(1)) + top)[:, None]
        own = log_p[np.arange(len(y)), y]
        others = (log_p.sum(1) - own) / max(1, log_p.shape[1] - 1)
        return -float(((1 - smooth) * own + smooth * others).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    model.temperature = float(np.exp((low + high) / 2))


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all ``texts.text`` hold each bucket, and how many have letters.

    Every task sums its rows first; the result is as long as there are buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for value in batch.column(0):
                found = gram_counts(value.as_py() or "")
                if found is not None:
                    held[found[0]] += 1
                    held[BUCKETS] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["bucket", "n"])

    summed = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow()
    held = np.zeros(BUCKETS + 1, np.int64)
    held[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return held[:BUCKETS], int(held[BUCKETS])


def fit(learn: DataFrame, sample_rows: int = SAMPLE_ROWS, max_langs: int = MAX_LANGS) -> Model:
    """A model from ``learn`` (``key, text, lang``).

    Of each of the ``max_langs`` most frequent languages about an equal share of
    ``sample_rows`` rows is fitted on, chosen by a hash of ``key``; rarer labels are not
    learnt. Document frequencies are those of all rows.
    """
    labelled = learn.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    langs = sorted(r["lang"] for r in counts)
    empty = Model(langs, np.zeros(BUCKETS), np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs)), 1.0)
    if not langs:
        return empty
    held, total = document_frequencies(labelled)
    empty.idf = np.log((1 + total) / (1 + held)) + 1
    share = sample_rows / len(langs)
    part = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, share / r["count"]))))
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.where(draw < F.element_at(part, F.col("lang"))).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang.as_py(), gram_counts(text.as_py())) for text, lang in zip(*batch.columns, strict=True)]
            rows = [(lang, *found) for lang, found in rows if found is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                ],
                names=["lang", "buckets", "counts"],
            )

    drawn = chosen.mapInArrow(run, "lang string, buckets array<int>, counts array<int>").limit(sample_rows * 2).toArrow()
    number = {x: i for i, x in enumerate(langs)}
    buckets, counted = (drawn.column(c).combine_chunks() for c in ("buckets", "counts"))
    ends = buckets.offsets.to_numpy()  # of both: a count stands beside each bucket
    buckets, counted = buckets.values.to_numpy(), counted.values.to_numpy()
    rows = [
        (number[lang], buckets[low:high], counted[low:high])
        for lang, low, high in zip(drawn.column("lang").to_pylist(), ends, ends[1:], strict=False)
    ]
    rows.sort(key=lambda r: (r[0], len(r[1]), int(r[1].sum()), int(r[2].sum())))  # tasks end in any order
    fit_ftrl(empty, [r for i, r in enumerate(rows) if i % 8] or rows)
    fit_temperature(empty, rows[::8])
    return empty


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score`` behind its columns (which replace columns of these names).

    Without a letter, with a null text or with nothing learnt: ``und`` and 0.
    """
    # Bounded: buckets times languages. Plain values, as workers need no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(Model)))
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text_col)
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = StructType(list(rows.schema.fields)).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            found = [known.predict(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*names, "lang_pred", "score"],
            )

    return rows.mapInArrow(run, schema)


def language_ids(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: one row per row of ``docs``.

    Learns from rows that are not held out and have a text and a label; label and id are
    no inputs of a prediction. Repeated rows give repeated results, an empty table gives
    none, other columns play no part.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows.where(~held_out("doc_id")).select(F.col("doc_id").alias("key"), "text", "lang"), sample_rows)
    return identify(rows.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")
