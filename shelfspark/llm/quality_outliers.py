"""Quality rules by robust multivariate outliers.

Each text gives a vector of statistics. For every language and source the mean and the
covariance of the most concentrated three quarters of its vectors are estimated (minimum
covariance determinant: concentration steps from two starts, the one with the smaller
determinant is taken, then one reweighting), and vectors whose Mahalanobis distance to that
estimate is improbable are rejected.

Everything is DataFrame expressions. Texts are read once; the steps run over a narrow table
of whole numbers, whose sums are exact, so results do not depend on how rows are dealt. A
step sums its rows by (group, start, rounded distance) and never gathers a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

#: Fixed values of the base rules.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: The vector: whole thousandths of these logarithms.
UNIT = 1000
STATISTICS = {
    "v0": "ln(nullif(n_words, 0))",
    "v1": "ln(word_chars / nullif(n_words, 0))",
    "v2": "ln(1 + n_symbols / nullif(n_words, 0))",
    "v3": "ln(1 + n_dup_lines / nullif(n_lines, 0))",
    "v4": "ln(1 + n_repeat_words / nullif(n_words, 0))",
}
#: Standard deviations that are added to every covariance, so that statistics that are nearly always zero stay regular.
FLOORS = (0.3, 0.05, 0.05, 0.1, 0.05)
DIMS = len(STATISTICS)
#: Share of a group that an estimate rests on at least, concentration steps, and steps of log2 by which distances are rounded.
SHARE = 0.75
STEPS = 6
STEPS_PER_LOG = 32
#: Groups below it are pooled by language; pools below it reject nothing.
LEAST_ROWS = 50
#: Tail of the chi-square distribution that is rejected, and that the reweighting leaves out.
TAIL = 1e-6
LEFT_OUT = 0.025
SALTS = 16
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def chi_square(x: float, freedom: int) -> float:
    """Distribution function of the chi-square distribution."""
    total, k = (math.erf(math.sqrt(x / 2)), 1) if freedom % 2 else (1 - math.exp(-x / 2), 2)
    while k < freedom:
        total -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
        k += 2
    return total


def chi_square_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < share else (low, middle)
    return high


def _consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of a normal sample is multiplied by."""
    return share / chi_square(chi_square_quantile(share, DIMS), DIMS + 2)


def _repeats(hashes: Column) -> Column:
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed`` (longs, boolean).

    Words stand between ASCII white space. Windows are compared by 64-bit hashes; only texts
    in which one recurs sort them, which takes n log n steps for n words.
    """
    keep = [f"`{c}`" for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda letters: F.length(F.translate(text, letters, ""))
    cut = docs.select(
        *keep, F.transform(words, lambda w: F.xxhash64(w)).alias("qs_hash"), lines.alias("qs_lines"),
        without(SPACES).cast("long").alias("word_chars"), (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    hashes = F.col("qs_hash")
    window = F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + j) for j in range(1, WINDOW))))
    windows = F.slice(window, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))
    counted = cut.select(
        *keep, "word_chars", "n_symbols", windows.alias("qs_windows"), F.size("qs_hash").cast("long").alias("n_words"),
        F.size("qs_lines").cast("long").alias("n_lines"),
        (F.size("qs_lines") - F.size(F.array_distinct("qs_lines"))).cast("long").alias("n_dup_lines"),
    )
    rest = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    placed = F.sort_array(F.transform("qs_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    ordered = counted.select(*keep, *rest, F.when(_repeats(F.col("qs_windows")), placed).alias("qs_sorted"))
    most = F.size("qs_sorted") - 1
    same = F.zip_with(
        F.slice("qs_sorted", 1, most), F.slice("qs_sorted", F.lit(2), most),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])),
    )
    starts = F.sort_array(F.flatten(F.filter(same, lambda x: x.isNotNull())))
    marked = ordered.select(*keep, *rest, F.when(F.col("qs_sorted").isNotNull(), starts).alias("qs_starts"))
    # A window covers its words up to where the next one starts.
    others = F.size("qs_starts") - 1
    widths = F.zip_with(F.slice("qs_starts", 1, others), F.slice("qs_starts", F.lit(2), others), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(widths, F.lit(WINDOW), lambda total, x: total + x)
    told = marked.select(*keep, *rest, F.when(F.col("qs_starts").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return told.withColumn("base_failed", failed)


# ---------------------------------------------------------------------------
# estimates; expressions as text, one layer of them after the other
# ---------------------------------------------------------------------------

Layer = dict[str, str]


def vector_layer() -> Layer:
    return {name: f"CAST(round({UNIT} * {of}) AS BIGINT)" for name, of in STATISTICS.items()}


def sum_layer() -> Layer:
    """Aggregates of a set of vectors: their number, sums and sums of products."""
    return {"n": "count(*)"} | {f"s{i}": f"CAST(sum(v{i}) AS BIGINT)" for i in range(DIMS)} | {
        f"p{i}{j}": f"CAST(sum(v{i} * v{j}) AS BIGINT)" for i, j in PAIRS
    }


def estimate_layers() -> list[Layer]:
    """From sums to means ``m``, the covariances ``c`` with the floors added, and their Cholesky factor ``l``."""
    means = {f"m{i}": f"CAST(s{i} AS DOUBLE) / n" for i in range(DIMS)}
    covs = {
        f"c{i}{j}": f"CAST(p{i}{j} AS DOUBLE) / n - m{i} * m{j}" + (f" + CAST({(UNIT * FLOORS[i]) ** 2:.1f} AS DOUBLE)" if i == j else "")
        for i, j in PAIRS
    }
    return [means, covs, *factor_layers()]


def factor_layers() -> list[Layer]:
    layers = []
    for j in range(DIMS):
        less = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        layers.append({f"l{j}{j}": f"sqrt(c{j}{j}{less})"})
        if j + 1 < DIMS:
            layers.append({f"l{i}{j}": f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j}" for i in range(j + 1, DIMS)})
    return layers


DETERMINANT = " * ".join(f"l{i}{i}" for i in range(DIMS))


def distance_layers() -> list[Layer]:
    """From a vector ``v`` and an estimate to the squared Mahalanobis distance ``d2``."""
    layers = [{f"y{i}": f"(v{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i}"} for i in range(DIMS)]
    return [*layers, {"d2": " + ".join(f"y{i} * y{i}" for i in range(DIMS))}]


BUCKET = f"CAST(floor({STEPS_PER_LOG} * log2(1 + d2)) AS INT)"
ESTIMATE = [f"m{i}" for i in range(DIMS)] + [f"l{i}{j}" for i, j in PAIRS]


def _layered(df: DataFrame, layers: list[Layer]) -> DataFrame:
    for layer in layers:
        df = df.withColumns({name: F.expr(sql) for name, sql in layer.items()})
    return df


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(sql).alias(name) for name, sql in sum_layer().items()])


def _added(*extra: str) -> list[Column]:
    """Sums of partial sums."""
    return [F.sum(c).alias(c) for c in (*sum_layer(), *extra)]


def _share(sums: DataFrame, key: list[str]) -> DataFrame:
    """Sums over the nearest buckets of each key that together hold ``SHARE`` of its rows; ties stay together."""
    up_to = Window.partitionBy(*key).orderBy("bucket")
    ranked = sums.withColumns({"before": F.sum("n").over(up_to) - F.col("n"), "all": F.sum("n").over(Window.partitionBy(*key))})
    return ranked.where(F.col("before") < F.ceil(F.col("all") * SHARE)).groupBy(*key).agg(*_added())


def _meet(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with the estimates of their group; salted, so that no group goes to one task."""
    spread = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, ["grp", "salt"])


def _median_start(rows: DataFrame) -> DataFrame:
    """Medians, and deviations from them, per group and dimension, from counts of rounded values."""
    at = F.posexplode(F.array(*[F.floor(F.col(v) / 10).cast("long") for v in STATISTICS])).alias("dim", "x")
    held = rows.select("grp", at).groupBy("grp", "dim", "x").agg(F.count("*").alias("n"))

    def median(counts: DataFrame, name: str) -> DataFrame:
        key = ["grp", "dim"]
        seen = F.sum("n").over(Window.partitionBy(*key).orderBy("x"))
        half = (F.sum("n").over(Window.partitionBy(*key)) + 1) / 2
        return counts.withColumns({"seen": seen, "half": half}).where(F.col("seen") >= F.floor("half")).groupBy(*key).agg(F.min("x").alias(name))

    held = cut_lineage(held)
    middle = median(held, "med")
    off = held.join(middle, ["grp", "dim"]).withColumn("x", F.abs(F.col("x") - F.col("med")))
    spread = median(off.groupBy("grp", "dim", "x").agg(F.sum("n").alias("n")), "mad")
    both = middle.join(spread, ["grp", "dim"])
    pick = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c)))
    wide = both.groupBy("grp").agg(*[pick("med", i).alias(f"a{i}") for i in range(DIMS)], *[pick("mad", i).alias(f"b{i}") for i in range(DIMS)])
    means = {f"m{i}": F.col(f"a{i}") * F.lit(10.0) for i in range(DIMS)}
    factor = {
        f"l{i}{j}": F.greatest(F.col(f"b{i}") * F.lit(14.826), F.lit(UNIT * FLOORS[i])) if i == j else F.lit(0.0) for i, j in PAIRS
    }
    return wide.select("grp", F.lit(1).alias("start"), *[c.cast("double").alias(n) for n, c in (means | factor).items()])


def robust_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """``grp``, means ``m`` and Cholesky factor ``l`` of each group's reweighted minimum-covariance-determinant estimate.

    ``rows`` has ``grp``, ``salt`` and the vector ``v0`` and on. The table of estimates has
    one row per group; steps are written to the shared folder.
    """
    every = _layered(_sums(rows, "grp"), estimate_layers()).select("grp", F.lit(0).alias("start"), *ESTIMATE)
    estimates = cut_lineage(every.unionByName(_median_start(rows)))
    for _ in range(steps):
        met = _layered(_meet(rows, estimates), distance_layers()).withColumn("bucket", F.expr(BUCKET))
        nearest = _share(_sums(met, "grp", "start", "bucket"), ["grp", "start"])
        estimates = cut_lineage(_layered(nearest, estimate_layers()).select("grp", "start", *ESTIMATE))
    least = F.struct(F.expr(DETERMINANT).alias("det"), "start", *ESTIMATE)
    chosen = estimates.groupBy("grp").agg(F.min(least).alias("e")).select("grp", *[F.col(f"e.{c}") for c in ESTIMATE])
    limit = chi_square_quantile(1 - LEFT_OUT, DIMS) * _consistency(SHARE)
    inner = _layered(_meet(rows, cut_lineage(chosen)), distance_layers()).where(F.col("d2") <= limit)
    return cut_lineage(_layered(_sums(inner, "grp"), estimate_layers()).select("grp", *ESTIMATE))


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL
) -> DataFrame:
    """``id_col``, the statistics of :func:`text_statistics`, ``distance`` and ``kept``, one row per row of ``docs``.

    ``distance`` is the squared Mahalanobis distance over the consistency factor; rows
    beyond the chi-square quantile of ``1 - tail`` are not kept. Estimates rest on the rows
    that pass the base rules; the others have no distance and are not kept. A language and
    source of fewer than ``LEAST_ROWS`` such rows is judged with the other small sources of
    its language; where these are fewer too, nothing is rejected and there is no distance.
    Null texts count as empty and fail the base rules. Null languages and sources are values
    of their own, a null id stays null, repeated rows count repeatedly and get the same
    verdict, an empty table gives no rows, other columns are not read.
    """
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("qs_id"), F.col(f"`{text_col}`").alias("qs_text"),
        F.coalesce(F.to_json(F.struct(F.col(f"`{lang_col}`").cast("string").alias("l"))), F.lit("")).alias("qs_lang"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("\x00")).alias("qs_source"),
    )
    told = cut_lineage(text_statistics(narrow, "qs_text").drop("qs_text"))
    good = told.where("NOT base_failed")
    sizes = good.groupBy("qs_lang", "qs_source").agg(F.count("*").alias("n"))
    # An own group where there are rows enough, else the pool of the language.
    own = F.when(F.col("n") >= LEAST_ROWS, F.concat(F.lit("own:"), F.to_json(F.struct("qs_lang", "qs_source")))).otherwise(F.concat(F.lit("pool:"), "qs_lang"))
    named = sizes.withColumn("grp", own).withColumn("rows", F.sum("n").over(Window.partitionBy("grp")))
    judged = named.where(F.col("rows") >= LEAST_ROWS).select(F.col("qs_lang").alias("g_lang"), F.col("qs_source").alias("g_source"), "grp")
    judged = cut_lineage(judged).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("qs_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    rows = told.withColumn("r_salt", salt)
    same = (F.col("qs_lang") == F.col("g_lang")) & (F.col("qs_source") == F.col("g_source")) & (F.col("r_salt") == F.col("salt"))
    vectors = rows.join(judged, same & ~F.col("base_failed"), "left").drop("salt", "g_lang", "g_source").withColumnRenamed("r_salt", "salt")
    vectors = cut_lineage(_layered(vectors, [vector_layer()]).drop("qs_lang", "qs_source"))
    fitted = robust_estimates(vectors.where("grp IS NOT NULL").select("grp", "salt", *STATISTICS))
    spread = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    measured = _layered(vectors.join(spread, ["grp", "salt"], "left"), distance_layers())
    distance = F.col("d2") / _consistency(1 - LEFT_OUT)
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (distance <= chi_square_quantile(1 - tail, DIMS)))
    return measured.select(
        F.col("qs_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed",
        distance.alias("distance"), kept.alias("kept"),
    )
