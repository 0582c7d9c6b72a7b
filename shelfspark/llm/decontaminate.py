"""Benchmark decontamination by winnowing.

Words of both sides are hashed and k-grams of word hashes are hashed again; of every window
of consecutive k-grams of an item the least hash is kept. Any ``window`` consecutive words
that a document shares with an item hold one whole window of k-grams, so one of the
document's k-grams there is kept. A table of bits tells most other k-grams apart, the rest
is joined, and each hit is extended word by word; it counts where the shared span is
``window`` words long or the whole item.

Everything is DataFrame expressions. Word positions count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

WINDOW = 10
GRAM = 5
# What separates words, after A-Z are lower-cased, and a word of a text as it is.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits (as a power of two) of the table that tells which hashes cannot be an item's fingerprint.
TABLE = 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text; A-Z are lower-cased, other letters stay as they are."""
    folded = F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    words = F.filter(F.split(folded, NO_WORD, -1), lambda w: w != "")
    return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def _grams(words: Column, gram: int) -> Column:
    """Hash of the ``gram`` words from each position on; shorter tails give none."""
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, gram))))
    return F.slice(hashed, 1, F.greatest(F.size(words) - (gram - 1), F.lit(0)))


def _lows(grams: Column, span: int) -> Column:
    """The least hash of each window of ``span`` consecutive k-grams."""
    least = F.transform(grams, lambda g, i: F.least(g, *(F.get(grams, i + j) for j in range(1, span))))
    return F.slice(least, 1, F.greatest(F.size(grams) - (span - 1), F.lit(0)))


def _exploded(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``rows`` (with ``words``, ``grams`` and the k-grams ``kept``, as ``at, print``) exploded to a row per kept k-gram.

    ``at`` is the k-gram's word position, ``print`` its hash. ``near`` holds the words from
    ``window - gram`` before it to as many behind it, null beyond the text's ends.
    """
    side = window - gram
    keep = [c for c in rows.columns if c not in ("words", "grams", "lows", "kept")]
    marked = rows.withColumn(
        "kept",
        F.transform(
            "kept",
            lambda s: F.struct(
                s["at"].alias("at"), s["print"].alias("print"),
                F.slice(F.col("words"), F.greatest(s["at"] - side, F.lit(0)) + 1, F.lit(window + side)).alias("near"),
                F.least(s["at"], F.lit(side)).alias("before"), F.size("words").alias("n"),
            ),
        ),
    )
    # An inner explode would let a filter on its array sink below, with all its expressions.
    return marked.select(*keep, F.explode_outer("kept").alias("k")).where("k IS NOT NULL").select(*keep, "k.*")


def fingerprints(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``rows`` (with ``words``) exploded to a row per k-gram that is the least of a window (see ``_exploded``)."""
    span = window - gram + 1
    low = rows.withColumn("grams", _grams(F.col("words"), gram)).withColumn("lows", _lows(F.col("grams"), span))
    lows = F.col("lows")
    # A k-gram is kept if it is the least of a window; windows that hold it start up to span - 1 before.
    kept = F.filter(
        F.transform(
            "grams",
            lambda g, i: F.struct(
                i.alias("at"), g.alias("print"),
                (g == F.greatest(*(F.when(i >= j, F.get(lows, i - j)) for j in range(span)))).alias("kept"),
            ),
        ),
        lambda s: s["kept"],
    )
    return _exploded(low.withColumn("kept", kept), window, gram)


def _table(prints: DataFrame, power: int) -> Column:
    """An array of 2^``power`` bits, in longs: a bit is 1 if it has the number of the last bits of any print."""
    word = F.shiftright(F.col("print").bitwiseAND((1 << power) - 1), 6)
    ones = prints.select(word.alias("at"), F.expr("shiftleft(1L, cast(print & 63 AS int))").alias("ones"))
    held = ones.groupBy("at").agg(F.bit_or("ones").alias("ones"))
    numbered = prints.sparkSession.range(1 << (power - 6)).withColumnRenamed("id", "at").join(held, "at", "left")
    longs = F.array_sort(F.collect_list(F.struct("at", F.coalesce("ones", F.lit(0).cast("bigint")).alias("ones"))))
    return numbered.agg(longs.alias("longs")).select(F.col("longs.ones")).scalar()


def looked_up(rows: DataFrame, prints: DataFrame, window: int, gram: int, power: int = TABLE) -> DataFrame:
    """``rows`` (with ``words``) exploded to a row per k-gram that may be among ``prints`` (see ``_exploded``).

    A table of bits of fixed size leaves out nearly all others; the join decides. With more
    prints than bits it leaves out less, never a k-gram that is among them.
    """

    def may_be(g: Column) -> Column:
        longs = F.get("table", F.shiftright(g.bitwiseAND((1 << power) - 1), 6).cast("int"))
        return F.call_function("getbit", longs, g.bitwiseAND(63).cast("int")) == 1

    kept = F.array_compact(F.transform("grams", lambda g, i: F.when(may_be(g), F.struct(i.alias("at"), g.alias("print")))))
    marked = rows.withColumn("grams", _grams(F.col("words"), gram)).withColumn("table", _table(prints, power)).withColumn("kept", kept)
    return _exploded(marked.drop("table"), window, gram)


def _short_hits(texts: DataFrame, shorts: DataFrame) -> DataFrame:
    """Hits of items below ``window`` words: a join on the hash of all their words.

    Only lengths that occur among the items are looked at; without short items no text is
    cut into words here.
    """
    lengths = shorts.agg(F.sort_array(F.collect_set("n"))).scalar()  # at most window - 1 numbers
    of_length = (
        texts.withColumn("lengths", lengths)
        .where(F.size("lengths") > 0)
        .select("doc_id", "text_hash", "lengths", word_hashes(F.col("text")).alias("words"))
        .select(
            "doc_id", "text_hash",
            F.explode_outer(
                F.flatten(
                    F.transform(
                        "lengths",
                        lambda n: F.transform(
                            "words",
                            lambda w, i: F.struct(
                                n.alias("n"), i.alias("at"),
                                F.when(i + n <= F.size("words"), F.xxhash64(F.slice(F.col("words"), i + 1, n))).alias("print"),
                            ),
                        ),
                    )
                )
            ).alias("g"),
        )
        .select("doc_id", "text_hash", "g.*")
        .where("print IS NOT NULL")
    )
    items = shorts.select("item_id", "n", F.xxhash64("words").alias("print"))
    return of_length.join(items, ["n", "print"]).select(
        "doc_id", "text_hash", "item_id", F.col("at").alias("low"), (F.col("at") + F.col("n")).alias("high")
    )


def benchmark_hits(texts: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, text_hash, item_id, low, high``: word spans that a document shares with an item.

    ``texts`` has ``doc_id, text_hash, text``, ``items`` has ``item_id, words``.
    """
    side = window - gram
    sized = items.withColumn("n", F.size("words"))
    long_items = fingerprints(sized.where(F.col("n") >= window).select("item_id", "words"), window, gram)
    # The same words around the same fingerprint tell an item once.
    there = long_items.select("item_id", "print", F.col("near").alias("i_near"), F.col("before").alias("i_before")).distinct()
    words = texts.select("doc_id", "text_hash", word_hashes(F.col("text")).alias("words"))
    # All k-grams of a text meet the items' kept ones: any shared window holds one of these, so texts need not be winnowed.
    here = looked_up(words, there.select("print"), window, gram)
    met = here.join(there, "print")

    def along(sign: int, offset: int) -> Column:
        """Words that agree from the k-gram on, to the left (-1) or the right (1)."""
        agree = F.lit(side)
        for j in reversed(range(side)):
            step = -1 - j if sign < 0 else offset + j
            mine, theirs = F.col("before") + step, F.col("i_before") + step
            a = F.when(mine >= 0, F.get("near", mine))
            b = F.when(theirs >= 0, F.get("i_near", theirs))
            agree = F.when(a == b, agree).otherwise(F.lit(j))
        return agree

    # Equal words of the k-gram are counted: as plain equalities they would become join keys.
    same = sum(
        F.when(F.get("near", F.col("before") + j) == F.get("i_near", F.col("i_before") + j), 1).otherwise(0) for j in range(gram)
    )
    hits = (
        met.where(same == gram)
        .withColumn("left", along(-1, 0))
        .withColumn("right", along(1, gram))
        .where(F.col("left") + F.col("right") + gram >= window)
        .select(
            "doc_id", "text_hash", "item_id",
            (F.col("at") - F.col("left")).alias("low"), (F.col("at") + gram + F.col("right")).alias("high"),
        )
    )
    shorts = sized.where((F.col("n") < window) & (F.col("n") > 0)).select("item_id", "n", "words")
    return hits.unionByName(_short_hits(texts, shorts))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    keep_hash: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``benchmark`` has ``item_id, text``. A word is hit if it lies in ``window`` consecutive
    words of an item (in the whole item, where that is shorter). ``spans`` are the maximal
    runs of hit words, as ``low, high`` word positions, end exclusive. Null texts and texts
    without words have no words and no hits; items without words match nothing; repeated
    rows on either side give repeated or equal results; a null item_id takes part in hits
    but is no name in ``items_sha256``. Empty tables give no rows or no hits. With
    ``keep_hash`` a column ``text_hash`` (xxhash64 of the text's bytes) tells rows of one id
    apart.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    read = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit("")).cast("binary")).alias("text_hash")
    )
    items = cut_lineage(benchmark.select("item_id", word_hashes(F.col("text")).alias("words")))
    hits = benchmark_hits(read, items, window, gram).distinct()
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("low", "high"))).alias("pieces"),
        F.count_distinct("item_id").alias("n_items"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("names"),
    )
    spans = F.aggregate(
        "pieces",
        F.array().cast("array<struct<low:int,high:int>>"),
        lambda runs, p: F.when(
            (F.size(runs) > 0) & (F.element_at(runs, -1)["high"] >= p["low"]),
            F.concat(
                F.slice(runs, 1, F.size(runs) - 1),
                F.array(F.struct(F.element_at(runs, -1)["low"].alias("low"), F.greatest(F.element_at(runs, -1)["high"], p["high"]).alias("high"))),
            ),
        ).otherwise(F.concat(runs, F.array(p))),
    )
    hit = found.select(
        F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), spans.alias("spans"), "n_items", "names"
    )
    counted = read.select("doc_id", "text_hash", word_count(F.col("text")).alias("n_words"))
    joined = counted.join(hit, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    n_hit = F.aggregate(F.coalesce("spans", F.array()), F.lit(0).cast("long"), lambda n, s: n + (s["high"] - s["low"]))
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<low:int,high:int>>"))).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("names", F.array().cast("array<string>")), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), "spans", *(["text_hash"] if keep_hash else []),
    )
