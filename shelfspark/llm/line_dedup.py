"""Line dedup by a log-template tree.

A line's tokens with digits are variable fields. The tree has a fixed depth: its first
level is the number of tokens, the next ones are the leading tokens. Within a leaf a
token that is rare at its position is a variable field too; what remains is the line's
template. Templates that recur across documents keep their first line only. Lines that are
equal as text can recur by themselves, whatever their tokens.

The tree is never held anywhere: a leaf is a key, and everything is grouping and joins
of narrow rows. Texts are read to make the keys, to fetch one line per variant of a leaf
and to write the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

DEPTH = 3
MIN_DOCS = 3
MIN_TOKENS = 4
MIN_FIXED = 0.6
BLANKS = r"[\x20\x09\x0B-\x0D]+"
FIELD = "<*>"
#: Copies of a line of so many tokens or characters recur from two documents on.
LONG_TOKENS = 50
LONG_CHARS = 200


def masked_tokens(line: Column) -> Column:
    """The tokens of a line; those with a digit are variable fields."""
    tokens = F.filter(F.split(line, BLANKS, -1), lambda t: t != "")
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))


def leaf_of(tokens: Column, depth: int) -> Column:
    return F.xxhash64(F.size(tokens), *(F.get(tokens, i) for i in range(depth)))


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """``doc, doc_id, pos, leaf, skel, fixed, n``: a narrow row per line that may be dropped."""
    keyed = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct(i.alias("pos"), masked_tokens(line).alias("tokens")),
    )
    facts = F.transform(
        F.filter(keyed, lambda x: F.size(x["tokens"]) >= min_tokens),
        lambda x: F.struct(
            x["pos"].alias("pos"),
            leaf_of(x["tokens"], depth).alias("leaf"),
            F.xxhash64(x["tokens"]).alias("skel"),
            F.size(F.filter(x["tokens"], lambda t: t != FIELD)).alias("fixed"),
            F.size(x["tokens"]).alias("n"),
        ),
    )
    return docs.select("doc", "doc_id", F.explode_outer(facts).alias("l")).where("l IS NOT NULL").select("doc", "doc_id", "l.*")


def _variants(docs: DataFrame, skels: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """``skel, template, fixed`` of the lines in leaves with more than one variant.

    ``skels`` has ``leaf, skel, docs, doc, pos``: for each variant how many documents hold
    it and one line that shows it.
    """
    wanted = skels.groupBy("doc").agg(F.collect_list(F.struct("pos", "leaf", "skel", "docs")).alias("wanted"))
    lines = docs.select("doc", "text").distinct().join(wanted, "doc").select(
        F.split("text", "\n", -1).alias("lines"), "wanted"
    )
    tokens = (
        lines.select(F.explode_outer(F.transform(
            "wanted", lambda w: F.struct(w["leaf"], w["skel"], w["docs"], F.get("lines", w["pos"]).alias("line"))
        )).alias("w"))
        .where("w IS NOT NULL").select("w.*")
        .select("leaf", "skel", "docs", F.posexplode_outer(masked_tokens(F.col("line"))).alias("at", "token"))
        .where("at IS NOT NULL")
    )
    tokens = cut_lineage(tokens)
    support = (
        tokens.where(F.col("at") >= depth).groupBy("leaf", "at", "token").agg(F.sum("docs").alias("support"))
        .where(F.col("support") >= min_docs)
    )
    kept = tokens.join(support, ["leaf", "at", "token"], "left").select(
        "leaf", "skel", "at",
        F.when((F.col("at") < depth) | F.col("support").isNotNull(), F.col("token")).otherwise(FIELD).alias("token"),
    )
    return kept.groupBy("leaf", "skel").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("tokens")).select(
        "leaf", "skel", F.xxhash64("tokens.token").alias("template"),
        F.size(F.filter("tokens", lambda t: t["token"] != FIELD)).alias("t_fixed"),
    )


def repeated_lines(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, min_fixed: float = MIN_FIXED
) -> DataFrame:
    """``doc, pos`` of the lines to drop; ``docs`` has ``doc, doc_id, text``."""
    lines = cut_lineage(_lines(docs, depth, min_tokens))
    per_doc = lines.groupBy("leaf", "skel", "doc").agg(F.min("pos").alias("pos"))
    skels = per_doc.groupBy("leaf", "skel").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "pos")).alias("shown"))
    skels = cut_lineage(skels)
    # In a leaf of fewer documents no template can recur.
    leaves = skels.groupBy("leaf").agg(F.sum("docs").alias("held"), F.count("*").alias("kinds")).where(F.col("held") >= min_docs)
    open_ = skels.join(leaves.where("kinds > 1").select("leaf"), "leaf", "left_semi").select("leaf", "skel", "docs", "shown.*")
    variants = _variants(docs, open_, depth, min_docs)
    live = skels.join(leaves.select("leaf"), "leaf", "left_semi").select("leaf", "skel")
    named = cut_lineage(
        lines.join(live.join(variants, ["leaf", "skel"], "left"), ["leaf", "skel"])
        .withColumn("template", F.coalesce("template", F.xxhash64(F.array("skel"))))
        .where(F.coalesce("t_fixed", "fixed") >= F.ceil(F.col("n") * min_fixed))
        .select("leaf", "template", "doc", "doc_id", "pos")
    )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "doc", "pos")
    held = named.groupBy("leaf", "template", "doc").agg(F.min(order).alias("first"))
    recur = held.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= min_docs)
    return (
        named.join(recur.select("leaf", "template", "first.doc", "first.pos").toDF("leaf", "template", "f_doc", "f_pos"), ["leaf", "template"])
        .where("NOT (doc = f_doc AND pos = f_pos)")
        .select("doc", "pos").distinct()
    )


def copied_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, pos`` of all but the first of the lines that are equal as text and recur; blank lines never do."""

    def fact(line: Column, i: Column) -> Column:
        size = F.size(F.filter(F.split(line, BLANKS, -1), lambda t: t != ""))
        return F.struct(
            i.alias("pos"), F.xxhash64(line).alias("line"), (size > 0).alias("full"),
            ((size >= LONG_TOKENS) | (F.length(line) >= LONG_CHARS)).alias("long"),
        )

    facts = F.filter(F.transform(F.split("text", "\n", -1), fact), lambda x: x["full"])
    lines = cut_lineage(
        docs.select("doc", "doc_id", F.explode_outer(facts).alias("l")).where("l IS NOT NULL")
        .select("doc", "doc_id", "l.pos", "l.line", "l.long")
    )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "doc", "pos")
    held = lines.groupBy("line", "doc").agg(F.min(order).alias("first"), F.max("long").alias("long"))
    needed = F.when(F.max("long"), min(2, min_docs)).otherwise(min_docs)
    recur = held.groupBy("line").agg(F.count("*").alias("docs"), F.min("first").alias("first"), needed.alias("needed"))
    firsts = recur.where("docs >= needed").select("line", "first.doc", "first.pos").toDF("line", "f_doc", "f_pos")
    return lines.join(firsts, "line").where("NOT (doc = f_doc AND pos = f_pos)").select("doc", "pos")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    min_fixed: float = MIN_FIXED,
    copies: bool = False,
) -> DataFrame:
    """All columns of ``docs``, with the kept lines as text, and ``n_lines, n_dropped`` behind them.

    A template recurs if ``min_docs`` documents hold it and at least ``min_fixed`` of its
    tokens are no variable fields; all its lines but the first (by document id, then
    position) are dropped. Lines of fewer than ``min_tokens`` tokens stay as templates.
    With ``copies``, lines that are equal as text recur by themselves, whatever their tokens:
    if ``min_docs`` documents hold them, or two for long ones; blank lines stay. A null
    text stays null and has no lines; an empty one has one line, which stays. Rows with
    the same id and text are one document. Null ids come last. Columns of ``docs`` named
    like the two counts are replaced; other columns pass through. An empty table gives no
    rows.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    doc_key = F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = docs.select(doc_key.alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    drops = repeated_lines(keyed, depth, min_docs, min_tokens, min_fixed)
    if copies:
        drops = drops.unionAll(copied_lines(keyed, min_docs)).distinct()
    by_doc = drops.groupBy("doc").agg(F.collect_list("pos").alias("drop"))
    whole = docs.select(F.struct(*rest).alias("row"), F.col(text_col).alias("text"), doc_key.alias("doc"))
    joined = whole.join(by_doc, "doc", "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("drop", i)), "\n")
    )
    return joined.select(
        *(kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in rest),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
