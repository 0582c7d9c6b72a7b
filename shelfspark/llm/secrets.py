"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for credentials of three base kinds and for further token-like
candidates. Hashes of the candidate values are then counted by distinct repositories and
owners over the whole corpus: a value that many owners hold is a copied example, one that
a single owner holds and that looks live is a credential of that owner. Token-like
candidates of the second sort are added to the base findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

# The base kinds, in their order, with the least length of what they hold.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "owned"]
# What may be a token without a tell-tale name: long, with letters and digits.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
EXAMPLE_OWNERS = 3

SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, hint: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as ``SPAN``, positions in code points.

    The pieces between the matches give the positions. ``hint`` is a cheap pattern that
    every text with a match has.
    """
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["found"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"), x["value"].alias("value"))
        keep = F.length(x["value"]) >= least
        return F.struct(stop.alias("at"), F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast(f"array<{SPAN}>")
    walked = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(text.rlike(hint), walked).otherwise(none)


def find_candidates(text: Column) -> dict[str, Column]:
    """The span lists of every kind; those of ``owned`` are only candidates yet."""
    owned = _spans(text, "owned", TOKEN, 0, 20, TOKEN)
    return {
        "assign": _spans(text, "assign", ASSIGN, 1, LEAST["assign"], r"(?i)(?:passw|secret|token|api_?key)"),
        "access": _spans(text, "access", ACCESS, 0, LEAST["access"], "AKIA[A-Z0-9]"),
        "hex": _spans(text, "hex", HEX, 0, LEAST["hex"], HEX),
        "owned": F.filter(owned, lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")),
    }


def _told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``value_hash, n_docs, n_repos, n_owners, standing`` of every candidate value.

    ``found`` has ``owner, repo, value_hash``, a row per candidate. ``standing`` is
    ``example`` for values of ``example_owners`` owners or more, ``live`` for those of one
    owner, else ``shared``. Rows are combined per value, repository and owner before they
    meet, so a value that is everywhere costs no more than its repositories.
    """
    by_repo = found.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n"))
    counted = by_owner.groupBy("value_hash").agg(
        F.sum("n").alias("n_found"), F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners")
    )
    return counted.withColumn(
        "standing",
        F.when(F.col("n_owners") >= example_owners, "example").when(F.col("n_owners") == 1, "live").otherwise("shared"),
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example``.

    ``spans`` lists kind:start:end of the base findings and of the added ones (kind
    ``owned``), by start, then kind. A token-like candidate is added if one owner alone
    holds its value and no base finding overlaps it. ``n_live`` and ``n_example`` count the
    base findings whose value is held by one owner, or by ``example_owners`` and more.
    Owner and repository are named by columns; rows where they are null belong to one
    owner without a name. A null text is empty and has no findings; repeated rows give
    repeated results (they count once per repository); an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), owner.alias("owner"), repo.alias("repo"),
        *(spans.alias(kind) for kind, spans in find_candidates(text).items()),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    # A candidate that overlaps a base finding is that finding.
    free = F.filter("owned", lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    rows = cut_lineage(
        rows.withColumn("base", base).withColumn("owned", free).select(
            "doc_id", "text_hash", "owner", "repo", "base", "owned",
            *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]),
        )
    )
    found = rows.select(
        "doc_id", "text_hash", "owner", "repo", F.explode(F.concat("base", "owned")).alias("span")
    ).select("*", F.sha2(F.col("span.value"), 256).alias("value_hash"))
    standing = ownership(found.select("owner", "repo", "value_hash"), example_owners).select("value_hash", "standing")
    judged = (
        found.select("doc_id", "text_hash", "value_hash", F.col("span").dropFields("value").alias("span"))
        .distinct()
        .join(standing, "value_hash")
        .groupBy("doc_id", "text_hash")
        .agg(
            F.collect_set(F.when((F.col("span.kind") == 3) & (F.col("standing") == "live"), F.col("span"))).alias("added"),
            F.count_if((F.col("span.kind") < 3) & (F.col("standing") == "live")).alias("n_live"),
            F.count_if((F.col("span.kind") < 3) & (F.col("standing") == "example")).alias("n_example"),
        )
        .select(F.col("doc_id").alias("j_id"), F.col("text_hash").alias("j_hash"), "added", "n_live", "n_example")
    )
    plain = F.transform("base", lambda s: s.dropFields("value"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    return (
        rows.join(judged, F.col("doc_id").eqNullSafe(F.col("j_id")) & (F.col("text_hash") == F.col("j_hash")), "left")
        .withColumn("added", F.coalesce("added", none))
        .select(
            "doc_id", "n_assign", "n_access", "n_hex",
            F.sha2(_told(plain), 256).alias("base_sha256"),
            _told(F.array_sort(F.concat(plain, "added"))).alias("spans"),
            F.size("added").cast("long").alias("n_owned"),
            F.coalesce("n_live", F.lit(0)).alias("n_live"),
            F.coalesce("n_example", F.lit(0)).alias("n_example"),
        )
    )
