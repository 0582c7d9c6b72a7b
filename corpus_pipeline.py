"""The corpus pipeline: five stages over the documents table, each one of the training-data operators.

``STAGES`` lists (name, function); each function takes (spark, docs, folder of the tables)
and returns the documents that stay. Every stage but the last returns the columns of its
input. ``run`` applies them one after the other and writes each result as Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.decontaminate import decontaminate
from shelfspark.llm.language_id import fit, held_out, identify
from shelfspark.llm.line_dedup import dedup_lines
from shelfspark.llm.mixing import mix
from shelfspark.llm.simhash import near_duplicate_keepers
from shelfspark.session import cut_lineage

#: A prediction below this calibrated probability names no language.
LEAST_SCORE = 0.5
#: Share of a document's words that benchmark items must cover for it to go.
MOST_HIT = 0.0

# SQL can express neither the classifier nor the fingerprints: tests/llm/test_llm_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def _row() -> Column:
    return F.struct("*").alias("row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the model names with ``LEAST_SCORE`` or more.

    Learns from the documents that are not held out. Texts that are null or without a
    letter go; where nothing can be learnt (no labels) only those go.
    """
    learn = docs.where(~held_out("doc_id")).select(F.col("doc_id").alias("key"), "text", "lang")
    model = fit(learn)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = identify(docs.select(_row(), "text"), model)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template or text recurs; ``n_chars`` follows the text."""
    kept = dedup_lines(docs.select(_row(), "doc_id", "text"), copies=True)
    text = F.col("text")
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        same = F.col("row.text").eqNullSafe(text)
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(same, F.col("row.n_chars")).otherwise(F.length(text)).cast(kind))
    return kept.select(row.alias("row")).select("row.*")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    kept = near_duplicate_keepers(docs).select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
    rows = docs.select(_row(), "doc_id", _text_hash().alias("text_hash"))
    same = rows["doc_id"].eqNullSafe(kept["k_id"]) & (rows["text_hash"] == kept["k_hash"])
    return rows.join(kept, same, "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words no more than ``MOST_HIT`` lie in passages of benchmark items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(_row(), "doc_id", "text", _text_hash().alias("text_hash"))
    found = decontaminate(rows.select("doc_id", "text"), benchmark, keep_hash=True)
    bad = found.where(F.col("n_hit") > F.col("n_words") * MOST_HIT).select(
        F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash")
    )
    same = rows["doc_id"].eqNullSafe(bad["b_id"]) & (rows["text_hash"] == bad["b_hash"])
    return rows.join(bad, same, "left_anti").select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens follow the target mix, with its weight and probability."""
    mixed = mix(docs.select(_row(), "doc_id", "text", "source", "lang")).where("mix_kept")
    added = [c for c in ("mix_topic", "mix_tokens", "mix_weight", "mix_p") if c not in docs.columns]
    return mixed.select("row.*", *added)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages leave; each stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
