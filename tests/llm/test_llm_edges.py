"""Nulls, empty tables, repeated rows and clashing columns of every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm.decontaminate import decontaminate
from shelfspark.llm.language_id import language_ids
from shelfspark.llm.line_dedup import dedup_lines
from shelfspark.llm.mixing import mix
from shelfspark.llm.projected_search import nearest
from shelfspark.llm.repeated_spans import repeated_spans
from shelfspark.llm.secrets import scan_secrets
from shelfspark.llm.simhash import near_duplicate_keepers, simhash_components
from shelfspark.llm.token_counts import token_counts
from shelfspark.llm.warc import archive_pages

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
SAME = "one two three four five six seven eight nine ten eleven twelve thirteen"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, component_id long, doc string, row string, p double"
ROWS = [
    (1, SAME, "en", "a"), (1, SAME, "en", "a"), (2, SAME, "en", "b"), (3, None, "en", "a"), (4, "", None, None),
    (5, "  \n\n ", "de", "b"), (None, SAME, "en", "a"), (None, None, None, None), (6, LONG, "en", "a"), (7, "123 !!", "de", "a"),
    (8, "é", "fr", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, s, len(t or ""), 5, 0.5, 9, "d", "r", 1.0) for i, t, g, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, SAME), (2, "é"), (3, None), (4, "!!"), (None, "123")], "item_id long, text string")


def operators(benchmark):
    return {
        "line_dedup": lambda d: dedup_lines(d, min_docs=2),
        "secrets": scan_secrets,
        "decontaminate": lambda d: decontaminate(d, benchmark),
        "repeated_spans": repeated_spans,
        "language": language_ids,
        "simhash": simhash_components,
        "tokens": lambda d: token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
        "mix": mix,
    }


NAMES = ["line_dedup", "secrets", "decontaminate", "repeated_spans", "language", "simhash", "tokens", "mix"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(name, docs, benchmark):
    got = operators(benchmark)[name](docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    one = [r for r in got if r.doc_id == 1]
    assert one[0] == one[1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, docs, benchmark):
    assert operators(benchmark)[name](docs.limit(0)).collect() == []


def test_values_of_edge_rows(docs, benchmark):
    hits = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.contaminated) for r in decontaminate(docs, benchmark).collect()}
    assert hits[1, 13] == (13, 1, True) and hits[3, 0] == (0, 0, False)
    assert hits[8, 1] == (1, 1, True) and hits[7, 1] == (1, 0, True)  # an item without an id has no name
    spans = {r.doc_id: (r.n_removed, r.n_spans) for r in repeated_spans(docs).where("doc_id IS NOT NULL").collect()}
    assert spans[1] == (0, 0) and spans[2] == (len(SAME), 1) and spans[3] == (0, 0)
    parts = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(docs).collect() if r.doc_id is not None}
    assert parts[3] == parts[4] == parts[5] == ("0" * 16, 3) and parts[2][1] == 1
    langs = {r.doc_id: (r.lang_pred, r.score) for r in language_ids(docs).collect() if r.doc_id is not None}
    assert langs[3] == langs[4] == langs[5] == langs[7] == ("und", 0.0)
    kept = {r.doc_id: r for r in dedup_lines(docs, min_docs=2).collect() if r.doc_id is not None}
    assert kept[1].text == SAME and kept[2].text == "" and kept[3].text is None and kept[5].text == "  \n\n "
    assert near_duplicate_keepers(docs).where("doc_id = 1").count() == 1


def test_line_templates(spark):
    rows = [(i, f"user number {i} logged in from here\nprose line {'abcdefghij'[i]} alone") for i in range(6)]
    rows.append((9, "a line of its own that nobody else has"))
    got = {r.doc_id: (r.text, r.n_dropped) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (rows[0][1], 0) and got[9] == (rows[6][1], 0)
    assert all(got[i] == (rows[i][1].split("\n")[1], 1) for i in range(1, 6))


def test_secret_ownership(spark):
    copied, own = "password = hunter2hunter2", "Zx9" + "aB3" * 8
    rows = [(i, copied, f"s{i}", "en") for i in range(4)] + [(7, f"see {own} there", "s1", "en"), (8, "token: é", "s1", "en")]
    got = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got[0].spans == f"assign:0:{len(copied)}" and (got[0].n_live, got[0].n_example) == (0, 1)
    assert got[7].spans == f"owned:4:{4 + len(own)}" and got[7].n_owned == 1 and got[8].n_assign == 0


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.5, None]), (7, [2.0, 1.0]), (20, [0.0, 3.0]), (20, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in nearest(df, df.where("vec_id % 20 = 0"), k=2).collect())
    assert got == [(0, 1, 7, 2.0), (0, 2, 1, 1.0), (20, 1, 7, 3.0), (20, 2, 0, 0.0)]
    assert nearest(df.limit(0), df).collect() == []


def test_archives_of_no_pages(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows(stage, spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stage(spark, docs, str(tmp_path))
    assert got.columns[: len(docs.columns)] == docs.columns
    assert got.count() <= len(ROWS)
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_stage_decisions(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.near_duplicates(spark, docs, "")) == ["1", "1", "3", "6", "7", "8"]
    assert ids(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == ["3", "4", "5", "6", "None"]
    assert "4" not in ids(corpus_pipeline.language_id(spark, docs, "")) and "1" in ids(corpus_pipeline.language_id(spark, docs, ""))
